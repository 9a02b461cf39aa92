"""Context-tree weighting of bytes, learned and scored in parallel.

A text is its words in lower case, joined by spaces and ended by a line feed. A byte is eight
binary decisions; each decision has a context tree over the bytes before it, with a
Krichevsky-Trofimov estimate at every depth. A node's weighted probability is half its own
estimate and half the product of its children's, so after training the tree mixes all depths:
a decision's probability is, from the deepest context seen upwards, the mean of the node's
estimate and of what came from below, weighted by how well each explained the training bytes.

The probability of a byte depends on it and the ``depth`` bytes before: a gram. So a block of
documents needs its distinct grams only, each with a probability, and those of all blocks meet
once: grams are dealt by the three bytes nearest to the predicted one, which keeps whole
subtrees together. A part first adds up the counts of equal grams of all blocks, then builds the trees of
a few contexts at a time; the contexts of up to two bytes, at most 65,536 times 255 decisions
whatever the input, are summed over the parts. Words and their counts, for the word-frequency score,
take the same way.

Blocks and parts travel packed: the sorted grams of one block for one part are one row. Texts and packed
rows are read as streams in the order of their block, so a worker holds the distinct grams of one
block, or of one part, and a few megabytes of text. Their number grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import Store, texts

#: Context bytes. Grams fit a signed long up to six.
DEPTH = 5
#: Depth from which contexts stay together in one part.
DEALT = 3
#: Bytes of text in a block, and grams of which trees are built at a time, about.
BLOCK_BYTES, TREE_GRAMS = 16 << 20, 50_000
#: Positions that are scored at a time.
STEP = 1 << 18
MEMO = 1 << 16
#: Bits of a logarithm that travel: sign, exponent and 36 of the mantissa, two parts in 10^11.
KEPT_BITS = -1 << 16
END = b"\n"
WORDS, GRAMS = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series, eight places further on."""
    y = x + 8.0
    product = np.ones_like(y)
    for i in range(8):
        product *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return (
        log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)
    )


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that the zeros of small ones are runs."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


@dataclass(frozen=True)
class Level:
    """All decisions of one depth, sorted by ``context << 8 | decision``."""

    keys: np.ndarray
    n: np.ndarray
    ones: np.ndarray
    own: np.ndarray  # weight of the node's estimate against what comes from below
    weighted: np.ndarray  # logarithm of the weighted probability

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys one depth up, with the sums of ``n``, ``ones`` and ``weighted`` over the children."""
        keys, at = np.unique(((self.keys >> 16) << 8) | (self.keys & 255), return_inverse=True)
        return keys, *(np.bincount(at, x, len(keys)) for x in (self.n, self.ones, self.weighted))


def inner(keys: np.ndarray, n: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Level:
    """A level with children, whose weighted logarithms sum to ``below``."""
    mine = estimate(n - ones, ones)
    return Level(
        keys, n, ones, 1 / (1 + np.exp(np.clip(below - mine, -700, 700))), np.logaddexp(mine, below) - math.log(2)
    )


def deepest(grams: np.ndarray, counts: np.ndarray) -> Level:
    """The leaves: sorted distinct grams become eight decisions each."""
    keys, ones = [], []
    for bit in range(8):
        byte = grams & 255
        keys.append(((grams >> 8) << 8) | (1 << bit) | (byte >> (8 - bit)))
        ones.append(counts * ((byte >> (7 - bit)) & 1))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.tile(counts, 8), len(found))
    n_ones = np.bincount(at, np.concatenate(ones), len(found))
    mine = estimate(n - n_ones, n_ones)
    return Level(found, n, n_ones, np.ones(len(found)), mine)


def tree(grams: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels from ``depth`` up to ``DEALT``."""
    levels = [deepest(grams, counts.astype(float))]
    while len(levels) <= depth - DEALT:
        levels.append(inner(*levels[-1].parents()))
    return levels


def crown(keys: np.ndarray, n: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels from ``DEALT - 1`` up to no context at all, of the sums over all parts."""
    levels = [inner(keys, n, ones, below)]
    while len(levels) < DEALT:
        levels.append(inner(*levels[-1].parents()))
    return levels


def log_probability(levels: list[Level], grams: np.ndarray, depth: int) -> np.ndarray:
    """Natural logarithm of each gram's last byte given those before.

    ``levels`` go from ``depth`` to 0. A context never seen in training adds nothing: the
    deepest one that was seen starts the mixture, and without any a decision is even.
    """
    total = np.zeros(len(grams))
    byte = grams & 255
    for bit in range(8):
        decision = (1 << bit) | (byte >> (8 - bit))
        one = ((byte >> (7 - bit)) & 1).astype(bool)
        p, seen = np.full(len(grams), 0.5), np.zeros(len(grams), dtype=bool)
        for up, level in enumerate(levels):
            if not len(level.keys):
                continue
            key = ((grams >> (8 * (up + 1))) << 8) | decision
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            here = level.keys[at] == key
            n, ones = level.n[at], level.ones[at]
            mine = (np.where(one, ones, n - ones) + 0.5) / (n + 1)
            weight = np.where(seen, level.own[at], 1.0)
            p = np.where(here, weight * mine + (1 - weight) * p, p)
            seen |= here
        total += np.log(p)
    return total


def normal(text: str) -> list[bytes]:
    """The words of a text: A-Z in lower case, split at ASCII white space."""
    return text.encode().lower().split()


def grams_of(documents: list[list[bytes]], depth: int) -> np.ndarray:
    """One gram per byte of the documents, whose contexts start as line feeds.

    The predicted byte is the lowest; the one before it the highest, then downwards.
    """
    pad = END * depth
    joined = [b" ".join(words) + END for words in documents]
    data = np.frombuffer(pad + pad.join(joined), dtype=np.uint8).astype(np.int64)
    out = data.copy()
    for back in range(1, depth + 1):
        out[back:] |= data[:-back] << (8 * (depth + 1 - back))
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    ends = np.cumsum([depth + len(j) for j in joined])
    np.add.at(inside, ends - [len(j) for j in joined], 1)
    np.add.at(inside, ends, -1)
    return out[np.cumsum(inside[:-1]) > 0]


def _steps(texts: pd.Series) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Ranges of texts of about ``STEP`` characters, with their words."""
    start, held = 0, 0
    for at, size in enumerate(texts.str.len()):
        if held and held + size > STEP:
            yield start, at, [normal(t) for t in texts.iloc[start:at]]
            start, held = at, 0
        held += size
    if start < len(texts):
        yield start, len(texts), [normal(t) for t in texts.iloc[start:]]


class _Hashes(dict):
    """A bounded memo of words' 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        found -= (found >> 63) << 64
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


#: The end of a text as a token; no word contains a line feed.
END_TOKEN = _Hashes()[END]


def token_hashes(documents: list[list[bytes]], memo: _Hashes) -> np.ndarray:
    """One hash per token, an end after the words of each document."""
    return np.array([h for words in documents for h in (*map(memo.__getitem__, words), END_TOKEN)], dtype=np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Pile:
    """Distinct keys with counts. What comes is added when it is as much as what is there."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        if sum(len(k) for k, _ in self.parts[1:]) >= len(self.parts[0][0]):
            self.parts = [_merged(self.parts)]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def part_of(kind: int, keys: np.ndarray, parts: int, depth: int) -> np.ndarray:
    """Where a key is counted: grams by the bytes next to the predicted one, words by their hash."""
    near = keys >> (8 * (depth + 1 - DEALT)) if kind == GRAMS else keys
    mixed = near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


PACKED = "block long, kind int, part int, keys binary, n binary, tokens long"


def _counts(docs: DataFrame, parts: int, depth: int) -> DataFrame:
    """Packed distinct tokens and grams of each block, with their training counts, one row per part.

    ``docs`` come sorted by ``block`` in their partitions.
    """

    def rows(block: int, found: dict[int, _Pile]) -> pd.DataFrame:
        out = []
        for kind, pile in found.items():
            keys, n = pile.whole()
            part = part_of(kind, keys, parts, depth)
            order = np.argsort(part, kind="stable")
            keys, n, part = keys[order], n[order], part[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            for i, j in zip(at, np.r_[at[1:], len(part)]):
                tokens = int(n[i:j].sum()) if kind == WORDS else 0
                out.append((block, kind, part[i], packed(np.diff(keys[i:j], prepend=0)), packed(n[i:j]), tokens))
        return pd.DataFrame(out, columns=["block", "kind", "part", "keys", "n", "tokens"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, found, memo = None, {}, _Hashes()
        for frame in frames:
            for here, some in frame.groupby("block", sort=False):
                if here != block:
                    if found:
                        yield rows(block, found)
                    block, found = here, {WORDS: _Pile(), GRAMS: _Pile()}
                train = some["train"].to_numpy(dtype=bool)
                for a, b, documents in _steps(some["text"]):
                    for learned in (True, False):
                        chosen = [d for d, t in zip(documents, train[a:b]) if t == learned]
                        if chosen:
                            for kind, keys in ((WORDS, token_hashes(chosen, memo)), (GRAMS, grams_of(chosen, depth))):
                                keys, n = np.unique(keys, return_counts=True)
                                found[kind].add(keys, n * learned)
        if found:
            yield rows(block, found)

    return docs.mapInPandas(run, PACKED)


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of rows sorted by ``part``, the blocks' keys and counts of one part after the other."""
    part, held = None, []
    for frame in frames:
        for block, here, keys, n in frame[["block", "part", "keys", "n"]].itertuples(index=False):
            if here != part and held:
                yield held
                held = []
            part = here
            held.append((block, np.cumsum(unpacked(keys)), unpacked(n)))
    if held:
        yield held


def _contexts(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """Ranges of about ``TREE_GRAMS`` sorted grams that end with the last of a context."""
    near = keys >> (8 * (depth + 1 - DEALT))
    starts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]][: len(near)])
    begin = 0
    for end in [*starts[1:].tolist(), len(keys)]:
        if end - begin >= TREE_GRAMS or end == len(keys):
            if end > begin:
                yield slice(begin, end)
            begin = end


def _by_part(counts: DataFrame, kind: int) -> DataFrame:
    return counts.where(F.col("kind") == kind).repartition("part").sortWithinPartitions("part", "block")


def _words(counts: DataFrame) -> DataFrame:
    """Packed rows with the counts over all blocks instead of the block's own, and ``distinct`` on the
    first row of a part: how many of its words were in the training rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _parts(frames):
            keys, n = _merged([(k, c) for _, k, c in held])
            distinct = int((n > 0).sum())
            for block, some, _ in held:
                yield pd.DataFrame([(block, WORDS, packed(np.diff(some, prepend=0)),
                                     packed(n[np.searchsorted(keys, some)]), distinct)], columns=RATED_COLUMNS)
                distinct = 0

    return _by_part(counts, WORDS).mapInPandas(run, RATED)


RATED = "block long, kind int, keys binary, n binary, distinct long"
RATED_COLUMNS = ["block", "kind", "keys", "n", "distinct"]


def _crown(counts: DataFrame, depth: int) -> list[Level]:
    """The shallow levels of all parts' trees: bounded by the alphabet, so they fit the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _parts(frames):
            keys, n = _merged([(k, c) for _, k, c in held])
            keys, n = keys[n > 0], n[n > 0]
            for some in _contexts(keys, depth):
                top = tree(keys[some], n[some], depth)[-1].parents()
                yield pd.DataFrame(dict(zip(("key", "n", "ones", "below"), top)))

    sums = _by_part(counts, GRAMS).mapInPandas(run, "key long, n double, ones double, below double")
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "ones", "below")]).toPandas()
    sums = sums.sort_values("key")
    return crown(*(sums[c].to_numpy() for c in ("key", "n", "ones", "below")))


def _rated(counts: DataFrame, top: list[Level], depth: int) -> DataFrame:
    """Packed rows whose ``n`` are the logarithms of the grams' probabilities, as the bits of doubles."""
    given = counts.sparkSession.sparkContext.broadcast(top)

    def values(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys))
        for some in _contexts(keys, depth):
            asked, count = keys[some], n[some]
            if count.any():
                levels = [*tree(asked[count > 0], count[count > 0], depth), *given.value]
            else:  # nothing of these contexts was seen: only the shallow levels speak
                empty = Level(*(np.empty(0, dtype=t) for t in (np.int64, float, float, float, float)))
                levels = [empty] * (depth - DEALT + 1) + given.value
            out[some] = log_probability(levels, asked, depth)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _parts(frames):
            keys, n = _merged([(k, c) for _, k, c in held])
            value = values(keys, n)
            for block, some, _ in held:
                bits = value[np.searchsorted(keys, some)].view(np.int64) & KEPT_BITS
                yield pd.DataFrame([(block, GRAMS, packed(np.diff(some, prepend=0)), packed(bits), 0)],
                                   columns=RATED_COLUMNS)

    return _by_part(counts, GRAMS).mapInPandas(run, RATED)


def score(docs: DataFrame, trainable: Column, store: Store, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Learns from the rows that ``trainable`` (a condition on ``doc_id``, null: no) admits and scores
    all. Both scores are log10 probabilities of the words in order and an end. Null and empty
    texts are an end alone. Rows count as often as they stand there; equal rows get equal
    scores; without training rows every decision is even; an empty table gives no rows.
    """
    if not DEALT <= depth <= 6:
        raise ValueError(f"depth must be from {DEALT} to 6")
    given = texts(docs).withColumn("train", F.coalesce(trainable, F.lit(False)))
    volume = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(volume / BLOCK_BYTES))
    given = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    dealt = given.repartition("block").sortWithinPartitions("block")
    counts = store.put(_counts(dealt, parts, depth), "counts", tokens=F.sum("tokens"))
    words = store.put(_words(counts), "words", distinct=F.sum("distinct"))
    grams = store.put(_rated(counts, _crown(counts, depth), depth), "grams")
    store.drop(counts)
    n_train, n_distinct = counts.measured["tokens"] or 0, words.measured["distinct"] or 0

    def rated(some: pd.DataFrame, tables: dict, memo: _Hashes) -> pd.DataFrame:
        """Scores of texts of one block by its tables, a few megabytes at a time."""
        out = []
        for _, _, documents in _steps(some["text"]):
            sizes = np.array([len(d) + 1 for d in documents])
            spread = np.array([sum(map(len, d)) + len(d) + (not d) for d in documents])
            keys, n = tables[WORDS]
            c = n[np.searchsorted(keys, token_hashes(documents, memo))]
            ends = np.cumsum(sizes) - sizes
            base = np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
            keys, bits = tables[GRAMS]
            # distinct grams in order: sorted searches stay in the cache
            asked, at = np.unique(grams_of(documents, depth), return_inverse=True)
            p = bits.view(np.float64)[np.searchsorted(keys, asked)][at]
            out.append(pd.DataFrame({
                "n_tokens": sizes, "n_known": np.add.reduceat((c > 0).astype(np.int64), ends),
                "base_score": np.add.reduceat(base, ends),
                "score": np.add.reduceat(p, np.cumsum(spread) - spread) / math.log(10), "bytes": spread,
            }))
        found = pd.concat(out, ignore_index=True)
        return found.assign(doc_id=some["doc_id"].reset_index(drop=True))[
            ["doc_id", "n_tokens", "n_known", "base_score", "score", "bytes"]
        ]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each block its packed tables first, then its texts."""
        block, held, tables, memo = None, {}, {}, _Hashes()
        for frame in frames:
            for here, some in frame.groupby("block", sort=False):
                if here != block:
                    block, held, tables = here, {WORDS: [], GRAMS: []}, {}
                is_text = some["kind"].isna().to_numpy()
                for kind, keys, n in some.loc[~is_text, ["kind", "keys", "n"]].itertuples(index=False):
                    held[int(kind)].append((np.cumsum(unpacked(keys)), unpacked(n)))
                if is_text.any():
                    for kind in list(held):
                        keys, n = (np.concatenate(x) for x in zip(*held.pop(kind)))
                        order = np.argsort(keys)
                        tables[kind] = keys[order], n[order]
                    yield rated(some[is_text], tables, memo)

    nothing = lambda kind: F.lit(None).cast(kind)
    tables = words.union(grams).select("block", "kind", "keys", "n", nothing("string").alias("doc_id"), nothing("string").alias("text"))
    asked = given.select(
        "block", nothing("int").alias("kind"), nothing("binary").alias("keys"), nothing("binary").alias("n"),
        F.col("doc_id").cast("string").alias("doc_id"), "text",
    )
    both = tables.union(asked).repartition("block").sortWithinPartitions("block", F.col("kind").asc_nulls_last())
    scored = both.mapInPandas(
        run, "doc_id string, n_tokens long, n_known long, base_score double, score double, bytes long"
    )
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that are scored but not learned from; a null id is one of the others."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
