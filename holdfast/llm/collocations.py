"""Phrase collocations from stripes: each prefix keys a counter of the words that follow it.

A stripe is one row: a language, a prefix of zero to four words, the words that follow it and how
often. Stripes of one prefix merge elementwise. From the merged stripes come

* extensions: an entry is a phrase and its count;
* prefix totals: an entry is also the total of the stripe whose prefix it completes, and the
  stripe of the empty prefix sums to the words of the language;
* subsumption maxima: the greatest entry of a phrase's own stripe, and of the stripes where
  the phrase ends a longer one.

Only phrases that can be frequent enter stripes. Counts of 32-bit phrase hashes, level by level,
mark frequent hashes in a bit map of fixed size (``FILTER_BITS``); a phrase is counted exactly if all
its parts are marked. A shared bit costs work, never a count, so results are exact at every size.

Edge cases: a null text is empty; a null language is ``und``. Tables without rows give no rows.
Ties keep the smallest cut, and phrases in byte order. Rows that repeat count again.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import LOWER, UPPER, Store

LONGEST = 5
MIN_COUNT = 100
LIMIT = 2000
#: Size of the bit map of frequent hashes: 16 MB, sent to every worker whatever the input's size.
FILTER_BITS = 27
#: Bytes of text that are taken apart at a time.
STEP_BYTES = 4 << 20
#: Hashes and phrases that a worker counts before it passes them on.
HELD_HASHES, HELD = 2 << 20, 400_000

#: Ends a piece; this byte never stands in UTF-8.
_END = 0xFF
_BYTES = bytes.maketrans(
    (UPPER + ".,;:!?\n\x0b\x0c\r\t").encode(), LOWER.encode() + bytes([_END]) * 10 + b" "
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a buffer of texts: bytes, places, pieces and hashes, as arrays."""

    def __init__(self, lang: str, texts: bytes):
        raw = np.frombuffer(texts.translate(_BYTES), np.uint8)
        inside = (raw != 0x20) & (raw != _END)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.lang = lang
        self.lengths = edges[1::2] - edges[::2]
        self.piece = np.cumsum(raw == _END, dtype=np.int32)[edges[::2]]
        self.body = raw[inside]
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def __len__(self) -> int:
        return len(self.lengths)

    def places(self) -> np.ndarray:
        """Of each byte, its place in its word."""
        return np.arange(len(self.body), dtype=np.int64) - np.repeat(self.offsets, self.lengths)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.full(int(self.lengths.max()), _ODD))
        sums = np.add.reduceat(_VALUES[self.body] * powers[self.places()], self.offsets)
        salt = _mix(np.array([sum(b * 257**i for i, b in enumerate(self.lang.encode()[:64])) % 2**64], np.uint64))
        return _mix(sums ^ salt)

    def numbered(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its number, and of each number a word's place; equal bytes, equal numbers."""
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        model = first[number]
        equal = np.array_equal(self.lengths, self.lengths[model]) and np.array_equal(
            self.body, self.body[np.repeat(self.offsets[model], self.lengths) + self.places()]
        )
        if not equal:  # two words share a hash: number them by their bytes
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(self.word(i), len(seen)) for i in range(len(self))])
            first = np.unique(number, return_index=True)[1]
        return number, first

    def word(self, at: int) -> bytes:
        start = self.offsets[at]
        return self.body[start : start + self.lengths[at]].tobytes()


def _buffers(frames: Iterator[pd.DataFrame]) -> Iterator[Words]:
    """Texts of a language joined to buffers of ``STEP_BYTES``; a long text is cut between pieces."""
    held, size = defaultdict(list), 0
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            while len(text) > 2 * STEP_BYTES:
                cut = max(text.rfind(bytes([b]), 0, STEP_BYTES) for b in b".,;:!?\n\x0b\x0c\r") + 1
                if not cut:
                    break
                yield Words(lang, text[:cut])
                text = text[cut:]
            held[lang].append(text)
            size += len(text)
            if size >= STEP_BYTES:
                yield from (Words(k, bytes([_END]).join(v)) for k, v in held.items())
                held, size = defaultdict(list), 0
    yield from (Words(k, bytes([_END]).join(v)) for k, v in held.items())


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _levels(words: Words, longest: int, bits: np.ndarray | None, marked: int) -> Iterator[tuple]:
    """For each phrase length: hashes by first word, and where a phrase stands whose parts are marked.

    Lengths up to ``marked`` are looked up in ``bits`` themselves.
    """
    single = words.hashes()
    whole, there = single, np.ones(len(words), bool)
    for n in range(1, longest + 1):
        if n > 1:
            whole = _mix(whole[:-1] * _ODD + single[n - 1 :])
            there = there[:-1] & there[1:] & (words.piece[: len(whole)] == words.piece[n - 1 :])
        if n <= marked:
            there = there.copy()
            there[there] = _marked(bits, whole[there])
        yield n, whole, there


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: high planes of small numbers are runs of zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _hash_counts(levels: tuple[int, ...], blocks: int, sent):
    """Rows of one block of the hash space each: hashes (32 bits, as steps) and counts of phrases."""

    def packed(held: list) -> pd.DataFrame:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        at = np.searchsorted(keys, (np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks))
        rows = [
            (b, _planes(np.diff(keys[i:j], prepend=0)), _planes(counts[i:j]))
            for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i
        ]
        return pd.DataFrame(rows, columns=["block", "keys", "counts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if sent is None else np.frombuffer(sent.value, np.uint64)
        held, size = [], 0
        for words in _buffers(frames):
            for n, whole, there in _levels(words, levels[-1], bits, levels[0] - 1):
                if n in levels:
                    keys, counts = np.unique(whole[there] >> np.uint64(32), return_counts=True)
                    held.append((keys, counts))
                    size += len(keys)
            if size > HELD_HASHES:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _marks(min_count: int):
    """Words of the bit map that have frequent hashes, from sorted blocks, one block at a time."""

    def marks(held: list) -> pd.DataFrame:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        place = keys[counts >= min_count].astype(np.uint64) >> np.uint64(32 - FILTER_BITS)
        at, first = np.unique(place >> np.uint64(6), return_index=True)
        mark = np.uint64(1) << (place & np.uint64(63))
        mark = np.bitwise_or.reduceat(mark, first) if len(first) else mark
        return pd.DataFrame({"at": at.astype(np.int64), "mark": mark.view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, []
        for frame in frames:
            for b, keys, counts in frame.itertuples(index=False):
                if b != block and held:
                    yield marks(held)
                    held = []
                block = b
                held.append((np.cumsum(_numbers(keys), dtype=np.uint64), _numbers(counts).astype(np.int64)))
        if held:
            yield marks(held)

    return run


def _blocks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _filter(docs: DataFrame, min_count: int):
    """A broadcast bit map that marks the hashes of all phrases with ``min_count`` occurrences.

    Words first, then pairs of marked words, then longer phrases of marked pairs.
    """
    blocks = _blocks(docs)
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    sent = None
    for levels in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        counted = docs.mapInPandas(_hash_counts(levels, blocks, sent), "block int, keys binary, counts binary")
        dealt = counted.repartition(blocks, "block").sortWithinPartitions("block")
        found = dealt.mapInPandas(_marks(min_count), "at long, mark long").toArrow()  # at most the map's size
        np.bitwise_or.at(bits, found["at"].to_numpy(), found["mark"].to_numpy().view(np.uint64))
        sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    return sent


def _stripes(blocks: int, sent):
    """Rows of packed stripes: entries of many prefixes, dealt by a hash of the entry."""

    def packed(held: dict) -> pd.DataFrame:
        rows: list = [([], [], [], []) for _ in range(blocks)]
        for (lang, prefix), entries in held.items():
            of, salt = prefix.decode(), zlib.crc32(prefix)
            for word, n in entries.items():
                row = rows[zlib.crc32(word, salt) % blocks]
                for column, value in zip(row, (lang, of, word.decode(), n)):
                    column.append(value)
        return pd.DataFrame([(b, *row) for b, row in enumerate(rows) if row[0]],
                            columns=["block", "lang", "prefix", "word", "n"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(sent.value, np.uint64)
        held: dict[tuple[str, bytes], dict[bytes, int]] = defaultdict(dict)
        size = 0
        for words in _buffers(frames):
            number, first = words.numbered(words.hashes())
            text: dict[int, bytes] = {}  # words that stand in a marked phrase
            prefixes, before = [b""], np.zeros(len(words), np.int64)  # phrases one shorter, and by place
            for n, _, there in _levels(words, LONGEST, bits, LONGEST):
                at = np.flatnonzero(there)
                pair = before[at] * max(len(first), 1) + number[at + n - 1]
                kinds, model, kind, counts = np.unique(
                    pair, return_index=True, return_inverse=True, return_counts=True
                )
                of, last = before[at[model]].tolist(), (kinds % max(len(first), 1)).tolist()
                longer = []
                for p, w, c in zip(of, last, counts.tolist()):
                    if w not in text:
                        text[w] = words.word(first[w])
                    entries = held[words.lang, prefixes[p]]
                    size += text[w] not in entries
                    entries[text[w]] = entries.get(text[w], 0) + c
                    longer.append(prefixes[p] + b" " + text[w] if p or prefixes[p] else text[w])
                if n == 1 and len(words) > len(at):  # what is no entry of the empty prefix counts as well
                    entries = held[words.lang, b""]
                    entries[b""] = entries.get(b"", 0) + len(words) - len(at)
                before = np.full(len(words), -1, np.int64)
                before[at] = kind
                prefixes = longer
            if size > HELD:
                yield packed(held)
                held.clear()
                size = 0
        if held:
            yield packed(held)

    return run


def _merged(min_count: int):
    """Entries of equal prefix and word added up over all packed rows of a partition.

    A rare word whose hash is marked for another one is no entry, but counts among the words of its language.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for frame in frames:
            for _, *row in frame.itertuples(index=False):
                for lang, prefix, word, n in zip(*row):
                    held[lang, prefix][word] += n
        for (_, prefix), stripe in held.items():
            rare = 0 if prefix else sum(n for w, n in stripe.items() if w and n < min_count)
            if rare:
                stripe[""] += rare
        rows = [(*of, w, n) for of, stripe in held.items() for w, n in stripe.items() if n >= min_count or not w]
        for start in range(0, len(rows), HELD):
            yield pd.DataFrame(rows[start : start + HELD], columns=["lang", "prefix", "word", "n"])

    return run


def stripes(docs: DataFrame, store: Store, min_count: int = MIN_COUNT) -> DataFrame:
    """Merged entries with ``min_count``, stored: ``lang``, ``prefix``, ``word``, ``n``.

    The stripe of the empty prefix has all words; rare ones are entries under an empty word, one a task at
    most. Entries are dealt by a hash of prefix and word, so that the stripe of a very common prefix is spread over all
    tasks; a task holds the distinct frequent entries of its share.
    """
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    sent, blocks = _filter(texts, min_count), _blocks(docs)
    packed = "block int, lang array<string>, prefix array<string>, word array<string>, n array<long>"
    parts = texts.mapInPandas(_stripes(blocks, sent), packed).repartition(blocks, "block")
    return store.put(parts.mapInPandas(_merged(min_count), "lang string, prefix string, word string, n long"), "stripes")


def collocations(
    docs: DataFrame, store: Store, min_count: int = MIN_COUNT, limit: int | None = LIMIT
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is a phrase's count, ``l`` and ``r`` those of its parts at the cut with the least
    ``score`` = floor(1000 * a * n / (l * r)), ``n`` the language's words. A phrase that stands in a longer
    candidate as often as anywhere is left out.
    """
    entries = stripes(docs, store, min_count)
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    listed = entries.where((F.col("word") != "")).select("lang", phrase.alias("phrase"), "prefix", "n")
    counts = store.put(listed, "phrases")
    candidates = counts.where("prefix <> ''")

    shorter = F.array("prefix", F.regexp_replace("phrase", "^[^ ]+ ", ""))
    longest = candidates.select("lang", F.explode(shorter).alias("phrase"), "n").groupBy("lang", "phrase").agg(
        F.max("n").alias("longer")
    )
    own = candidates.join(longest, ["lang", "phrase"], "left").where("longer is null or longer < n")

    words = F.split("phrase", " ")
    cuts = own.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).select(
        "lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    )
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                       part(F.col("k") + 1, F.size("w")).alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    size = entries.where("prefix = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(size, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(cast(1000 as decimal(4,0)) * a18 * n18) div (l18 * r18)")
    scored = scored.withColumns({f"{c}18": wide(c) for c in ("n", "l", "r")}).withColumn(
        "a18", F.col("a").cast("decimal(15,0)")
    )
    least = scored.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = least.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    flat = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
