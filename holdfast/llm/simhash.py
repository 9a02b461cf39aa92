"""SimHash near-duplicates found through Golay-code keys.

A fingerprint's 64 bits are cut in three segments of at most 23 bits, the length of the
perfect binary Golay code: every 23-bit word lies within three bits of exactly one
codeword. A segment's keys are the indices of the codewords nearest to it and to its 23
neighbours, one key or six. Segments that differ in at most two bits have a common
neighbour (or are equal or neighbours), hence a common key.

Four differing bits over three segments leave two segments with at most two each: one
and two errors at worst. So a key joins the indices of two segments (24 bits), in the
three ways to choose them, and the join verifies the distance of whole fingerprints.
Equal fingerprints collapse before; ``clusters`` links the rest without listing the
pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.clusters import clusters
from holdfast.llm.common import Store, if_small, pieces, text_key, texts

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: The Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, CHECKS = 0b110001110101, 23, 11


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of the division by the generator: the syndrome."""
    left = words.astype(np.int64)
    for shift in range(LENGTH - 1, CHECKS - 1, -1):
        left = np.where((left >> shift) & 1, left ^ (GENERATOR << (shift - CHECKS)), left)
    return left


def _corrections() -> np.ndarray:
    """For each syndrome the one pattern of at most three bits that has it."""
    patterns = [0]
    for weight in (1, 2, 3):
        patterns += [sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)]
    table = np.zeros(1 << CHECKS, dtype=np.int64)
    table[_remainder(np.array(patterns))] = patterns
    return table


CORRECTIONS = _corrections()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ CORRECTIONS[_remainder(words)]) >> CHECKS


def segment_keys(words: np.ndarray) -> np.ndarray:
    """For each word six sorted codeword indices; a row with fewer repeats its last."""
    around = np.stack([words, *(words ^ (1 << b) for b in range(LENGTH))], axis=1)
    found = np.sort(codeword_index(around.ravel()).reshape(around.shape), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(fresh, axis=1) - 1
    out = np.repeat(found[:, -1:], 6, axis=1)
    rows = np.repeat(np.arange(len(words)), found.shape[1]).reshape(found.shape)
    out[rows[fresh], place[fresh]] = found[fresh]
    return out


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: each is set in over half the XXH64 values of the text's word shingles.

    A-Z are lower-cased. A text with fewer words than a shingle has one shingle, all its
    words; a text without words has fingerprint zero.
    """
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())],
        dtype="<u8",
    )
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a long text
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``key`` and ``bits`` (the fingerprint as a signed long) of every row; null text: empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = np.array([fingerprint(t, shingle) for t in frame["text"]], dtype=np.uint64)
            yield frame[["doc_id", "key"]].assign(bits=found.view(np.int64))

    keyed = texts(docs).withColumn("key", text_key(F.col("text")))
    return keyed.mapInPandas(run, "doc_id long, key long, bits long")


def golay_keys(prints: DataFrame) -> DataFrame:
    """Each fingerprint (``id``, and ``label`` if given) under every pair of its segments' keys (``key``)."""
    columns = [c for c in ("id", "label") if c in prints.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1 << 12):
                some = {c: frame[c].to_numpy()[at : at + (1 << 12)] for c in columns}
                ids = some["id"]
                bits = ids.view(np.uint64)
                segments = [
                    segment_keys(((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64))
                    for a, n in SEGMENTS
                ]
                for kind, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
                    pair = (segments[i][:, :, None] << 12) | segments[j][:, None, :]
                    keys = np.sort(pair.reshape(len(ids), -1), axis=1)
                    fresh = np.ones(keys.shape, dtype=bool)
                    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    owner = np.repeat(np.arange(len(ids)), keys.shape[1]).reshape(keys.shape)[fresh]
                    named = {c: values[owner] for c, values in some.items()}
                    yield pd.DataFrame({"key": keys[fresh] | (kind << 24), **named})

    schema = ", ".join(["key int", *(f"{c} long" for c in columns)])
    return prints.select(*columns).mapInPandas(run, schema)


def near(max_bits: int):
    def within(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= max_bits

    return within


def _components(docs: DataFrame, store: Store, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Stored ``doc_id``, ``key``, ``bits`` of the rows, and ``bits``, ``label``, ``component_id``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find up to {MAX_BITS} differing bits")
    marked = store.put(fingerprints(docs, shingle), "fingerprints")
    prints = store.put(marked.groupBy(F.col("bits").alias("id")).agg(F.min("doc_id").alias("first")), "prints")
    labels = clusters(prints.select("id"), golay_keys, near(max_bits), store)
    groups = prints.join(labels, "id", "left").select(
        F.col("id").alias("bits"), "first", F.coalesce("label", "id").alias("label")
    )
    least = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    return marked, store.put(groups.join(least, "label").select("bits", "label", "component_id"), "named")


def near_duplicates(
    docs: DataFrame, store: Store, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id``, ``bits``, ``component_id`` of every row.

    Rows link when their fingerprints differ in at most ``max_bits`` (no more than four:
    that is what the keys guarantee); ``component_id`` is the smallest ``doc_id`` that links
    reach. Rows without words link like any other. A null ``doc_id`` links too but names no
    component unless no other row is in it; equal rows give equal rows; an empty table none.
    """
    marked, named = _components(docs, store, shingle, max_bits)
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")


def representatives(
    docs: DataFrame, store: Store, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each component of ``near_duplicates``.

    That of the smallest ``doc_id`` stays. Rows that share this ``doc_id`` are told apart by
    their text's hash; of rows equal in both one stays.
    """
    marked, named = _components(docs, store, shingle, max_bits)
    row = F.struct("doc_id", "key")
    # null ids come last, so that a component of other rows is never named by one
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    named_here = F.col("component_id").eqNullSafe(F.col("doc_id"))
    best = marked.join(named, "bits").groupBy("label").agg(
        F.min_by(row, order).alias("row"), F.count_if(named_here).alias("n")
    )
    kept = store.put(best.select(F.col("row.doc_id").alias("kept_id"), F.col("row.key").alias("kept_key"), "n"), "kept")
    key = text_key(F.coalesce(docs["text"], F.lit("")))
    match = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (key == F.col("kept_key"))
    names = [docs[f"`{c}`"] for c in docs.columns]
    once = docs.join(if_small(kept).where("n = 1"), match).select(*names)
    if not kept.where("n <> 1").take(1):
        return once
    several = docs.join(kept.where("n <> 1"), match)
    first = several.groupBy("kept_id", "kept_key").agg(F.first(F.struct(*names)).alias("row"))
    return once.union(first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
