"""The nodes of the prefix trie against prefixes counted in Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.llm import prefix_trie
from holdfast.llm.common import Store

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_directly(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(found)] for c, found in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = turns.get(c - c % 20, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(found) - 1) * words
            leaves[p[:d]] += not children[p]
    out = []
    for p, found in members.items():
        ends = ",".join(map(str, sorted(c for c, ending in found if ending)))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in found), len(p), up, len(found), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_rows(conversations, store, **how):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(conversations, store, **how).collect()), key=str)


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_equals_counted_prefixes_for_any_number_of_batches(spark, seed):
    random.seed(seed)
    rows = []
    for conv in random.sample(range(400), 150):
        shape = random.choice((1, 2, 5, 40))
        for turn in range(random.randrange(1, shape + 1)):
            rows.append((conv, turn, random.choice(("user", "user", "bot")), random.choice(("hi there", "hi there", "a  b\tc", ""))))
    want = nodes_directly(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 2, 3):
        assert found_rows(docs, Store(spark), batches=batches) == want


def test_long_and_repeated_conversations_span_ranges(spark):
    rows = [(7, t, "user", f"w {t % 3}") for t in range(1500)] + [(8, t, "user", f"w {t % 3}") for t in range(1200)]
    rows += [(20 * c, 0, "user", "same first turn") for c in range(1, 1500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert found_rows(docs, Store(spark)) == nodes_directly(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (None, 0, "user", "x"), (None, None, None, None), (3, 5, "a", "bc"),
            (4, 5, "ab", "c"), (40, 0, "user", "x " * 50_000), (41, 0, "user", "é日本 \x1c 😀")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("d", "k1", "owner", "h", "uid", "cls", "m"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert found_rows(docs, Store(spark)) == nodes_directly(rows)
    assert found_rows(docs.limit(0), Store(spark)) == []


def test_repeated_rows_are_turns_and_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(c, 0, "user", "x"), (c, 0, "user", "x")]  # its first two turns go and no base stands in
    assert found_rows(spark.createDataFrame(rows, SCHEMA), Store(spark)) == nodes_directly(rows)
    more = rows + [(c, 0, "user", "x")] * 3
    assert found_rows(spark.createDataFrame(more, SCHEMA), Store(spark)) == nodes_directly(more)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 70) for b in range(a + 1, 71)] + [(0, 2**40 + 5), (2**40, 2**40 + 1)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = frame.select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in found:
        power = 1 << ((r.a ^ r.b).bit_length() - 1)
        assert r.f == r.b // power * power and r.a < r.f <= r.b


def test_a_batch_finds_the_deepest_node_on_its_way(spark):
    store = Store(spark)
    rows = [(c, t, "user", str(t if t < c % 7 * 2 else (c, t))) for c in range(20, 400, 20) for t in range(15)]
    turns = prefix_trie.hashed_turns(spark.createDataFrame(rows, SCHEMA), store)
    ids, whole = prefix_trie.rebuilt(turns, store)
    found = prefix_trie.prefixes(whole, store)
    _, equal = prefix_trie.classes(ids, found, store)
    sequences = found.withColumnRenamed("conv_id", "cls")
    early, late = equal.where("cls % 40 = 0"), equal.where("cls % 40 <> 0")
    trie = prefix_trie.Trie(store)
    trie.insert(sequences.where("cls % 40 = 0"), early)
    exits = {r.cls: r.low for r in trie.exits(sequences.where("cls % 40 <> 0"), late).collect()}
    nodes = {(r.hi, r.k1, r.k2) for r in trie.compacted().collect()}
    keys = defaultdict(dict)
    for r in sequences.collect():
        keys[r.cls][r.d] = (r.d, r.k1, r.k2)
    for r in late.collect():
        assert exits[r.cls] == max([d for d, k in keys[r.cls].items() if k in nodes], default=0)
    assert any(exits.values())
