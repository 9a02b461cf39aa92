"""Prefix trie of conversations, as a z-fast trie in tables.

A conversation is a sequence of turns (role, text); a node is a distinct prefix. Prefixes are known by
128 bits of hash: a turn's hash is salted with its place and the salted hashes add up, so that prefix
hashes are running sums. Nodes with one child at which no conversation ends are passed over: a compacted
node stands for the edge ``(lo, hi]`` of depths above it, and is found under its handle, the prefix
hash at the two-fattest depth of that interval.

Conversations enter in batches, each many times as large as what the trie holds. A batch finds its exit nodes by fat
binary search: all its conversations probe the handles' table together, one join for each halving of
their intervals of depths. Then the exit edges are walked, prefixes that the trie lacks become nodes,
and the trie is compacted anew. At the end edges are expanded to one row per node.

No conversation is gathered in a task: turns are cut into ranges of their order and running sums get
the totals of the ranges before. Groups of equal conversations enter once, with their number. Only the branching
nodes of one conversation are sorted together.

Edge cases: null role and text are empty; turns of one conversation with the same number are ordered by a hash
of role and text; rows that repeat are further turns. Rows without ``conv_id`` belong to no conversation and
are left out. A conversation without turns ends at the root. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Store, if_small

WORD = r"[^\x20\x09-\x0D]+"
#: A batch holds so many times the conversations of those before it.
GROWTH = 16
BATCHES = 2
ORDER = ("conv_id", "part", "turn", "g1", "g2", "uid")
SUMS = ("s1", "s2", "s3", "s4", "total_words")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in ``(low, high]`` that most powers of two divide."""
    zeros = F.length(F.bin(low.bitwiseXOR(high))) - 1
    power = F.call_function("shiftleft", F.lit(1).cast("long"), zeros.cast("int"))
    return high - F.pmod(high, power)


def hashed_turns(conversations: DataFrame, store: Store) -> DataFrame:
    """``conv_id, turn, uid, g1, g2, words`` of every row that has a conversation, stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("uid"),
        F.xxhash64(role, text).alias("g1"), F.xxhash64(F.lit(1), text, role).alias("g2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return store.put(rows, "turns")


def rebuilt(turns: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Conversations (stored ``conv_id``) and their turns after the first ones were replaced.

    Conversation c starts with the first h turns of c - c % 20, then its own follow after its first h;
    h = crc32(c) % 4. ``part`` 0 sorts before 1. A window that keeps three rows drops the rest before its shuffle.
    """
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = store.put(ids.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20}), "ids", least=F.min("conv_id"))
    place = Window.partitionBy("conv_id").orderBy("turn", "g1", "g2", "uid")
    first = turns.withColumn("i", F.row_number().over(place)).where("i <= 3")
    first = store.put(first.select(F.col("conv_id").alias("of"), "i", "uid", "g1", "g2", "words"), "first")
    head = ids.join(first, (ids["base"] == first["of"]) & (first["i"] <= ids["h"])).select(
        "conv_id", F.lit(0).alias("part"), F.col("i").cast("long").alias("turn"), "g1", "g2", "uid", "words"
    )
    gone = ids.join(first, (ids["conv_id"] == first["of"]) & (first["i"] <= ids["h"])).select("uid")
    own = turns.join(gone, "uid", "left_anti").select(
        "conv_id", F.lit(1).alias("part"), "turn", "g1", "g2", "uid", "words"
    )
    return ids, head.union(own)


def _earlier(ranged: DataFrame, totals: list[Column], names: list[str]) -> DataFrame:
    """Sums over a conversation's earlier ranges, for ranges that continue one.

    A range continues at most one conversation: there are fewer rows than ranges.
    """
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("conv_id", "pid").agg(*totals)
    moved = sums.select("conv_id", "pid", *[F.sum(n).over(before).alias(f"before_{n}") for n in names])
    return F.broadcast(moved.where(f"before_{names[0]} is not null"))


def prefixes(rows: DataFrame, store: Store) -> DataFrame:
    """One row per turn, stored: its depth ``d``, the keys of its prefix and of the one before, words so far."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, *ORDER).withColumn("pid", F.spark_partition_id())
    ranged = store.put(ranged, "ranged")
    here = Window.partitionBy("conv_id", "pid").orderBy(*ORDER[1:])
    offsets = _earlier(ranged, [F.count(F.lit(1)).alias("n")], ["n"])
    d = F.row_number().over(here) + F.coalesce("before_n", F.lit(0))
    placed = ranged.join(offsets, ["conv_id", "pid"], "left").withColumn("d", d.cast("long"))
    salted = placed.withColumns({"x": F.xxhash64("d", "g1", "g2"), "y": F.xxhash64(F.lit(1), "d", "g2", "g1")})
    low = F.lit(0xFFFFFFFF)
    halves = salted.withColumns({
        "p1": F.shiftrightunsigned("x", 32), "p2": F.col("x").bitwiseAND(low),
        "p3": F.shiftrightunsigned("y", 32), "p4": F.col("y").bitwiseAND(low), "p5": F.col("words"),
    })
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [f"p{i}" for i in range(1, 6)]
    summed = halves.withColumns({s: F.sum(p).over(so_far) for s, p in zip(SUMS, parts)})
    summed = store.put(summed.select("conv_id", "pid", "d", *parts, *SUMS), "summed")
    last = F.max(F.struct("d", *SUMS)).alias("last")
    ends = summed.groupBy("conv_id", "pid").agg(last).select("conv_id", "pid", "last.*")
    offsets = _earlier(ends, [F.first(s).alias(s) for s in SUMS], list(SUMS))
    whole = summed.join(offsets, ["conv_id", "pid"], "left").withColumns(
        {s: F.col(s) + F.coalesce(f"before_{s}", F.lit(0)) for s in SUMS}
    )

    def keys(sums: list[Column], depth: Column) -> tuple[Column, Column]:
        return F.xxhash64(depth, *sums), F.xxhash64(F.lit(1), *sums[::-1], depth)

    now = keys([F.col(s) for s in SUMS[:4]], F.col("d"))
    past = keys([F.col(s) - F.col(p) for s, p in zip(SUMS[:4], parts)], F.col("d") - 1)
    root = F.col("d") == 1
    out = store.put(whole.select(
        "conv_id", "d", now[0].alias("k1"), now[1].alias("k2"),
        F.when(root, 0).otherwise(past[0]).alias("up1"), F.when(root, 0).otherwise(past[1]).alias("up2"),
        "total_words", F.col("p5").alias("words"),
    ), "prefixes")
    store.drop(ranged, summed)
    return out


def classes(ids: DataFrame, found: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Ends of all conversations (``conv_id, l, k1, k2``), and equal ones as one row with their least id."""
    ends = found.groupBy("conv_id").agg(F.max(F.struct(F.col("d").alias("l"), "k1", "k2")).alias("e"))
    ends = ids.select("conv_id").join(ends, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"e.{c}", F.lit(0).cast("long")).alias(c) for c in ("l", "k1", "k2")]
    )
    ends = store.put(ends, "ends")
    equal = ends.groupBy("l", "k1", "k2").agg(F.min("conv_id").alias("cls"), F.count(F.lit(1)).alias("m"))
    return ends, store.put(equal, "classes")


class Trie:
    """Nodes (``d, k1, k2, up1, up2, owner, total_words, words``) and their compaction.

    ``owner`` is a conversation that brought the node in. The nodes of an edge have one owner: whatever enters
    later below an old node makes it a branching node or follows on an end.
    """

    def __init__(self, store: Store):
        self.store = store
        self.parts: list[DataFrame] = []
        self.ended: list[DataFrame] = []

    def nodes(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def compacted(self) -> DataFrame:
        """``owner, lo, hi, k1, k2, children, total_words`` of branching nodes, leaves and ends."""
        nodes = self.nodes()
        children = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(
            F.count(F.lit(1)).alias("children")
        )
        ended = reduce(DataFrame.union, self.ended).select(F.col("l").alias("d"), "k1", "k2", F.lit(True).alias("ends"))
        kept = nodes.join(children, ["d", "k1", "k2"], "left").join(ended, ["d", "k1", "k2"], "left")
        kept = kept.where("ends or children is null or children > 1")
        start = nodes.groupBy("owner").agg((F.min("d") - 1).alias("start"))
        above = F.lag("d").over(Window.partitionBy("owner").orderBy("d"))
        out = kept.withColumn("above", above).join(start, "owner").select(
            "owner", F.coalesce("above", "start").alias("lo"), F.col("d").alias("hi"), "k1", "k2",
            F.coalesce("children", F.lit(0)).cast("long").alias("children"), "total_words",
        )
        return self.store.put(out, "compacted")

    def handles(self) -> DataFrame:
        """Stored ``f, k1, k2`` (a handle) with the edge ``(lo, hi]`` and the node's hash ``e1, e2``."""
        edges = self.compacted()
        edges = edges.select("owner", "lo", "hi", F.col("k1").alias("e1"), F.col("k2").alias("e2"),
                             two_fattest(F.col("lo"), F.col("hi")).alias("f"))
        at = self.nodes().select("owner", F.col("d").alias("f"), "k1", "k2")
        return self.store.put(edges.join(at, ["owner", "f"]).select("f", "k1", "k2", "lo", "hi", "e1", "e2"), "handles")

    def exits(self, batch: DataFrame, ends: DataFrame) -> DataFrame:
        """``cls`` and ``low``, the depth of the deepest node on its way: fat binary search of all together.

        A probe that finds a handle goes on below that node, or stops above the node's edge if the
        conversation leaves it; one that finds none goes on above the probed depth.
        """
        store = self.store
        handles = if_small(self.handles())
        probed = batch.select("cls", F.col("d").alias("f"), "k1", "k2")
        reached = batch.select("cls", F.col("d").alias("hi"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
        state = ends.where("l > 0").select("cls", F.lit(0).cast("long").alias("low"), F.col("l").alias("high"))
        found, state = state.where("high = 0").select("cls", "low"), store.put(state, "search")
        left = state.measured["rows"]
        while left:
            asked = state.where("low < high").withColumn("f", two_fattest(F.col("low"), F.col("high")))
            met = asked.join(probed, ["cls", "f"]).join(handles, ["f", "k1", "k2"], "left")
            met = met.join(reached, ["cls", "hi"], "left")
            inside = F.coalesce((F.col("r1") == F.col("e1")) & (F.col("r2") == F.col("e2")), F.lit(False))
            low = F.when(inside, F.col("hi")).otherwise(F.coalesce("lo", "low"))
            high = F.when(F.col("hi").isNull(), F.col("f") - 1).when(inside, F.col("high")).otherwise(F.col("lo"))
            state = store.put(
                met.select("cls", low.alias("low"), high.alias("high")), "search",
                left=F.count_if(F.col("low") < F.col("high")),
            )
            left = state.measured["left"]
            found = found.union(state.where("low >= high").select("cls", "low"))
        return found

    def insert(self, batch: DataFrame, ends: DataFrame) -> None:
        """Add the prefixes of a batch's conversations that the trie lacks."""
        fresh = batch
        if self.parts:
            found = self.exits(batch, ends)
            below = batch.join(found, "cls").where("d > low").drop("low")
            known = self.nodes().select("d", "k1", "k2")
            fresh = below.join(known, ["d", "k1", "k2"], "left_anti")
        same = [F.first(c).alias(c) for c in ("up1", "up2", "total_words", "words")]
        new = fresh.groupBy("d", "k1", "k2").agg(F.min("cls").alias("owner"), *same)
        self.parts.append(self.store.put(new, "nodes"))
        self.ended.append(ends.where("l > 0"))


def member_digests(ends: DataFrame, store: Store) -> DataFrame:
    """``l, k1, k2`` and the SHA-256 of the sorted conversation ids that end there.

    Ids are sorted in ranges and joined to strings range by range. A node whose ids fill several ranges has
    its strings hashed one after the other.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["l", "k1", "k2"]
    ranged = ends.repartitionByRange(ranges, *key, "conv_id").withColumn("pid", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = store.put(ranged.groupBy(*key, "pid").agg(ids.alias("ids")), "members")
    many = store.put(pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many")
    single = pieces if not many.measured["rows"] else pieces.join(F.broadcast(many), key, "left_anti")
    out = single.select(*key, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    if many.measured["rows"]:  # each but the first begins in another range: fewer rows than ranges
        rest = pieces.join(F.broadcast(many.drop("n")), key).repartition(*key).sortWithinPartitions(*key, "pid")
        out = out.union(rest.select(*key, "ids").mapInPandas(_digests, out.schema))
    return out


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash sorted rows of one key one after the other."""
    key, running, out = None, None, []
    for frame in frames:
        for l, k1, k2, ids in frame.itertuples(index=False):
            if (l, k1, k2) == key:
                running.update(b"," + ids.encode())
            else:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = (l, k1, k2), hashlib.sha256(ids.encode())
    if key is not None:
        out.append((*key, running.hexdigest()))
    yield pd.DataFrame(out, columns=["l", "k1", "k2", "ends_sha256"])


def trie(sequences: DataFrame, equal: DataFrame, store: Store, batches: int = BATCHES) -> Trie:
    """Insert classes of equal conversations in batches that grow by ``GROWTH``, drawn by a hash."""
    draw = F.pmod(F.xxhash64("cls", F.lit("batch")), F.lit(GROWTH ** (batches - 1)))
    number = reduce(lambda other, b: F.when(draw < GROWTH**b, b).otherwise(other), range(batches - 1, -1, -1), F.lit(batches))
    out = Trie(store)
    for b in range(batches):
        now = store.put(equal.where(number == b), "batch")
        if now.measured["rows"]:
            own = sequences.join(if_small(now).select("cls"), "cls")
            out.insert(store.put(own, "batch"), now)
    return out


def prefix_nodes(conversations: DataFrame, store: Store, batches: int = BATCHES) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A subtree's totals come from its conversations: each conversation carries the totals of the edges it
    brought in, so that a node adds up over the conversations that pass it, at any depth of the tree.
    """
    turns = hashed_turns(conversations, store)
    ids, rows = rebuilt(turns, store)
    if not ids.measured["rows"]:
        return _empty(conversations)
    found = prefixes(rows, store)
    ends, equal = classes(ids, found, store)
    sequences = found.withColumnRenamed("conv_id", "cls").join(if_small(equal).select("cls", "m", "l"), "cls")
    sequences = store.put(sequences, "sequences")
    store.drop(turns, found)
    digests = store.put(member_digests(ends, store), "digests")
    shape = trie(sequences.drop("m", "l"), equal, store, batches)

    at_root = digests.where("l = 0").select("ends_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    root_sha = F.coalesce(at_root.scalar(), F.lit(nothing))
    least, size = ids.measured["least"], ids.measured["rows"]
    number = lambda n: F.lit(n).cast("long")
    root = lambda children, leaves, saved: conversations.sparkSession.range(1).select(
        number(least).alias("conv_id"), number(0).alias("depth"), number(None).alias("parent_conv_id"),
        number(size).alias("n_convs"), number(children).alias("n_children"), number(leaves).alias("n_leaves"),
        number(saved).alias("saved_tokens"), root_sha.alias("ends_sha256"),
    )
    if not sequences.measured["rows"]:
        return root(0, 1, 0)

    nodes, edges = shape.nodes(), shape.compacted()
    passed = sequences.join(
        edges.select("owner", "hi", "children", F.col("hi").alias("d"), "k1", "k2"), ["d", "k1", "k2"]
    )
    passed = passed.withColumn("leaf", ((F.col("hi") == F.col("l")) & (F.col("children") == 0)).cast("long"))
    every = Window.partitionBy("cls")
    passed = store.put(
        passed.select("cls", "owner", "hi", "m", F.max("leaf").over(every).alias("leaf")), "passed"
    )
    counted = passed.groupBy("owner", "hi").agg(
        F.min("cls").alias("conv_id"), F.sum("m").alias("n_convs"), F.sum("leaf").alias("n_leaves")
    )
    top = nodes.select(
        "owner", (F.col("d") - 1).alias("lo"), "up1", "up2", (F.col("total_words") - F.col("words")).alias("words_above")
    )
    edges = edges.withColumnRenamed("total_words", "words_below").join(counted, ["owner", "hi"]).join(top, ["owner", "lo"])
    saved = (F.col("n_convs") - 1) * (F.col("words_below") - F.col("words_above"))
    edges = store.put(
        edges.withColumn("saved", saved), "edges", saved=F.sum("saved"), top=F.count_if(F.col("lo") == 0),
        leaves=F.count_if(F.col("children") == 0),
    )

    brought = edges.select(F.col("owner").alias("cls"), "hi", "saved")
    deeper = every.orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    carried = passed.join(brought, ["cls", "hi"], "left").select(
        "owner", "hi", F.coalesce(F.sum(F.coalesce("saved", F.lit(0))).over(deeper), F.lit(0)).alias("below")
    )
    below = carried.groupBy("owner", "hi").agg(F.sum("below").alias("below"))
    up = edges.select(F.col("hi").alias("lo"), F.col("k1").alias("up1"), F.col("k2").alias("up2"),
                      F.col("conv_id").alias("up_conv"))
    ended = digests.select(F.col("l").alias("hi"), "k1", "k2", "ends_sha256")
    whole = edges.join(below, ["owner", "hi"]).join(up, ["lo", "up1", "up2"], "left").join(ended, ["hi", "k1", "k2"], "left")
    whole = whole.drop("k1", "k2", "up1", "up2").withColumn("depth", F.explode(F.expr("sequence(lo + 1, hi)")))
    each = nodes.select("owner", F.col("d").alias("depth"), "total_words", "words")
    last, first = F.col("depth") == F.col("hi"), F.col("depth") == F.col("lo") + 1
    rest = F.col("words_below") - F.col("total_words") + F.col("words")
    expanded = whole.join(each, ["owner", "depth"]).select(
        "conv_id", "depth",
        F.when(first, F.coalesce("up_conv", F.lit(least))).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("children")).otherwise(1).alias("n_children"), "n_leaves",
        ((F.col("n_convs") - 1) * rest + F.col("below")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(nothing))).otherwise(nothing).alias("ends_sha256"),
    )
    totals = edges.measured
    return root(totals["top"], totals["leaves"], totals["saved"]).union(expanded)


def _empty(conversations: DataFrame) -> DataFrame:
    schema = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long, ends_sha256 string")
    return conversations.sparkSession.createDataFrame([], schema)
