"""Connected groups of rows that share a key and pass a check, without listing a bucket's pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Store

def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbours and itself."""
    both = _directed(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """``id`` and ``label`` (least id that links reach) of every node that has a link.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Large-star and small-star
    alternate until nothing moves, in rounds that grow with the logarithm of the longest
    chain. A node with very many links is one row of the aggregate's result per task, and
    the join that brings it back is one that Spark splits when skewed.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now, seen = store.put(clean.distinct(), "edges", sign=sign), None
    while now.measured["rows"] and now.measured != seen:
        before, seen = now, now.measured
        now = store.put(_small_star(_large_star(before)), "edges", sign=sign)
        store.drop(before)
    members = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return members.union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def clusters(
    nodes: DataFrame,
    keyed: Callable[[DataFrame], DataFrame],
    screen: Callable[[Column, Column], Column],
    store: Store,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    payload: str = "id",
) -> DataFrame:
    """``id`` and ``label`` of the ids that link to another; exact for any bucket size.

    ``nodes`` (stored; ``id``, ``payload``, short ones) go through ``keyed``, the second time with
    a column ``label``, which returns their columns once per ``key``. Two ids link if they share a key, pass ``screen`` on
    their payloads and survive ``verify``, a function from pairs (``a``, ``b``) to the pairs that hold.

    First every bucket's rows are compared with one hub, as many comparisons as rows, and the
    links give labels. Then the rows outside a bucket's largest label are compared with its
    rows of other labels: every pair of different labels meets, copies of one group do not.
    Each step shuffles the keys once; a bucket's pairs are never listed, only its links are.
    """
    bucket = Window.partitionBy("key")
    other = F.col("id") if payload == "id" else F.col(payload)
    hub = keyed(nodes).withColumn("hub", F.min(F.struct("id", other.alias("p"))).over(bucket))
    stars = hub.where((F.col("id") != F.col("hub.id")) & screen(other, F.col("hub.p")))
    links = _checked(_pairs(stars, F.col("id"), F.col("hub.id")), verify, store)
    labels = store.put(components(links, store), "labels")

    marked = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    marked = store.put(marked, "marked")
    # dealt by key once: both windows and both sides of the join stand on this shuffle
    dealt = keyed(marked).repartition("key")
    sized = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
    main = F.max(F.struct("n", "label")).over(bucket)["label"]
    few = sized.withColumn("main", main).where("label <> main").select(
        "key", F.col("id").alias("a"), other.alias("p"), F.col("label").alias("l"), "main"
    )
    every = dealt.select("key", F.col("id").alias("b"), other.alias("q"), F.col("label").alias("m"))
    # a pair outside the main label is compared from its lesser label only
    apart = (few.l < every.m) | (every.m == few.main)
    met = few.join(every, (few.key == every.key) & apart & screen(few.p, every.q))
    rest = _checked(_pairs(met, F.col("a"), F.col("b")), verify, store)
    if not rest.measured["rows"]:
        return labels
    return components(links.union(rest), store)


def _pairs(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _checked(pairs: DataFrame, verify, store: Store) -> DataFrame:
    return store.put(pairs if verify is None else verify(pairs), "links")
