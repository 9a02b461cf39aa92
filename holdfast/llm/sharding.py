"""Best-fit-decreasing packing of indivisible groups into shards of one capacity.

Groups (rows with equal texts) are sized by an aggregate. Those large enough to matter for a
shard are items of their own; the others are bundled by a hash into items of about the same
small weight, so the number of items depends on the number of shards, not on the input, and
the packing itself is a short job on the driver. A group larger than a shard cannot stay
whole: it is dealt by row into parts no larger than a bundle.

The items, sorted by falling size, enter the bin with the least room that still fits, found
by bisection of the bins ordered by room; if none fits, the roomiest.

Rows are numbered within a shard by ranks within sub-buckets plus the sizes of the buckets
before, so no task holds a whole shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Store, if_small, texts

#: A row's cost beside its text's bytes.
ROW_BYTES = 16
#: Bundles per shard: each is about this part of a shard's capacity.
BUNDLES = 500
#: Rows of one numbering task, about.
BUCKET_ROWS = 100_000


def best_fit_decreasing(
    items: Iterable[tuple[str, int]], capacity: int, shards: int | None = None
) -> dict[str, int]:
    """Shard of each item. With ``shards`` that many bins are open from the start and an item
    that fits nowhere enters the roomiest; else a new bin opens for it."""
    rooms = [(capacity, s) for s in range(shards or 0)]  # sorted by room, then shard
    opened, placed = shards or 0, {}
    for size, name in sorted(((n, i) for i, n in items), key=lambda x: (-x[0], x[1])):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, shard = rooms.pop(at)
        elif shards:
            room, shard = rooms.pop()
        else:
            room, shard, opened = capacity, opened, opened + 1
        placed[name] = shard
        insort(rooms, (room - size, shard))
    return placed


def best_fit(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each item. One that is larger than a fair share of what is left has a shard alone;
    the capacity of the others is a fair share of the rest."""
    sizes = sorted(items, key=lambda x: (-x[1], x[0]))
    rest, alone = sum(size for _, size in sizes), 0
    while alone < min(shards - 1, len(sizes)) and sizes[alone][1] * (shards - alone) > rest:
        rest -= sizes[alone][1]
        alone += 1
    placed = {name: shard for shard, (name, _) in enumerate(sizes[:alone])}
    left = shards - alone
    others = best_fit_decreasing(sizes[alone:], max(1, ceil(rest / left)), left)
    return placed | {name: alone + shard for name, shard in others.items()}


def assign(docs: DataFrame, shards: int, store: Store) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row.

    Shards hold nearly equal bytes: each lies within the weight of an item of the mean, but for a row
    that is larger than that, which has a shard alone. Null texts have no bytes; equal texts share a shard unless they alone exceed one, and then are
    dealt by row hash. Slots are gapless from 0. An empty table gives no rows.
    """
    text = F.col("text")
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group"),
    )
    rows = store.put(rows, "rows", bytes=F.sum("size"))
    total, count = rows.measured["bytes"] or 0, rows.measured["rows"]
    capacity = max(1, ceil(total / shards))
    bundle = max(1, capacity // BUNDLES)
    # within the key of a hot group only the row's own hash can tell its rows apart
    part = F.xxhash64("doc_id", "text_crc32")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = store.put(groups.where(F.col("bytes") > bundle), "large")
    kind = F.when(F.col("bytes") > capacity, F.ceil(F.col("bytes") / bundle)).otherwise(F.lit(1))
    large = if_small(large).select("group", kind.alias("parts"))
    n_bundles = max(1, shards * BUNDLES)
    named = rows.join(large, "group", "left").withColumn(
        "item",
        F.when(F.col("parts").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(n_bundles))))
        .when(F.col("parts") == 1, F.col("group"))
        .otherwise(F.concat("group", F.lit("/"), F.pmod(part, "parts"))),
    )
    sizes = named.groupBy("item").agg(F.sum("size").alias("bytes"))
    # at most BUNDLES bundles and twice as many larger items or parts per shard
    placed = best_fit([(r.item, r.bytes) for r in sizes.toLocalIterator()], shards)
    schema = "item string, shard int"
    where = docs.sparkSession.createDataFrame(list(placed.items()), schema)
    where = if_small(store.put(where, "placed"))
    buckets = max(1, ceil(count / shards / BUCKET_ROWS))
    return numbered(
        named.join(where, "item").withColumn("bucket", F.pmod(part, F.lit(buckets)).cast("int")), store
    )


def numbered(rows: DataFrame, store: Store) -> DataFrame:
    """``slot`` within each ``shard``, gapless from 0: rank in the bucket after the buckets before."""
    rows = store.put(rows, "sharded")
    sizes = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    offsets = if_small(store.put(offsets, "offsets"))
    order = Window.partitionBy("shard", "bucket").orderBy("group", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).alias("slot")
    )
