"""Global ranks and running totals without a single-task window.

An unpartitioned window sorts the whole table in one task. Here the sort key
space is cut into ranges of about equal size, every range is ranked on its own,
and the sizes of the preceding ranges are added. The cuts come from a small
sample picked by hash of the key, not at random, so every scan of the input
assigns every row to the same range, also after a lost executor.

The cut key ends in the row's id. A single value shared by a third of all rows
is therefore spread over many ranges like any other part of the key space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_RANGE = 20
LARGEST_SAMPLE = 100_000
HELPERS = ("_group", "_key", "_range")


def descending(value: Column) -> Column:
    """Sort key for a numeric measure: greatest first, nulls last.

    NaN sorts after every number; measures have null instead of NaN since ingestion.
    """
    return F.coalesce(-value.cast("double"), F.lit(float("nan")))


def _cuts(
    keyed: DataFrame, tie_starts: bool, width: int, ranges: int, drawn_by: Sequence[str] = ()
) -> Column:
    """Range starts, sorted and chunked into arrays of ``width``, as a scalar subquery.

    ``drawn_by`` columns join the hash that picks the sample. Naming the columns
    that the rest of the plan reads lets Spark reuse one shuffle for both.
    """
    size = min(ranges * SAMPLE_PER_RANGE, LARGEST_SAMPLE)
    step = max(1, size // ranges)
    draw = F.xxhash64("_key", *drawn_by)
    sample = keyed.orderBy(draw, "_key").limit(size).select("_key")
    cuts = sample.agg(F.sort_array(F.collect_list("_key")).alias("cuts")).select(
        F.filter("cuts", lambda _, i: i % step == step - 1).alias("cuts")
    )
    if tie_starts:
        # The start of a sampled value is a cut too: a range then begins either
        # at the start of a value or inside one. Null ids sort first.
        fields = sample.schema["_key"].dataType
        before_ids = F.transform("cuts", lambda k: _blank(k, fields))
        cuts = cuts.select(F.sort_array(F.array_distinct(F.concat("cuts", before_ids))).alias("cuts"))
    numbers = F.sequence(F.lit(0), F.greatest(F.size("cuts") - 1, F.lit(0)), F.lit(width))
    chunks = F.transform(numbers, lambda i: F.slice("cuts", i + 1, width))
    return cuts.select(F.filter(chunks, lambda c: F.size(c) > 0)).scalar()


def _blank(key: Column, fields: T.StructType) -> Column:
    """The key without its row id."""
    return F.struct(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name.startswith("id")
        else key[f.name].alias(f.name)
        for f in fields
    ])


def _named(prefix: str, columns: Sequence[Column]) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


class _Ranges:
    """Rows with their sort key and range number, and the totals of every range."""

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[Column],
        row_id: Sequence[str],
        within: Sequence[str],
        tie_starts: bool = False,
        drawn_by: Sequence[str] = (),
    ):
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.width = max(2, int(ranges**0.5))
        self.groups = [f"g{i}" for i in range(len(within))]
        self.values = [f"k{i}" for i in range(len(by))]
        # One flat struct: comparing it is several times cheaper than a nested one.
        parts = _named("g", [F.col(c) for c in within]) + _named("k", by)
        parts += _named("id", [F.col(c) for c in row_id])
        group = F.struct(*within) if within else F.struct(F.lit(0).alias("all"))
        keyed = df.withColumns({"_group": group, "_key": F.struct(*parts)})
        self.cuts = _cuts(keyed, tie_starts, self.width, ranges, drawn_by)
        self.rows = self._numbered(keyed)

    def _numbered(self, keyed: DataFrame) -> DataFrame:
        """Find the chunk first, then the cut in it: 2 * sqrt(ranges) comparisons a row.

        Each step is a column of its own, so that none is computed twice, and the
        number is never null, so a join on it needs no filter that repeats the search.
        """
        key = F.col("_key")
        keyed = keyed.withColumn("_chunks", self.cuts)
        keyed = keyed.withColumn(
            "_chunk", F.size(F.filter("_chunks", lambda c: F.get(c, F.lit(0)) <= key))
        )
        inside = F.filter(F.get("_chunks", F.col("_chunk") - 1), lambda cut: cut <= key)
        number = F.when(F.col("_chunk") > 0, (F.col("_chunk") - 1) * self.width + F.size(inside))
        return keyed.withColumn("_range", F.coalesce(number, F.lit(0))).drop("_chunks", "_chunk")

    def totals(self, *sums: Column) -> DataFrame:
        """One row per range and group: at most ranges + groups rows."""
        return self.rows.groupBy("_range", "_group").agg(*sums)

    def start_value(self) -> Column:
        """Of a totals row: the sort value at which its range starts, if in its group."""
        place = F.col("_range") - 1
        chunk = F.get("_chunks", F.floor(place / self.width).cast("int"))
        cut = F.get(chunk, F.pmod(place, F.lit(self.width)))
        same_group = F.lit(True)
        for field, name in zip(self.groups, self._group_fields()):
            same_group = same_group & cut[field].eqNullSafe(F.col("_group")[name])
        return F.when(same_group, F.struct(*[cut[v].alias(v) for v in self.values]))

    def _group_fields(self) -> list[str]:
        return self.rows.schema["_group"].dataType.fieldNames()

    def value(self) -> Column:
        return F.struct(*[F.col("_key")[v].alias(v) for v in self.values])


def _before(name: str) -> Column:
    """Sum of a per-range total over the preceding ranges of the group."""
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return F.coalesce(F.sum(name).over(earlier), F.lit(0))


def global_rank(
    df: DataFrame,
    name: str,
    by: Sequence[Column],
    row_id: Sequence[str],
    ties: str = "first",
    within: Sequence[str] = (),
) -> DataFrame:
    """Add a 1-based rank over the whole table, or over each ``within`` group.

    ``by`` are ascending sort keys. ``ties="first"`` numbers equal values by
    ``row_id``; ``ties="min"`` gives equal values their lowest position. The
    input is read three times (sample, range sizes, rows): pass a stored table.
    """
    if ties not in ("first", "min"):
        raise ValueError(f"unknown ties: {ties}")
    ranges = _Ranges(df, by, row_id, within, tie_starts=ties == "min")
    sizes = ranges.totals(F.count("*").alias("_rows")).withColumn("_offset", _before("_rows"))
    if ties == "min":
        sizes = sizes.withColumn("_chunks", ranges.cuts)
        sizes = sizes.withColumn("_start", ranges.start_value())
        same_start = Window.partitionBy("_group", "_start")
        sizes = sizes.withColumn("_first_offset", F.min("_offset").over(same_start))
    sizes = sizes.drop("_rows", "_chunks")

    in_range = Window.partitionBy("_range", "_group")
    joined = ranges.rows.join(sizes, ["_range", "_group"])
    if ties == "first":
        position = F.row_number().over(in_range.orderBy("_key")) + F.col("_offset")
    else:
        by_value = in_range.orderBy(*[F.col("_key")[v] for v in ranges.values])
        local = F.rank().over(by_value) + F.col("_offset")
        continues = F.col("_start") == ranges.value()
        position = F.when(continues, F.col("_first_offset") + 1).otherwise(local)
    ranked = joined.withColumn(name, position.cast("long"))
    return ranked.drop(*HELPERS, "_offset", "_first_offset", "_start")


def running_totals(
    df: DataFrame, by: Sequence[Column], totals: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Add ``<total>_before``: the sum over all rows that sort earlier.

    The rows must have distinct sort keys inside a group, as after a groupBy.
    """
    ranges = _Ranges(df, by, (), within, drawn_by=totals)
    sums = ranges.totals(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    offsets = sums.select(
        "_range", "_group", *[_before(f"_sum_{t}").alias(f"_offset_{t}") for t in totals]
    )
    earlier = Window.partitionBy("_range", "_group").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = ranges.rows.join(offsets, ["_range", "_group"]).withColumns({
        f"{t}_before": F.coalesce(F.sum(t).over(earlier), F.lit(0)) + F.col(f"_offset_{t}")
        for t in totals
    })
    return joined.drop(*HELPERS, *[f"_offset_{t}" for t in totals])
