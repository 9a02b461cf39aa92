"""Exact descriptive statistics that scale: quantiles, histograms, correlations.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. The
quantiles here count distinct values first (copies collapse on the map side) and
read the wanted positions off running totals, so no task holds a whole column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.rank import running_totals
from holdfast.sources import tables


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): keep..., metric, value (double)."""
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per probability."""
    return quantiles_of_counts(counted(df, value, within), value, probabilities, within)


def as_is(df: DataFrame) -> DataFrame:
    return df


def counted(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Every known value of a group once, with its number ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("n"))


def quantiles_of_counts(
    counts: DataFrame, value: str, probabilities: dict[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """The quantiles of values that are counted already.

    ``within`` may have any number of groups: their totals join without a forced broadcast.
    """
    placed = running_totals(counts, [F.col(value)], ["n"], within)
    totals = counts.groupBy(*within).agg(F.sum("n").alias("total"))
    if within:
        placed = placed.join(totals, list(within))
    else:
        placed = placed.withColumn("total", totals.scalar())

    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    picks = []
    for name, p in probabilities.items():
        position = (F.col("total") - 1) * F.lit(p)
        picks += [
            at(F.floor(position)).alias(f"_low_{name}"),
            at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    found = placed.groupBy(*within).agg(*picks)
    return found.select(
        *within,
        *[
            (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}"))
            .alias(n)
            for n in probabilities
        ],
    )


#: Size of a quantile sketch, its rank error with room to spare (99 % stay below a third of it), and
#: the steps of rank at which it is read.
SKETCH, RANK_ERROR, STEPS = 2000, 0.008, 500
#: Distinct values of a bracket that one task sorts at the end.
BRACKET = 200_000


def bracketed_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], within: Sequence[str] = (), largest: int = BRACKET
) -> DataFrame:
    """As ``exact_quantiles``, without sorting or shuffling all values.

    A mergeable sketch per group brackets each wanted rank between two values. The next scan counts what is below
    and keeps the values inside, each once with its number. While a bracket has more than ``largest``
    distinct values a sketch of what is inside brackets it again; then the rank is read off its running count.
    A rank that a sketch has put outside its bracket is told by the exact counts, and then all ranks are read
    off the whole counts. ``df`` is scanned twice for each bracketing: pass a stored table.
    """
    by = [*within, "_all"]
    keys = [*by, "quantile"]
    rows = df.where(F.col(value).isNotNull()).select(*within, F.lit(0).alias("_all"), F.col(value).cast("double").alias("value"))
    names = F.array(*[F.struct(F.lit(n).alias("quantile"), F.lit(p).alias("p")) for n, p in probabilities.items()])
    sizes = _sketched(rows, by).select("*", F.explode(names).alias("q")).select("*", "q.*").drop("q")
    position = (F.col("rows") - 1) * F.col("p")
    wanted = sizes.withColumns({
        "offset": F.lit(0), "low_rank": F.floor(position), "high_rank": F.ceil(position),
        "part": position - F.floor(position),
    })
    brackets, inside, most = _bracket(rows, wanted, by, keys)
    while most > largest:
        near = rows.join(brackets, by).where(F.col("value").between(F.col("lo"), F.col("hi")))
        wanted = _sketched(near, keys).join(brackets.drop("lo", "hi"), keys)
        before = most
        brackets, inside, most = _bracket(rows, wanted, by, keys)
        if most >= before:  # the sketch can tell no more
            break
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value")) + F.col("offset")
    placed = inside.join(brackets, keys).withColumn("upto", upto)
    here = lambda rank: (F.col("upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    low, high = (F.max(F.when(here(r), F.col("value"))).alias(a) for r, a in (("low_rank", "low"), ("high_rank", "high")))
    told = brackets.select(*keys, "part").join(placed.groupBy(*keys).agg(low, high), keys, "left")
    read = tables.stored(told, "quantiles")
    if read.where("low is null or high is null").limit(1).count():
        return exact_quantiles(df, value, probabilities, within)
    found = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    one = lambda n: F.max(F.when(F.col("quantile") == n, found)).alias(n)
    return read.groupBy(*within).agg(*map(one, probabilities))


def _sketched(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``sketch``, number of ``rows``, ``least`` and ``most`` value of each group; partial sketches meet in the shuffle."""
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"), F.count(F.lit(1)).alias("rows"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )


def _bracket(
    rows: DataFrame, wanted: DataFrame, by: Sequence[str], keys: Sequence[str]
) -> tuple[DataFrame, DataFrame, int]:
    """Brackets with the number of rows below (``offset``), the values inside with their number ``n``,
    and how many distinct values the largest bracket has. Both tables are stored."""

    def step(rank: str, side: int) -> Column:
        return ((F.col(rank) - F.col("offset")) / F.col("rows") + F.lit(side * RANK_ERROR)) * STEPS

    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    low, high = F.floor(step("low_rank", -1)).cast("int"), F.ceil(step("high_rank", 1)).cast("int")
    ends = tables.stored(wanted.withColumn("grid", grid).withColumns({
        "lo": F.when(low <= 0, F.col("least")).otherwise(F.get("grid", low)),
        "hi": F.when(high >= STEPS, F.col("most")).otherwise(F.get("grid", high)),
    }).select(*keys, "lo", "hi", "low_rank", "high_rank", "part"), "ends")
    kept = F.when(F.col("value") >= F.col("lo"), F.col("value"))  # one null for all that is below
    counted = rows.join(ends, list(by)).where(F.col("value") <= F.col("hi")).groupBy(*keys, kept.alias("value"))
    counted = tables.stored(counted.agg(F.count(F.lit(1)).alias("n")), "bracketed")
    sums = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("offset"), F.count("value").alias("distinct")
    )
    brackets = ends.join(sums, list(keys), "left").fillna(0, ["offset", "distinct"])
    brackets = tables.stored(brackets, "brackets")
    most = brackets.agg(F.max("distinct")).first()[0] or 0
    return brackets.drop("distinct"), counted.where("value is not null"), most


def shares(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows and share of each value. The total is summed over the few grouped rows,
    so the input is read once."""
    counts = df.groupBy(column).agg(F.count("*").alias(name))
    total = F.sum(name).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col(name) / total)


def describe(df: DataFrame, columns: Sequence[str], keep: Callable = as_is) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column, one row a column.

    The rows are read once, into counts of values; ``keep`` may store those, since moments and
    quartiles both read them.
    """
    counts = keep(counted(to_long(df, columns), "value", ["metric"]))
    n, value = F.col("n"), F.col("value")
    means = counts.groupBy("metric").agg((F.sum(n * value) / F.sum(n)).alias("mean"))
    around = counts.join(F.broadcast(means), "metric")  # one row per column
    squares = F.sum(n * (value - F.col("mean")) ** 2)
    moments = around.groupBy("metric").agg(
        F.sum(n).alias("count"),
        F.max("mean").alias("mean"),
        F.when(F.sum(n) > 1, F.sqrt(squares / (F.sum(n) - 1))).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = quantiles_of_counts(
        counts, "value", {"p25": 0.25, "p50": 0.50, "p75": 0.75}, ["metric"]
    )
    found = moments.join(quartiles, "metric")
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "metric string")
    return names.join(F.broadcast(found), "metric", "left").select(
        "metric", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def boxplot(df: DataFrame, column: str, group: str, keep: Callable = as_is) -> DataFrame:
    """Quartiles, IQR and the outermost values inside 1.5 IQR, per group; ``keep`` as in ``describe``."""
    values = df.select(F.col(group).alias("group_value"), F.col(column).cast("double").alias("value"))
    counts = keep(counted(values, "value", ["group_value"]))
    box = quantiles_of_counts(counts, "value", {"q1": 0.25, "median": 0.50, "q3": 0.75}, ["group_value"])
    box = box.withColumn("iqr", F.col("q3") - F.col("q1"))
    low = F.col("q1") - F.col("iqr") * 1.5
    high = F.col("q3") + F.col("iqr") * 1.5
    inside = (F.col("value") >= low) & (F.col("value") <= high)
    fenced = counts.join(box, "group_value")
    return fenced.groupBy("group_value", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def histograms(
    df: DataFrame,
    columns: Sequence[str],
    bins: int,
    group: str | None = None,
    groups: Sequence = (),
) -> DataFrame:
    """Equal-width counts of each column over the range of all its rows.

    Bins are closed on the left, the last one on both sides; empty bins are kept.
    A constant column gets a range of width one around its value. ``groups`` are
    the values of ``group`` to show, known in advance. What is broadcast has one
    row per column.
    """
    keep = [group] if group else []
    cells = to_long(df, columns, keep).where(F.col("value").isNotNull())
    half = F.when(F.min("value") == F.max("value"), 0.5).otherwise(0.0)
    spans = cells.groupBy("metric").agg(
        (F.min("value") - half).alias("low"), (F.max("value") + half).alias("high")
    )
    width = F.col("high") - F.col("low")
    index = F.floor((F.col("value") - F.col("low")) / width * bins)
    placed = cells.join(F.broadcast(spans), "metric")
    counted = placed.groupBy(*keep, "metric", F.least(index, F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n")
    )
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if group:
        frame = frame.withColumn(group, F.explode(F.array(*[F.lit(g) for g in groups])))
    return frame.join(counted, [*keep, "metric", "bin"], "left").select(
        "metric",
        *keep,
        "bin",
        (F.col("low") + F.col("bin") * (width / bins)).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * (width / bins)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(
    df: DataFrame, column: str, bins: int, group: str | None = None, groups: Sequence = ()
) -> DataFrame:
    return histograms(df, [column], bins, group, groups).drop("metric")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson coefficient of each pair in one scan; null when a column is constant."""
    one = df.agg(*[_pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*cells)))


def _pearson(a: str, b: str) -> Column:
    """Over the rows where both are known; ``corr`` itself fails on a zero deviation."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)
