"""Distributed ranks and statistics against pandas, with ties, nulls and a hot value."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators import stats
from holdfast.operators.rank import descending, global_rank, running_totals

ROWS = 3000


@pytest.fixture(scope="module")
def frame():
    draw = np.random.default_rng(7)
    value = np.where(draw.random(ROWS) < 0.4, 7.0, draw.normal(size=ROWS).round(2))
    pdf = pd.DataFrame({"id": np.arange(ROWS), "g": draw.integers(0, 3, ROWS), "v": value})
    pdf.loc[::50, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.repartition(7).persist()


@pytest.mark.parametrize("within", [[], ["g"]])
@pytest.mark.parametrize("ties", ["first", "min"])
def test_global_rank(table, frame, within, ties):
    ranked = global_rank(table, "r", [descending(F.col("v"))], ["id"], ties, within)
    found = ranked.select("id", "r").toPandas().set_index("id")["r"].sort_index()
    keyed = frame.assign(s=-frame.v.fillna(-1e9)).sort_values(["s", "id"])
    series = keyed.groupby("g").s if within else keyed.s
    wanted = series.rank(method=ties).sort_index()
    assert (found.to_numpy() == wanted.to_numpy()).all()


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_rank_does_not_depend_on_partitions(spark, table, frame, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ranked = global_rank(table, "r", [descending(F.col("v"))], ["id"], "min")
        found = ranked.select("id", "r").toPandas().set_index("id")["r"].sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = (-frame.v.fillna(-1e9)).rank(method="min")
    assert (found.to_numpy() == wanted.to_numpy()).all()


def test_hot_value_is_spread_over_ranges(spark):
    """A value shared by most rows is ranked in several tasks."""
    same = spark.range(5000).withColumn("v", F.lit(1.0))
    ranked = global_rank(same, "r", [descending(F.col("v"))], ["id"])
    sizes = ranked.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert ranked.agg(F.countDistinct("r")).first()[0] == 5000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number()" in plan and "windowspecdefinition(_range" in plan
    assert len(sizes) >= 1
    tied = global_rank(same, "r", [descending(F.col("v"))], ["id"], "min")
    assert tied.agg(F.max("r")).first()[0] == 1


def test_rank_of_an_empty_table(table):
    nothing = table.where("id < 0")
    for ties in ("first", "min"):
        assert global_rank(nothing, "r", [descending(F.col("v"))], ["id"], ties).count() == 0


def test_unknown_ties_are_refused(table):
    with pytest.raises(ValueError, match="dense"):
        global_rank(table, "r", [F.col("v")], ["id"], "dense")


def test_running_totals(table, frame):
    counts = table.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    found = running_totals(counts, [F.col("v")], ["n"]).toPandas().sort_values("v")
    sizes = frame.v.dropna().value_counts().sort_index()
    wanted = sizes.cumsum().shift(fill_value=0)
    assert (found["n_before"].to_numpy() == wanted.to_numpy()).all()


def test_quantiles_interpolate(table, frame):
    asked = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = stats.exact_quantiles(table, "v", asked, ["g"]).toPandas().set_index("g").sort_index()
    wanted = frame.groupby("g").v.quantile(list(asked.values())).unstack()
    assert np.allclose(found.to_numpy(), wanted.to_numpy())
    whole = stats.exact_quantiles(table, "v", asked).toPandas().to_numpy()[0]
    assert np.allclose(whole, frame.v.quantile(list(asked.values())))


@pytest.mark.parametrize("largest", (50, stats.BRACKET))
def test_bracketed_quantiles_are_exact(spark, largest):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 40_000), "v": rng.normal(size=40_000)})
    frame.loc[rng.random(40_000) < 0.3, "v"] = 0.25  # a value with a third of all rows
    frame.loc[frame.g == 2, "v"] = frame.v.round(1)
    frame.loc[rng.random(40_000) < 0.1, "v"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    rows = rows.union(spark.createDataFrame([(7, 3.5), (8, None)], "g long, v double"))
    asked = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    wanted = stats.exact_quantiles(rows, "v", asked, ["g"]).orderBy("g").collect()
    found = stats.bracketed_quantiles(rows, "v", asked, ["g"], largest)
    assert found.orderBy("g").collect() == wanted and len(wanted) == 4
    whole = stats.bracketed_quantiles(rows, "v", asked, (), largest).collect()
    assert whole == stats.exact_quantiles(rows, "v", asked).collect()
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert stats.bracketed_quantiles(rows.where("g = 8"), "v", asked, ["g"]).collect() == []


def test_a_rank_outside_its_bracket_is_found_all_the_same(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000 * 1.0).alias("v"))
    monkeypatch.setattr(stats, "RANK_ERROR", -0.01)  # brackets that miss
    assert stats.bracketed_quantiles(rows, "v", {"m": 0.5}).first()["m"] == 2499.5


def test_describe(table, frame):
    found = stats.describe(table, ["v"]).toPandas().iloc[0]
    wanted = frame.v.describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%",
             "p50": "50%", "p75": "75%", "max": "max"}
    for ours, theirs in names.items():
        assert found[ours] == pytest.approx(wanted[theirs])


def test_histogram_like_numpy(table, frame):
    found = stats.histogram(table, "v", 6).toPandas().sort_values("bin")
    counts, edges = np.histogram(frame.v.dropna(), 6)
    assert found["n"].tolist() == counts.tolist()
    assert np.allclose(found["bin_start"], edges[:-1])


def test_histogram_of_a_constant(spark):
    found = stats.histogram(spark.range(4).withColumn("v", F.lit(2.0)), "v", 4).toPandas()
    counts, edges = np.histogram([2.0] * 4, 4)
    found = found.sort_values("bin")
    assert found["n"].tolist() == counts.tolist()
    assert np.allclose(found["bin_end"], edges[1:])


def test_correlation_skips_nulls_and_constants(table, frame):
    wide = table.withColumn("k", F.lit(1))
    found = {(r["left"], r["right"]): r["corr"]
             for r in stats.correlations(wide, [("v", "id"), ("v", "k"), ("v", "v")]).collect()}
    assert found["v", "id"] == pytest.approx(frame.v.corr(frame.id))
    assert found["v", "k"] is None
    assert found["v", "v"] == pytest.approx(1.0)
