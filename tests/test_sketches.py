"""Distinct counts from sketches: near the exact ones, for any span, from one row per period."""

from __future__ import annotations

from conftest import panel_row
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import sketches
from holdfast.plans.pipeline import RetentionJob


def test_unions_are_within_the_error_of_the_exact_count(spark):
    rows = spark.range(300_000).select((F.col("id") % 70_000).alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("shop"))
    stored = sketches.per_group(rows, "k", "day", "shop")
    for spanned, exact in ((stored, 70_000), (stored.where("day < 2"), rows.where("day < 2").select("k").distinct().count())):
        found = sketches.distinct(spanned).first()["distinct"]
        assert abs(found - exact) < 4 * 1.04 / 2**6 * exact
    assert sketches.distinct(stored).first()["rows"] == 300_000
    per_shop = {r["shop"]: r["distinct"] for r in sketches.distinct(stored, "shop").collect()}
    assert len(per_shop) == 3 and all(abs(n - 70_000) < 4500 for n in per_shop.values())
    assert sketches.distinct(stored.limit(0)).first()["distinct"] == 0


def test_small_counts_are_exact_and_follow_new_rows(spark, tmp_path):
    names = schemas.ENGAGEMENT.fieldNames()
    panel = lambda *given: spark.createDataFrame([tuple(panel_row(*g)[n] for n in names) for g in given], schemas.ENGAGEMENT)
    job = RetentionJob(spark, str(tmp_path), buckets=2)
    job.add_engagement(panel(*[(f"C{i}", "2024-01") for i in range(50)], *[(f"C{i}", "2024-02") for i in range(40, 80)]))
    job.update_sketches()
    assert job.distinct_customers("2024-01", "2024-02").first()["distinct"] == 80
    job.add_engagement(panel(("late", "2024-01"), ("new", "2024-03")))
    job.update_sketches()
    assert job.distinct_customers("2024-01", "2024-01").first().asDict() == {"distinct": 51, "rows": 51}
    assert job.distinct_customers("2024-02", "2024-03").first()["distinct"] == 41
    version = job.table("customer_sketches").version()
    job.update_sketches()
    assert job.table("customer_sketches").version() == version
