"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (data folder), BENCH_CPUS (local cores) and BENCH_RUNS (best of n)
may be set in the environment. Every query writes all its rows to a no-op sink.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.plans.catalog import CATALOG  # noqa: E402
from holdfast.plans.pipeline import RetentionJob, load_inputs  # noqa: E402
from holdfast.plans.workspace import Workspace  # noqa: E402
from holdfast.sources import tables  # noqa: E402

HEADLINES = (
    "engagement_enriched", "feature_matrix", "score_customers", "score_all_periods", "risk_rank",
    "revenue_rank", "prescriptions", "journey_summary", "journey_timeline", "priority_customers",
    "kpi_summary", "describe_features", "boxplot_stats", "correlation_matrix", "roc_auc",
    "calibration_deciles", "explanation_summary", "monitoring_checks", "uncontacted_high_risk",
    "ingest_dedup",
)


def session(cpus: str, shared: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("holdfast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def daily_job(spark: SparkSession, sf_dir: str) -> float:
    """Ingest the panel, then time all steps of one day on stored tables."""
    w = Workspace(spark, sf_dir)
    root = f"{tables.shared_folder(spark)}/retention"
    load_inputs(spark, root, w.panel, w.customers)
    last_day = w.panel.agg(F.max("period")).first()[0]
    job = RetentionJob(spark, root)
    return timed(lambda: job.run(F.lit(last_day).cast("timestamp")))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    shared = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = session(cpus, shared)
    CATALOG["feature_matrix"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINES:
        def run(build=CATALOG[name]):
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()

        times[name] = min(timed(run) for _ in range(runs))
    times["daily_job"] = daily_job(spark, sf_dir)
    print(json.dumps({
        "metric": "retention_headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
