"""Run statistics, drift between runs, distribution checks and the metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, RISK_TIERS, Settings
from holdfast.functions.columns import decimals, percent, ratio

LOW, MEDIUM, HIGH = RISK_TIERS
#: What makes a row of the metric log, with its day.
METRIC_KEY = ("metric_type", "metric_name")


def latest_run(predictions: DataFrame) -> DataFrame:
    """Rows of the last run. On a partitioned table only its folder is read."""
    latest = predictions.agg(F.max("prediction_date").alias("latest")).scalar()
    return predictions.where(F.col("prediction_date") == latest)


def last_runs(predictions: DataFrame, runs: int) -> DataFrame:
    """Rows of the last runs. On a partitioned table only their folders are read: the dates come
    from the folder names, and the oldest of them is a filter known when the scan starts."""
    dates = predictions.select("prediction_date").distinct()
    newest = dates.orderBy(F.desc("prediction_date")).limit(runs)
    oldest = newest.agg(F.min("prediction_date").alias("oldest")).scalar()
    return predictions.where(F.col("prediction_date") >= oldest)


def per_run(predictions: DataFrame) -> DataFrame:
    """One row per run date."""
    p, tier = F.col("churn_probability"), F.col("risk_tier")
    return predictions.groupBy("prediction_date").agg(
        F.count("*").alias("total_predictions"),
        F.avg(p).alias("avg_churn"),
        F.min(p).alias("min_churn"),
        F.max(p).alias("max_churn"),
        F.count_if(tier == HIGH).alias("high_risk_count"),
        F.count_if(tier == MEDIUM).alias("medium_risk_count"),
        F.count_if(tier == LOW).alias("low_risk_count"),
        F.sum("annual_revenue_at_risk").alias("total_revenue_at_risk"),
    )


def ledger_rows(predictions: DataFrame) -> DataFrame:
    """What a run's ledger row holds: all that monitors say of a run without its predictions."""
    more = predictions.groupBy("prediction_date").agg(F.sum("revenue_at_risk").alias("quarter_revenue_at_risk"))
    return per_run(predictions).join(more, "prediction_date")


def run_statistics(predictions: DataFrame) -> DataFrame:
    """Statistics of the last run."""
    return per_run(latest_run(predictions))


def run_history(predictions: DataFrame, runs: int = 5) -> DataFrame:
    """The last runs, newest first."""
    return history_of(ledger_rows(last_runs(predictions, runs)), runs)


def history_of(ledger: DataFrame, runs: int = 5) -> DataFrame:
    """The last runs, newest first, from ledger rows."""
    return ledger.orderBy(F.desc("prediction_date")).limit(runs).select(
        "prediction_date",
        F.col("total_predictions").alias("customer_count"),
        "high_risk_count",
        F.round("avg_churn", 4).alias("avg_churn_prob"),
        F.round("quarter_revenue_at_risk", 0).alias("total_revenue_at_risk"),
    ).orderBy(F.desc("prediction_date"))


def run_status(predictions: DataFrame, runs: int = 5) -> DataFrame:
    """Run history as report text, with the share of high-risk customers."""
    return status_of(run_history(predictions, runs))


def status_of(history: DataFrame) -> DataFrame:
    share = ratio(F.col("high_risk_count"), F.col("customer_count"))
    return history.select(
        "prediction_date",
        "customer_count",
        "high_risk_count",
        percent(F.col("avg_churn_prob")).alias("avg_churn_text"),
        F.concat(F.lit("$"), F.format_number("total_revenue_at_risk", 0)).alias("revenue_text"),
        percent(share).alias("high_risk_text"),
    )


def run_delta(predictions: DataFrame) -> DataFrame:
    """Mean probability of the last run next to the one before it."""
    return delta_of(per_run(last_runs(predictions, 2)))


def delta_of(runs: DataFrame) -> DataFrame:
    """The unpartitioned window sees two rows: the runs are aggregated and limited first."""
    means = runs.select("prediction_date", "avg_churn").orderBy(F.desc("prediction_date")).limit(2)
    by_run = Window.partitionBy(F.lit(0)).orderBy("prediction_date")
    return means.select(
        F.col("prediction_date").alias("latest_run"),
        F.lag("prediction_date").over(by_run).alias("previous_run"),
        F.col("avg_churn").alias("latest_avg"),
        F.lag("avg_churn").over(by_run).alias("previous_avg"),
        F.row_number().over(by_run).alias("_n"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("_runs"),
    ).where(F.col("_n") == F.col("_runs")).drop("_n", "_runs")


def drift(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Relative change of the mean probability; always one row, also without runs."""
    return drift_of(per_run(last_runs(predictions, 2)), cfg)


def drift_of(runs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    means = runs.select("prediction_date", "avg_churn").orderBy(F.desc("prediction_date")).limit(2)
    two = means.agg(
        F.sort_array(F.collect_list(F.struct("prediction_date", "avg_churn")), asc=False)
        .alias("runs")
    )
    latest, previous = F.get("runs", F.lit(0))["avg_churn"], F.get("runs", F.lit(1))["avg_churn"]
    change = F.abs(F.try_divide(latest - previous, previous))
    facts = two.select(F.size("runs").alias("n"), change.alias("change"))
    # The three message texts.
    message = (
        F.when(F.col("n") < 2, "Insufficient historical data (need 2+ runs)")
        .when(F.col("change").isNull(), "Insufficient data for comparison")
        .otherwise(F.concat(F.lit("Change: "), percent(F.col("change"), 2)))
    )
    return facts.select(
        F.coalesce(F.col("change") > cfg.drift_threshold, F.lit(False)).alias("is_drift"),
        F.coalesce("change", F.lit(0.0)).alias("pct_change"),
        message.alias("message"),
    )


def risk_anomaly(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Shares of high and medium risk in the last run against their limits."""
    return anomaly_of(per_run(latest_run(predictions)), cfg)


def anomaly_of(runs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Of the last of some runs; one row also without runs."""
    last = lambda name: F.max_by(name, "prediction_date")
    total = last("total_predictions")
    shares = runs.agg(
        F.coalesce(ratio(last("high_risk_count"), total), F.lit(0.0)).alias("high_pct"),
        F.coalesce(ratio(last("medium_risk_count"), total), F.lit(0.0)).alias("medium_pct"),
    )

    def warning(name: str, share: Column, limit: float) -> Column:
        text = F.concat(F.lit(f"{name} > {limit * 100:.0f}% (actual: "), percent(share), F.lit(")"))
        return F.when(share > limit, text)

    warnings = F.concat_ws(
        "; ",
        warning(HIGH, F.col("high_pct"), cfg.high_share_alert),
        warning(MEDIUM, F.col("medium_pct"), cfg.medium_share_alert),
    )
    return shares.select(
        (warnings != "").alias("is_anomaly"),
        "high_pct",
        "medium_pct",
        F.when(warnings == "", "Normal distribution").otherwise(warnings).alias("message"),
    )


# --- metric log -------------------------------------------------------------------------


def _metric(
    kind: str, name: str, value: Column, notes: Column, alert: Column | None = None
) -> Column:
    alert = F.lit(False) if alert is None else alert
    return F.struct(
        F.lit(kind).alias("metric_type"),
        F.lit(name).alias("metric_name"),
        value.cast("double").alias("metric_value"),
        F.when(alert, "alert").otherwise("normal").alias("status"),
        alert.alias("alert_flag"),
        notes.alias("notes"),
    )


def monitoring_checks(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The metric rows of one monitoring pass; the statistics rows need a run to exist."""
    return checks_of(per_run(last_runs(predictions, 2)), cfg)


def checks_of(runs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The metric rows from the rows of the last runs, two at least."""
    moved = drift_of(runs, cfg)
    drift_row = moved.select(
        _metric("prediction_drift", "daily_drift_detection", F.col("pct_change"),
                F.col("message"), F.col("is_drift")).alias("m")
    )
    shares = anomaly_of(runs, cfg)
    share_notes = F.concat(
        F.lit("High: "), percent(F.col("high_pct")),
        F.lit(", Medium: "), percent(F.col("medium_pct")),
    )
    share_row = shares.select(
        _metric("risk_distribution", "high_risk_percentage", F.col("high_pct"),
                share_notes, F.col("is_anomaly")).alias("m")
    )
    range_notes = F.concat(
        F.lit("Min: "), decimals(F.col("min_churn"), 4),
        F.lit(", Max: "), decimals(F.col("max_churn"), 4),
    )
    count_notes = F.concat(
        F.lit("High Risk: "), F.col("high_risk_count").cast("string"),
        F.lit(", Medium: "), F.col("medium_risk_count").cast("string"),
    )
    newest = runs.orderBy(F.desc("prediction_date")).limit(1)
    stat_rows = newest.select(
        F.explode(F.array(
            _metric("prediction_stats", "average_churn_probability", F.col("avg_churn"), range_notes),
            _metric("prediction_stats", "total_revenue_at_risk", F.col("total_revenue_at_risk"),
                    count_notes),
        )).alias("m")
    )
    return drift_row.unionByName(share_row).unionByName(stat_rows).select("m.*")


def metric_row(
    spark: SparkSession,
    metric_type: str,
    metric_name: str,
    metric_value: float,
    status: str = "normal",
    alert_flag: bool = False,
    notes: str = "",
) -> DataFrame:
    """A single check result, to be logged next to the others."""
    schema = ("metric_type string, metric_name string, metric_value double, status string, "
              "alert_flag boolean, notes string")
    row = (metric_type, metric_name, float(metric_value), status, alert_flag, notes)
    return spark.createDataFrame([row], schema)


def log_metrics(checks: DataFrame, as_of: Column) -> DataFrame:
    """Metric rows in the stored layout; ids repeat when a pass is run again on the same day."""
    day = F.date_format(as_of.cast("timestamp"), "yyyy-MM-dd")
    key = F.concat_ws("|", "metric_type", "metric_name", day)
    return checks.select(
        stable_id(key).alias("metric_id"),
        as_of.cast("date").alias("metric_date"),
        as_of.cast("timestamp").alias("metric_time"),
        "metric_type", "metric_name", "metric_value", "status", "alert_flag", "notes",
    )


def stable_id(key: Column) -> Column:
    """60-bit id from the MD5 of a text key, equal in every engine and on every run."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def model_health(checks: DataFrame) -> DataFrame:
    alerts = F.count_if("alert_flag")
    return checks.agg(
        F.when(alerts > 0, "ALERT").otherwise("HEALTHY").alias("model_status"),
        alerts.alias("alerts"),
    )
