"""Feature matrix of the engagement panel.

All per-customer windows share one partitioning and one sort. A customer's group
holds one row per period (the panel key is unique), so its size is bounded by
the calendar, not by activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, MODEL_FEATURES, SEGMENT_COLUMNS, Settings
from holdfast.functions.columns import (
    adoption_rate,
    flag,
    health_score,
    recency_category,
    recency_score,
)

LABEL_COLUMNS = ("customer_id", "period", "churned")
FEATURE_COLUMNS = LABEL_COLUMNS + MODEL_FEATURES + SEGMENT_COLUMNS
ROLLING = {
    "logins_3m_avg": "logins_per_day",
    "api_calls_3m_avg": "api_calls",
    "features_3m_avg": "features_used_count",
}
RISK_FLAGS = (
    "flag_no_login_30days",
    "flag_low_feature_adoption",
    "flag_high_support_tickets",
    "flag_declining_engagement",
)


def in_time() -> WindowSpec:
    return Window.partitionBy("customer_id").orderBy("period")


def enrich(panel: DataFrame, customers: DataFrame) -> DataFrame:
    """Inner join on the customer; Spark broadcasts customers only while they are small."""
    return panel.join(customers.select("customer_id", *SEGMENT_COLUMNS), "customer_id")


# Each step is a set of column expressions; steps that do not depend on each other
# are added in one projection.


def rolling(cfg: Settings = DEFAULT) -> dict[str, Column]:
    """Means over the current and the preceding rows; raw value when all are missing."""
    last_rows = in_time().rowsBetween(1 - cfg.window_rows, 0)
    return {
        name: F.coalesce(F.avg(source).over(last_rows), F.col(source).cast("double"))
        for name, source in ROLLING.items()
    }


def decay() -> dict[str, Column]:
    """Change of the engagement score since the previous row; 0 when there is none."""
    change = F.col("engagement_score") - F.lag("engagement_score").over(in_time())
    return {"engagement_decay": F.coalesce(change, F.lit(0.0))}


def recency() -> dict[str, Column]:
    days = F.col("days_since_last_login")
    return {
        "days_inactive": days,
        "recency_category": recency_category(days),
        "recency_score": recency_score(days),
    }


def adoption(cfg: Settings = DEFAULT) -> dict[str, Column]:
    rate = adoption_rate(F.col("features_used_count"), cfg)
    return {
        "feature_adoption_rate": rate,
        "is_high_adoption": flag(rate > cfg.high_adoption_above),
        "is_low_adoption": flag(rate < cfg.low_adoption_below),
    }


def risk_flags(cfg: Settings = DEFAULT) -> dict[str, Column]:
    """Needs the recency, adoption and trend columns."""
    tests = {
        "flag_no_login_30days": F.col("days_inactive") >= cfg.inactive_after,
        "flag_no_login_60days": F.col("days_inactive") >= cfg.severely_inactive_after,
        "flag_low_feature_adoption": F.col("feature_adoption_rate") < cfg.low_adoption_below,
        "flag_high_support_tickets": F.col("support_tickets") >= cfg.many_tickets_from,
        "flag_declining_engagement": F.col("logins_trend_3m") < cfg.declining_below,
    }
    return {name: flag(test) for name, test in tests.items()}


def composites(corrected_health: bool = False) -> dict[str, Column]:
    """Count of four flags (the 60-day one repeats the 30-day one) and the health score."""
    count: Column = F.col(RISK_FLAGS[0])
    for name in RISK_FLAGS[1:]:
        count = count + F.col(name)
    health = health_score(
        F.col("recency_score"),
        F.col("feature_adoption_rate"),
        F.col("engagement_decay"),
        F.col("support_tickets"),
        corrected_health,
    )
    return {"risk_flag_count": count, "health_score": health}


POSITION = ("_number", "_history")


def position() -> dict[str, Column]:
    """Row number and length of each customer's history, for the trend."""
    whole = Window.partitionBy("customer_id")
    return {"_number": F.row_number().over(in_time()), "_history": F.count("*").over(whole)}


def _trend(df: DataFrame, cfg: Settings, point_in_time: bool) -> DataFrame:
    """Add ``logins_trend_3m`` to rows with a position. Rows that are only the end of a history
    bring its first logins in ``_oldest``."""
    k = cfg.window_rows
    number, history, logins = F.col("_number"), F.col("_history"), F.col("logins_per_day")
    if point_in_time:
        history = number
        so_far = in_time().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({
            "_recent": F.avg(logins).over(in_time().rowsBetween(1 - k, 0)),
            "_past": F.avg(logins).over(in_time().rowsBetween(1 - 2 * k, -k)),
            "_oldest": F.first(logins).over(so_far),
        })
    else:
        everything = Window.partitionBy("customer_id")
        recent = number > history - k
        past = (number > history - 2 * k) & (number <= history - k)
        df = df.withColumns({
            "_recent": F.avg(F.when(recent, logins)).over(everything),
            "_past": F.avg(F.when(past, logins)).over(everything),
            "_oldest": F.col("_oldest") if "_oldest" in df.columns
            else F.max(F.when(number == 1, logins)).over(everything),
        })
    base = F.when(history >= 2 * k, F.col("_past")).otherwise(F.col("_oldest"))
    trend = F.when(base > 0, (F.col("_recent") - base) / base).otherwise(0.0)
    return df.withColumn("logins_trend_3m", trend).drop(*POSITION, "_recent", "_past", "_oldest")


def with_login_trend(
    df: DataFrame, cfg: Settings = DEFAULT, point_in_time: bool = False
) -> DataFrame:
    """Relative change of logins, the last rows against the rows before them.

    By default each customer's *whole* history gives one value, repeated on every
    row. ``point_in_time=True`` looks back from each row instead, which keeps
    later months out of training rows.
    """
    return _trend(df.withColumns(position()), cfg, point_in_time)


def panel_features(
    panel: DataFrame,
    cfg: Settings = DEFAULT,
    point_in_time: bool = False,
    corrected_health: bool = False,
) -> DataFrame:
    """Every derived column, on top of the panel columns."""
    independent = rolling(cfg) | decay() | recency() | adoption(cfg) | position()
    df = _trend(panel.withColumns(independent), cfg, point_in_time)
    return df.withColumns(risk_flags(cfg)).withColumns(composites(corrected_health))


def features_of_last_rows(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Every derived column of rows that end their customer's history, right for the last ones.

    The rows have ``_number``, ``_history`` and ``_oldest`` and reach back as far as the windows do.
    """
    df = _trend(rows.withColumns(rolling(cfg) | decay() | recency() | adoption(cfg)), cfg, False)
    return df.withColumns(risk_flags(cfg)).withColumns(composites())


def feature_matrix(
    panel: DataFrame, customers: DataFrame, cfg: Settings = DEFAULT, **options: bool
) -> DataFrame:
    """The 29 columns used for training, scoring and analysis."""
    return panel_features(enrich(panel, customers), cfg, **options).select(*FEATURE_COLUMNS)


def model_columns(df: DataFrame, existing_only: bool = False) -> list[str]:
    """The 22 model inputs, by name; absent ones are skipped or refused."""
    present = [c for c in MODEL_FEATURES if c in df.columns]
    if not existing_only and len(present) < len(MODEL_FEATURES):
        raise ValueError(f"Missing model features: {sorted(set(MODEL_FEATURES) - set(present))}")
    return present


def fill_with_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scoring policy for missing inputs."""
    return df.na.fill(0, subset=columns)


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Analysis policy for missing inputs: the column mean, in one extra scan."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in columns})


def latest_period(df: DataFrame) -> DataFrame:
    """Rows of the greatest period."""
    latest = df.agg(F.max("period").alias("latest")).scalar()
    return df.where(F.col("period") == latest)
