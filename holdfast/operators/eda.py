"""Exploration tables of the panel and the feature matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import COMPANY_SIZES, RISK_TIERS, TIER_PRICES
from holdfast.functions.columns import percent, risk_segment
from holdfast.operators import stats

SEGMENTS = ("company_size", "subscription_tier", "industry")
LABEL_METRICS = (
    "logins_per_day", "features_used_count", "days_since_last_login", "engagement_score",
)
SEGMENT_MEANS = (
    "days_inactive", "feature_adoption_rate", "health_score", "risk_flag_count", "churned",
)
KEY_FEATURES = (
    "days_inactive", "feature_adoption_rate", "health_score", "logins_3m_avg", "logins_trend_3m",
)
MATRIX_COLUMNS = (
    "logins_per_day", "days_inactive", "feature_adoption_rate", "logins_trend_3m",
    "health_score", "risk_flag_count", "churned",
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name != "customer_id"
    ]


# --- churn by segment and time ---------------------------------------------------------


def churn_by(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(segment).agg(
        F.sum("churned").alias("churn_count"),
        F.avg("churned").alias("churn_rate"),
        F.count("*").alias("total_records"),
    )


def churn_by_segments(df: DataFrame) -> DataFrame:
    """Churn by size, tier and industry from one scan."""
    sets = [[F.col(s)] for s in SEGMENTS]
    grouped = df.groupingSets(sets, *SEGMENTS).agg(
        *[(F.grouping(s) == 0).alias(f"_{s}") for s in SEGMENTS],
        F.sum("churned").alias("churn_count"),
        F.avg("churned").alias("churn_rate"),
        F.count("*").alias("total_records"),
    )
    # the set that a row belongs to, not its value, names it: a null segment stays null
    name = F.coalesce(*[F.when(F.col(f"_{s}"), F.lit(s)) for s in SEGMENTS])
    return grouped.select(
        name.alias("segment"), F.coalesce(*SEGMENTS).alias("segment_value"),
        "churn_count", "churn_rate", "total_records",
    )


def churn_pivot(df: DataFrame) -> DataFrame:
    """Churn rate by size (rows) and tier (columns); the columns are known in advance."""
    return df.groupBy("company_size").pivot("subscription_tier", list(TIER_PRICES)).agg(
        F.avg("churned")
    )


def engagement_by_label(df: DataFrame) -> DataFrame:
    label = F.when(F.col("churned") == 1, "Churned").otherwise("Active").alias("label")
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in LABEL_METRICS])


def churn_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(
        F.sum("churned").alias("churn_count"), F.avg("churned").alias("churn_rate")
    )


def high_churn_periods(df: DataFrame, above: float = 0.10) -> DataFrame:
    return churn_trend(df).where(F.col("churn_rate") > above)


def segment_summary(enriched: DataFrame, customers: DataFrame) -> DataFrame:
    """Seven headline figures as (metric, value) text rows, in one scan of the panel."""

    def rate(column: str, wanted: str) -> Column:
        return F.avg(F.when(F.col(column) == wanted, F.col("churned")))

    one = enriched.agg(
        F.count("*").alias("records"),
        F.avg("churned").alias("overall"),
        rate("company_size", COMPANY_SIZES[0]).alias("small"),
        rate("company_size", COMPANY_SIZES[-1]).alias("large"),
        rate("subscription_tier", "Starter").alias("starter"),
        rate("subscription_tier", "Enterprise").alias("enterprise"),
    )
    size = customers.agg(F.count("*").alias("customers")).scalar()
    rows = (
        ("Total Customers", size.cast("string")),
        ("Total Records", F.col("records").cast("string")),
        ("Overall Churn Rate", percent(F.col("overall"), 2)),
        ("Small Company Churn", percent(F.col("small"), 2)),
        ("Large Company Churn", percent(F.col("large"), 2)),
        ("Starter Tier Churn", percent(F.col("starter"), 2)),
        ("Enterprise Tier Churn", percent(F.col("enterprise"), 2)),
    )
    cells = [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows]
    return one.select(F.inline(F.array(*cells)))


# --- quality --------------------------------------------------------------------------------


#: Label values that a report lists: a label has two, but a broken column may have any number.
LABELS = 100


def quality_report(df: DataFrame) -> DataFrame:
    """Nulls, duplicate rows, infinities, ranges and label values (the first ``LABELS``), one row."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    infinities = sum(
        (F.count_if(F.abs(F.col(c)) == float("inf")) for c in doubles), F.lit(0)
    )
    ranges = []
    for c in ("logins_per_day", "days_since_last_login", "features_used_count"):
        ranges += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )
    known = df.select(F.col("churned").cast("string").alias("label")).where("label is not null").distinct()
    labels = known.orderBy("label").limit(LABELS).agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return df.agg(
        F.count("*").alias("records"),
        nulls.cast("long").alias("total_nulls"),
        infinities.cast("long").alias("infinite_values"),
        *ranges,
        F.concat_ws(",", labels.scalar()).alias("label_values"),
        F.sum("churned").alias("churn_events"),
        F.avg("churned").alias("churn_rate"),
    ).withColumn("duplicate_rows", copies.scalar())


def label_distribution(df: DataFrame) -> DataFrame:
    return stats.shares(df, "churned", "records")


def complete_records(df: DataFrame) -> DataFrame:
    """Rows in all, churned rows, and rows without any missing value."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("total_records"),
        F.sum("churned").alias("churned"),
        F.avg("churned").alias("churn_rate"),
        F.count_if(whole).alias("complete_records"),
    )


# --- distributions and relations ------------------------------------------------------------


def describe_features(features: DataFrame, keep: Callable = stats.as_is) -> DataFrame:
    return stats.describe(features, numeric_columns(features), keep)


def label_correlation(features: DataFrame) -> DataFrame:
    """Correlation of every numeric column with the label, strongest first."""
    pairs = [(c, "churned") for c in numeric_columns(features) if c != "churned"]
    found = stats.correlations(features, pairs)
    return found.select(F.col("left").alias("feature"), F.col("corr").alias("correlation")).orderBy(
        F.desc_nulls_last("correlation"), "feature"
    )


def correlation_matrix(features: DataFrame, columns=MATRIX_COLUMNS) -> DataFrame:
    """Long form of the symmetric matrix; each pair is computed once."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    found = stats.correlations(features, upper)
    mirrored = found.where(F.col("left") != F.col("right")).select(
        F.col("right").alias("left"), F.col("left").alias("right"), "corr"
    )
    return found.unionByName(mirrored)


def features_by(features: DataFrame, segment: str) -> DataFrame:
    return features.groupBy(segment).agg(
        *[F.bround(F.avg(c), 2).alias(c) for c in SEGMENT_MEANS]
    )


def boxplot_stats(features: DataFrame, keep: Callable = stats.as_is) -> DataFrame:
    """The four box plots of the exploration, as one long table."""
    plots = (
        ("health_score", "company_size"),
        ("risk_flag_count", "subscription_tier"),
        ("feature_adoption_rate", "churned"),
        ("days_inactive", "churned"),
    )
    parts = [
        F.struct(
            F.concat_ws(
                " by ", F.lit(column), F.lit(group)
            ).alias("plot"),
            F.col(group).cast("string").alias("group"),
            F.col(column).cast("double").alias("value"),
        )
        for column, group in plots
    ]
    long = features.select(F.inline(F.array(*parts)))
    # as in the exploration, rows without a group are in no plot
    known = long.where(F.col("group").isNotNull()).withColumn("cell", F.struct("plot", "group"))
    return stats.boxplot(known, "value", "cell", keep).select(
        "group_value.plot", "group_value.group",
        "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers",
    )


def feature_center(features: DataFrame, keep: Callable = stats.as_is) -> DataFrame:
    counts = keep(stats.counted(stats.to_long(features, KEY_FEATURES), "value", ["metric"]))
    means = counts.groupBy("metric").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    medians = stats.quantiles_of_counts(counts, "value", {"median": 0.5}, ["metric"])
    return means.join(medians, "metric")


def with_risk_segment(features: DataFrame) -> DataFrame:
    return features.withColumn("risk_segment", risk_segment(F.col("risk_flag_count")))


def segment_churn_rate(features: DataFrame) -> DataFrame:
    return with_risk_segment(features).groupBy("risk_segment").agg(
        F.sum("churned").alias("churned_count"),
        F.count("*").alias("total_customers"),
        F.avg("churned").alias("churn_rate"),
    )


def health_by_segment(features: DataFrame, bins: int = 20) -> DataFrame:
    rows = with_risk_segment(features)
    return stats.histogram(rows, "health_score", bins, "risk_segment", RISK_TIERS)
