"""Scores of the raw panel that need a look at neighbours or at the whole period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from holdfast.config import (
    DEFAULT,
    INDUSTRY_MULTIPLIERS,
    MONTHLY_CHURN_RATES,
    TIER_PRICES,
    Settings,
)
from holdfast.functions.columns import clip


def flag_silent_next(active: Column, in_time: WindowSpec) -> Column:
    """1 when the customer's next period has no activity; 0 on the last period."""
    return F.coalesce(~F.lead(active).over(in_time), F.lit(False)).cast("int")


def period_peak(panel: DataFrame) -> DataFrame:
    """Greatest active_users of each period: one row per calendar period."""
    return panel.groupBy("period").agg(F.max("active_users").alias("peak_users"))


def with_period_max(panel: DataFrame, peak: DataFrame | None = None) -> DataFrame:
    """The period maximum on every row.

    A window over the period would send each period to one task. The maximum
    per period has one row per calendar period whatever the number of customers,
    so it is broadcast.
    """
    peak = period_peak(panel) if peak is None else peak
    return panel.join(F.broadcast(peak), "period", "left")


def with_engagement_score(
    panel: DataFrame, peak: DataFrame | None = None, cfg: Settings = DEFAULT
) -> DataFrame:
    """0-100 blend of users, logins, features and recency, one decimal, half-even."""
    users = F.col("active_users") / F.col("peak_users") * 25
    logins = F.col("logins_per_day") / F.lit(5.0) * 25
    features = F.col("features_used_count") / F.lit(float(cfg.features_available)) * 25
    recency = (60 - F.col("days_since_last_login")) / F.lit(60.0) * 25
    # Rounded in a column of its own: the bounds below would repeat the rounding.
    rounded = with_period_max(panel, peak).withColumn(
        "engagement_score", F.bround(users + logins + features + recency, 1)
    )
    bounded = clip(F.col("engagement_score"), 0.0, 100.0)
    return rounded.withColumn("engagement_score", bounded).drop("peak_users")


# --- rate tables and the segment prior ------------------------------------------


def rate_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tier prices, (size, tier) rates and industry multipliers: 17 fixed rows in all."""
    prices = spark.createDataFrame(list(TIER_PRICES.items()), "subscription_tier string, list_price double")
    rates = spark.createDataFrame(
        [(size, tier, rate) for (size, tier), rate in MONTHLY_CHURN_RATES.items()],
        "company_size string, subscription_tier string, base_rate double",
    )
    industries = spark.createDataFrame(
        list(INDUSTRY_MULTIPLIERS.items()), "industry string, industry_factor double"
    )
    return prices, rates, industries


def with_rates(customers: DataFrame) -> DataFrame:
    """Look up list price, base churn rate and industry factor per customer."""
    prices, rates, industries = rate_tables(customers.sparkSession)
    return (
        customers.join(F.broadcast(prices), "subscription_tier", "left")
        .join(F.broadcast(rates), ["company_size", "subscription_tier"], "left")
        .join(F.broadcast(industries), "industry", "left")
    )


def segment_churn_prior(customers: DataFrame, month: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Expected churn of each customer's segment in ``month`` (a date).

    base(size, tier) x industry x season x tenure, capped; 0 before onboarding.
    """
    season = F.when(F.month(month).isin(*cfg.peak_months), cfg.peak_factor).otherwise(
        cfg.off_peak_factor
    )
    tenure = _month_number(month) - _month_number(F.col("onboarding_date"))
    # New customers churn more often in their first half year.
    effect = F.when(tenure < 2, 1.5).when(tenure < 6, 1.2).otherwise(1.0)
    expected = F.col("base_rate") * F.col("industry_factor") * season * effect
    prior = F.when(tenure < 0, 0.0).otherwise(F.least(expected, F.lit(cfg.prior_cap)))
    return with_rates(customers).withColumns({
        "tenure_months": tenure.cast("int"),
        "churn_prior": prior,
    })


def _month_number(date: Column) -> Column:
    return (F.year(date) - 2023) * 12 + F.month(date) - 1
