"""Engagement panel and customer attributes derived from raw activity events.

The event log has one row per action. The panel needs one row per customer and
day, including days without any action. Two shuffles do it: events collapse to
(customer, day) on the map side first, then each customer's active days are laid
out in order and the gaps between them are filled from the calendar. A customer
with a third of all events still contributes at most one row per day and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.config import TIER_PRICES
from holdfast.operators import scores

# Fixed values of the adapter.
INDUSTRY_OF_SEGMENT = {
    "AUTOMOBILE": "SaaS",
    "BUILDING": "Finance",
    "FURNITURE": "Healthcare",
    "HOUSEHOLD": "Retail",
    "MACHINERY": "Other",
}
NEVER_SEEN = 365
FEATURE_KINDS = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_activity(events: DataFrame) -> DataFrame:
    """(customer, day) totals.

    Distinct features are counted with a bit mask: ``k % 10`` takes at most 19
    values, so OR-ing one bit per value replaces a second, distinct aggregation.
    Values are summed as decimals, exact whatever the row order; NaN counts as no value, and a value
    that a decimal of sixteen digits before the point cannot hold stops the job.
    """
    bit = F.call_function("shiftleft", F.lit(1), feature_number() % FEATURE_KINDS + FEATURE_KINDS - 1)
    total = F.coalesce(F.sum(F.when(~F.isnan("value"), F.col("value")).cast("decimal(28,12)")), F.lit(0))
    known = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return known.groupBy(
        F.col("user_id").alias("customer_id"), F.to_date("ts").alias("day")
    ).agg(
        F.count("*").alias("active_users"),
        F.floor(total + F.lit(0.5).cast("decimal(2,1)")).cast("long").alias("api_calls"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("logins"),
        F.bit_count(F.bit_or(bit)).alias("features"),
        F.count_if(F.col("event_type") == "error").alias("tickets"),
        F.max("ts").alias("last_ts"),
    )


def feature_number() -> Column:
    """``k`` of the event's properties; the JSON parser only sees unusual ones."""
    bare = F.when(
        F.startswith("props", F.lit('{"k": ')), F.btrim("props", F.lit('{"k: }')).try_cast("int")
    )
    return F.coalesce(bare, F.get_json_object("props", "$.k").try_cast("int"))


def calendar(events: DataFrame) -> Column:
    """Sorted array of the days seen in events: one entry per calendar day."""
    return events.agg(F.sort_array(F.collect_set(F.to_date("ts")))).scalar()


def engagement_panel(events: DataFrame) -> DataFrame:
    daily = daily_activity(events)
    by_day = Window.partitionBy("customer_id").orderBy("day")
    spans = daily.select(
        "*",
        F.lag("day").over(by_day).alias("previous_day"),
        F.lead("day").over(by_day).alias("next_day"),
    ).withColumn("calendar", calendar(events))
    # An active day stands for itself and the silent days up to the next active
    # one; the first also stands for the silent days before it. The calendar is sorted
    # and has all active days, so what a day stands for is a slice of it.
    start = F.when(F.col("previous_day").isNull(), 1).otherwise(F.array_position("calendar", F.col("day")))
    behind = F.coalesce(F.array_position("calendar", F.col("next_day")), F.size("calendar") + 1)
    covered = F.slice("calendar", start.cast("int"), (behind - start).cast("int"))
    days = spans.withColumn("date", F.explode(covered))
    active = F.col("date") == F.col("day")
    idle_hours = F.timestamp_diff("HOUR", F.col("last_ts"), F.date_add("date", 1))
    by_date = Window.partitionBy("customer_id").orderBy("date")
    panel = days.select(
        "customer_id",
        F.date_format("date", "yyyy-MM-dd").alias("period"),
        _on(active, "active_users", "long").alias("active_users"),
        _on(active, "api_calls", "long").alias("api_calls"),
        _on(active, "logins", "double").alias("logins_per_day"),
        F.when(F.col("date") < F.col("day"), NEVER_SEEN).otherwise(idle_hours).cast("int")
        .alias("days_since_last_login"),
        _on(active, "features", "int").alias("features_used_count"),
        _on(active, "tickets", "int").alias("support_tickets"),
        scores.flag_silent_next(active, by_date).alias("churned"),
    )
    peak = (
        daily.groupBy(F.date_format("day", "yyyy-MM-dd").alias("period"))
        .agg(F.max("active_users").alias("peak_users"))
    )
    scored = scores.with_engagement_score(panel, peak)
    return scored.select(
        "customer_id", "period", "active_users", "api_calls", "logins_per_day",
        "days_since_last_login", "features_used_count", "support_tickets",
        "engagement_score", "churned",
    )


def _on(active: Column, name: str, kind: str) -> Column:
    return F.when(active, F.col(name)).otherwise(0).cast(kind)


def customer_attributes(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    slot = key % 20
    tier = (
        F.when(F.col("c_acctbal") < 4500, "Starter")
        .when(F.col("c_acctbal") < 8500, "Professional")
        .otherwise("Enterprise")
    )
    industry = F.lit(None).cast("string")
    for segment, name in INDUSTRY_OF_SEGMENT.items():
        industry = F.when(F.col("c_mktsegment") == segment, name).otherwise(industry)
    price = F.lit(None).cast("double")
    months = F.lit(None).cast("int")
    terms = {"Starter": 6 + key % 7, "Professional": 12 + key % 13, "Enterprise": 24 + key % 13}
    for name, amount in TIER_PRICES.items():
        price = F.when(F.col("subscription_tier") == name, amount).otherwise(price)
        months = F.when(F.col("subscription_tier") == name, terms[name]).otherwise(months)
    return customer.withColumn("subscription_tier", tier).select(
        key.alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.when(slot < 10, "small").when(slot < 17, "medium").otherwise("large")
        .alias("company_size"),
        industry.alias("industry"),
        "subscription_tier",
        price.alias("monthly_revenue"),
        F.date_add(F.lit("2023-01-01").cast("date"), ((key * 37) % 730).cast("int"))
        .alias("onboarding_date"),
        months.cast("int").alias("contract_length_months"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement_panel(read(spark, sf_dir, "events"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_attributes(read(spark, sf_dir, "customer"))
