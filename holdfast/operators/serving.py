"""Read queries behind dashboards and look-ups. All take stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Settings
from holdfast.functions.columns import decimals, money, percent, ratio
from holdfast.operators.monitoring import HIGH, latest_run

PREDICTION_FIELDS = (
    "customer_id", "churn_probability", "risk_tier", "monthly_revenue",
    "annual_revenue_at_risk", "health_score", "recommendation",
)
PRIORITY_FIELDS = (
    "customer_id", "monthly_revenue", "churn_probability", "health_score", "revenue_at_risk",
    "annual_revenue_at_risk", "risk_tier", "recommendation",
)


def ranked_run(predictions: DataFrame) -> DataFrame:
    """The last run in rank order."""
    return latest_run(predictions).orderBy("risk_rank")


# --- look-ups of one key: the filter reaches the scan ----------------------------------


def customer_lookup(predictions: DataFrame, customer_id) -> DataFrame:
    """The last prediction of one customer; no row when the customer is unknown."""
    mine = latest_run(predictions).where(F.col("customer_id") == customer_id)
    return mine.select(*PREDICTION_FIELDS).distinct()


def prescription_lookup(prescriptions: DataFrame, customer_id) -> DataFrame:
    return prescriptions.where(F.col("customer_id") == customer_id).select(
        "customer_id",
        F.col("prescribed_action").alias("recommended_action"),
        "discount_percent", "roi", "confidence", "success_probability",
    )


def explanation_lookup(explanations: DataFrame, customer_id) -> DataFrame:
    return explanations.where(F.col("customer_id") == customer_id).select(
        "customer_id",
        F.col("predicted_churn").alias("churn_probability"),
        "top_3_features",
        F.col("top_3_shap_values").alias("top_3_values"),
    )


def customer_360(
    predictions: DataFrame, prescriptions: DataFrame, explanations: DataFrame
) -> DataFrame:
    """Prediction, prescription and explanation of each customer; absent parts are null."""
    plan = prescriptions.select(
        "customer_id",
        F.struct("prescribed_action", "discount_percent", "roi", "success_probability")
        .alias("recommendation"),
    )
    reasons = explanations.select(
        "customer_id", F.struct("top_3_features", "top_3_shap_values").alias("explanation")
    )
    scored = latest_run(predictions).select(*PREDICTION_FIELDS).distinct().select(
        "customer_id", F.struct(*PREDICTION_FIELDS).alias("prediction")
    )
    return scored.join(plan, "customer_id", "left").join(reasons, "customer_id", "left")


def customer_options(journeys: DataFrame) -> DataFrame:
    return journeys.select("customer_id").distinct().orderBy("customer_id")


# --- top lists: a limited sort keeps only the best rows of every task -------------------


def priority_customers(predictions: DataFrame, n: int = 50) -> DataFrame:
    return top_by(predictions, "annual_revenue_at_risk", n).select(*PRIORITY_FIELDS)


def top_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n greatest rows; equal values in customer order, nulls last."""
    return df.orderBy(F.desc_nulls_last(column), "customer_id").limit(n)


def high_risk_list(predictions: DataFrame, limit: int = 50) -> DataFrame:
    high = latest_run(predictions).where(F.col("risk_tier") == HIGH)
    return top_by(high, "annual_revenue_at_risk", limit).select(
        "customer_id", "churn_probability", "monthly_revenue", "annual_revenue_at_risk",
        "health_score", "recommendation",
    )


def likely_to_churn(predictions: DataFrame, above: float = 0.40, limit: int = 10) -> DataFrame:
    """A few rows above a probability, for a quick look at a table."""
    return (
        predictions.where(F.col("churn_probability") > above)
        .orderBy(F.desc("churn_probability"), "customer_id", "prediction_date").limit(limit)
        .select("customer_id", "prediction_date", "churn_probability", "risk_tier")
    )


def priority_rank(top: DataFrame, column: str, name: str = "priority_rank") -> DataFrame:
    """Number an already limited list; the one-task window sees at most n rows."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(column), "customer_id")
    return top.withColumn(name, F.row_number().over(order))


def display_table(predictions: DataFrame, n: int = 50) -> DataFrame:
    """The quarterly priority list with every figure as text."""
    top = priority_rank(top_by(predictions, "revenue_at_risk", n), "revenue_at_risk", "rank")
    return top.select(
        "rank",
        "customer_id",
        money(F.col("monthly_revenue")).alias("monthly_revenue"),
        percent(F.col("churn_probability")).alias("churn_probability"),
        decimals(F.col("health_score"), 0).alias("health_score"),
        money(F.col("revenue_at_risk")).alias("revenue_at_risk"),
        "recommendation",
        "risk_tier",
    )


def display_prescriptions(prescriptions: DataFrame, n: int = 20) -> DataFrame:
    top = priority_rank(top_by(prescriptions, "roi", n), "roi", "rank")
    return top.select(
        "rank",
        "customer_id",
        "prescribed_action",
        F.concat(F.col("discount_percent").cast("string"), F.lit("%")).alias("discount_percent"),
        F.concat(decimals(F.col("roi"), 1), F.lit("x")).alias("roi"),
        percent(F.col("confidence"), 0).alias("confidence"),
        percent(F.col("success_probability"), 0).alias("success_probability"),
    )


# --- figures of one run --------------------------------------------------------------------


def kpi_summary(predictions: DataFrame) -> DataFrame:
    """Headline figures of the last run; zeros when there is none."""
    zero = F.lit(0.0)
    at_risk = F.col("annual_revenue_at_risk")
    high = F.col("risk_tier") == HIGH
    return latest_run(predictions).agg(
        F.count("*").alias("total_customers"),
        F.count_if(high).alias("high_risk"),
        F.coalesce(F.sum(at_risk), zero).alias("total_revenue_at_risk"),
        F.coalesce(F.avg("churn_probability"), zero).alias("avg_churn_prob"),
        F.coalesce(F.sum(F.when(high, at_risk)), zero).alias("revenue_at_risk_high_risk"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("customers")).orderBy(
        F.desc("customers"), column
    )


def total_by(df: DataFrame, group: str, column: str, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(column).alias(name)).orderBy(F.desc(name), group)


def probability_buckets(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    low, high = cfg.business_tier_cuts
    p = F.col("churn_probability")
    return predictions.agg(
        F.count_if(p < low).alias("under_20"),
        F.count_if((p >= low) & (p < high)).alias("between_20_40"),
        F.count_if(p >= high).alias("above_40"),
    )


def retention_scenarios(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Annual revenue saved at several success rates."""
    total = predictions.agg(F.coalesce(F.sum("annual_revenue_at_risk"), F.lit(0.0)).alias("total"))
    rates = F.array(*[F.lit(r) for r in cfg.retention_rates])
    return total.select(F.explode(rates).alias("rate"), "total").select(
        percent(F.col("rate"), 0).alias("scenario"),
        (F.col("total") * F.col("rate")).alias("revenue_saved"),
    )


def business_case(predictions: DataFrame, saved_share: float = 0.20) -> DataFrame:
    total = F.count("*")
    high = F.count_if(F.col("risk_tier") == HIGH)
    at_risk = F.coalesce(F.sum("annual_revenue_at_risk"), F.lit(0.0))
    return predictions.agg(
        total.alias("total_customers"),
        high.alias("high_risk_customers"),
        (ratio(high, total) * 100).alias("high_risk_percent"),
        at_risk.alias("annual_revenue_at_risk"),
        F.count_if(F.col("recommendation") == "Urgent Account Review").alias("urgent_reviews"),
        (at_risk * saved_share).alias("revenue_saved"),
    )


def churn_health_points(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "health_score", "churn_probability", "risk_tier", "monthly_revenue", "customer_id",
        "recommendation",
    )


def distinct_customers(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Exact by default; the sketch is an explicit choice."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(F.count("*").alias("records"), count("customer_id").alias("customers"))


def top_customer(predictions: DataFrame) -> Column:
    """Id of the customer most likely to churn in the last run, as a scalar subquery."""
    best = F.min_by(
        "customer_id", F.struct((-F.col("churn_probability")).alias("p"), F.col("customer_id"))
    )
    return latest_run(predictions).agg(best.alias("customer_id")).scalar()
