"""From features to predictions: probability, tier, money at risk, rank, advice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, RISK_TIERS, Settings
from holdfast.functions import columns as C
from holdfast.operators.features import fill_with_zero, latest_period, model_columns
from holdfast.operators.rank import descending, global_rank

Strategy = Callable[[DataFrame], DataFrame]

PREDICTION_COLUMNS = (
    "customer_id",
    "prediction_date",
    "churn_probability",
    "predicted_churn",
    "risk_tier",
    "health_score",
    "monthly_revenue",
    "revenue_at_risk",
    "annual_revenue_at_risk",
    "composite_risk_score",
    "recommendation",
)


# --- strategies: features -> features with churn_probability -----------------------


def scorecard(cfg: Settings = DEFAULT) -> Strategy:
    """A fixed logistic model: transparent, reproducible, no training needed."""

    def add(features: DataFrame) -> DataFrame:
        odds: Column = F.lit(cfg.scorecard_intercept)
        for name, weight in cfg.scorecard_weights.items():
            odds = odds + F.col(name) * weight
        return features.withColumn("churn_probability", 1 / (1 + F.exp(-odds)))

    return add


def trained(model: PipelineModel) -> Strategy:
    """A fitted pipeline; missing inputs are scored as zero."""

    def add(features: DataFrame) -> DataFrame:
        filled = fill_with_zero(features, model_columns(features))
        scored = model.transform(filled)
        positive = vector_to_array("probability")[1]
        return scored.withColumn("churn_probability", positive).select(
            *features.columns, "churn_probability"
        )

    return add


# --- predictions ---------------------------------------------------------------------


def predict(
    features: DataFrame, strategy: Strategy, tiers: str = "business", cfg: Settings = DEFAULT
) -> DataFrame:
    """One prediction per feature row; the period becomes the run date."""
    p, health = F.col("churn_probability"), F.col("health_score")
    revenue = F.col("monthly_revenue")
    if tiers not in ("business", "model"):
        raise ValueError(f"unknown tier system: {tiers}")
    tier = C.risk_tier_business(p, cfg) if tiers == "business" else C.risk_tier_model(p, cfg)
    scored = strategy(features)
    scored = scored.withColumns({
        "churn_probability": C.stable(p),
        "health_score": C.stable(health),
        "prediction_date": F.col("period"),
    })
    return scored.withColumns({
        "predicted_churn": C.predicted_churn(p, cfg),
        "risk_tier": tier,
        "revenue_at_risk": C.revenue_at_risk(revenue, p, cfg.quarter_months),
        "annual_revenue_at_risk": C.revenue_at_risk(revenue, p, cfg.year_months),
        "composite_risk_score": p,
        "recommendation": C.recommendation(p, health),
    }).select(*PREDICTION_COLUMNS)


def with_risk_rank(predictions: DataFrame) -> DataFrame:
    """Position by probability inside each run, equal ones in customer order."""
    by = [descending(F.col("composite_risk_score"))]
    return global_rank(
        predictions, "risk_rank", by, ["customer_id"], within=["prediction_date"]
    )


def score_customers(
    features: DataFrame, strategy: Strategy, tiers: str = "business", cfg: Settings = DEFAULT
) -> DataFrame:
    """Ranked predictions of the latest period."""
    return with_risk_rank(predict(latest_period(features), strategy, tiers, cfg))


def score_all_periods(
    features: DataFrame, strategy: Strategy, cfg: Settings = DEFAULT
) -> DataFrame:
    """Probability, class and model tier of every feature row, label kept."""
    p = F.col("churn_probability")
    scored = strategy(features).withColumn("churn_probability", C.stable(p))
    return scored.withColumns({
        "predicted_churn": C.predicted_churn(p, cfg),
        "risk_tier": C.risk_tier_model(p, cfg),
    })


# --- money ------------------------------------------------------------------------------


def with_revenue(
    predictions: DataFrame, customers: DataFrame, cfg: Settings = DEFAULT
) -> DataFrame:
    """Attach revenue, money at risk and business tier to bare probabilities."""
    bare = predictions.drop("monthly_revenue")
    joined = bare.join(customers.select("customer_id", "monthly_revenue"), "customer_id", "left")
    p, revenue = F.col("churn_probability"), F.col("monthly_revenue")
    return joined.withColumns({
        "revenue_at_risk": C.revenue_at_risk(revenue, p, cfg.quarter_months),
        "annual_revenue_at_risk": C.revenue_at_risk(revenue, p, cfg.quarter_months) * 4,
        "risk_tier": C.risk_tier_business(p, cfg),
    })


def with_revenue_rank(predictions: DataFrame) -> DataFrame:
    """Position by annual money at risk; equal amounts share the best position."""
    by = [descending(C.stable(F.col("annual_revenue_at_risk")))]
    return global_rank(predictions, "risk_rank", by, ["customer_id"], ties="min")


def retier(predictions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Recompute the tier of stored rows with the business cuts."""
    return predictions.withColumn(
        "risk_tier", C.risk_tier_business(F.col("churn_probability"), cfg)
    )


def revenue_summary(predictions: DataFrame) -> DataFrame:
    tier = F.col("risk_tier")
    low, medium, high = RISK_TIERS
    at_risk = F.col("annual_revenue_at_risk")
    zero = F.lit(0.0)
    return predictions.agg(
        F.count("*").alias("total_customers"),
        F.count_if(tier == low).alias("low_risk_count"),
        F.count_if(tier == medium).alias("medium_risk_count"),
        F.count_if(tier == high).alias("high_risk_count"),
        (F.coalesce(F.sum("monthly_revenue"), zero) * 12).alias("total_annual_revenue"),
        F.coalesce(F.sum(at_risk), zero).alias("total_revenue_at_risk"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.coalesce(F.sum(F.when(tier == high, at_risk)), zero).alias("high_risk_revenue_at_risk"),
    )
