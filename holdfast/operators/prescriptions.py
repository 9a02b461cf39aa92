"""The action prescribed to each customer, its cost and its expected return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, PLAYBOOKS, Playbook, Settings

OUTPUTS = (
    "prescribed_action", "action_type", "discount_percent", "action_cost",
    "expected_retention_value", "expected_impact", "roi", "confidence", "timing",
    "rationale", "success_probability",
)


def _applies(play: Playbook) -> Column:
    tests = []
    if play.recommendation is not None:
        tests.append(F.col("recommendation") == play.recommendation)
    if play.above_probability is not None:
        tests.append(F.col("churn_probability") > play.above_probability)
    if play.below_health is not None:
        tests.append(F.col("health_score") < play.below_health)
    if play.above_revenue is not None:
        tests.append(F.col("monthly_revenue") > play.above_revenue)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _outcome(play: Playbook) -> Column:
    revenue = F.col("monthly_revenue")
    cost = revenue * play.revenue_cost_share if play.revenue_cost_share else F.lit(play.fixed_cost)
    if play.retained_months:
        value = revenue * play.retained_months
        impact = value * (1 - F.col("churn_probability"))
        roi = F.when(revenue > 0, F.try_divide(impact, cost)).otherwise(0.0)
    else:
        value = impact = roi = F.lit(0.0)
    fields = (
        F.lit(play.action), F.lit(play.action_type), F.lit(play.discount_percent), cost, value,
        impact, roi, F.lit(play.confidence), F.lit(play.timing), F.lit(play.rationale),
        F.lit(play.success_probability),
    )
    return F.struct(*[f.alias(name) for f, name in zip(fields, OUTPUTS)])


def prescribe(predictions: DataFrame) -> DataFrame:
    """The first playbook that fits each prediction. Row-wise, no shuffle."""
    *special, default = PLAYBOOKS
    choice = _outcome(default)
    for play in reversed(special):
        choice = F.when(_applies(play), _outcome(play)).otherwise(choice)
    return predictions.select(
        "customer_id",
        "churn_probability",
        F.col("recommendation").alias("current_recommendation"),
        choice.alias("_plan"),
    ).select("customer_id", "churn_probability", "current_recommendation", "_plan.*")


def by_roi(prescriptions: DataFrame) -> DataFrame:
    """Best return first; a range sort, not a single-task one."""
    return prescriptions.orderBy(F.desc_nulls_last("roi"), "customer_id")


def portfolio_impact(prescriptions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    cost = F.coalesce(F.sum("action_cost"), F.lit(0.0))
    impact = F.coalesce(F.sum("expected_impact"), F.lit(0.0))
    return prescriptions.agg(
        cost.alias("total_action_cost"),
        impact.alias("total_expected_impact"),
        F.when(cost > 0, F.try_divide(impact, cost)).otherwise(0.0).alias("portfolio_roi"),
        F.count_if(F.col("roi") > cfg.high_roi_above).alias("high_roi_actions"),
    )


def action_breakdown(prescriptions: DataFrame) -> DataFrame:
    return prescriptions.groupBy("action_type").agg(
        F.count("customer_id").alias("customer_count"),
        F.bround(F.sum("action_cost"), 0).alias("total_cost"),
        F.bround(F.sum("expected_impact"), 0).alias("total_impact"),
        F.bround(F.avg("roi"), 0).alias("avg_roi"),
    )
