"""Additive explanations: how much each input moved a prediction.

Contributions are kept as ``array<struct<feature, value, contribution>>`` and
turned into text only in the summary table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Settings
from holdfast.functions.columns import decimals, stable


def features_with_predictions(latest_features: DataFrame, run: DataFrame) -> DataFrame:
    """Feature rows with their distinct predictions; the feature's health score is kept."""
    scored = run.select("customer_id", "churn_probability", "recommendation", "risk_tier").distinct()
    return latest_features.join(scored, "customer_id")


def explain_linear(
    rows: DataFrame, cfg: Settings = DEFAULT, keep: Sequence[str] = ("customer_id",)
) -> DataFrame:
    """Exact contributions of the scorecard on the log-odds scale.

    For a linear model with independent inputs the Shapley value of input i is
    ``w_i * (x_i - mean(x_i))``; the base value is the score of the mean row.
    The means come from one aggregate row, used as a scalar.
    """
    names = list(cfg.scorecard_weights)
    means = rows.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    base: Column = F.lit(cfg.scorecard_intercept)
    parts = []
    for name, weight in cfg.scorecard_weights.items():
        base = base + means[name] * weight
        value = F.col(name).cast("double")
        parts.append(contribution(name, value, (value - means[name]) * weight))
    return rows.select(*keep, base.alias("base_value"), F.array(*parts).alias("contributions"))


def contribution(feature: str, value: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"), value.alias("value"), amount.alias("contribution")
    )


def strongest_first(contributions: Column) -> Column:
    """Order by absolute contribution, equal ones by feature name."""
    keyed = F.transform(
        contributions,
        lambda c: F.struct(
            (-stable(F.abs(c["contribution"]))).alias("order"), c["feature"].alias("feature"),
            c["value"].alias("value"), c["contribution"].alias("contribution"),
        ),
    )
    return F.sort_array(keyed)


def summary(explained: DataFrame, top: int = 3) -> DataFrame:
    """The strongest inputs per customer as two comma-joined texts."""
    best = explained.withColumn("_top", F.slice(strongest_first(F.col("contributions")), 1, top))
    return best.select(
        "customer_id",
        F.col("churn_probability").alias("predicted_churn"),
        F.array_join(F.transform("_top", lambda c: c["feature"]), ", ").alias("top_3_features"),
        F.array_join(
            F.transform("_top", lambda c: decimals(stable(c["contribution"]), 3)), ", "
        ).alias("top_3_shap_values"),
    )


def detail(explained: DataFrame, customer_id, top: int = 10) -> DataFrame:
    """The strongest inputs of one customer as rows."""
    mine = explained.where(F.col("customer_id") == customer_id)
    rows = mine.select(
        "customer_id",
        F.col("churn_probability").alias("predicted_churn"),
        "base_value",
        F.posexplode(F.slice(strongest_first(F.col("contributions")), 1, top)).alias("i", "c"),
    )
    return rows.select(
        "customer_id", "predicted_churn", "base_value",
        (F.col("i") + 1).alias("position"),
        "c.feature", "c.value", "c.contribution",
        F.abs("c.contribution").alias("abs_contribution"),
    )


def rows_of_summary(explanations: DataFrame) -> DataFrame:
    """Take the comma-joined texts apart again: rank, feature, amount, direction."""
    pairs = F.arrays_zip(
        F.split("top_3_features", ", ").alias("feature"),
        F.split("top_3_shap_values", ", ").alias("amount"),
    )
    rows = explanations.select("customer_id", F.posexplode(pairs).alias("i", "pair"))
    amount = F.col("pair.amount").cast("double")
    # The two direction texts.
    direction = F.when(amount > 0, "↑ Increases Risk").otherwise("↓ Decreases Risk")
    return rows.select(
        "customer_id",
        (F.col("i") + 1).alias("rank"),
        F.col("pair.feature").alias("feature"),
        decimals(amount, 4).alias("impact_value"),
        direction.alias("direction"),
    )
