"""Quality of scored rows: confusion, curves, calibration, tiers against outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import RISK_TIERS
from holdfast.functions.columns import ratio
from holdfast.operators.rank import running_totals

HIGH = RISK_TIERS[2]


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def confusion_counts(scored: DataFrame, *group: str) -> DataFrame:
    actual, predicted = F.col("churned") == 1, F.col("predicted_churn") == 1
    return scored.groupBy(*group).agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def confusion_metrics(scored: DataFrame, *group: str) -> DataFrame:
    """Counts with precision, recall and F1; a ratio without cases is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion_counts(scored, *group).withColumns({
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
    })


def classification_report(scored: DataFrame) -> DataFrame:
    """Per-class and averaged precision, recall and F1 from one aggregate row."""

    def of_class(name: str, hit: str, wrong: str, missed: str) -> Column:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(name).alias("label"),
            _or_zero(h, h + w).alias("precision"),
            _or_zero(h, h + m).alias("recall"),
            _or_zero(2 * h, 2 * h + w + m).alias("f1"),
            (h + m).alias("support"),
        )

    classes = confusion_counts(scored).select(
        of_class("Active", "tn", "fn", "fp").alias("a"),
        of_class("Churned", "tp", "fp", "fn").alias("c"),
        _or_zero(F.col("tn") + F.col("tp"), F.col("tn") + F.col("tp") + F.col("fn") + F.col("fp"))
        .alias("accuracy"),
    )
    total = F.col("a.support") + F.col("c.support")

    def averaged(name: str, combine) -> Column:
        fields = [combine(f"a.{m}", f"c.{m}").alias(m) for m in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("label"), *fields, total.alias("support"))

    weighted = averaged("weighted avg", lambda a, c: _or_zero(
        F.col(a) * F.col("a.support") + F.col(c) * F.col("c.support"), total))
    macro = averaged("macro avg", lambda a, c: (F.col(a) + F.col(c)) / 2)
    nothing = F.lit(None).cast("double")
    accuracy = F.struct(
        F.lit("accuracy").alias("label"), nothing.alias("precision"), nothing.alias("recall"),
        F.col("accuracy").alias("f1"), total.alias("support"),
    )
    return classes.select(F.inline(F.array(F.col("a"), F.col("c"), accuracy, macro, weighted)))


# --- ranking quality ---------------------------------------------------------------------


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score, with the totals above it."""
    positive = F.col("churned") == 1
    per_score = scored.where(F.col("churn_probability").isNotNull()).groupBy("churn_probability").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return running_totals(per_score, [-F.col("churn_probability")], ["pos", "neg"])


def _class_sizes(scored: DataFrame) -> Column:
    positive = F.col("churned") == 1
    return scored.agg(
        F.struct(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ).scalar()


def roc_curve(scored: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score, plus the origin."""
    sizes = _class_sizes(scored)
    points = _by_score(scored).select(
        F.col("churn_probability").alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), sizes["neg"]).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), sizes["pos"]).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (churned, active) pairs in the right order, ties counted half."""
    area = F.sum(
        F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / F.lit(2.0))
    )
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return _by_score(scored).agg(
        F.try_divide(area, pairs).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )


def evaluate(train: DataFrame, test: DataFrame, limit: float = 0.05) -> DataFrame:
    """AUC and confusion metrics of both parts, with an overfitting flag."""
    parts = []
    for name, scored in (("train", train), ("test", test)):
        auc = roc_auc(scored).select("auc").scalar()
        parts.append(
            confusion_metrics(scored).select(F.lit(name).alias("part"), auc.alias("auc"), "*")
        )
    # two rows, one per part: the gap is taken between them
    both = Window.partitionBy(F.lit(0))
    gap = F.max("auc").over(both) - F.min("auc").over(both)
    known = F.count("auc").over(both) == 2
    return parts[0].unionByName(parts[1]).withColumn("overfitting", F.when(known, gap >= limit))


# --- calibration and tiers ---------------------------------------------------------------


def calibration_deciles(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against actual rate in equal-width, right-closed probability bins."""
    p = F.col("churn_probability")
    span = scored.agg(F.struct(F.min(p).alias("low"), F.max(p).alias("high"))).scalar()
    low, width = span["low"], span["high"] - span["low"]
    position = F.ceil(F.try_divide(p - low, width) * bins)
    # A constant probability falls in the middle of a range widened around it.
    middle = (bins + 1) // 2
    index = F.when(position.isNull(), middle).otherwise(F.greatest(F.lit(1), position)).cast("int")
    return scored.where(p.isNotNull()).groupBy(index.alias("bin")).agg(
        F.count("*").alias("total_customers"),
        F.sum("churned").alias("churned_count"),
        F.round(F.avg("churned"), 3).alias("actual_churn_rate"),
        F.avg(p).alias("pred_churn_prob"),
    )


def tier_calibration(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_tier").agg(
        F.sum("churned").alias("churned_count"),
        F.count("*").alias("total_customers"),
        F.avg("churned").alias("actual_churn_rate"),
        F.avg("predicted_churn").alias("predicted_churn_rate"),
    )


def with_segments(scored: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join of customer attributes; where both sides have a column, theirs wins."""
    attributes = ("company_size", "subscription_tier", "monthly_revenue")
    bare = scored.drop(*attributes)
    return bare.join(customers.select("customer_id", *attributes), "customer_id", "left")


def high_risk_segments(scored: DataFrame, customers: DataFrame) -> DataFrame:
    """High-risk rows and revenue by size, by tier and in all, from one scan."""
    high = with_segments(scored.where(F.col("risk_tier") == HIGH), customers)
    size, tier = F.col("company_size"), F.col("subscription_tier")
    grouped = high.groupingSets([[size], [tier], []], size, tier).agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("customers"),
        F.sum("churned").alias("churned"),
        F.coalesce(F.sum("monthly_revenue"), F.lit(0.0)).alias("monthly_revenue"),
    )
    return grouped.select(
        F.when(F.col("level") == 1, "company_size").when(F.col("level") == 2, "subscription_tier")
        .otherwise("all").alias("segment"),
        F.when(F.col("level") == 3, "all").otherwise(F.coalesce(size, tier)).alias("segment_value"),
        "customers", "churned", "monthly_revenue",
    )


def top_risk_rows(scored: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """The likeliest churners of the high tier with their segment."""
    high = scored.where(F.col("risk_tier") == HIGH)
    top = high.orderBy(F.desc("churn_probability"), "customer_id", "period").limit(n)
    return with_segments(top, customers).select(
        "customer_id", "period", "churn_probability", "company_size", "subscription_tier", "churned"
    )
