"""Train, evaluate and store the churn model; explain its predictions."""

from __future__ import annotations

from functools import lru_cache
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import evaluation, explain, ml, scoring
from holdfast.operators.tree_contributions import explain_trees
from holdfast.plans.workspace import Workspace
from holdfast.sources import tables


def fit_and_store(
    features: DataFrame, path: str, settings: ml.BoostingSettings = ml.BoostingSettings()
) -> tuple[PipelineModel, DataFrame]:
    """Split, fit, save; returns the model and its train/test evaluation.

    What is scanned more than once is written next to the model first: boosting
    and evaluation scan their rows often, and a stored table survives lost executors.
    The rows are ranked once for both parts and dealt evenly, as each level of a tree waits for its longest task.
    """
    spark = features.sparkSession
    tables.replace_table(features, f"{path}/all_rows")
    stored = spark.read.parquet(f"{path}/all_rows")
    tables.replace_table(ml.evenly_dealt(ml.marked_split(stored), stored), f"{path}/split_rows")
    rows = _split_rows(spark, path)
    model = ml.train(rows["train"], settings)
    ml.save_model(model, f"{path}/model")
    for name in rows:
        scored = scoring.score_all_periods(rows[name], scoring.trained(model))
        scored = scored.select("churned", "churn_probability", "predicted_churn")
        tables.replace_table(scored, f"{path}/{name}_scores")
    report = evaluation.evaluate(
        spark.read.parquet(f"{path}/train_scores"), spark.read.parquet(f"{path}/test_scores")
    )
    return model, report


def _split_rows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored rows of the parts ``train`` and ``test``."""
    marked = spark.read.parquet(f"{path}/split_rows")
    return {
        "train": marked.where(~F.col(ml.TEST)).drop(ml.TEST), "test": marked.where(ml.TEST).drop(ml.TEST)
    }


def tree_explanations(current: DataFrame, model: PipelineModel, path: str) -> DataFrame:
    """Contributions of the stored model to its predictions for the latest features."""
    run = scoring.predict(current, scoring.trained(model))
    rows = explain.features_with_predictions(current, run)
    return explain_trees(rows, model, f"{path}/model", ("customer_id", "churn_probability"))


# --- catalogue entries: one fit with the job's own settings per session and data folder -----


@lru_cache(maxsize=4)
def _fitted_once(application: str, sf_dir: str) -> str:
    w = Workspace(SparkSession.getActiveSession(), sf_dir)
    path = f"{tables.shared_folder(w.spark)}/boosting-{uuid4().hex}"
    _, report = fit_and_store(w.features, path)
    tables.replace_table(report, f"{path}/report")
    return path


def _fitted(w: Workspace) -> tuple[PipelineModel, str]:
    path = _fitted_once(w.spark.sparkContext.applicationId, w.sf_dir)
    return ml.load_model(f"{path}/model"), path


def train_evaluate(w: Workspace) -> DataFrame:
    return w.spark.read.parquet(f"{_fitted(w)[1]}/report")


def stratified_split(w: Workspace) -> DataFrame:
    """Rows of every label in both parts."""
    _, path = _fitted(w)
    parts = [
        rows.select(F.lit(part).alias("part"), "churned") for part, rows in _split_rows(w.spark, path).items()
    ]
    return parts[0].union(parts[1]).groupBy("part", "churned").agg(F.count("*").alias("records"))


def confusion_boosted(w: Workspace) -> DataFrame:
    """Rows of each part that the stored scores and the report's counts agree on."""
    _, path = _fitted(w)
    parts = [
        w.spark.read.parquet(f"{path}/{part}_scores").select(F.lit(part).alias("part"), "*")
        for part in ("train", "test")
    ]
    counts = parts[0].union(parts[1]).groupBy("part").agg(
        F.count("*").alias("records"),
        F.sum("churned").cast("bigint").alias("positives"),
        F.count_if(F.col("predicted_churn") != F.when(F.col("churn_probability") >= 0.5, 1).otherwise(0))
        .alias("misread"),
    )
    report = w.spark.read.parquet(f"{path}/report").select("part", "auc")
    known = F.col("auc").between(0.5, 1.0).alias("better_than_chance")
    return counts.join(report, "part").select("part", "records", "positives", "misread", known)


#: Model columns of few values, on which a tree's cuts are the midpoints of neighbouring values.
STEP_COLUMNS = [
    "features_used_count", "risk_flag_count", "is_high_adoption", "is_low_adoption", "flag_no_login_30days",
    "flag_no_login_60days", "flag_low_feature_adoption", "flag_high_support_tickets", "flag_declining_engagement",
]
ONE_STEP = ml.BoostingSettings(max_depth=1, trees=1, row_share=1.0, column_share=1.0)


def boosted_step(w: Workspace) -> DataFrame:
    """The first step of boosting on the first four fifths of the periods, evaluated on both parts.

    One tree with one cut, from all rows: training, the stored tree, importances, scores, AUC and confusion
    can all be found again by counting.
    """
    path = tables.temporary_folder(w.spark, "step")
    tables.replace_table(w.features, f"{path}/rows")
    rows = w.spark.read.parquet(f"{path}/rows")
    periods = [r["period"] for r in rows.select("period").distinct().orderBy("period").collect()]
    train, test = ml.temporal_split(rows, periods[len(periods) * 4 // 5])
    model = ml.train(train, ONE_STEP, STEP_COLUMNS)
    ml.save_model(model, f"{path}/model")
    model = ml.load_model(f"{path}/model")
    report = evaluation.evaluate(*[scoring.score_all_periods(part, scoring.trained(model)) for part in (train, test)])
    nodes = w.spark.read.parquet(f"{path}/model/stages/*GBTClassifier*/data").select("nodeData.*")
    top = nodes.where("id = 0").select(
        F.get(F.array(*map(F.lit, STEP_COLUMNS)), F.col("split.featureIndex")).alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "leftChild", "rightChild",
    )
    values = nodes.select(F.col("id"), F.col("prediction"))
    tree = top.join(values.toDF("leftChild", "left_value"), "leftChild").join(
        values.toDF("rightChild", "right_value"), "rightChild"
    ).join(ml.feature_importance(model, w.spark), "feature")
    split = tree.select(F.struct("feature", "threshold", "left_value", "right_value", "importance").alias("s")).scalar()
    return report.withColumn("s", split).select("s.*", "*").drop("s")


def feature_importance_top(w: Workspace) -> DataFrame:
    model, _ = _fitted(w)
    return ml.feature_importance(model, w.spark).limit(15)


def importance_total(w: Workspace) -> DataFrame:
    """Number and sum of all importances."""
    model, _ = _fitted(w)
    return ml.feature_importance(model, w.spark).agg(
        F.count("*").alias("inputs"), F.sum("importance").alias("total")
    )


def explain_boosted(w: Workspace) -> DataFrame:
    """Summary texts of the tree model, as the scorecard has them."""
    model, path = _fitted(w)
    return explain.summary(tree_explanations(w.current_features, model, path))


def contribution_gap(w: Workspace) -> DataFrame:
    """Base value and contributions add up to the log-odds of the model's probability."""
    model, path = _fitted(w)
    told = tree_explanations(w.current_features, model, path)
    p = F.col("churn_probability")
    # the contributions are log-odds: twice the margin, as Spark's boosting has them
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["contribution"])
    gap = F.round(F.max(F.abs(total - F.log(p / (1 - p)))), 5)
    return told.agg(F.count("*").alias("customers"), gap.alias("gap"))


def score_boosted(w: Workspace) -> DataFrame:
    model, _ = _fitted(w)
    ranked = scoring.score_customers(w.current_features, scoring.trained(model))
    return ranked.select("customer_id", "prediction_date", "churn_probability", "risk_tier",
                         F.col("risk_rank"))


def score_boosted_ranks(w: Workspace) -> DataFrame:
    """Every customer of the last run has a probability and a rank of its own."""
    ranked = score_boosted(w)
    return ranked.agg(
        F.count("*").alias("customers"),
        F.countDistinct("risk_rank").alias("ranks"),
        F.max("risk_rank").cast("bigint").alias("last_rank"),
        F.count_if(~F.col("churn_probability").between(0, 1)).alias("outside"),
    )
