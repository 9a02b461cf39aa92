"""Training, splitting and storing the boosted-tree model on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.features import model_columns
from holdfast.operators.rank import global_rank

INPUT_SUFFIX = "_in"
#: Column that marks the rows of the test part.
TEST = "_test"


@dataclass(frozen=True)
class BoostingSettings:
    """The hyper-parameters of the churn model."""

    max_depth: int = 6
    learning_rate: float = 0.1
    trees: int = 100
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


def stratified_split(
    df: DataFrame,
    label: str = "churned",
    key: tuple[str, ...] = ("customer_id", "period"),
    test_share: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Random train and test parts with the same share of every label, see ``marked_split``."""
    marked = marked_split(df, label, key, test_share, seed)
    return marked.where(~F.col(TEST)).drop(TEST), marked.where(TEST).drop(TEST)


def marked_split(
    df: DataFrame,
    label: str = "churned",
    key: tuple[str, ...] = ("customer_id", "period"),
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """All rows, ``TEST`` says which are in the test part; store them to rank once for both parts.

    Rows are ordered by a seeded hash of their key, so the split does not depend
    on partitioning. The majority label is ranked in ranges, not in one task.
    """
    shuffled = df.withColumn("_draw", F.xxhash64(*key, F.lit(seed)))
    placed = global_rank(shuffled, "_place", [F.col("_draw")], key, within=[label])
    sizes = df.groupBy(label).agg(F.round(F.count("*") * test_share).alias("_test_rows"))
    placed = placed.join(F.broadcast(sizes), label)
    chosen = F.col("_place") <= F.col("_test_rows")
    return placed.withColumn(TEST, chosen).drop("_draw", "_place", "_test_rows")


def evenly_dealt(df: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("customer_id", "period")) -> DataFrame:
    """The rows, made from a stored table that is read in more parts than there are cores, in equal
    parts: a multiple of the cores. Rows of a smaller table stay as they are.

    Boosting runs a short stage for each level of each tree. With one part more than cores all cores but one
    wait for half of the time.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, stored.rdd.getNumPartitions()
    return df.repartition(-(-parts // cores) * cores, *key) if parts > cores else df


def temporal_split(df: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Periods before the cutoff train, the rest test."""
    return df.where(F.col("period") < cutoff), df.where(F.col("period") >= cutoff)


def build_pipeline(features: list[str], settings: BoostingSettings) -> Pipeline:
    inputs = [f"{c}{INPUT_SUFFIX}" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=features, outputCols=inputs),
        VectorAssembler(inputCols=inputs, outputCol="features"),
        GBTClassifier(
            labelCol="churned",
            featuresCol="features",
            maxDepth=settings.max_depth,
            stepSize=settings.learning_rate,
            maxIter=settings.trees,
            subsamplingRate=settings.row_share,
            featureSubsetStrategy=str(settings.column_share),
            seed=settings.seed,
        ),
    ])


def as_inputs(df: DataFrame) -> DataFrame:
    """Model columns as doubles, as the imputer needs them."""
    return df.withColumns({c: F.col(c).cast("double") for c in model_columns(df)})


def train(
    df: DataFrame, settings: BoostingSettings = BoostingSettings(), columns: list[str] | None = None
) -> PipelineModel:
    """Fit the model, on all model columns or some; with a cluster checkpoint folder set, long
    boosting lineage is cut there."""
    return build_pipeline(columns or model_columns(df), settings).fit(as_inputs(df))


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), greatest first; one row per model input."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(names, weights)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
