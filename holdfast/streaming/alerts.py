"""Alerts as prediction runs arrive: one pass per stored run, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast import schemas
from holdfast.operators import actions
from holdfast.operators.monitoring import HIGH
from holdfast.sources import tables


def alert_stream(
    spark: SparkSession, predictions: str, interventions: str, checkpoint: str
) -> StreamingQuery:
    """Append an alert and a flag for every high-risk customer of each arriving run.

    Rows whose customer, action and day are logged are left out, so neither a replayed
    batch nor a rewritten run alerts twice. Only the days at hand are read of the log.
    """
    stored = spark.read.parquet(predictions).schema
    arriving = spark.readStream.schema(stored).parquet(predictions)

    def act(batch: DataFrame, _: int) -> None:
        high = batch.where(F.col("risk_tier") == HIGH).select(
            *actions.ALERT_COLUMNS, F.col("prediction_date").cast("string").alias("run")
        ).distinct()
        log = tables.load(
            spark, interventions, schemas.INTERVENTION_LOG, batch.schema["customer_id"].dataType
        )
        high = high.withColumn("day", F.date_format(F.to_timestamp("run"), "yyyy-MM-dd"))
        first = high.agg(F.min("day").alias("first")).scalar()
        last = high.agg(F.max("day").alias("last")).scalar()
        contacted = log.where(F.col("log_day").between(first, last)).select(
            "customer_id", F.col("log_day").alias("day")
        ).distinct()
        waiting = high.join(contacted, ["customer_id", "day"], "left_anti")
        new = actions.new_interventions(waiting, F.to_timestamp("run"))
        tables.append_log(spark, new, interventions, actions.LOG_KEY, "timestamp")

    return (
        arriving.writeStream.foreachBatch(act)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
