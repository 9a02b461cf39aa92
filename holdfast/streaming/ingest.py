"""Incremental ingestion: new engagement files are added to the stored panel once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast import schemas
from holdfast.sources import tables


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Read every file that has not been read yet, then stop.

    The stream finds the files; each micro-batch reads its files by name as the batch job
    does, refuses one without a required column or rows without a key, keeps the first row of
    a key in file order and appends by key. A replayed batch finds its keys stored already.
    """
    reader = spark.readStream.schema(schemas.ENGAGEMENT).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = reader.csv(source).select(F.col("_metadata.file_path").alias("file"))

    def add(batch: DataFrame, _: int) -> None:
        names = [row["file"] for row in batch.distinct().toLocalIterator()]
        if names:
            tables.append_engagement(spark, tables.read_new_engagement(spark, names), target)

    return (
        arriving.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
