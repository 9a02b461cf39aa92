"""Streams that remember per customer what they have seen, so that a batch reads no stored rows.

Each stream keeps a row of state per customer in its checkpoint's state store. A batch's output goes to
a versioned table together with the batch's number, so a batch that is replayed after a stop is not
added again, and state and table agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from holdfast import schemas
from holdfast.operators import actions
from holdfast.operators.monitoring import HIGH
from holdfast.sources import tables
from holdfast.sources.versions import VersionedTable

#: Periods of a customer that a stream remembers.
REMEMBERED = 36
#: Days of alerts that a stream remembers of a customer.
ALERT_DAYS = 14


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their place in the task, which reads a piece of a file in order."""
    count = 0
    for frame in batches:
        yield frame.assign(_row=range(count, count + len(frame)))
        count += len(frame)


def first_of_keys(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The first row, by file order, of each period; holds one row per period at a time."""
    kept = None
    for frame in batches:
        both = frame if kept is None else pd.concat([kept, frame])
        kept = both.sort_values(["_file", "_start", "_row"], kind="stable").drop_duplicates("period")
    return kept


def remember(remembered: int):
    """Pass on the rows of periods that the customer has not had; note the last ``remembered`` periods.

    Rows of periods before those are passed on with ``_unknown``: whether they were stored is not remembered.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        floor, seen = state.get if state.exists else ("", [])
        rows = first_of_keys(batches)
        rows = rows[~rows["period"].isin(seen)].assign(_unknown=lambda r: r["period"] <= floor)
        periods = sorted({*seen, *rows.loc[~rows["_unknown"], "period"]})
        if len(periods) > remembered:
            floor, periods = periods[-remembered - 1], periods[-remembered:]
        state.update((floor, periods))
        yield rows.drop(columns=["_file", "_start", "_row"])

    return run


def ingest_with_state(
    spark: SparkSession,
    source: str,
    target: VersionedTable,
    checkpoint: str,
    files_per_batch: int | None = None,
    remembered: int = REMEMBERED,
) -> StreamingQuery:
    """Add the first row of every (customer, period) of the arriving CSV files; then stop.

    Repeated and late rows within ``remembered`` periods are told from the state; older ones are compared
    with the stored rows of their periods. Rows without a key are dropped here: ``ingest`` of the job sets
    them apart. ``target`` has one stream; rows that other jobs stored are not in the state.
    """
    reader = spark.readStream.schema(schemas.ENGAGEMENT).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = tables.nan_to_null(reader.csv(source).select(
        *schemas.ENGAGEMENT.fieldNames(), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    ))
    placed = T.StructType([*arriving.schema, T.StructField("_row", T.LongType())])
    arriving = arriving.mapInPandas(numbered, placed).where("customer_id is not null and period is not null")
    out = T.StructType([*schemas.ENGAGEMENT, T.StructField("_unknown", T.BooleanType())])
    new = arriving.groupBy("customer_id").applyInPandasWithState(
        remember(remembered), out, "floor string, periods array<string>", "append", GroupStateTimeout.NoTimeout
    )

    def add(batch: DataFrame, number: int) -> None:
        rows, note = tables.stored(batch, "arrived"), target.note()  # a replayed batch must bring the state up to date
        if note.get("batch", -1) >= number:
            return
        fresh, old = rows.where("not _unknown").drop("_unknown"), rows.where("_unknown").drop("_unknown")
        periods = [r["period"] for r in old.select("period").distinct().collect()]
        if target.pieces(periods):
            keys = T.StructType([schemas.ENGAGEMENT[c] for c in tables.PANEL_KEY])
            old = tables.new_rows(old, target.read(periods, keys), tables.PANEL_KEY)
        target.append(fresh.unionByName(old), note={**note, "batch": number})

    return _started(new, add, checkpoint)


def once_a_day(keep_days: int):
    """Pass on a customer's first alert of a day; remember the days until they are ``keep_days`` old."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        days = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("run", kind="stable").drop_duplicates("day")
        rows = rows[~rows["day"].isin(days)]
        days = sorted({*days, *rows["day"]})[-keep_days:]
        state.update((days,))
        until = pd.Timestamp(days[-1]) + pd.Timedelta(days=keep_days)
        state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.drop(columns="seen")

    return run


def alerts_with_state(
    spark: SparkSession, predictions: str, log: VersionedTable, checkpoint: str, keep_days: int = ALERT_DAYS
) -> StreamingQuery:
    """One alert and flag a day for every high-risk customer of the arriving runs; then stop.

    What was alerted is in the state: the log is appended to and never read. The state of a customer
    goes ``keep_days`` after the last alert.
    """
    stored = spark.read.parquet(predictions).schema
    run = F.col("prediction_date").cast("string")
    arriving = spark.readStream.schema(stored).parquet(predictions).where(F.col("risk_tier") == HIGH).select(
        *actions.ALERT_COLUMNS, run.alias("run"), F.date_format(F.to_timestamp(run), "yyyy-MM-dd").alias("day"),
        F.to_timestamp(run).alias("seen"),
    ).withWatermark("seen", "1 day")
    out = arriving.drop("seen").schema
    new = arriving.groupBy("customer_id").applyInPandasWithState(
        once_a_day(keep_days), out, "days array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )

    def act(batch: DataFrame, number: int) -> None:
        rows, note = tables.stored(batch, "alerts"), log.note()
        if note.get("batch", -1) < number:
            found = actions.new_interventions(rows, F.to_timestamp("run"))
            log.append(found.withColumn("log_day", F.date_format("timestamp", "yyyy-MM-dd")), note={**note, "batch": number})

    return _started(new, act, checkpoint)


def _started(new: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    return (
        new.writeStream.foreachBatch(sink).outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
