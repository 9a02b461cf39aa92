"""Reading, validating and storing the tables of the retention jobs.

Tables are Parquet folders. Predictions are partitioned by ``prediction_date``
and engagement by ``period``, so a reader of the latest run or of a few periods
lists only those folders. Every write can be repeated without adding rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import and_, or_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas
from holdfast.sources import files

PANEL_KEY = ("customer_id", "period")


def read_customers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Customer rows, columns matched by name in every file."""
    return nan_to_null(files.read(spark, path, schemas.CUSTOMERS, fmt))


def read_engagement(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", keep_order: bool = False
) -> DataFrame:
    """Engagement rows, columns matched by name; a file without a required column is refused.

    ``keep_order`` adds ``_order``, the position of the row in its input files.
    """
    order = [file_order().alias("_order")] if keep_order else []
    return nan_to_null(files.read(spark, path, schemas.ENGAGEMENT, fmt, *order))


def read_new_engagement(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Arriving rows, the first of each customer and period in file order."""
    rows = read_engagement(spark, path, fmt, keep_order=True)
    return dedup_first(rows, PANEL_KEY, F.col("_order")).drop("_order")


def require_columns(present: Sequence[str], required: Sequence[str]) -> None:
    missing = [name for name in required if name not in present]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def validate_columns(
    df: DataFrame, required: Sequence[str] = schemas.REQUIRED_ENGAGEMENT
) -> DataFrame:
    """Fail on an absent column; looks at the schema only, runs no job."""
    require_columns(df.columns, required)
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "missing" to analysts but poisons Spark averages, so store null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def file_order() -> Column:
    """Position of a row in its input files, for "first row wins"."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep the first row per key in ``order``.

    An aggregate, not a window: copies of a key collapse on the map side, so a
    key that holds a third of the input sends one row per task to the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that ``dedup_first`` would remove, as one row."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count("*").alias("kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Local sessions without the setting get a temporary folder; a cluster session
    without it is an error, since a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"holdfast-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    _TEMPORARY.append((spark, path))
    return path


_TEMPORARY: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear_temporary() -> None:
    for spark, path in _TEMPORARY:
        try:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop = spark._jsparkSession.sparkContext().hadoopConfiguration()
            location.getFileSystem(hadoop).delete(location, True)
        except Exception:  # noqa: BLE001  the session has already ended
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    For a result that the next steps scan several times: it is computed once, its
    scans read single columns, and a lost executor costs no recomputation.
    """
    path = temporary_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jsparkSession.sparkContext().hadoopConfiguration()
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(hadoop).exists(location)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path; none if there is no such path."""
    if not table_exists(spark, path):
        return []
    hadoop = spark._jsparkSession.sparkContext().hadoopConfiguration()
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(hadoop).listStatus(location)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def keep_only(spark: SparkSession, path: str, name: str) -> None:
    """Delete the folders below a path that a newer one has replaced."""
    hadoop = spark._jsparkSession.sparkContext().hadoopConfiguration()
    for other in folders(spark, path):
        if other != name:
            location = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{other}")
            location.getFileSystem(hadoop).delete(location, True)


def load(
    spark: SparkSession, path: str, schema: T.StructType, key_type: T.DataType | None = None
) -> DataFrame:
    """A stored table, or an empty one when nothing has been written yet."""
    if key_type is not None:
        schema = T.StructType([
            T.StructField(f.name, key_type, f.nullable) if f.name == "customer_id" else f
            for f in schema
        ])
    if not table_exists(spark, path):
        return schemas.empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored; a null in a key equals a stored null."""
    kept = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in keys])
    equal = [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in keys]
    return incoming.join(kept, reduce(and_, equal), "left_anti")


def refuse_null_keys(rows: DataFrame, keys: Sequence[str]) -> None:
    """Fail with their number if rows lack a part of their key; reads the key columns only."""
    lacking = rows.where(reduce(or_, [F.col(k).isNull() for k in keys])).count()
    if lacking:
        raise ValueError(f"{lacking} rows without {' or '.join(keys)}")


def append_engagement(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add rows whose (customer, period) is not stored yet; rows without one are refused.

    The arriving plan runs once. Only the stored key columns are read, and only the folders
    between the first and the last arriving period.
    """
    rows = stored(validate_columns(rows), "arriving")
    refuse_null_keys(rows, PANEL_KEY)
    if table_exists(spark, path):
        schema = T.StructType([rows.schema[c] for c in rows.columns])
        rows = new_rows(rows, _between(spark.read.schema(schema).parquet(path), rows, "period"), PANEL_KEY)
    salt = F.pmod(F.xxhash64("customer_id"), F.lit(_spread(spark)))
    rows.repartition("period", salt).write.mode("append").partitionBy("period").parquet(path)


def _between(stored: DataFrame, arriving: DataFrame, column: str) -> DataFrame:
    """Stored rows in the arriving range of a partition column; other folders are not read."""
    first = arriving.agg(F.min(column).alias("first")).scalar()
    last = arriving.agg(F.max(column).alias("last")).scalar()
    return stored.where(F.col(column).between(first, last))


def _spread(spark: SparkSession) -> int:
    """Tasks that share one period when writing, so one folder is not one task."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def store_predictions(spark: SparkSession, predictions: DataFrame, path: str) -> None:
    """Write whole runs; a repeated run replaces its own folder and nothing else."""
    salt = F.pmod(F.xxhash64("customer_id"), F.lit(_spread(spark)))
    (
        predictions.repartition("prediction_date", salt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("prediction_date")
        .parquet(path)
    )


def append_log(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str], time: str) -> None:
    """Append the rows of a log whose key is not stored for their day yet.

    Rows are told apart by what they say (``keys`` and the day of ``time``), not by their
    ids, which can collide. The log is partitioned by ``log_day``: only the folders of the
    arriving days are read.
    """
    rows = rows.withColumn("log_day", F.date_format(time, "yyyy-MM-dd"))
    if table_exists(spark, path):
        stored = _between(spark.read.schema(rows.schema).parquet(path), rows, "log_day")
        rows = new_rows(rows, stored, [*keys, "log_day"])
    rows.write.mode("append").partitionBy("log_day").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header per part file; nested columns are refused by Spark."""
    df.write.mode("overwrite").csv(path, header=True)


def latest_value(df: DataFrame, column: str) -> Column:
    """Scalar subquery with the greatest value of a column.

    Used as a filter on a partition column it prunes folders at run time.
    """
    return df.agg(F.max(column).alias("latest")).scalar()
