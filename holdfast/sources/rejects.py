"""Reading arriving files without losing rows in silence: what cannot be read is set apart and counted.

Every row is either good or rejected, with a reason, its file and its raw text:

* ``ragged row``: a CSV line with more or fewer cells than its header;
* ``unreadable cell``: a cell that is not empty and not of its column's type;
* ``no key``: a row without a part of its key.

Rejected rows are stored once, however often their file is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources import files, tables
from holdfast.sources.versions import VersionedTable

NO_KEY = "no key"
REJECTED = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("raw", T.StringType()),
])


def checked(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, keys: Sequence[str], fmt: str = "csv"
) -> DataFrame:
    """The schema's columns and ``_order``, ``_file``, ``_raw``, ``_reason`` (null: a good row) of every row."""
    if fmt == "csv":
        rows = files.read_csv(
            spark, paths, schema, tables.file_order().alias("_order"), F.col("_metadata.file_path").alias("_file"),
            keep_raw=True,
        )
    else:
        rows = _typed(spark, paths, schema, fmt)
    without_key = reduce(or_, [F.col(k).isNull() for k in keys])
    reason = F.coalesce("_reason", F.when(without_key, F.lit(NO_KEY)))
    raw = F.coalesce("_raw", F.when(without_key, F.to_json(F.struct(*schema.fieldNames()))))
    return tables.nan_to_null(rows.withColumns({"_reason": reason, "_raw": raw}))


def _typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, fmt: str) -> DataFrame:
    """Files that have types: a value that its column's type cannot hold is an unreadable cell."""
    rows = spark.read.format(fmt).load(paths)
    files.check_header(str(paths), rows.columns, schema.fieldNames())
    given = {files.canonical(c): F.col(f"`{c}`") for c in rows.columns}
    cast = {f.name: given[f.name].try_cast(f.dataType) for f in schema}
    lost = reduce(or_, [given[n].isNotNull() & c.isNull() for n, c in cast.items()])
    return rows.select(
        *[c.alias(n) for n, c in cast.items()],
        tables.file_order().alias("_order"),
        F.col("_metadata.file_path").alias("_file"),
        F.when(lost, F.to_json(F.struct(*[given[n].alias(n) for n in cast]))).alias("_raw"),
        F.when(lost, files.UNREADABLE).alias("_reason"),
    )


def good(rows: DataFrame) -> DataFrame:
    return rows.where("_reason is null").drop("_file", "_raw", "_reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("_reason is not null").select(
        F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col("_raw").alias("raw")
    )


def counts(rows: DataFrame) -> dict[str, int]:
    """Rows by reason; good ones under ``good``."""
    found = rows.groupBy(F.coalesce("_reason", F.lit("good")).alias("reason")).count().collect()
    return {r["reason"]: r["count"] for r in found}


def store(rows: DataFrame, table: VersionedTable) -> None:
    """Add rejected rows of files that have none stored yet; of the table the file names are read."""
    new = rejected(rows)
    if table.exists():
        known = table.read(schema=T.StructType([REJECTED["file"]])).distinct()
        new = new.join(known, "file", "left_anti")
    table.append(new)
