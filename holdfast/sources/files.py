"""Checked, by-name reading of arriving files, the same in batch and in streams.

Every CSV file is read by its own header: files with the same header are read together,
under a schema in that header's order, and brought to one column order afterwards. A file
without a required column is named in the error. Headers are read through Hadoop's file
systems, one line per file; nothing of the data passes the driver.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which a column may arrive.
ALIASES = {"year_month": "period"}
#: Headers that are read at a time.
OPEN_FILES = 32
#: Why a line of a file does not fit its columns.
RAGGED, UNREADABLE = "ragged row", "unreadable cell"


def canonical(name: str) -> str:
    return ALIASES.get(name.strip(), name.strip())


def listed(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files below a path; their content is not read."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return sorted(row["path"] for row in found.toLocalIterator())


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a CSV file, compressed or not."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sparkContext().hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        plain = codec.createInputStream(stream) if codec else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").removeprefix("﻿")]), ()))


def check_header(path: str, names: Sequence[str], required: Sequence[str]) -> None:
    present = [canonical(n) for n in names]
    missing = [n for n in required if n not in present]
    if missing:
        raise ValueError(f"Missing required columns: {missing} in {path}")
    twice = sorted({n for n in required if present.count(n) > 1})
    if twice:
        raise ValueError(f"Columns given twice: {twice} in {path}")


def headers(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, ...]]:
    """The headers of many files, ``OPEN_FILES`` opened at a time."""
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        return list(pool.map(lambda path: header(spark, path), paths))


def ragged(raw: Column, cells: int) -> Column:
    """Whether a CSV line has another number of cells than its header, quotes respected."""
    names = ", ".join(f"c{i} string" for i in range(cells)) + ", _bad string"
    parsed = F.from_csv(raw, names, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return parsed["_bad"].isNotNull()


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, *more, keep_raw: bool = False
) -> DataFrame:
    """The schema's columns of all files, matched by name; ``more`` are further columns to select.

    ``keep_raw`` adds ``_raw`` and ``_reason`` of lines that do not fit (else null), for which all
    columns are parsed. Without it such cells and lines are read as far as they go.
    """
    required = schema.fieldNames()
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    found = listed(spark, paths)
    for path, names in zip(found, headers(spark, found)):
        check_header(path, names, required)
        by_header[names].append(path)
    out = None
    for names, files in sorted(by_header.items()):
        # other columns are read as text and dropped; their names need not be unique
        arriving = T.StructType([
            T.StructField(n, schema[n].dataType) if n in required else T.StructField(f"_other{i}", T.StringType())
            for i, n in enumerate(map(canonical, names))
        ])
        reader = spark.read.option("header", True)
        raw = []
        if keep_raw:
            arriving = arriving.add("_raw", T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", "_raw").option("columnPruning", False)
            bad = ragged(F.col("_raw"), len(names))
            reason = F.when(bad, RAGGED).otherwise(UNREADABLE)
            raw = ["_raw", F.when(F.col("_raw").isNotNull(), reason).alias("_reason")]
        rows = reader.schema(arriving).csv(files).select(*required, *more, *raw)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"No files in {paths}")
    return out


def read(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, fmt: str, *more
) -> DataFrame:
    """The schema's columns by name from files of any format, under its types."""
    if fmt == "csv":
        return read_csv(spark, paths, schema, *more)
    rows = spark.read.format(fmt).load(paths)
    check_header(str(paths), rows.columns, schema.fieldNames())
    given = {canonical(c): c for c in rows.columns}
    wanted = [rows[given[f.name]].cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*wanted, *more)
