"""Tables whose writes are seen whole or not at all, laid out for joins and look-ups by one key.

A write goes to a new folder of the table. Then a manifest, one small file, lists the folders that are the
table from now on; it appears under its final name in one step. Readers take the newest manifest and
open the folders it names. A write that stops earlier leaves a folder that no reader knows; repeating
the write gives the same table, and the next manifest's writer deletes what the last ones do not name.

A manifest has a line for each piece: the value of the partition column, the folder and its rows. So the
parts of a table, their rows and what has arrived since an earlier version are known without opening a file.

With a ``key``, rows are dealt to ``buckets`` by a hash of the key and sorted by it in every file, with bloom
filters. Joins and groups by the key then need no shuffle, and a look-up opens one bucket's file per piece and reads
the row groups that can hold the key. One writer at a time is assumed, as for any job of a day.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from hashlib import md5
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas

MANIFESTS = "_published"
#: Folders are named as partitions, so that Spark reads several of them as one table.
FOLDER = "holdfast_version"
#: Manifests whose folders stay, so that a reader of the last version can finish.
KEPT = 2


@dataclass(frozen=True)
class Piece:
    """A folder of the table: value of the partition column (empty without one) and rows."""

    part: str
    folder: str
    rows: int
    buckets: int


class VersionedTable:
    """One table below ``path``, partitioned by ``part`` and laid out by ``key``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        part: str | None = None,
        key: str | None = None,
        buckets: int | None = None,
        row_group_bytes: int | None = None,
    ):
        self.spark, self.path, self.part, self.key = spark, path.rstrip("/"), part, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.row_group_bytes = row_group_bytes

    # --- manifests -----------------------------------------------------------------------

    def _location(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _files(self):
        return self._location().getFileSystem(self.spark._jsparkSession.sparkContext().hadoopConfiguration())

    def _names(self, *below: str) -> list[str]:
        files, folder = self._files(), self._location(*below)
        if not files.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in files.listStatus(folder))

    def version(self) -> str | None:
        """Name of the newest manifest."""
        return max((n for n in self._names(MANIFESTS) if n.isdigit()), default=None)

    def _manifest(self, version: str | None) -> dict:
        if version is None:
            return {"pieces": [], "note": {}, "schema": None}
        stream = self._files().open(self._location(MANIFESTS, version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.version() is not None

    def pieces(self, parts: Iterable[str] | None = None) -> list[Piece]:
        """Pieces of the newest version, of some parts or all."""
        found = [Piece(**p) for p in self._manifest(self.version())["pieces"]]
        if parts is None:
            return found
        wanted = set(parts)
        return [p for p in found if p.part in wanted]

    def parts(self) -> list[str]:
        return sorted({p.part for p in self.pieces()})

    def note(self) -> dict:
        """What the writer of the newest version noted with it."""
        return self._manifest(self.version())["note"]

    def _publish(self, pieces: Sequence[Piece], columns: T.StructType, note: dict | None) -> None:
        before = self.version()
        number = f"{int(before or 0) + 1:012d}"
        text = json.dumps({
            "pieces": [asdict(p) for p in pieces], "schema": self._typed(columns).jsonValue(), "note": note or {},
        })
        files, draft = self._files(), self._location(MANIFESTS, f"draft-{uuid4().hex}")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not files.rename(draft, self._location(MANIFESTS, number)):
            raise RuntimeError(f"{self.path}: version {number} was published by another writer")
        self._clear()

    def _clear(self) -> None:
        """Delete old manifests and the folders that no kept manifest names."""
        files, names = self._files(), self._names(MANIFESTS)
        kept = [n for n in names if n.isdigit()][-KEPT:]
        named = {p["folder"].split("/")[0] for n in kept for p in self._manifest(n)["pieces"]}
        for name in set(names) - set(kept):
            files.delete(self._location(MANIFESTS, name), False)
        for name in self._names():
            if name.startswith(f"{FOLDER}=") and name not in named:
                files.delete(self._location(name), True)

    # --- writing -------------------------------------------------------------------------

    def _write(self, frames: Sequence[DataFrame]) -> list[Piece]:
        """Write rows to a new folder; nothing is published yet."""
        name = f"{FOLDER}={uuid4().hex}"
        folder = f"{self.path}/{name}"
        for frame in frames:
            self._append(frame, folder)
        if self.key:
            self.spark.sql(f"DROP TABLE {_table_name(folder)}")  # the session's entry; the files stay
        written = self.spark.read.schema(self._typed(frames[0].schema)).parquet(folder)
        rows = written.groupBy(self.part) if self.part else written.groupBy()
        counted = rows.count().collect()  # footers only; one row per part
        buckets = self.buckets if self.key else 0
        if not self.part:
            return [Piece("", name, counted[0]["count"], buckets)]
        count = {r[self.part]: r["count"] for r in counted}
        found = [n for n in self._names(name) if n.startswith(f"{self.part}=")]
        parts = {unquote(n.split("=", 1)[1]): n for n in found}
        return [Piece(p, f"{name}/{parts[p]}", count[p], buckets) for p in sorted(count)]

    def _append(self, frame: DataFrame, folder: str) -> None:
        if not self.key:
            writer = frame.write.mode("append").option("path", folder)
            (writer.partitionBy(self.part) if self.part else writer).save(format="parquet")
            return
        dealt = frame.repartition(self.buckets, self.key).sortWithinPartitions(*filter(None, (self.part, self.key)))
        writer = dealt.write.format("parquet").mode("append").option("path", folder)
        writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        if self.row_group_bytes:
            writer = writer.option("parquet.block.size", self.row_group_bytes)
        writer = writer.bucketBy(self.buckets, self.key).sortBy(self.key)
        (writer.partitionBy(self.part) if self.part else writer).saveAsTable(_table_name(folder))

    def _typed(self, schema: T.StructType) -> T.StructType:
        """The partition column is text: folder names such as 2024-01 are neither numbers nor dates."""
        return T.StructType([T.StructField(f.name, T.StringType()) if f.name == self.part else f for f in schema])

    def replace(self, *frames: DataFrame, note: dict | None = None) -> None:
        """The frames' rows become the whole table."""
        self._publish(self._write(frames), frames[0].schema, note)

    def replace_parts(self, frame: DataFrame, note: dict | None = None) -> list[str]:
        """The frame's parts replace those of the same value; returns them."""
        new = self._write([frame])
        gone = {p.part for p in new}
        self._publish([p for p in self.pieces() if p.part not in gone] + new, frame.schema, note)
        return sorted(gone)

    def append(self, frame: DataFrame, note: dict | None = None) -> None:
        """The frame's rows are added; without rows and a new note there is no new version.

        A note that is not given stays as it was.
        """
        new = [p for p in self._write([frame]) if p.rows]
        if new or note is not None:
            self._publish(self.pieces() + new, frame.schema, self.note() if note is None else note)

    # --- reading -------------------------------------------------------------------------

    def schema(self) -> T.StructType | None:
        """Columns of the newest version; None of a table never written."""
        found = self._manifest(self.version())["schema"]
        return found and T.StructType.fromJson(found)

    def read(
        self,
        parts: Iterable[str] | None = None,
        schema: T.StructType | None = None,
        pieces: Sequence[Piece] | None = None,
    ) -> DataFrame:
        """Rows of the newest version, of some parts or given pieces; other folders are not opened."""
        found = self.pieces(parts) if pieces is None else list(pieces)
        columns = schema or self.schema()
        if columns is None:
            raise ValueError(f"{self.path} has not been written")
        if not found:
            return schemas.empty(self.spark, columns)
        folders = [f"{self.path}/{p.folder}" for p in found]
        rows = self.spark.read.schema(self._typed(columns)).option("basePath", self.path).parquet(*folders)
        return rows.select(*columns.fieldNames())

    def by_key(self, piece: Piece, schema: T.StructType | None = None) -> DataFrame:
        """A piece as a bucketed table: Spark joins and groups it by the key without a shuffle."""
        columns = schema or self.schema()
        folder = f"{self.path}/{piece.folder}"
        if not piece.buckets:
            return self.read(schema=columns, pieces=[piece])
        inside = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns if f.name != self.part)
        name = _table_name(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({inside}) USING parquet CLUSTERED BY (`{self.key}`) "
            f"SORTED BY (`{self.key}`) INTO {piece.buckets} BUCKETS LOCATION '{folder}'"
        )
        rows = self.spark.table(name)
        if self.part:
            rows = rows.withColumn(self.part, F.lit(piece.part))
        return rows.select(*columns.fieldNames())

    def lookup(
        self, value, parts: Iterable[str] | None = None, schema: T.StructType | None = None
    ) -> DataFrame:
        """Rows of one key. Of each piece one bucket's files are opened, and there the row groups
        whose range and bloom filter allow the key."""
        found = self.pieces(parts)
        columns = schema or self.schema()
        if not found:
            return schemas.empty(self.spark, columns)
        kind = columns[self.key].dataType
        wanted = F.lit(value).cast(kind)
        each: Callable[[Piece], DataFrame] = lambda p: self.by_key(p, columns).where(F.col(self.key) == wanted)
        return reduce(DataFrame.union, map(each, found))


def _table_name(folder: str) -> str:
    return f"holdfast_{md5(folder.encode()).hexdigest()}"
