"""Small helpers that the operators share: input columns, row keys, stored tables."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.tables import shared_folder

#: White space that separates words, as a class of Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
#: Separators of licence and benchmark words, after lower-casing.
NO_LETTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker takes on at a time, and of an Arrow batch that it is sent.
BATCH_BYTES, ARROW_BYTES = 8 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and nothing else that the input has."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of single bytes can take the faster ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """With ``doc_id`` it tells rows apart. Rows equal in both are copies of one row."""
    return F.xxhash64(text)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equal in the named columns; nulls equal each other."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


#: A stored table of at most so many rows is broadcast, if its files are small too.
SMALL_ROWS, SMALL_BYTES = 1 << 18, 16 << 20


def if_small(stored: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its measured size allows; else Spark shuffles it."""
    small = stored.measured["rows"] <= SMALL_ROWS and stored.file_bytes <= SMALL_BYTES
    return F.broadcast(stored) if small else stored


def trim() -> None:
    """What this worker has freed goes back to the system: it lives on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def pieces(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Frames cut so that each holds about ``BATCH_BYTES`` of text, or one row. At the end memory is trimmed."""
    for frame in frames:
        start, held = 0, 0
        for at, size in enumerate(frame[column].str.len()):
            if held and held + size > BATCH_BYTES:
                yield frame.iloc[start:at]
                start, held = at, 0
            held += size
        if start < len(frame):
            yield frame.iloc[start:]
    trim()


ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether a command deletes the files of its shuffles when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables in the cluster's shared folder that cut a lineage and serve several scans.

    A lost executor then costs the running stage only. ``drop`` deletes what is no
    longer read; the rest goes when the driver's program ends.

    A session that does not bound the bytes of its Arrow batches gets ``ARROW_BYTES``: ten thousand
    long texts in one batch would not fit a worker.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if spark.conf.get(ARROW_LIMIT, None) is None:
            spark.conf.set(ARROW_LIMIT, ARROW_BYTES)
        self.root = f"{shared_folder(spark)}/holdfast-llm-{uuid4().hex}"
        self.written: list[str] = []
        _STORES.append(self)

    def put(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """Write ``df`` and return it as read back, its row count and other aggregates in ``measured``.

        The files of its shuffles go at once, not when the driver collects its garbage.
        """
        path = f"{self.root}/{name}-{uuid4().hex[:8]}"
        seen = Observation()
        counted = [m.alias(k) for k, m in measures.items()]
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *counted).write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.written.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at, out.measured = path, seen.get
        files, folder = self._folder(path)
        out.file_bytes = files.getContentSummary(folder).getLength()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (t.stored_at for t in tables if hasattr(t, "stored_at")):
            self._delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but the given ones."""
        kept = {t.stored_at for t in tables}
        for path in [p for p in self.written if p not in kept]:
            self._delete(path)
            self.written.remove(path)

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsparkSession.sparkContext().hadoopConfiguration()
        return folder.getFileSystem(conf), folder

    def _delete(self, path: str) -> None:
        files, folder = self._folder(path)
        files.delete(folder, True)


_STORES: list[Store] = []


@atexit.register
def _clear() -> None:
    for store in _STORES:
        try:
            store._delete(store.root)
        except Exception:  # noqa: BLE001  the session has already ended
            return
