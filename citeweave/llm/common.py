"""Shared helpers: scratch tables, joins that survive hot keys, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a few numbers or 16-byte identifiers that a broadcast may hold at most: some 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only in local mode, where all tasks share a disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def _database(spark: SparkSession) -> str:
    """The database of this application's scratch tables, which lies in the shared folder."""
    name = "citeweave_" + re.sub("[^a-z0-9]", "_", spark.sparkContext.applicationId.lower())
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch_dir(spark)}/{name}'")
    return name


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage without tying results to one executor's disk, and
    leaves the reader free to choose its partitioning (a later join exchanges
    both sides itself, so adaptive execution can split a hot key). The table stays until the
    innermost ``results_dropped`` ends, or the application.
    """
    return (_HOLDERS[-1] if _HOLDERS else Scratch(df.sparkSession))(df, tag)


class Scratch:
    """Written intermediate tables of one operator; leaving the context drops them and their files.

    What an operator returns must be written outside of it, or before, by ``materialize``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        name = f"{_database(self.spark)}.{re.sub('[^a-z0-9]', '_', tag.lower())}_{uuid.uuid4().hex}"
        df.write.format("parquet").saveAsTable(name)
        written = self.spark.table(name)
        self.names.append((written, name))
        return written

    def drop(self, *tables: DataFrame) -> None:
        """Drop those of ``tables`` that were written here; nothing may read them any more."""
        for df, name in [n for n in self.names if any(n[0] is t for t in tables)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.names.remove((df, name))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*(df for df, _ in self.names))


_HOLDERS: list[Scratch] = []
#: The C library's call that returns freed heap to the system, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


@contextmanager
def results_dropped(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` writes inside is dropped at the end: for a caller that has written what it made of it."""
    with Scratch(spark) as holder:
        _HOLDERS.append(holder)
        try:
            yield
        finally:
            _HOLDERS.remove(holder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it was counted to hold at most ``rows`` rows; else Spark chooses, and shuffles what is large."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(text: Column) -> Column:
    """128 bits that, with its id, name a row by its text as it stands; null and empty texts differ."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(text.cast("string"), F.lit("")))))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text of single-byte characters takes the vectorised ``lower``; any other
    is translated letter by letter, as ``lower`` would also change e.g. accented
    capitals.
    """
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, size: int = 6 << 20) -> DataFrame:
    """Apply ``fn`` (batch -> dict of column lists) batch by batch; nothing is gathered."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, batch.num_rows, size):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in out], schema=out)
                del cols, part
            del batch
            pa.default_memory_pool().release_unused()
        release()

    return df.mapInArrow(run, schema)


#: What workers remember of the texts of a task; emptied at its end.
TASK_CACHES: list[dict] = []


def release() -> None:
    """Give freed memory back: a worker stays, idle, beside those of later stages."""
    for cache in TASK_CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def sliced(batch: pa.RecordBatch, rows: int, size: int) -> Iterable[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text, so the memory of a step is bounded."""
    widths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            widths += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for i, width in enumerate(widths):
        if i > start and (total + width > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += width
    if batch.num_rows > start:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]
