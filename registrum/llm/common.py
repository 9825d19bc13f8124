"""What the operators of this subpackage share: reading, shared tables, small helpers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere here: space and \t \n \v \f \r.
BLANKS = b" \t\n\x0b\x0c\r"
T = TypeVar("T")
COLUMNS_OF_DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Without that setting there
    is no place that all executors see, so the operators that need one refuse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends at the files, a lost executor repeats nothing before them."""
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run in this block, so many rows travel to Python at a time (for rows that are large themselves)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``df``; any others, however they are called, stay behind."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column, with null as an empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


_kept: dict = {}


def remembered(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made by ``make``: of one operator at a time, so a later stage finds the memory free."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)


def slices(rows: Iterable[pa.RecordBatch], column: str, size: int = 1 << 21, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of ``column`` (texts, or lists of four-byte numbers), in order; a longer row is a part of its own. Operators that remember things ``keep`` them."""
    if not keep:
        _kept.clear()  # what an earlier stage's operator remembered in this worker
    for batch in rows:
        values = batch.column(column)
        length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        each = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (4 if pa.types.is_list(values.type) else 1)
        starts = np.flatnonzero(np.diff(np.cumsum(each) // size, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
