"""What the text operators share: reading tables, cutting lineage, and a few expressions.

Nulls: a null text counts as empty everywhere; a null doc_id is carried through as null.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_dir, table

#: White space of the contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and about how many bytes a Python function gets at once, however large Spark's batches are.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
_KEPT: list[dict[str, SparkSession]] = []

__all__ = ["SPACE", "documents", "dropped", "held_out", "lean", "scoped_path", "scratch_path", "scope", "stored", "table", "text_of"]

Batches = Iterator[pa.RecordBatch]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(col: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(divisor: int, remainder: int, col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % divisor == remainder, F.lit(False))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"


def scoped_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the end of the scope, if there is one."""
    path = scratch_path(spark, label)
    if _KEPT:
        _KEPT[-1][path] = spark
    return path


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df as written to a table in the shared folder and read again: its lineage ends there."""
    path = path or scoped_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(label: str):
    """Deletes, at its end, the tables that stored() wrote in it. It yields a function that writes a result which stays."""
    _KEPT.append({})

    def result(df: DataFrame) -> DataFrame:
        mine = _KEPT.pop()  # the result belongs to the scope outside, if there is one
        try:
            return stored(df, label)
        finally:
            _KEPT.append(mine)

    try:
        yield result
    finally:
        for path, spark in _KEPT.pop().items():
            dropped(spark, path)


def _released() -> None:
    """Gives freed memory back to the system, where the C library can: a worker that later tasks use again stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Batches) -> Batches:
    """The batches in slices of bounded rows and, on average in a batch, bytes; a single row is never cut."""
    for b in batches:
        step = max(1, min(SLICE_ROWS, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run over bounded slices; what it frees is given back before and after."""

    @functools.wraps(run)
    def over(batches: Batches) -> Batches:
        _released()
        try:
            yield from run(sliced(batches))
        finally:
            _released()

    return over
