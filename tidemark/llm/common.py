"""What the corpus operators share with the rest of the library, and reading only the columns that one needs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.shared import BROADCAST_ROWS, Scratch, components, delete, extended, shared_dir, small

#: Rows of an Arrow batch of whole texts: a worker and its executor hold a few batches each.
BATCH_ROWS = 1000

__all__ = ["BROADCAST_ROWS", "Scratch", "components", "delete", "extended", "shared_dir", "small", "small_batches", "table", "trimmed"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so that extra columns never reach an operator."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def small_batches(df: DataFrame) -> DataFrame:
    """df, as it is; from here on, the session's Arrow batches have BATCH_ROWS rows at most. Plans read the setting when they run, so it stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable, every: int = 16) -> Callable:
    """run, for mapInArrow; what it has freed goes back to the system after every few batches and at the end, as workers live on from stage to stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for n, out in enumerate(run(batches), 1):
                yield out
                if n % every == 0:
                    _release()
        finally:
            _release()

    return wrapped
