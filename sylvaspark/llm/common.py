"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import PLAIN_FILES, release, shared_dir

__all__ = ["ARROW_ROWS", "chunks", "materialize", "release", "settings", "shared_dir", "signed", "slices", "table", "text_bytes"]

#: Rows of an Arrow batch while a stage of texts is written: texts may be long, so batches stay small.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the length of one action (``__`` stands for a dot); the session's own come back after it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Shuffle files of the write go with it, as what is written needs them no longer.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with settings(spark, spark__sql__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(ARROW_ROWS)):
        df.write.options(**PLAIN_FILES).parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._written_at = at
    return back


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few hundred rows, without copying: where the caller's session decides how large they come."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def signed(hexadecimal) -> "F.Column":
    """The first 16 hexadecimal digits of a string column, as a long that may be negative."""
    return F.conv(F.substring(hexadecimal, 1, 16), 16, -10).cast("long")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; null is empty."""
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes; a longer row stands alone."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if len(sizes) > a:
        yield a, len(sizes)
