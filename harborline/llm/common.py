"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# An Arrow batch holds at most this much, so that one batch of long texts fits a Python worker.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 * 1024 * 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes of an Arrow batch, for operators that hand whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(rows: int, per_cell: int) -> int:
    """Number of hash cells so that a cell holds about `per_cell` rows, whatever the number of rows."""
    return max(1, math.ceil(rows / per_cell))


def cell_of(count: int, *values: Column) -> Column:
    """Cell number from 0 by a hash of the values."""
    return F.pmod(F.xxhash64(*values), F.lit(count)).cast("long")


def hidden(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches whose texts in `column` hold at most `most` bytes together, or are one text."""
    texts = batch.column(column).cast(pa.large_string())
    upto = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
