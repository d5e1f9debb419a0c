"""Choosing one date format for a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats tried, in order; day-first comes before month-first.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy",
    "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "d-M-yyyy H:m:s", "d/M/yyyy H:m:s", "M-d-yyyy H:m:s", "M/d/yyyy H:m:s",
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s.SSSSSS",
)


def best_format(df: DataFrame, column: str) -> Column:
    """Position of the format most values parse with, the earlier one on a tie; NULL when none parses."""
    hits = [F.count(F.try_to_timestamp(F.col(column), F.lit(f))) for f in DATE_FORMATS]
    scores = F.array(*hits)
    top = F.array_max(scores)
    return df.agg(F.when(top > 0, F.array_position(scores, top)).alias("f")).scalar()


def parse_dates(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Parse a whole text column with the one format that fits it best; failures become NULL, zone UTC."""
    choice = best_format(df, column)
    parsed = F.lit(None).cast("timestamp")
    for i, f in reversed(list(enumerate(DATE_FORMATS, 1))):
        parsed = F.when(F.col("__f") == i, F.try_to_timestamp(F.col(column), F.lit(f))).otherwise(parsed)
    return df.withColumn("__f", choice).withColumn(output or column, parsed).drop("__f")
