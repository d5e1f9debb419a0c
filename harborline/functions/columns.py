"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: ColumnLike) -> Column:
    """NaN and the two infinities become NULL, so that averages skip them."""
    c = as_column(value).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def to_number(value: ColumnLike) -> Column:
    """Text to a finite double, NULL where it does not parse."""
    return finite(as_column(value).try_cast("double"))


def clip(value: ColumnLike, low: float | Column | None, high: float | Column | None) -> Column:
    """Hold a value inside [low, high]; NULL stays NULL."""
    c = as_column(value)
    held = c
    if low is not None:
        held = F.greatest(held, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        held = F.least(held, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), held)


def half_up(value: ColumnLike) -> Column:
    """Nearest whole number with halves going up, also for negatives."""
    return F.floor(as_column(value) + F.lit(0.5))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Fractional days from `earlier` to `later`, NULL when negative."""
    seconds = F.timestamp_diff("SECOND", as_column(earlier), as_column(later))
    return F.when(seconds >= 0, seconds / F.lit(86400.0))


def whole_days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Calendar days from `earlier` to `later`, NULL when negative."""
    days = F.datediff(as_column(later), as_column(earlier))
    return F.when(days >= 0, days)


def one_row(df: DataFrame, *columns: Column) -> Column:
    """A one-row aggregate of `df` as a scalar subquery returning a struct.

    The aggregate stays inside the caller's plan, so no join and no driver-side value is needed.
    """
    return df.agg(F.struct(*columns).alias("s")).scalar()


def with_scalar(df: DataFrame, name: str, source: DataFrame, *columns: Column) -> DataFrame:
    return df.withColumn(name, one_row(source, *columns))


def bind_value(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
