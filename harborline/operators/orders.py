"""Derived and imputed columns of orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, days_between, whole_days_between
from ..functions.quantiles import counted_median, scalar_struct
from ..session import pinned

PURCHASE, APPROVED = "order_purchase_timestamp", "order_approved_at"
DELIVERED, ESTIMATED = "order_delivered_timestamp", "order_estimated_delivery_date"


def with_order_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"order_year": F.year(PURCHASE), "order_month": F.month(PURCHASE)})


def with_whole_days(df: DataFrame) -> DataFrame:
    """processing_time and delivery_days in calendar days, negative ones NULL."""
    return df.withColumns({
        "processing_time": whole_days_between(APPROVED, PURCHASE),
        "delivery_days": whole_days_between(DELIVERED, PURCHASE),
    })


def with_fractional_days(df: DataFrame) -> DataFrame:
    """Processing, actual and estimated delivery time in fractional days, negative ones NULL."""
    return df.withColumns({
        "processing_time": days_between(APPROVED, PURCHASE),
        "actual_delivery_days": days_between(DELIVERED, PURCHASE),
        "estimated_delivery_days": days_between(ESTIMATED, PURCHASE),
    })


def with_on_time(df: DataFrame, by: str = "dates") -> DataFrame:
    """on_time_delivery: 1, 0, or NULL where a side is missing.

    `by="dates"` compares calendar dates, `by="durations"` the fractional delivery times.
    """
    if by == "dates":
        actual, promised = F.to_date(DELIVERED), F.to_date(ESTIMATED)
    else:
        actual, promised = days_between(DELIVERED, PURCHASE), days_between(ESTIMATED, PURCHASE)
    return df.withColumn("on_time_delivery", (actual <= promised).cast("int"))


def derive_order_columns(df: DataFrame) -> DataFrame:
    """All derived order columns the analyses use, in one projection."""
    return with_on_time(with_fractional_days(with_order_month(df)), "durations").withColumn(
        "delivery_days", whole_days_between(DELIVERED, PURCHASE)
    )


def impute_delivery_days(df: DataFrame, group: str | None = "product_category_name") -> DataFrame:
    """delivery_days: whole days to delivery (else to the estimate), at least 1; then the group's median, then the
    overall median; held in 1..30. Works on order lines, where the category is known.
    """
    elapsed = F.floor(
        F.timestamp_diff("SECOND", F.col(PURCHASE), F.coalesce(F.col(DELIVERED), F.col(ESTIMATED))) / F.lit(86400)
    )
    out = df.withColumn("delivery_days", clip(elapsed, F.lit(1).cast("long"), None))
    if not group:
        overall = scalar_struct(counted_median(out, "delivery_days", "m"))
        fallback = [F.col("delivery_days").cast("double")]
    else:
        # Both medians follow from the lines per group and day, unknown days included, so the lines are read once for them.
        counts = pinned(out.groupBy(group, "delivery_days").agg(F.count(F.lit(1)).alias("__n")))
        known = counts.where("delivery_days IS NOT NULL")
        # Written, so that its size is known: the lines meet a small side where they are, a large one by a join that
        # adaptive execution splits.
        medians = pinned(known.groupBy(group).agg(
            F.percentile("delivery_days", F.lit(0.5), F.col("__n")).alias("__group_median")))
        # The overall median counts the rows that the group step has filled.
        filled = counts.join(medians, group, "left").withColumn(
            "__known", F.coalesce(F.col("delivery_days").cast("double"), "__group_median"))
        overall = scalar_struct(filled.agg(F.percentile("__known", F.lit(0.5), F.col("__n")).alias("m")))
        out = out.join(medians, group, "left")
        fallback = [F.col("delivery_days").cast("double"), F.col("__group_median")]
    days = clip(F.coalesce(*fallback, overall["m"]), 1.0, 30.0)
    return out.withColumn("delivery_days", days).drop("__group_median")


def impute_delivered(df: DataFrame) -> DataFrame:
    """A missing delivery stamp becomes purchase plus delivery_days."""
    seconds = (F.col("delivery_days") * 86400).cast("int")
    return df.withColumn(
        DELIVERED, F.coalesce(F.col(DELIVERED), F.timestamp_add("SECOND", seconds, F.col(PURCHASE)))
    )


def synthesize_stamps(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Stamps for absent columns: purchase on the 15th of the order month, approved 24-47 hours later, delivered 3-7
    days after that, estimated 5-10 days after purchase. Offsets follow from the key, so a rerun agrees."""
    out = df
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("long") if kind in ("int", "bigint", "smallint") else F.xxhash64(key)
    if PURCHASE not in out.columns:
        out = out.withColumn(PURCHASE, F.make_date("order_year", "order_month", F.lit(15)).cast("timestamp_ntz"))
    if APPROVED not in out.columns:
        hours = (24 + F.pmod(number, F.lit(24))).cast("int")
        out = out.withColumn(APPROVED, F.timestamp_add("HOUR", hours, F.col(PURCHASE)))
    if DELIVERED not in out.columns:
        days = (3 + F.pmod(number, F.lit(5))).cast("int")
        out = out.withColumn(DELIVERED, F.timestamp_add("DAY", days, F.col(APPROVED)))
    if ESTIMATED not in out.columns:
        days = (5 + F.pmod(number, F.lit(6))).cast("int")
        out = out.withColumn(ESTIMATED, F.timestamp_add("DAY", days, F.col(PURCHASE)))
    return out


def process_orders(df: DataFrame) -> DataFrame:
    """Orders at calendar-day grain with defaults: delivery from the approval gap plus 5 days where no delivery column
    exists, then 7; on-time 0.5 where unknown; estimate 7 days after approval where no estimate column exists."""
    names = df.columns
    out = df.withColumns({c: F.to_date(c) for c in (PURCHASE, APPROVED)})
    out = with_order_month(out).withColumn("processing_time", whole_days_between(APPROVED, PURCHASE))
    if DELIVERED in names:
        delivery = F.datediff(F.col(DELIVERED), F.col(PURCHASE))
        on_time = F.lit(None).cast("double")
        if ESTIMATED in names:
            on_time = (F.to_date(DELIVERED) <= F.to_date(ESTIMATED)).cast("double")
    else:
        delivery = F.datediff(F.col(APPROVED), F.col(PURCHASE)) + 5
        on_time = F.lit(1.0)
    out = out.withColumns({
        "delivery_days": F.coalesce(delivery, F.lit(7)), "on_time_delivery": F.coalesce(on_time, F.lit(0.5)),
    })
    if ESTIMATED not in names:
        out = out.withColumn(ESTIMATED, F.date_add(APPROVED, 7))
    return out


def missing_stamps(columns: Sequence[str]) -> list[str]:
    """The stamp columns a frame lacks."""
    return [c for c in (PURCHASE, APPROVED, DELIVERED, ESTIMATED) if c not in columns]
