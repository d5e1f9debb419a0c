"""Metrics per customer state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "customer_state"


def state_metrics(lines: DataFrame, missing: str = "skip") -> DataFrame:
    """Lines, times, sales and on-time rate per state.

    `missing="skip"` leaves lines without a flag out and gives a percentage; `missing="half"` counts them as 0.5 and
    gives a share.
    """
    flag = F.col("on_time_delivery").cast("double")
    rate = F.avg(flag) * 100 if missing == "skip" else F.avg(F.coalesce(flag, F.lit(0.5)))
    return lines.groupBy(STATE).agg(
        F.count("order_id").alias("order_count"),
        F.avg("processing_time").alias("avg_processing_time"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        F.sum("price").alias("total_sales"),
        rate.alias("on_time_delivery_rate"),
    )


def category_by_state(lines: DataFrame) -> DataFrame:
    """Lines per state and category."""
    return (
        lines.where(F.col("product_category_name").isNotNull())
        .groupBy(STATE, "product_category_name").agg(F.count("order_id").alias("order_count"))
    )


def top_category_by_state(counts: DataFrame, ties: str = "keep") -> DataFrame:
    """The category with the most lines per state; `ties="first"` keeps one by name."""
    order = [F.desc("order_count")] + ([] if ties == "keep" else [F.col("product_category_name")])
    place = F.rank() if ties == "keep" else F.row_number()
    over = Window.partitionBy(STATE).orderBy(*order)
    return counts.withColumn("__place", place.over(over)).where(F.col("__place") == 1).drop("__place")


def states_with_top_category(states: DataFrame, top: DataFrame) -> DataFrame:
    """State metrics with the state's leading category."""
    lead = top.select(STATE, F.col("product_category_name").alias("top_category"),
                      F.col("order_count").alias("top_category_orders"))
    return states.join(lead, STATE, "left")


def leading_states(states: DataFrame, limit: int = 10) -> DataFrame:
    """The states with the most lines."""
    return states.orderBy(F.desc("order_count"), STATE).limit(limit)


def fastest_states(states: DataFrame, limit: int = 10) -> DataFrame:
    """The states with the shortest average delivery."""
    return states.orderBy(F.asc_nulls_last("avg_delivery_days"), STATE).limit(limit)


def order_shares(states: DataFrame, named: int = 5) -> DataFrame:
    """Share of all lines for the largest states and for the others together.

    The leaders come from a top-n sort; everything else is folded into one row without ranking it.
    """
    leaders = leading_states(states, named).select(F.col(STATE).alias("name"), F.col("order_count").alias("value"))
    both = states.agg(F.sum("order_count").alias("total"), F.count(F.lit(1)).alias("states"))
    taken = leaders.agg(F.sum("value").alias("taken"))
    others = (
        both.withColumn("taken", taken.scalar()).where(F.col("states") > named)
        .select(F.lit("Others").alias("name"), (F.col("total") - F.col("taken")).alias("value"))
    )
    total = states.agg(F.sum("order_count")).scalar()
    out = leaders.unionByName(others).withColumn("__total", total)
    share = F.coalesce(F.col("value") / F.nullif(F.col("__total"), F.lit(0)) * 100, F.lit(0.0))
    return out.withColumn("percentage", share).drop("__total")


def region_highlights(states: DataFrame) -> DataFrame:
    """One row: the state with the most lines, the fastest delivery and the highest sales. Ties go to the first name."""
    first = lambda order: F.min_by(STATE, F.struct(order, F.col(STATE)))
    return states.agg(
        first(-F.coalesce("order_count", F.lit(0))).alias("most_orders"),
        first(F.coalesce("avg_delivery_days", F.lit(0.0))).alias("fastest_delivery"),
        first(-F.coalesce("total_sales", F.lit(0.0))).alias("highest_sales"),
    )
