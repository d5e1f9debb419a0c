"""Monthly demand per category and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip

CATEGORY = "product_category_name"


def monthly_demand(lines: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Lines per category and month with the month's first day; lines without a category are left out."""
    return (
        lines.where(F.col(category).isNotNull())
        .groupBy(category, "order_year", "order_month")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("date", F.make_date("order_year", "order_month", F.lit(1)))
    )


def finished_until(frame: DataFrame, stamp: str = "order_purchase_timestamp", slack_days: int = 3) -> Column:
    """First day that belongs to no finished month, as a scalar of one scan of the stamps.

    The last month is finished if stamps reach into its last `slack_days` days; otherwise its own first day is given.
    Without any stamp the result is NULL.
    """
    last = F.max(F.to_date(stamp))
    end = F.last_day(last)
    day = F.when(F.datediff(end, last) < slack_days, F.date_add(end, 1)).otherwise(F.trunc(last, "month"))
    return frame.agg(day.alias("day")).scalar()


def monthly_sales(lines: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Line count and sales per category and month."""
    return (
        lines.where(F.col(category).isNotNull())
        .groupBy(category, "order_year", "order_month")
        .agg(F.count("order_id").alias("order_count"), F.sum("price").alias("total_sales"))
    )


def top_categories(demand: DataFrame, limit: int = 15, category: str = CATEGORY) -> DataFrame:
    """The categories with the most demand, largest first, ties by name."""
    return (
        demand.where(F.col(category).isNotNull())
        .groupBy(category).agg(F.sum(F.coalesce("count", F.lit(0))).alias("total_count"))
        .orderBy(F.desc("total_count"), category).limit(limit)
    )


def busiest_categories(demand: DataFrame, limit: int = 5, category: str = CATEGORY) -> DataFrame:
    """The categories present in the most months, ties by name."""
    return (
        demand.where(F.col(category).isNotNull())
        .groupBy(category).agg(F.count(F.lit(1)).alias("active_months"))
        .orderBy(F.desc("active_months"), category).limit(limit)
    )


def demand_per_month(demand: DataFrame) -> DataFrame:
    """Demand of all categories together per month, with the number of categories."""
    return demand.groupBy("date").agg(
        F.sum("count").alias("total"), F.count_distinct(CATEGORY).alias("categories")
    )


def demand_heatmap(demand: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Category and year against the twelve months, zero where nothing was ordered. Columns m1 to m12."""
    wide = demand.groupBy(category, "order_year").pivot("order_month", list(range(1, 13))).agg(F.sum("count"))
    months = [F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("long").alias(f"m{m}") for m in range(1, 13)]
    return wide.select(category, "order_year", *months)


def category_totals(demand: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Total and average monthly demand, and months with demand, per category."""
    return demand.groupBy(category).agg(
        F.sum("count").alias("total_demand"), F.avg("count").alias("avg_monthly_demand"),
        F.count(F.lit(1)).alias("months"),
    )


def nested_series(demand: DataFrame, category: str = CATEGORY) -> DataFrame:
    """One row per category holding its months in order; a series is as long as the calendar."""
    points = F.sort_array(F.collect_list(F.struct("date", "count")))
    return demand.groupBy(category).agg(points.alias("points"))


def month_changes(demand: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Change and percent change against the category's previous month; 0 in its first month."""
    previous = F.lag("count").over(Window.partitionBy(category).orderBy("date"))
    out = demand.withColumn("__previous", previous)
    change = F.when(F.col("__previous").isNotNull(), F.col("count") - F.col("__previous")).otherwise(F.lit(0))
    percent = F.when(F.col("__previous") > 0, change / F.col("__previous") * 100).otherwise(F.lit(0.0))
    return out.withColumns({"change": change, "percent_change": percent}).drop("__previous")


def category_growth(demand: DataFrame, category: str = CATEGORY) -> DataFrame:
    """Growth of a category: last three months against first three when it has six, else last month against first;
    held in -99..1000. The trend is up above 5, down below -5, else flat."""
    along = Window.partitionBy(category).orderBy("date")
    back = Window.partitionBy(category).orderBy(F.desc("date"))
    numbered = demand.withColumns({"from_start": F.row_number().over(along), "from_end": F.row_number().over(back)})
    n = F.count(F.lit(1))

    def mean_of(position: str, upto: int):
        return F.avg(F.when(F.col(position) <= upto, F.col("count")))

    ends = numbered.groupBy(category).agg(
        n.alias("months"),
        F.when(n >= 6, mean_of("from_start", 3)).otherwise(mean_of("from_start", 1)).alias("first_value"),
        F.when(n >= 6, mean_of("from_end", 3)).otherwise(mean_of("from_end", 1)).alias("last_value"),
    )
    raw = (F.col("last_value") - F.col("first_value")) / F.nullif(F.col("first_value"), F.lit(0.0)) * 100
    growth = F.when(
        (F.col("months") >= 2) & (F.col("first_value") > 0), clip(raw, -99.0, 1000.0)
    ).otherwise(F.lit(0.0))
    out = ends.withColumn("growth", growth)
    trend = F.when(F.col("growth") > 5, "up").when(F.col("growth") < -5, "down").otherwise("flat")
    return out.withColumn("trend", trend)
