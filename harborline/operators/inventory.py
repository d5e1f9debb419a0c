"""Safety stock, reorder points, order quantities and their recommendations, all categories in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, half_up

# Service level, costs and the defaults of the ordering rules.
SERVICE_FACTOR = 1.645
ORDER_COST = 50.0
HOLDING_SHARE = 0.2
DEFAULT_LEAD_DAYS = 7.0
DEFAULT_ITEM_COST = 50.0
DEFAULT_DEMAND = 100.0
MAX_ORDER_GAP_DAYS = 90.0


def category_inputs(lines: DataFrame, demand: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast categories with their demand statistics, mean lead time and mean item cost.

    `forecast` has category and next_month_forecast. Three aggregates and two left joins serve all categories.
    """
    history = demand.groupBy(F.col("product_category_name").alias("category")).agg(
        F.avg("count").alias("avg_monthly_demand"), F.stddev_samp("count").alias("demand_std"))
    supply = lines.groupBy(F.col("product_category_name").alias("category")).agg(
        F.avg("delivery_days").alias("lead_time_days"), F.avg("price").alias("avg_item_cost"))
    return forecast.select("category", "next_month_forecast").join(history, "category", "left").join(
        supply, "category", "left")


def safety_stock(mean: Column, deviation: Column, lead_days: Column) -> Column:
    """Stock against demand variation over the lead time, at least 0.3 of the monthly mean; unknown variation is 0."""
    cover = SERVICE_FACTOR * F.coalesce(deviation, F.lit(0.0)) * F.sqrt(lead_days / 30.0)
    return F.greatest(cover, mean * 0.3)


def reorder_point(mean: Column, safety: Column, lead_days: Column) -> Column:
    return mean * (lead_days / 30.0) + safety


def bounded_forecast(forecast: Column, mean: Column) -> Column:
    """The forecast, or the mean without one, within 0.5 and 2.5 of the mean."""
    value = F.coalesce(forecast, mean)
    return F.when(mean > 0, F.least(F.greatest(value, mean * 0.5), mean * 2.5)).otherwise(value)


def growth_of(forecast: Column, mean: Column) -> Column:
    """Percent change against the mean, held in -50..150."""
    change = (forecast - mean) / F.nullif(mean, F.lit(0.0)) * 100
    return F.when(mean > 0, clip(change, -50.0, 150.0)).otherwise(F.lit(0.0))


def growth_adjusted(safety: Column, growth: Column) -> Column:
    """More safety stock above 20 percent growth (at most double), less below -20 percent (at least 0.6)."""
    more = F.least(safety * (1 + growth / 100 * 0.5), safety * 2)
    less = F.greatest(safety * (1 + growth / 100 * 0.3), safety * 0.6)
    return F.when(growth > 20, more).when(growth < -20, less).otherwise(safety)


def annual_demand(mean: Column, growth: Column) -> Column:
    yearly = mean * 12
    return F.greatest(yearly * (1 + growth / 100), yearly * 0.5)


def order_quantity(yearly: Column, item_cost: Column) -> Column:
    """Economic order quantity."""
    return F.sqrt(2 * yearly * ORDER_COST / (item_cost * HOLDING_SHARE))


def order_gap_days(yearly: Column, quantity: Column) -> Column:
    """Days between orders."""
    per_year = F.when(quantity > 0, F.try_divide(yearly, quantity)).otherwise(F.lit(12.0))
    return F.when(per_year > 0, 365 / F.nullif(per_year, F.lit(0.0))).otherwise(F.lit(30.0))


def item_cost_or_default(cost: Column) -> Column:
    return F.when(cost > 0, cost).otherwise(F.lit(DEFAULT_ITEM_COST))


def recommend(inputs: DataFrame) -> DataFrame:
    """Reorder recommendations from `category_inputs`."""
    mean = F.col("avg_monthly_demand")
    out = inputs.withColumns({
        "lead_time_days": F.coalesce("lead_time_days", F.lit(DEFAULT_LEAD_DAYS)),
        "avg_item_cost": item_cost_or_default(F.col("avg_item_cost")),
        "next_month_forecast": bounded_forecast(F.col("next_month_forecast"), mean),
    })
    out = out.withColumn("growth_rate", growth_of(F.col("next_month_forecast"), mean))
    base = safety_stock(mean, F.col("demand_std"), F.col("lead_time_days"))
    out = out.withColumn("safety_stock", growth_adjusted(base, F.col("growth_rate")))
    out = out.withColumn("__yearly", annual_demand(mean, F.col("growth_rate")))
    out = out.withColumn("order_quantity", order_quantity(F.col("__yearly"), F.col("avg_item_cost")))
    gap = order_gap_days(F.col("__yearly"), F.col("order_quantity"))
    return out.select(
        F.col("category").alias("product_category"), "category", "avg_monthly_demand", "safety_stock",
        reorder_point(mean, F.col("safety_stock"), F.col("lead_time_days")).alias("reorder_point"),
        "next_month_forecast", F.col("next_month_forecast").alias("forecast_demand"), "growth_rate", "lead_time_days",
        "order_quantity", clip(gap, None, MAX_ORDER_GAP_DAYS).alias("days_between_orders"), "avg_item_cost",
        (F.abs("growth_rate") > 20).alias("adjusted_for_growth"),
    )


def recommend_from_report(report: DataFrame, lines: DataFrame) -> DataFrame:
    """Recommendations from a forecast report whose columns may be partly missing; no growth adjustment and no cap.

    Categories without order lines are left out. When none is left, one row of defaults is returned.
    """
    name = next(c for c in ("category", "product_category", "product_category_name") if c in report.columns)
    given = lambda c: finite(c) if c in report.columns else F.lit(None).cast("double")
    rows = report.where(F.col(name).isNotNull()).select(
        F.col(name).alias("category"),
        *[given(c).alias(c) for c in ("avg_historical_demand", "growth_rate", "lead_time_days", "demand_std",
                                      "forecast_demand", "next_month_forecast")])
    by_month = lines.groupBy(F.col("product_category_name").alias("category"), "order_year", "order_month").agg(
        F.count("order_id").alias("n"), F.sum("price").alias("s"), F.count("price").alias("p"))
    history = by_month.groupBy("category").agg(
        F.avg("n").alias("history_mean"), F.try_divide(F.sum("s"), F.sum("p")).alias("mean_price"))
    out = rows.join(history, "category")
    mean = F.coalesce("avg_historical_demand", "history_mean", F.lit(DEFAULT_DEMAND))
    growth = F.coalesce("growth_rate", F.lit(0.0))
    out = out.withColumns({
        "avg_monthly_demand": mean, "growth_rate": growth,
        "lead_time_days": F.coalesce("lead_time_days", F.lit(DEFAULT_LEAD_DAYS)),
        "avg_item_cost": item_cost_or_default(F.col("mean_price")),
        "forecast_demand": F.coalesce("forecast_demand", "next_month_forecast", mean * (1 + growth / 100)),
    })
    m = F.col("avg_monthly_demand")
    deviation = F.coalesce("demand_std", m * 0.3)
    out = out.withColumn("safety_stock", safety_stock(m, deviation, F.col("lead_time_days")))
    yearly = m * 12
    gap = 365 / F.nullif(F.try_divide(yearly, order_quantity(yearly, F.col("avg_item_cost"))), F.lit(0.0))
    found = out.select(
        F.col("category").cast("string").alias("product_category"), F.col("category").cast("string").alias("category"),
        "avg_monthly_demand", "safety_stock",
        reorder_point(m, F.col("safety_stock"), F.col("lead_time_days")).alias("reorder_point"),
        F.col("forecast_demand").alias("next_month_forecast"), "forecast_demand", "growth_rate", "lead_time_days",
        F.coalesce(gap, F.lit(365.0)).alias("days_between_orders"), "avg_item_cost",
    )
    # The row returned when nothing qualifies.
    default = ("Default", "Default", 100.0, 30.0, 50.0, 100.0, 100.0, 0.0, 7.0, 30.0, 50.0)
    fallback = report.sparkSession.createDataFrame([default], found.schema)
    some = found.agg(F.count(F.lit(1))).scalar()
    return found.unionByName(fallback.withColumn("__n", some).where(F.col("__n") == 0).drop("__n"))


def backfill(recommendations: DataFrame) -> DataFrame:
    """Missing category, safety stock (0.3 of demand, else 30) and reorder point (demand plus safety stock, else 100)."""
    names = recommendations.columns
    have = lambda c: finite(c) if c in names else F.lit(None).cast("double")
    label = [F.col(c).cast("string") for c in ("product_category", "category") if c in names]
    out = recommendations.withColumn("product_category", F.coalesce(*label, F.lit("Unknown Category")))
    demand = have("avg_monthly_demand")
    out = out.withColumn("safety_stock", F.coalesce(have("safety_stock"), demand * 0.3, F.lit(30.0)))
    return out.withColumn(
        "reorder_point", F.coalesce(have("reorder_point"), demand + F.col("safety_stock"), F.lit(100.0)))


def lead_time_demand(recommendations: DataFrame) -> DataFrame:
    """Chart rows: safety stock, demand over the lead time (not below 0) and the forecast; missing numbers are 0."""
    names = recommendations.columns
    number = lambda c: F.coalesce(finite(c), F.lit(0.0)) if c in names else F.lit(0.0)
    ahead = [finite(c) for c in ("next_month_forecast", "forecast_demand") if c in names]
    return recommendations.select(
        F.coalesce(*[F.col(c) for c in ("product_category", "category") if c in names]).alias("name"),
        number("safety_stock").alias("safety_stock"),
        F.greatest(number("reorder_point") - number("safety_stock"), F.lit(0.0)).alias("lead_time_demand"),
        F.coalesce(*ahead, F.lit(0.0)).alias("next_month_forecast"))


def with_priority(recommendations: DataFrame) -> DataFrame:
    """Priority, recommendation and explanation from the growth rate, unless already given."""
    growth = F.coalesce(finite("growth_rate"), F.lit(0.0))
    # Texts of the recommendations.
    text = (
        F.when(growth > 10, F.concat(F.lit("Increase safety stock by "), half_up(growth).cast("string"), F.lit("%")))
        .when(growth > 5, "Maintain elevated safety stock levels")
        .when(growth > 0, "Maintain current safety stock levels")
        .otherwise("Consider reducing safety stock")
    )
    why = (
        F.when(growth > 10, "High growth category requires additional inventory to prevent stockouts.")
        .when(growth > 0, "Moderate growth category indicates stable demand.")
        .otherwise("Declining demand suggests reducing inventory investment.")
    )
    own = lambda c, v: F.coalesce(F.col(c), v) if c in recommendations.columns else v
    priority = F.when(growth > 10, "High").when(growth > 0, "Medium").otherwise("Low")
    return recommendations.withColumns({
        "priority": own("priority", priority), "recommendation": own("recommendation", text), "explanation": why,
    })


def priority_counts(recommendations: DataFrame) -> DataFrame:
    return with_priority(recommendations).groupBy("priority").agg(F.count(F.lit(1)).alias("count"))


def largest_recommendations(recommendations: DataFrame, limit: int = 10) -> DataFrame:
    """The recommendations with the highest reorder point."""
    return recommendations.orderBy(F.desc("reorder_point"), "product_category").limit(limit)
