"""Performance metrics, key figures and the summary report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite
from .demand import top_categories
from .sellers import TIER_NAMES

# Industry benchmarks used where nothing can be measured.
INVENTORY_TURNOVER = 8.0
RETURN_RATE = 3.0
ON_TIME_DEFAULT = 85.0
# Perfect order rate as a multiple of the on-time rate, by preset.
PERFECT_ORDER = {"line": 0.95, "dashboard": 0.9}
ORDER_ACCURACY, ORDER_COMPLETENESS = 0.97, 0.99


def _avg(df: DataFrame, name: str) -> Column:
    return F.avg(name) if name in df.columns else F.lit(None).cast("double")


def line_performance(lines: DataFrame) -> DataFrame:
    """One row of metrics over order lines; benchmarks stand in for absent columns."""
    on_time = F.coalesce(_avg(lines, "on_time_delivery") * 100, F.lit(ON_TIME_DEFAULT))
    value = F.lit(None).cast("double")
    if "price" in lines.columns:
        value = F.try_divide(F.sum("price"), F.count_distinct("order_id"))
    delivery = _avg(lines, "delivery_days") if "delivery_days" in lines.columns else F.lit(7.0)
    return lines.agg(
        F.count(F.lit(1)).alias("__n"),
        F.coalesce(_avg(lines, "processing_time"), F.lit(1.0)).alias("avg_processing_time"),
        delivery.alias("avg_delivery_days"),
        on_time.alias("on_time_delivery_rate"),
        (on_time * PERFECT_ORDER["line"]).alias("perfect_order_rate"),
        F.coalesce(value, F.lit(100.0)).alias("avg_order_value"),
        F.lit(INVENTORY_TURNOVER).alias("inventory_turnover"),
        F.lit("delivery_days" not in lines.columns).alias("is_estimated"),
    ).drop("__n")


def order_values(items: DataFrame) -> DataFrame:
    """Average order value (mean over orders of the summed price) and shipping cost ratio in percent."""
    ship = F.sum("shipping_charges") if "shipping_charges" in items.columns else F.lit(None).cast("double")
    per_order = items.groupBy("order_id").agg(F.sum("price").alias("price"), F.coalesce(ship, F.lit(0.0)).alias("ship"))
    out = per_order.agg(
        F.avg("price").alias("average_order_value"),
        (F.try_divide(F.avg("ship"), F.avg("price")) * 100).alias("shipping_cost_ratio"),
    )
    return out if "shipping_charges" in items.columns else out.withColumn("shipping_cost_ratio", ship)


def order_seasonality(orders: DataFrame) -> DataFrame:
    """Month of the year with the most orders (the earlier on a tie), and its count over the monthly mean."""
    monthly = (
        orders.where(F.col("order_purchase_timestamp").isNotNull())
        .groupBy(F.month("order_purchase_timestamp").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    )
    return monthly.agg(
        F.max_by("m", F.struct(F.col("n"), -F.col("m"))).alias("peak_order_month"),
        (F.max("n") / F.avg("n")).alias("peak_to_average_ratio"),
    )


def order_performance(orders: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row of metrics over orders, with spreads, benchmarks and the list of metrics that are estimates."""
    sources = {"on_time_delivery_rate": "on_time_delivery", "avg_processing_time": "processing_time",
               "avg_delivery_days": "delivery_days"}
    present = {metric: column in orders.columns for metric, column in sources.items()}

    def measured(column: str, function, default: float) -> Column:
        return function(column) if column in orders.columns else F.lit(default)

    on_time = F.avg("on_time_delivery") * 100 if present["on_time_delivery_rate"] else F.lit(ON_TIME_DEFAULT)
    estimated = F.array_compact(F.array(*[F.when(F.lit(not known), F.lit(m)) for m, known in present.items()]))
    out = orders.agg(
        on_time.alias("on_time_delivery_rate"),
        measured("processing_time", F.avg, 1.0).alias("avg_processing_time"),
        measured("processing_time", F.stddev_samp, 0.3).alias("processing_time_std"),
        measured("delivery_days", F.avg, 7.0).alias("avg_delivery_days"),
        measured("delivery_days", F.stddev_samp, 2.0).alias("delivery_days_std"),
        F.count(F.lit(1)).alias("__n"),
    ).drop("__n").withColumns({
        "perfect_order_rate": F.col("on_time_delivery_rate") * ORDER_ACCURACY * ORDER_COMPLETENESS,
        "inventory_turnover": F.lit(INVENTORY_TURNOVER),
        "days_of_supply": F.lit(365 / INVENTORY_TURNOVER),
        "return_rate": F.lit(RETURN_RATE),
        "estimated_values": estimated,
    })
    extras = []
    if items is not None and "price" in items.columns:
        extras.append(order_values(items))
    if "order_purchase_timestamp" in orders.columns:
        extras.append(order_seasonality(orders))
    for i, extra in enumerate(extras):
        names = extra.columns
        out = out.withColumn(f"__e{i}", extra.select(F.struct(*names).alias("s")).scalar())
        out = out.withColumns({n: F.col(f"__e{i}")[n] for n in names}).drop(f"__e{i}")
    return out


def performance_summary(
    lines: DataFrame, orders: DataFrame, products: DataFrame, forecast_report: DataFrame
) -> DataFrame:
    """Eight rows (position, metric, value, formatted)."""
    base = lines.agg(
        F.count_distinct("seller_id").cast("double").alias("sellers"), F.avg("price").alias("line_price"),
        F.avg("processing_time").alias("processing"), F.avg("delivery_days").alias("delivery"),
        (F.avg("on_time_delivery") * 100).alias("on_time"),
    )
    wide = base.withColumns({
        "orders": orders.agg(F.count(F.lit(1)).cast("double")).scalar(),
        "products": products.agg(F.count(F.lit(1)).cast("double")).scalar(),
        "mape": forecast_report.agg(F.avg("mape")).scalar(),
    })
    cents = lambda c: F.round(F.col(c), 2).cast("decimal(20,2)").cast("string")
    whole = lambda c: F.col(c).cast("long").cast("string")
    # Metric names and units of the summary.
    rows = [
        ("Total Orders", "orders", whole("orders")),
        ("Total Products", "products", whole("products")),
        ("Total Sellers", "sellers", whole("sellers")),
        ("Average Order Value", "line_price", F.concat(F.lit("$"), cents("line_price"))),
        ("Average Processing Time", "processing", F.concat(cents("processing"), F.lit(" days"))),
        ("Average Delivery Days", "delivery", F.concat(cents("delivery"), F.lit(" days"))),
        ("On-Time Delivery Rate", "on_time", F.concat(cents("on_time"), F.lit("%"))),
        ("Forecast Accuracy (Avg MAPE)", "mape", F.concat(cents("mape"), F.lit("%"))),
    ]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), F.col(c).alias("value"),
                 text.alias("formatted"))
        for i, (name, c, text) in enumerate(rows, 1)
    ])))


def parse_metric(value: Column | str) -> Column:
    """The number in texts such as "$1,234.5", "12%" or "3.2 days"; NULL when there is none."""
    text = F.col(value) if isinstance(value, str) else value
    bare = F.regexp_replace(F.trim(text), r"^\$|,", "")
    return finite(F.regexp_substr(bare, F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?")).try_cast("double"))


def summary_kpis(summary: DataFrame, value: str = "formatted") -> DataFrame:
    """The key figures named in a performance summary, one row."""
    # Summary metric to key figure.
    names = {
        "Average Processing Time": "avg_processing_time", "Average Delivery Days": "avg_delivery_days",
        "On-Time Delivery Rate": "on_time_delivery", "Total Orders": "total_orders",
        "Total Products": "total_products", "Average Order Value": "average_order_value",
        "Forecast Accuracy (Avg MAPE)": "forecast_accuracy",
    }
    return summary.agg(*[
        F.max(F.when(F.col("metric") == metric, parse_metric(value))).alias(k) for metric, k in names.items()
    ])


def kpis(demand: DataFrame, sellers: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Key figures over the demand, seller and forecast frames, one row."""
    seller_side = sellers.agg(F.struct(
        F.coalesce(F.avg(finite("avg_processing_time")), F.lit(0.0)).alias("processing"),
        F.coalesce(F.avg(finite("on_time_delivery_rate")), F.lit(ON_TIME_DEFAULT)).alias("on_time"),
        F.coalesce(F.try_divide(F.sum("total_sales"), F.sum("order_count").cast("double")), F.lit(0.0)).alias("value"),
    ).alias("s")).scalar()
    accuracy = F.lit(100.0) - clip(F.avg(F.coalesce(finite("mape"), F.lit(0.0))), None, 100.0)
    forecast_side = forecasts.agg(F.struct(
        F.coalesce(F.avg(finite("growth_rate")), F.lit(0.0)).alias("growth"),
        F.coalesce(accuracy, F.lit(0.0)).alias("accuracy"),
    ).alias("s")).scalar()
    out = demand.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_demand")).withColumns(
        {"__s": seller_side, "__f": forecast_side}
    )
    return out.select(
        F.col("__s")["processing"].alias("avg_processing_time"), F.col("__f")["growth"].alias("forecast_growth"),
        "total_demand", F.col("__s")["on_time"].alias("on_time_delivery"),
        (F.col("__s")["on_time"] * PERFECT_ORDER["dashboard"]).alias("perfect_order_rate"),
        F.lit(INVENTORY_TURNOVER).alias("inventory_turnover"), F.col("__s")["value"].alias("average_order_value"),
        F.col("__f")["accuracy"].alias("forecast_accuracy"),
        F.lit("on_time_delivery,perfect_order_rate,inventory_turnover").alias("estimated_fields"),
    )


def growth_kpi(forecasts: DataFrame) -> DataFrame:
    """Mean growth over forecasts, each held in -80..100 first; 0 without forecasts."""
    return forecasts.agg(F.coalesce(F.avg(clip(finite("growth_rate"), -80.0, 100.0)), F.lit(0.0)).alias("growth"))


def format_thousands(value: Column | str) -> Column:
    """Axis label: whole thousands with a K from 1000 on, else the whole number."""
    c = F.col(value) if isinstance(value, str) else value
    whole = lambda x: F.round(x, 0).cast("long").cast("string")
    return F.when(c >= 1000, F.concat(whole(c / 1000), F.lit("K"))).otherwise(whole(c))


def summary_report(
    lines: DataFrame, demand: DataFrame, tiers: DataFrame, recommendations: DataFrame, performance: DataFrame
) -> DataFrame:
    """The text report as rows (section, position, line). Every part is an aggregate or a short top list."""
    total = lambda c: F.count_distinct(c).cast("string")

    def listed(df: DataFrame, section: str, entries: list[Column]) -> DataFrame:
        rows = F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(i).alias("position"), e.alias("line"))
            for i, e in enumerate(entries, 1)
        ])
        return df.select(F.inline(rows))

    counts = lines.agg(total("order_id").alias("o"), total("product_id").alias("p"), total("customer_id").alias("c"))
    dataset = listed(counts, "Dataset Summary", [
        F.concat(F.lit("- Total Orders: "), "o"), F.concat(F.lit("- Total Products: "), "p"),
        F.concat(F.lit("- Total Customers: "), "c"),
    ])

    def numbered(df: DataFrame, section: str, order: list[Column], line) -> DataFrame:
        # A short list gathered in order: at most ten rows reach it.
        gathered = df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))).alias("l"))
        each = gathered.select(F.posexplode("l").alias("i", "e")).select("i", "e.row.*")
        return each.select(F.lit(section).alias("section"), (F.col("i") + 1).alias("position"),
                           line(F.col("i") + 1).alias("line"))

    top = numbered(
        top_categories(demand, 10), "Top Product Categories by Demand",
        [(-F.col("total_count")).alias("a"), F.col("product_category_name").alias("b")],
        lambda i: F.concat(i.cast("string"), F.lit(". "), "product_category_name", F.lit(": "),
                           F.col("total_count").cast("long").cast("string"), F.lit(" orders")),
    )
    n = tiers.agg(F.count(F.lit(1))).scalar()
    tier_counts = tiers.groupBy("prediction").agg(F.count(F.lit(1)).alias("sellers")).withColumn("__n", n)
    label = F.coalesce(*[F.when(F.col("prediction") == code, name) for code, name in TIER_NAMES.items()],
                       F.concat(F.lit("Cluster "), F.col("prediction").cast("string")))
    share = F.round(F.col("sellers") / F.col("__n") * 100, 1).cast("decimal(10,1)").cast("string")
    sellers = tier_counts.select(
        F.lit("Seller Performance Analysis").alias("section"), (F.col("prediction") + 1).alias("position"),
        F.concat(F.lit("- "), label, F.lit(" Performers: "), F.col("sellers").cast("string"), F.lit(" sellers ("),
                 share, F.lit("%)")).alias("line"),
    )
    best = recommendations.orderBy(F.desc("reorder_point"), "product_category").limit(5)
    whole = lambda c: F.col(c).cast("long").cast("string")
    reorder = numbered(
        best.select("product_category", "reorder_point", "safety_stock", "growth_rate"), "Inventory Recommendations",
        [(-F.col("reorder_point")).alias("a"), F.col("product_category").alias("b")],
        lambda i: F.concat(F.lit("- "), "product_category", F.lit(": Reorder at "), whole("reorder_point"),
                           F.lit(" units, Safety stock: "), whole("safety_stock"), F.lit(" units, Growth rate: "),
                           F.round("growth_rate", 1).cast("decimal(20,1)").cast("string"), F.lit("%")),
    )
    cents = lambda c: F.round(F.col(c), 2).cast("decimal(20,2)").cast("string")
    measured = listed(performance, "Supply Chain Performance Metrics", [
        F.concat(F.lit("- Average Processing Time: "), cents("avg_processing_time"), F.lit(" days")),
        F.concat(F.lit("- Average Delivery Time: "), cents("avg_delivery_days"), F.lit(" days")),
        F.concat(F.lit("- On-Time Delivery Rate: "), cents("on_time_delivery_rate"), F.lit("%")),
        F.concat(F.lit("- Perfect Order Rate: "), cents("perfect_order_rate"), F.lit("%")),
    ])
    return dataset.unionByName(top).unionByName(sellers).unionByName(reorder).unionByName(measured)
