"""The whole analysis as one set of frames (building them runs jobs), and the dashboard bundle over stored results."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import demand as D
from ..operators import forecast as P
from ..operators import geography as G
from ..operators import inventory as H
from ..operators import metrics as M
from ..operators import orders as O
from ..operators import quality as Q
from ..operators import sellers as S
from ..operators.anomalies import repair_anomalies
from ..operators.arima import forecast_all
from ..operators.items import impute_item_values, with_total_value
from ..operators.products import prepare_products
from ..operators.series import as_series
from ..operators.unify import unified_lines
from ..session import pinned
from ..sources.schemas import DIMENSIONS, STAMPS

MONEY = ("price", "shipping_charges")
# What each input table must hold, and which of its columns are numbers and dates.
CHECKS = {
    "orders": (("order_id", "customer_id", "order_purchase_timestamp"), (), STAMPS),
    "items": (("order_id", "product_id", "seller_id", "price"), ("price", "shipping_charges"), ()),
    "products": (("product_id", "product_category_name"), DIMENSIONS, ()),
    "customers": (("customer_id", "customer_state"), (), ()),
}
LINE_ORDER = ("order_purchase_timestamp", "order_id", "order_item_id", "seller_id", "price")


def prepare_lines(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, repair: bool = True
) -> DataFrame:
    """Cleaned and imputed order lines, written down once for the analyses that read them.

    Products are completed first, amounts imputed with their help, odd amounts repaired along each product's history,
    and delivery days imputed on lines, where the category is known.
    """
    products = pinned(prepare_products(products))
    items = impute_item_values(items, products)
    orders = O.derive_order_columns(O.synthesize_stamps(orders))
    if repair:
        timed = pinned(items.join(orders.select("order_id", "order_purchase_timestamp"), "order_id", "left"))
        for column in MONEY:
            timed = pinned(repair_anomalies(timed, column, ["product_id"], LINE_ORDER).drop("is_anomaly"))
        items = timed.drop("order_purchase_timestamp")
    lines = unified_lines(orders, with_total_value(items), products, customers)
    return pinned(O.impute_delivered(O.impute_delivery_days(lines)))


def input_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The checks of the four input tables in one frame: table_name, column_name, check_name, bad_rows, ok; one scan a table.

    Give it tables as they come, before values that do not parse have become NULL.
    """
    reports = [
        Q.validate_frame(tables[name], *rules).select(F.lit(name).alias("table_name"), "*")
        for name, rules in CHECKS.items() if name in tables
    ]
    return reduce(DataFrame.unionByName, reports)


def analyse(
    tables: Mapping[str, DataFrame], top_n: int = 15, periods: int = 6, repair: bool = True,
    clusters: int | None = 3, **grid: int
) -> dict[str, DataFrame]:
    """All result tables from the four input tables. Order stamps a source lacks are derived; an unfinished last month
    stays in the demand but is not modelled. Sellers are told apart by tiers and by k-means (`clusters=None` searches k).
    """
    orders = O.synthesize_stamps(tables["orders"])
    lines = prepare_lines(orders, tables["items"], tables["products"], tables["customers"], repair)
    demand = pinned(D.monthly_demand(lines))
    top = D.top_categories(demand, top_n)
    finished = demand.where(F.col("date") < D.finished_until(lines))
    chosen = finished.join(top.select(D.CATEGORY), D.CATEGORY, "left_semi")
    series = pinned(as_series(chosen, D.CATEGORY))
    forecast = pinned(forecast_all(series, periods, **grid))
    first = forecast.where(F.col("step") == 1)
    report = P.forecast_report(
        forecast, P.series_profile(series), first.select("series", "mae", "rmse", "mape"),
        first.select("series", "growth_rate"), first.select("series", "arima_params"))
    report = pinned(report)
    sellers = pinned(S.seller_metrics(lines))
    tiers = S.tier_sellers(sellers)
    features = S.seller_features(sellers)
    clusters, centres, _ = C.cluster_sellers(features, S.feature_names(features), clusters)
    states = pinned(G.state_metrics(lines))
    next_month = first.select(F.col("series").alias("category"), F.col("forecast").alias("next_month_forecast"))
    recommendations = pinned(H.recommend(H.category_inputs(lines, demand, next_month)))
    performance = M.line_performance(lines)
    return {
        "monthly_demand": demand,
        "top_categories": top,
        "forecasts": P.pack_forecasts(forecast, first.select("series", "growth_rate")),
        "forecast_report": report,
        "input_checks": input_checks(tables),
        "seller_clusters": tiers,
        "seller_kmeans": clusters.select("seller_id", "cluster"),
        "cluster_centers": centres,
        "supplier_performance": S.performance_report(tiers),
        "supplier_recommendations": S.improvement_recommendations(tiers),
        "state_metrics": states,
        "top_category_by_state": G.top_category_by_state(G.category_by_state(lines), "first"),
        "reorder_recommendations": H.with_priority(recommendations),
        "performance_metrics": performance,
        "performance_summary": M.performance_summary(lines, orders, tables["products"], report),
        "summary_report": M.summary_report(lines, demand, tiers, recommendations, performance),
    }


def dashboard(results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The dashboard's frames from stored result tables (lazy)."""
    demand = Q.normalize_demand(Q.normalize_tokens(results["monthly_demand"]))
    sellers = S.clean_sellers(results["seller_clusters"])
    report = results["forecast_report"]
    required = ("monthly_demand", "forecast_report", "seller_clusters", "reorder_recommendations", "top_categories")
    out = {
        "status": Q.bundle_status({n: results.get(n) for n in required}, required),
        "demand": demand,
        "demand_per_month": D.demand_per_month(demand),
        "top_categories": D.top_categories(demand),
        "category_series": D.nested_series(demand),
        "forecast_performance": P.performance_extract(report),
        "forecast_texts": P.interpret(report),
        "tier_metrics": S.complete_tier_metrics(sellers),
        "seller_points": S.scatter_frame(sellers),
        "recommendations": H.lead_time_demand(results["reorder_recommendations"]),
        "priorities": H.priority_counts(results["reorder_recommendations"]),
        "kpis": M.kpis(demand, sellers, report),
    }
    if "state_metrics" in results:
        out["order_shares"] = G.order_shares(results["state_metrics"])
        out["region_highlights"] = G.region_highlights(results["state_metrics"])
    return out
