"""Clusters, principal axes, the model grid, and the run store."""

from datetime import datetime

from pyspark.sql import functions as F

from harborline.operators import arima as X
from harborline.operators import clusters as C
from harborline.operators import metrics as M
from harborline.operators import sellers as S
from harborline.session import scratch_path
from harborline.sources import runstore as U
from harborline.sources import tables as W

from .base import query
from .demand import demand
from .intake import R, order_lines, state_lines
from .sellers import rounded, sellers, tiers
from .series import category_demand, series, text
from .views import add_view


def features(t):
    return S.seller_features(sellers(t))


# Standardised features with the hash that starts the clusters.
_FEATURES = ("log_order_count", "log_total_sales", "avg_processing_time", "avg_delivery_days", "avg_order_value",
             "on_time_delivery_rate", "shipping_ratio")
add_view("scaled", "SELECT seller_id, md5(CAST(seller_id AS VARCHAR)) AS place, ["
         + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)" for c in _FEATURES)
         + "] AS x FROM feat")
# Farthest-point starts, then rounds of all k until no centre moves; each k keeps its last round.
add_view("starts", """
    WITH RECURSIVE s AS (
        SELECT 1 AS k, [arg_min(x, place)] AS cs FROM scaled
        UNION ALL
        SELECT k + 1, list_append(cs, first(x ORDER BY gap DESC, place))
        FROM (SELECT s.k, s.cs, z.x, z.place, list_min(list_transform(s.cs, lambda c: list_distance(c, z.x))) AS gap
              FROM s, scaled z WHERE s.k < least(10, (SELECT count(*) - 1 FROM scaled))) GROUP BY k, cs HAVING max(gap) > 0)
    SELECT * FROM s WHERE k > 1""")
_MEANS = ", ".join(f"avg(x[{i}])" for i in range(1, len(_FEATURES) + 1))
add_view("centres", f"""
    WITH RECURSIVE l AS (
        SELECT k, 0 AS turn, cs, 1.0E9 AS moved FROM starts
        UNION ALL
        SELECT k, turn + 1, news, list_max(list_transform(range(1, k + 1), lambda i: list_distance(news[i], cs[i])))
        FROM (SELECT k, turn, cs, list_transform(range(1, k + 1), lambda i: coalesce(m[i], cs[i])) AS news
              FROM (SELECT k, turn, cs, map_from_entries(list((label, mean))) AS m
                    FROM (SELECT k, turn, cs, label, [{_MEANS}] AS mean
                          FROM (SELECT k, turn, cs, x, list_position(gaps, list_min(gaps)) AS label
                                FROM (SELECT l.k, l.turn, l.cs, z.x,
                                             list_transform(l.cs, lambda c: list_distance(c, z.x)) AS gaps
                                      FROM l, scaled z WHERE l.turn < 100 AND l.moved >= 1e-6)) GROUP BY ALL)
                    GROUP BY k, turn, cs)))
    SELECT k, arg_max(cs, turn) AS cs FROM l GROUP BY k""")
add_view("labelled", """
    SELECT k, seller_id, x, list_position(gaps, list_min(gaps)) AS label
    FROM (SELECT c.k, z.seller_id, z.x, list_transform(c.cs, lambda m: list_distance(m, z.x)) AS gaps FROM centres c, scaled z)""")
# The silhouette from all pairs of rows.
add_view("silhouettes", """
    SELECT k, avg(CASE WHEN size = 1 OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette
    FROM (SELECT k, seller_id, coalesce(max(total / nullif(n - 1, 0)) FILTER (mine), 0) AS own,
                 min(total / n) FILTER (NOT mine) AS other, max(n) FILTER (mine) AS size
          FROM (SELECT a.k, a.seller_id, b.label, b.label = a.label AS mine, sum(list_distance(a.x, b.x) ** 2) AS total, count(*) AS n
                FROM labelled a JOIN labelled b USING (k) GROUP BY ALL) GROUP BY ALL) GROUP BY k""")


@query("g02_seller_clusters", """
    SELECT seller_id, CAST(label - 1 AS INT) AS cluster, round(silhouette, 4) AS silhouette
    FROM labelled JOIN silhouettes USING (k) WHERE k = 3""")
def _(t):
    f = features(t)
    labelled, _, silhouette = C.cluster_sellers(f, S.feature_names(f), 3)
    return labelled.select("seller_id", "cluster", F.round(F.lit(silhouette), 4).alias("silhouette"))


@query("g03_cluster_count", """
    SELECT CAST(k AS INT) AS k, round(silhouette, 4) AS silhouette,
           row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS best FROM silhouettes""")
def _(t):
    f = features(t)
    return rounded(C.silhouette_by_k(f, S.feature_names(f)))


@query("g04_cluster_centres", "SELECT CAST(label - 1 AS INT) AS cluster, "
       + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _FEATURES)
       + " FROM feat JOIN labelled USING (seller_id) WHERE k = 3 GROUP BY 1")
def _(t):
    f = features(t)
    return rounded(C.cluster_sellers(f, S.feature_names(f), 3)[1])


# Axes by squaring the covariance matrix until one direction is left; the second after taking the first out.
_TIMES = "list_transform({0}, lambda r: list_transform({0}, lambda s: list_dot_product(r, s)))"
_TRACE = "list_sum(list_transform(range(1, 8), lambda i: {0}[i][i]))"


def _axis(matrix: str) -> str:
    return f"""
    WITH RECURSIVE p AS (
        SELECT 0 AS turn, c AS whole, c FROM ({matrix}) UNION ALL
        SELECT turn + 1, whole, list_transform(c2, lambda r: list_transform(r, lambda v: v / trace))
        FROM (SELECT turn, whole, c2, {_TRACE.format('c2')} AS trace
              FROM (SELECT turn, whole, {_TIMES.format('c')} AS c2 FROM p WHERE turn < 40))),
    v AS (SELECT whole, list_max(list_transform(c, lambda r: list_dot_product(r, r))) AS top, c FROM p WHERE turn = 40),
    u AS (SELECT whole, list_filter(c, lambda r: list_dot_product(r, r) = top)[1] AS r FROM v),
    n AS (SELECT whole, list_transform(r, lambda a: a / sqrt(list_dot_product(r, r))
                                       * CASE WHEN list_max(r) >= -list_min(r) THEN 1 ELSE -1 END) AS axis FROM u)
    SELECT whole, axis, list_sum(list_transform(whole, lambda r: list_dot_product(r, axis) ** 2)) ** 0.5 AS variance FROM n"""


add_view("covariances", "SELECT [" + ", ".join(
    "[" + ", ".join(f"covar_samp(x[{i}], x[{j}])" for j in range(1, 8)) + "]" for i in range(1, 8)) + "] AS c FROM scaled")
add_view("axis1", _axis("SELECT c FROM covariances"))
add_view("axis2", _axis("""SELECT list_transform(whole, lambda r, i: list_transform(r, lambda v, j:
    v - variance * axis[i] * axis[j])) AS c FROM axis1"""))


@query("g09_principal_axes", f"""
    SELECT f.feature, round(a.axis[f.i], 4) AS pc1, round(b.axis[f.i], 4) AS pc2,
           round(a.variance / {_TRACE.format('a.whole')}, 4) AS variance1, round(b.variance / {_TRACE.format('a.whole')}, 4) AS variance2
    FROM axis1 a JOIN axis2 b ON true, (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(_FEATURES, 1))}) f(feature, i)""")
def _(t):
    f = features(t)
    return rounded(C.principal_axes(f, S.feature_names(f))[1])


@query("g09_principal_points", """
    SELECT seller_id, round(list_dot_product(x, a.axis), 4) AS pc1, round(list_dot_product(x, b.axis), 4) AS pc2
    FROM scaled JOIN axis1 a ON true JOIN axis2 b ON true""")
def _(t):
    f = features(t)
    return rounded(C.principal_axes(f, S.feature_names(f))[0].select("seller_id", "pc1", "pc2"))


@query("f10_order_search")
def _(t):
    return X.search_orders(series(t)).select("series", "arima_params", R("rmse"))


@query("f11_order_search_short")
def _(t):
    # The newest ten months of each series: too short to hold months out, so the criterion decides.
    base = series(t)
    last = base.agg(F.max("month")).scalar()
    short = base.withColumn("__last", last).where(F.col("month") > F.add_months("__last", -10)).drop("__last")
    return X.search_orders(short).select("series", "arima_params", R("aic"))


@query("f12_model_forecasts")
def _(t):
    base = series(t)
    points, errors = X.model_forecasts(base, X.search_orders(base, 2, 1, 1))
    return rounded(points.join(errors, "series"))


@query("f18_forecast_chain")
def _(t):
    return text(X.forecast_all(series(t), max_p=2, max_d=1, max_q=1))


@query("f22_forecast_top")
def _(t):
    return text(X.forecast_top(category_demand(t), 5))


# Stored months: the run is the year, the storing time follows the month.
add_view("stored", """
    SELECT product_category_name, strftime("date", '%Y-%m-%d') AS "date", "count", CAST(order_year AS VARCHAR) AS run_id,
           make_timestamp(2024, 1, CAST(1 + order_month AS BIGINT), 0, 0, 0.0) AS stored_at FROM demand""")


def stored(t):
    return demand(t).select(
        "product_category_name", F.date_format("date", "yyyy-MM-dd").alias("date"), "count",
        F.col("order_year").cast("string").alias("run_id"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), 1 + F.col("order_month"), F.lit(0), F.lit(0), F.lit(0))
        .alias("stored_at"))


@query("a09_stored_demand", """
    SELECT product_category_name, "date", "count", run_id FROM stored
    ORDER BY stored_at DESC, product_category_name, "date" LIMIT 100""")
def _(t):
    return U.read_demand(stored(t), limit=100).drop("stored_at")


@query("a09_stored_inventory", """
    SELECT product_category_name AS category, 'other' AS product_category, "count", run_id FROM stored
    WHERE product_category_name = 'MEDIUM' AND run_id = '1997'""")
def _(t):
    kept = stored(t).select(F.col("product_category_name").alias("category"), F.lit("other").alias("product_category"),
                            "count", "run_id")
    return U.read_inventory(kept, "MEDIUM", "1997")


@query("a09_stored_forecasts", """
    SELECT category, run_id, CAST(n AS BIGINT) AS place, CAST("value" AS DOUBLE) AS forecast_value FROM (
        SELECT product_category_name AS category, run_id, "count" AS "value",
               row_number() OVER (PARTITION BY product_category_name, run_id ORDER BY "date") - 1 AS n FROM stored)
    WHERE category = 'MEDIUM' AND run_id = '1997'""")
def _(t):
    points = F.array_sort(F.collect_list(F.struct("date", F.col("count").cast("double").alias("value"))))
    packed = stored(t).groupBy(F.col("product_category_name").alias("category"), "run_id").agg(
        F.transform(points, lambda p: p["value"]).alias("forecast_values"), F.max("stored_at").alias("stored_at"))
    read = U.read_forecasts(U.encode_arrays(packed), "MEDIUM", "1997")
    return read.select("category", "run_id", F.posexplode("forecast_values").alias("place", "forecast_value")).withColumn(
        "place", F.col("place").cast("long"))


@query("a09_stored_suppliers", """
    SELECT s_suppkey AS seller_id, CAST(s_suppkey % 3 AS INT) AS prediction, 'r2' AS run_id
    FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 2 = 0""")
def _(t):
    tiers_of = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("seller_id"), (F.col("s_suppkey") % 3).cast("int").alias("prediction"),
        F.when(F.col("s_suppkey") % 2 == 0, "r2").otherwise("r1").alias("run_id"))
    return U.read_suppliers(tiers_of, 1, "r2")


@query("a09_recent_runs", """
    SELECT run_id, CAST(max(stored_at) AS VARCHAR) AS stored_at FROM (
        SELECT run_id, stored_at + INTERVAL 1 DAY * CAST(run_id AS INT) AS stored_at FROM stored) GROUP BY 1
    ORDER BY max(stored_at) DESC, run_id DESC LIMIT 3""")
def _(t):
    moved = stored(t).withColumn("stored_at", F.timestamp_add("DAY", F.col("run_id").cast("int"), F.col("stored_at")))
    runs = moved.groupBy("run_id").agg(F.max("stored_at").alias("stored_at"))
    return U.recent_runs(runs, 3).withColumn("stored_at", F.date_format("stored_at", "yyyy-MM-dd HH:mm:ss"))


@query("a07_result_tables", """
    SELECT 'demand' AS name, product_category_name AS label, CAST(sum("count") AS BIGINT) AS n FROM demand GROUP BY 2
    UNION ALL SELECT 'states', customer_state, order_count FROM states""")
def _(t):
    from harborline.operators.geography import state_metrics

    folder = scratch_path(t.spark, "results")
    paths = W.write_results({"demand": demand(t), "states": state_metrics(state_lines(t))}, folder)
    months = t.spark.read.parquet(paths["demand"]).groupBy(F.col("product_category_name").alias("label")).agg(
        F.sum("count").alias("n"))
    states = t.spark.read.parquet(paths["states"]).select(F.col("customer_state").alias("label"),
                                                          F.col("order_count").alias("n"))
    return months.select(F.lit("demand").alias("name"), "label", "n").unionByName(
        states.select(F.lit("states").alias("name"), "label", "n"))


@query("a08_run_store_append", """
    SELECT r AS run_id, product_category_name, strftime("date", '%Y-%m-%d') AS "date", "count" * f AS "count"
    FROM demand, (VALUES ('r1', 1), ('r2', 2)) v(r, f)""")
def _(t):
    store = U.RunStore(t.spark, scratch_path(t.spark, "runs"))
    months = demand(t).select("product_category_name", F.date_format("date", "yyyy-MM-dd").alias("date"), "count")
    store.store("demand_data", months, "r1", datetime(2024, 1, 1))
    store.store("demand_data", months.withColumn("count", F.col("count") * 2), "r2", datetime(2024, 1, 2))
    return store.collection("demand_data").select("run_id", "product_category_name", "date", "count")


@query("a10_delete_run", """
    SELECT 'removed' AS what, c AS collection, CASE WHEN c = 'demand_data' THEN (SELECT count(*) FROM demand)
           WHEN c = 'suppliers' THEN (SELECT count(*) FROM sellers) ELSE 0 END AS n
    FROM (VALUES ('demand_data'), ('forecasts'), ('suppliers'), ('inventory'), ('analysis_metadata')) v(c)
    UNION ALL SELECT 'left', 'demand_data', (SELECT count(*) FROM demand)
    UNION ALL SELECT 'left', 'suppliers', 0""")
def _(t):
    store = U.RunStore(t.spark, scratch_path(t.spark, "runs"))
    months = demand(t).drop("date")
    store.store("demand_data", months, "r1")
    store.store("demand_data", months, "r2")
    store.store("suppliers", sellers(t), "r1")
    removed = store.delete_run("r1").select(F.lit("removed").alias("what"), "collection", "n")
    left = store.counts("r2").where(F.col("collection").isin("demand_data", "suppliers"))
    return removed.unionByName(left.select(F.lit("left").alias("what"), "collection", "n"))


@query("a13_metrics_log", """
    SELECT '2024-01-01 00:00:00' AS "timestamp", round(avg(on_time_delivery) * 100, 4) AS on_time_delivery_rate,
           round(avg(processing_time), 4) AS avg_processing_time FROM unified""")
def _(t):
    path = scratch_path(t.spark, "metrics-log")
    U.log_metrics(M.line_performance(order_lines(t)), path, datetime(2024, 1, 1))
    logged = t.spark.read.schema(
        "timestamp string, metrics struct<on_time_delivery_rate: double, avg_processing_time: double>").json(path)
    return logged.select("timestamp", F.round("metrics.on_time_delivery_rate", 4).alias("on_time_delivery_rate"),
                         F.round("metrics.avg_processing_time", 4).alias("avg_processing_time"))


@query("d28_run_metadata", """
    SELECT 'r1' AS run_id, '5' AS top_n, count(*) AS tiered_sellers FROM tiered""")
def _(t):
    meta = U.metadata_frame(t.spark, "r1", {"top_n": 5, "forecast_periods": 6})
    n = tiers(t).agg(F.count(F.lit(1))).scalar()
    return meta.select("run_id", F.col("parameters")["top_n"].alias("top_n"), n.alias("tiered_sellers"))
