"""Seller metrics, scores, tiers and reports."""

from pyspark.sql import functions as F

from harborline.operators import sellers as S

from .base import query
from .intake import R, order_lines
from .views import add_view


def sellers(t):
    return S.seller_metrics(order_lines(t))


def tiers(t):
    return S.tier_sellers(sellers(t))


def rounded(df, places=4):
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


SELLER_COLUMNS = """order_count, round(avg_processing_time, 4) AS avg_processing_time,
           round(avg_delivery_days, 4) AS avg_delivery_days, round(total_sales, 4) AS total_sales,
           round(shipping_costs, 4) AS shipping_costs, round(avg_order_value, 4) AS avg_order_value,
           round(shipping_ratio, 4) AS shipping_ratio, round(on_time_delivery_rate, 4) AS on_time_delivery_rate"""


@query("d05_seller_metrics", f"SELECT seller_id, {SELLER_COLUMNS} FROM sellers")
def _(t):
    return rounded(sellers(t))


@query("c03_seller_on_time_join", """
    SELECT s.seller_id, s.order_count, round(o.rate, 4) AS on_time_delivery_rate FROM sellers s
    LEFT JOIN (SELECT seller_id, coalesce(avg(on_time_delivery), 0.5E0) * 100 AS rate FROM unified GROUP BY 1) o
        ON s.seller_id = o.seller_id""")
def _(t):
    return sellers(t).select("seller_id", "order_count", R("on_time_delivery_rate"))


@query("a12_seller_lookup", f"SELECT seller_id, {SELLER_COLUMNS} FROM sellers WHERE seller_id = 7")
def _(t):
    from harborline.sources.runstore import lookup

    return rounded(lookup(sellers(t), "seller_id", 7))


@query("a12_collection_sample", """
    SELECT seller_id, order_count FROM sellers ORDER BY seller_id LIMIT 100""")
def _(t):
    from harborline.sources.runstore import sample_rows

    return sample_rows(sellers(t).select("seller_id", "order_count"), ["seller_id"])


add_view("feat", """
    SELECT * REPLACE (least(total_sales, cap) AS total_sales, shipping_costs / least(total_sales, cap) * 100
                      AS shipping_ratio),
           ln(1 + least(total_sales, cap)) AS log_total_sales, ln(1 + order_count) AS log_order_count
    FROM sellers, (SELECT quantile_cont(total_sales, 0.99) AS cap FROM sellers)""")
add_view("tiered", """
    SELECT *, CASE WHEN rn <= n // 3 THEN 2 WHEN rn <= 2 * (n // 3) THEN 1 ELSE 0 END AS prediction,
           CASE WHEN rn <= n // 3 THEN 'Low' WHEN rn <= 2 * (n // 3) THEN 'Medium' ELSE 'High' END AS performance
    FROM (SELECT *, row_number() OVER (ORDER BY score, seller_id) AS rn, count(*) OVER () AS n
          FROM (SELECT *, log_order_count / max(log_order_count) OVER () * 15
                          + log_total_sales / max(log_total_sales) OVER () * 25
                          + (1 - avg_processing_time / max(avg_processing_time) OVER ()) * 20
                          + (1 - avg_delivery_days / max(avg_delivery_days) OVER ()) * 20
                          + on_time_delivery_rate / 100 * 20 AS score FROM feat))""")


@query("b21_winsorize", """
    SELECT seller_id, round(least(greatest(total_sales, lo), hi), 4) AS total_sales FROM sellers,
           (SELECT quantile_cont(total_sales, 0.05) AS lo, quantile_cont(total_sales, 0.95) AS hi FROM sellers)""")
def _(t):
    return S.winsorize(sellers(t), "total_sales", 0.05, 0.95).select("seller_id", R("total_sales"))


@query("b21_winsorize_lines", """
    SELECT order_id, order_item_id, round(least(price, hi), 4) AS price
    FROM sc_items, (SELECT quantile_cont(price, 0.99) AS hi FROM sc_items)""")
def _(t):
    return S.winsorize(t.items, "price").select("order_id", "order_item_id", R("price"))


@query("b22_rescale", """
    SELECT seller_id, round(10 + (total_sales - lo) * 90 / (hi - lo), 4) AS normalized_total_sales
    FROM sellers, (SELECT min(total_sales) AS lo, max(total_sales) AS hi FROM sellers)""")
def _(t):
    return S.rescale(sellers(t), "total_sales", 10.0, 100.0).select("seller_id", R("normalized_total_sales"))


@query("b23_log_features", """
    SELECT seller_id, round(log_total_sales, 4) AS log_total_sales, round(log_order_count, 4) AS log_order_count
    FROM feat""")
def _(t):
    return S.seller_features(sellers(t)).select("seller_id", R("log_total_sales"), R("log_order_count"))


@query("b24_ratio_features", """
    WITH s AS (SELECT seller_id, count(*) AS n, sum(price) AS sales,
                      sum(CASE WHEN order_id % 3 = 0 THEN shipping_charges END) AS ship FROM sc_items GROUP BY 1),
         cap AS (SELECT quantile_cont(sales, 0.99) AS cap FROM s)
    SELECT seller_id, round(least(sales, cap) / n, 4) AS avg_order_value,
           round(coalesce(ship, (SELECT median(ship) FROM s)) / least(sales, cap) * 100, 4) AS shipping_ratio
    FROM s, cap""")
def _(t):
    raw = t.items.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("price").alias("total_sales"),
        F.sum(F.when(F.col("order_id") % 3 == 0, F.col("shipping_charges"))).alias("shipping_costs"))
    return S.seller_features(raw).select("seller_id", R("avg_order_value"), R("shipping_ratio"))


@query("g01_seller_features", """
    SELECT seller_id, order_count::DOUBLE AS order_count, round(total_sales, 4) AS total_sales,
           round(log_total_sales, 4) AS log_total_sales, round(log_order_count, 4) AS log_order_count,
           round(avg_processing_time, 4) AS avg_processing_time, round(avg_order_value, 4) AS avg_order_value,
           round(shipping_ratio, 4) AS shipping_ratio FROM feat""")
def _(t):
    return rounded(S.seller_features(sellers(t)).select(
        "seller_id", "order_count", "total_sales", "log_total_sales", "log_order_count", "avg_processing_time",
        "avg_order_value", "shipping_ratio"))


add_view("volume", """
    SELECT *, order_count / max(order_count) OVER () * 25 + avg_order_value / max(avg_order_value) OVER () * 25
              + (1 - avg_processing_time / max(avg_processing_time) OVER ()) * 25
              + on_time_delivery_rate / 100 * 25 AS seller_score FROM sellers""")


@query("g06_volume_score", "SELECT seller_id, round(seller_score, 4) AS seller_score FROM volume")
def _(t):
    return S.volume_score(sellers(t)).select("seller_id", R("seller_score"))


@query("e06_quantile_thirds", """
    SELECT seller_id, CASE WHEN seller_score <= a THEN 2 WHEN seller_score <= b THEN 1 ELSE 0 END AS prediction
    FROM volume, (SELECT quantile_cont(seller_score, 1/3) AS a, quantile_cont(seller_score, 2/3) AS b FROM volume)""")
def _(t):
    return S.quantile_thirds(S.volume_score(sellers(t))).select("seller_id", "prediction")


@query("g07_balanced_score", "SELECT seller_id, round(score, 4) AS score FROM tiered")
def _(t):
    return S.balanced_score(S.seller_features(sellers(t))).select("seller_id", R("score"))


@query("e05_equal_thirds", "SELECT seller_id, prediction FROM tiered")
def _(t):
    return tiers(t).select("seller_id", "prediction")


@query("g08_tier_labels", "SELECT seller_id, prediction, performance FROM tiered")
def _(t):
    return tiers(t).select("seller_id", "prediction", "performance")


@query("d12_tier_metrics", """
    SELECT prediction, count(*) AS "count", round(sum(total_sales), 4) AS total_sales,
           round(avg(total_sales), 4) AS avg_sales, round(avg(avg_processing_time), 4) AS avg_processing_time,
           round(avg(avg_delivery_days), 4) AS avg_delivery_days FROM tiered GROUP BY 1""")
def _(t):
    return rounded(S.tier_metrics(tiers(t)))


@query("d13_complete_tier_metrics", """
    SELECT p.prediction, p.performance, count(x.seller_id) AS "count",
           round(coalesce(avg(avg_processing_time), 0), 4) AS avg_processing_time,
           round(coalesce(avg(avg_delivery_days), 0), 4) AS avg_delivery_days,
           round(coalesce(avg(order_count), 0), 4) AS avg_order_count,
           round(coalesce(sum(total_sales), 0), 4) AS total_sales,
           round(coalesce(avg(on_time_delivery_rate), 0), 4) AS avg_on_time_rate,
           round(count(x.seller_id) * 100.0E0 / (SELECT count(*) FROM tiered WHERE prediction < 2), 4) AS percentage
    FROM (VALUES (0, 'High'), (1, 'Medium'), (2, 'Low')) p(prediction, performance)
    LEFT JOIN (SELECT * EXCLUDE (performance) FROM tiered WHERE prediction < 2) x ON p.prediction = x.prediction
    GROUP BY ALL""")
def _(t):
    return rounded(S.complete_tier_metrics(tiers(t).where("prediction < 2")))


@query("d14_tier_interpretation", """
    SELECT prediction, performance, count(*) AS "count", round(avg(total_sales), 4) AS avg_sales,
           round(avg(avg_processing_time), 4) AS avg_processing_time,
           round(avg(avg_delivery_days), 4) AS avg_delivery_days, round(avg(order_count), 4) AS avg_order_count,
           round(avg(on_time_delivery_rate), 4) AS avg_on_time_rate,
           round(count(*) * 100.0E0 / (SELECT count(*) FROM tiered), 4) AS percentage FROM tiered GROUP BY 1, 2""")
def _(t):
    return rounded(S.tier_interpretation(tiers(t)))


@query("d23_tier_distribution", """
    SELECT prediction, performance, count(*) AS "count",
           round(count(*) * 100.0E0 / (SELECT count(*) FROM tiered), 1) AS percentage FROM tiered GROUP BY 1, 2""")
def _(t):
    return S.tier_distribution(tiers(t))


_METRICS = ("avg_processing_time", "avg_delivery_days", "order_count", "total_sales")


@query("d24_tier_five_numbers", " UNION ALL ".join(f"""
    SELECT prediction, '{m}' AS metric, round(min({m}), 4)::DOUBLE AS minimum, round(quantile_cont({m}, 0.25), 4) AS q1,
           round(quantile_cont({m}, 0.5), 4) AS "median", round(quantile_cont({m}, 0.75), 4) AS q3,
           round(max({m}), 4)::DOUBLE AS maximum FROM tiered GROUP BY 1""" for m in _METRICS))
def _(t):
    return rounded(S.tier_five_numbers(tiers(t)))


_BENCH = {"avg_order_count": "order_count", "avg_processing_time": "avg_processing_time",
          "avg_delivery_days": "avg_delivery_days", "avg_sales": "total_sales", "avg_order_value": "avg_order_value",
          "avg_on_time_rate": "on_time_delivery_rate"}
add_view("tier_means", "SELECT prediction, performance, " + ", ".join(
    f"avg({c}) AS {m}" for m, c in _BENCH.items()) + " FROM tiered GROUP BY 1, 2")


@query("d25_benchmark_matrix", "SELECT prediction, performance, " + ", ".join(
    f"round(CASE WHEN max({m}) OVER () > min({m}) OVER () THEN "
    + (f"(max({m}) OVER () - {m})" if m in ("avg_processing_time", "avg_delivery_days") else f"({m} - min({m}) OVER ())")
    + f" / (max({m}) OVER () - min({m}) OVER ()) ELSE 0.5E0 END, 4) AS {m}" for m in _BENCH) + " FROM tier_means")
def _(t):
    return rounded(S.benchmark_matrix(tiers(t)))


@query("d26_long_comparison", " UNION ALL ".join(
    f"SELECT prediction, performance, '{m}' AS metric, round({m}, 4) AS \"value\" FROM tier_means" for m in _BENCH))
def _(t):
    wide = S.tier_interpretation(tiers(t)).select(
        "prediction", "performance", "avg_order_count", "avg_processing_time", "avg_delivery_days", "avg_sales",
        "avg_on_time_rate")
    more = tiers(t).groupBy("prediction").agg(F.avg("avg_order_value").alias("avg_order_value"))
    return rounded(S.long_comparison(wide.join(more, "prediction")))


add_view("dirty_sellers", """
    SELECT seller_id, CASE WHEN seller_id % 10 = 0 THEN 5 ELSE prediction END AS prediction,
           CASE WHEN seller_id % 7 = 0 THEN 0.0E0 ELSE total_sales END AS total_sales,
           CASE WHEN seller_id % 4 = 0 THEN avg_processing_time * 5 ELSE avg_processing_time END AS avg_processing_time,
           avg_delivery_days, order_count::DOUBLE AS order_count, on_time_delivery_rate FROM tiered""")
add_view("cleaned_sellers", """
    SELECT * REPLACE (CASE WHEN prediction IN (0, 1, 2) THEN prediction ELSE 1 END AS prediction)
    FROM dirty_sellers""")


def dirty_sellers(t):
    key = F.col("seller_id")
    return tiers(t).select(
        "seller_id", F.when(key % 10 == 0, 5).otherwise(F.col("prediction")).alias("prediction"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("total_sales").cast("string")).alias("total_sales"),
        F.when(key % 4 == 0, F.col("avg_processing_time") * 5).otherwise(F.col("avg_processing_time"))
        .alias("avg_processing_time"),
        "avg_delivery_days", "order_count", "on_time_delivery_rate")


@query("b26_clean_sellers", """
    SELECT seller_id, prediction, round(total_sales, 4) AS total_sales,
           round(avg_processing_time, 4) AS avg_processing_time, round(avg_delivery_days, 4) AS avg_delivery_days,
           order_count, round(on_time_delivery_rate, 4) AS on_time_delivery_rate FROM cleaned_sellers""")
def _(t):
    return rounded(S.clean_sellers(dirty_sellers(t)))


@query("b28_scatter_frame", """
    WITH c AS (SELECT *, least(total_sales, (SELECT quantile_cont(total_sales, 0.99) FROM cleaned_sellers
                                             WHERE total_sales > 0)) AS s FROM cleaned_sellers)
    SELECT prediction AS cluster, seller_id AS name,
           round((s - min(s) OVER ()) * 100 / (max(s) OVER () - min(s) OVER ()), 4) AS x,
           round((avg_processing_time - min(avg_processing_time) OVER ()) * 100
                 / (max(avg_processing_time) OVER () - min(avg_processing_time) OVER ()), 4) AS y,
           least(greatest(order_count, 20.0E0), 100.0E0) AS z FROM c""")
def _(t):
    return rounded(S.scatter_frame(dirty_sellers(t)))


@query("e08_star_ratings", """
    WITH m AS (SELECT *, avg(avg_processing_time) OVER (PARTITION BY prediction) AS tm,
                      avg(on_time_delivery_rate) OVER (PARTITION BY prediction) AS rm FROM cleaned_sellers)
    SELECT seller_id, prediction,
           CAST(least(greatest((CASE prediction WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END)
                + floor((tm - avg_processing_time) / tm * 0.5 + 0.5)
                + floor((on_time_delivery_rate - rm) / rm * 0.5 + 0.5), 1), 5) AS BIGINT) AS stars FROM m""")
def _(t):
    return S.star_ratings(dirty_sellers(t)).select("seller_id", "prediction", "stars")


add_view("ranked", """
    SELECT *, (rank() OVER (ORDER BY total_sales) + (count(*) OVER (PARTITION BY total_sales) - 1) / 2.0E0)
              / count(*) OVER () * 100 AS sp,
           (rank() OVER (ORDER BY order_count) + (count(*) OVER (PARTITION BY order_count) - 1) / 2.0E0)
              / count(*) OVER () * 100 AS op,
           100 - (rank() OVER (ORDER BY avg_processing_time)
                  + (count(*) OVER (PARTITION BY avg_processing_time) - 1) / 2.0E0) / count(*) OVER () * 100 AS pp,
           (rank() OVER (ORDER BY on_time_delivery_rate)
            + (count(*) OVER (PARTITION BY on_time_delivery_rate) - 1) / 2.0E0) / count(*) OVER () * 100 AS tp
    FROM tiered""")


@query("e04_percentile_ranks", """
    WITH n AS (SELECT product_id, count(*) AS lines, count(DISTINCT seller_id) AS sources FROM sc_items GROUP BY 1)
    SELECT product_id,
           round((rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0E0)
                 / count(*) OVER () * 100, 4) AS lines_percentile,
           round(100 - (rank() OVER (ORDER BY sources) + (count(*) OVER (PARTITION BY sources) - 1) / 2.0E0)
                 / count(*) OVER () * 100, 4) AS sources_percentile FROM n""")
def _(t):
    counts = t.items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("seller_id").alias("sources"))
    out = S.percentile_ranks(counts, {"lines": True, "sources": False})
    return out.select("product_id", R("lines_percentile"), R("sources_percentile"))


@query("g10_performance_report", """
    SELECT seller_id, performance, prediction, order_count::DOUBLE AS order_count, round(total_sales, 4) AS total_sales,
           round(sp * 0.3 + op * 0.2 + pp * 0.25 + tp * 0.25, 2) AS performance_score FROM ranked""")
def _(t):
    return S.performance_report(tiers(t)).select(
        "seller_id", "performance", "prediction", "order_count", R("total_sales"), "performance_score")


_ADVICE = {
    "processing_time": ("performance = 'Low' OR avg_processing_time > mp", "avg_processing_time > 3",
                        "Optimize order processing workflow to reduce processing time",
                        ". Consider implementing automated order processing.", "Reduce processing time by at least 25%"),
    "delivery_time": ("performance = 'Low' OR avg_delivery_days > md", "avg_delivery_days > 7",
                      "Improve delivery logistics and carrier selection",
                      ". Consider partnering with faster shipping carriers.", "Reduce delivery time by at least 20%"),
    "order_volume": ("order_count < mo", "order_count < 20", "Increase visibility through promotional activities",
                     ". Consider product bundling strategies.", "Increase order volume by at least 30%"),
    "on_time_delivery": ("on_time_delivery_rate < 85", "FALSE",
                         "Improve on-time delivery rate through better inventory management", "",
                         "Achieve at least 90% on-time delivery rate"),
}


@query("g11_improvements", "WITH m AS (SELECT median(avg_processing_time) AS mp, median(avg_delivery_days) AS md, "
       "median(order_count) AS mo FROM tiered) " + " UNION ALL ".join(f"""
    SELECT seller_id, performance, CASE WHEN performance = 'Low' THEN 'High' ELSE 'Medium' END AS priority,
           '{area}' AS improvement_area, '{text}' || CASE WHEN {more} THEN '{extra}' ELSE '' END AS recommendation,
           '{action}' AS suggested_action FROM tiered, m WHERE performance <> 'High' AND ({case})"""
       for area, (case, more, text, extra, action) in _ADVICE.items()))
def _(t):
    return S.improvement_recommendations(tiers(t))


@query("t03_seller_page", """
    SELECT seller_id, prediction, order_count::DOUBLE AS order_count FROM tiered WHERE prediction = 0
    ORDER BY order_count DESC, seller_id LIMIT 10 OFFSET 10""")
def _(t):
    return S.page(tiers(t), [F.desc("order_count"), "seller_id"], 1, 10, tier=0).select(
        "seller_id", "prediction", "order_count")


add_view("volume_tiers", """
    SELECT *, CAST(seller_id % 3 AS INT) AS prediction FROM sellers""")
add_view("tier_scores", """
    SELECT prediction, avg(total_sales) AS s, avg(avg_processing_time) AS p, avg(on_time_delivery_rate) / 100 AS o
    FROM volume_tiers GROUP BY 1""")


@query("g05_cluster_order", """
    SELECT prediction, round(s / max(s) OVER () * 40 + (1 - p / max(p) OVER ()) * 30 + o * 30, 4) AS score,
           CAST(row_number() OVER (ORDER BY s / max_s * 40 + (1 - p / max_p) * 30 + o * 30 DESC, prediction) - 1 AS INT)
               AS performance_cluster
    FROM (SELECT *, max(s) OVER () AS max_s, max(p) OVER () AS max_p FROM tier_scores)""")
def _(t):
    from harborline.operators.clusters import order_clusters

    # Fixed labels stand in for k-means, whose labels SQL cannot give.
    labelled = sellers(t).withColumn("prediction", (F.col("seller_id") % 3).cast("int")).withColumn(
        "on_time_delivery_rate", F.col("on_time_delivery_rate") / 100)
    return order_clusters(labelled).select("prediction", R("score"), "performance_cluster")
