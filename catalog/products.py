"""Product imputation, neighbours, and anomaly repair over lines."""

from pyspark.sql import functions as F

from harborline.functions.neighbours import nearest_rows
from harborline.operators import anomalies as A
from harborline.operators import products as P
from harborline.operators.quality import imputation_report
from harborline.session import pinned
from harborline.sources.schemas import DIMENSIONS

from .base import query
from .intake import R
from .sellers import rounded
from .views import add_view

_DIMS = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


@query("b14_category_ladder", """
    WITH c AS (SELECT product_category_name AS c, median(product_weight_g) AS w, median(product_length_cm) AS l
               FROM sc_products_dirty WHERE product_category_name IS NOT NULL GROUP BY 1),
         f AS (SELECT p.*, coalesce(product_weight_g, c.w) AS w1, coalesce(product_length_cm, c.l) AS l1
               FROM sc_products_dirty p LEFT JOIN c ON p.product_category_name = c.c)
    SELECT product_id, product_category_name, round(coalesce(w1, (SELECT median(w1) FROM f)), 4) AS product_weight_g,
           round(coalesce(l1, (SELECT median(l1) FROM f)), 4) AS product_length_cm, product_height_cm, product_width_cm FROM f""")
def _(t):
    return rounded(P.impute_by_category(t.products_dirty).drop("product_subcategory"))


@query("b17_cap_dimensions", "SELECT product_id, " + ", ".join(
    f"round(least(greatest({d}, 0.0E0), (SELECT quantile_cont({d}, 0.995) FROM sc_products)), 4) AS {d}" for d in _DIMS)
    + " FROM sc_products")
def _(t):
    return rounded(P.cap_dimensions(t.products).select("product_id", *DIMENSIONS))


add_view("ladder", """
    WITH c AS (SELECT product_category_name AS c, median(product_weight_g) AS w, median(product_length_cm) AS l
               FROM sc_products_dirty WHERE product_category_name IS NOT NULL GROUP BY 1),
         f AS (SELECT p.*, coalesce(product_weight_g, c.w) AS w1, coalesce(product_length_cm, c.l) AS l1
               FROM sc_products_dirty p LEFT JOIN c ON p.product_category_name = c.c)
    SELECT product_id, coalesce(w1, (SELECT median(w1) FROM f)) AS product_weight_g,
           coalesce(l1, (SELECT median(l1) FROM f)) AS product_length_cm, product_height_cm, product_width_cm FROM f""")
add_view("capped", "SELECT product_id, " + ", ".join(
    f"least({d}, (SELECT quantile_cont({d}, 0.995) FROM ladder)) AS {d}" for d in _DIMS) + " FROM ladder")


@query("b18_imputation_report", " UNION ALL ".join(f"""
    SELECT '{d}' AS column_name, m AS metric, CAST(CASE m WHEN 'original_missing' THEN count(*) FILTER (b.{d} IS NULL)
           WHEN 'final_missing' THEN count(*) FILTER (a.{d} IS NULL)
           ELSE count(*) FILTER (b.{d} IS NOT NULL AND a.{d} <> b.{d}) END AS BIGINT) AS n
    FROM sc_products_dirty b JOIN capped a ON a.product_id = b.product_id
    CROSS JOIN (VALUES ('original_missing'), ('final_missing'), ('capped_values_count')) v(m) GROUP BY m""" for d in _DIMS))
def _(t):
    before = t.products_dirty
    after = P.cap_dimensions(P.impute_by_category(before))
    return imputation_report(before, after, "product_id", DIMENSIONS)


_Z = ", ".join(f"coalesce(({d} - avg({d}) OVER ()) / stddev_samp({d}) OVER (), 0.0E0) AS z{i}" for i, d in enumerate(_DIMS))
add_view("zscored", f"SELECT product_id, product_category_name AS cat, {_Z} FROM sc_products_dirty")
add_view("voters", """
    SELECT q.product_id AS query_id, d.product_id AS donor_id, d.cat,
           round((q.z0 - d.z0) * (q.z0 - d.z0) + (q.z1 - d.z1) * (q.z1 - d.z1) + (q.z2 - d.z2) * (q.z2 - d.z2)
                 + (q.z3 - d.z3) * (q.z3 - d.z3), 9) AS d2
    FROM zscored q JOIN zscored d ON q.cat IS NULL AND d.cat IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY q.product_id ORDER BY d2, d.product_id) <= 5""")


@query("b15_category_vote", """
    WITH c AS (SELECT query_id, cat, count(*) AS n FROM voters GROUP BY ALL),
         v AS (SELECT query_id, cat FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cat) = 1)
    SELECT p.product_id, coalesce(p.product_category_name, v.cat) AS product_category_name
    FROM sc_products_dirty p LEFT JOIN v ON p.product_id = v.query_id""")
def _(t):
    return P.impute_category_by_vote(t.products_dirty).select("product_id", "product_category_name")


def _knn(source: str, columns: tuple[str, ...], group: str, k: int) -> str:
    """Brute-force neighbour means of the two dimensions that can be missing."""
    parts = []
    for target in columns[:2]:
        shared = [c for c in columns if c != target]
        known = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in shared)
        total = " + ".join(
            f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN (q.{c} - d.{c}) * (q.{c} - d.{c}) ELSE 0.0E0 END"
            for c in shared)
        parts.append(f"""
        SELECT id, '{target}' AS dim, avg(val) AS val FROM (
            SELECT q.product_id AS id, d.{target} AS val FROM {source} q JOIN {source} d
            ON q.{target} IS NULL AND d.{target} IS NOT NULL {group}
            QUALIFY row_number() OVER (PARTITION BY q.product_id
                ORDER BY round(({total}) * 4.0E0 / ({known}), 9), d.product_id) <= {k}) GROUP BY 1""")
    return " UNION ALL ".join(parts)


add_view("near_means", _knn("sc_products_dirty", _DIMS, "AND q.product_category_name = d.product_category_name", 5))
add_view("once", """
    SELECT p.product_id, coalesce(product_weight_g, w.val) AS product_weight_g,
           coalesce(product_length_cm, l.val) AS product_length_cm, product_height_cm, product_width_cm
    FROM sc_products_dirty p LEFT JOIN near_means w ON p.product_id = w.id AND w.dim = 'product_weight_g'
    LEFT JOIN near_means l ON p.product_id = l.id AND l.dim = 'product_length_cm'""")
add_view("far_means", _knn("once", _DIMS, "", 10))


@query("b16_neighbour_imputation", """
    SELECT p.product_id, round(coalesce(product_weight_g, w.val), 4) AS product_weight_g,
           round(coalesce(product_length_cm, l.val), 4) AS product_length_cm, product_height_cm, product_width_cm
    FROM once p LEFT JOIN far_means w ON p.product_id = w.id AND w.dim = 'product_weight_g'
    LEFT JOIN far_means l ON p.product_id = l.id AND l.dim = 'product_length_cm'""")
def _(t):
    return rounded(P.impute_by_neighbours(t.products_dirty).select("product_id", *DIMENSIONS))


@query("c06_distance_join", """
    SELECT q.product_id AS query_id, d.product_id AS donor_id,
           CAST(row_number() OVER (PARTITION BY q.product_id ORDER BY dist, d.product_id) AS INT) AS rank, dist AS distance2
    FROM (SELECT * FROM sc_products_dirty WHERE product_category_name IS NULL) q
    JOIN (SELECT * FROM sc_products WHERE product_id % 31 <> 0) d ON q.product_subcategory = d.product_subcategory,
    LATERAL (SELECT (q.product_height_cm - d.product_height_cm) * (q.product_height_cm - d.product_height_cm)
                    + (q.product_width_cm - d.product_width_cm) * (q.product_width_cm - d.product_width_cm) AS dist)
    QUALIFY row_number() OVER (PARTITION BY q.product_id ORDER BY dist, d.product_id) <= 3""")
def _(t):
    without = t.products_dirty.where("product_category_name IS NULL")
    rest = t.products_dirty.where("product_category_name IS NOT NULL")
    return nearest_rows(without, rest, "product_id", "product_id", ["product_height_cm", "product_width_cm"], 3,
                        group=["product_subcategory"]).drop("product_subcategory")


add_view("timed_items", """
    SELECT i.*, o.order_purchase_timestamp AS bought FROM sc_items i JOIN sc_orders o ON i.order_id = o.order_id""")
ORDER = ["order_purchase_timestamp", "order_id", "order_item_id", "seller_id", "price"]
_SEQ = "PARTITION BY product_id ORDER BY bought, order_id, order_item_id, seller_id, price"
add_view("rolling", f"""
    SELECT *, avg(price) OVER (PARTITION BY product_id) AS gm, stddev_samp(price) OVER (PARTITION BY product_id) AS gs,
           CASE WHEN count(*) OVER w = 5 THEN avg(price) OVER w END AS rm,
           CASE WHEN count(*) OVER w = 5 THEN stddev_samp(price) OVER w END AS rs,
           lag(price, 1) OVER s AS a1, lag(price, 2) OVER s AS a2, lead(price, 1) OVER s AS b1, lead(price, 2) OVER s AS b2
    FROM timed_items WINDOW w AS ({_SEQ} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), s AS ({_SEQ})""")


def timed_items(t):
    """Lines with their price and purchase time, written down because the repair reads them several times."""
    return pinned(t.items.drop("shipping_charges").join(t.orders.select("order_id", "order_purchase_timestamp"), "order_id"))


# Whole cents, whose sums are exact in any order, so that means of equal rows agree to the last bit.
add_view("cents", """
    SELECT order_id, order_item_id, product_id, bought, seller_id, price, round(price * 100) AS cents FROM timed_items""")


@query("e07_rolling_statistics", f"""
    SELECT order_id, order_item_id, product_id, cents,
           round(CASE WHEN count(*) OVER w = 5 THEN avg(cents) OVER w ELSE avg(cents) OVER (PARTITION BY product_id) END, 3)
               AS rolling_mean,
           round(coalesce(nullif(CASE WHEN count(*) OVER w = 5 THEN stddev_samp(cents) OVER w END, 0.0E0),
                          stddev_samp(cents) OVER (PARTITION BY product_id)), 3) AS rolling_std
    FROM cents WINDOW w AS ({_SEQ} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(t):
    raw = timed_items(t).withColumn("cents", F.round(F.col("price") * 100))
    out = A.rolling_statistics(raw, "cents", ["product_id"], ORDER)
    return out.select("order_id", "order_item_id", "product_id", "cents", F.round("rolling_mean", 3).alias("rolling_mean"),
                      F.round("rolling_std", 3).alias("rolling_std"))


def _repair(mean: str, std: str) -> str:
    return f"""
    WITH m AS (SELECT *, (a1 + a2 + b1 + b2) / 4 AS nm FROM rolling),
         n AS (SELECT *, sqrt(((a1 - nm) * (a1 - nm) + (a2 - nm) * (a2 - nm) + (b1 - nm) * (b1 - nm)
                              + (b2 - nm) * (b2 - nm)) / 3) AS ns FROM m),
         z AS (SELECT *, coalesce(abs((price - coalesce({mean}, gm)) / nullif(coalesce(nullif({std}, 0.0E0), gs), 0.0E0)) > 3.0E0,
                                  FALSE) AS odd FROM n),
         r AS (SELECT *, median(CASE WHEN NOT odd THEN price END)
                      OVER ({_SEQ} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near,
                      median(price) OVER (PARTITION BY product_id) AS overall FROM z)
    SELECT order_id, order_item_id, product_id, odd AS is_anomaly,
           round(CASE WHEN odd THEN coalesce(near, overall) ELSE price END, 4) AS price FROM r"""


@query("b20_anomaly_repair", _repair("nm", "ns"))
def _(t):
    out = A.repair_anomalies(timed_items(t), "price", ["product_id"], ORDER)
    return out.select("order_id", "order_item_id", "product_id", "is_anomaly", R("price"))


@query("b20_anomaly_repair_as_written", _repair("rm", "rs"))
def _(t):
    out = A.repair_anomalies(timed_items(t), "price", ["product_id"], ORDER, exclude_center=False)
    return out.select("order_id", "order_item_id", "product_id", "is_anomaly", R("price"))
