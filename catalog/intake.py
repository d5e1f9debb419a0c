"""Scans, quality, cleaning and the line dataset."""

from pyspark.sql import functions as F

from harborline.functions.dates import parse_dates
from harborline.operators import items as I
from harborline.operators import orders as O
from harborline.operators import quality as Q
from harborline.operators.unify import dataset_summary, unified_lines
from harborline.session import pinned
from harborline.sources import schemas
from harborline.sources.tables import conform, read_table

from .base import query
from .views import Tables, add_view

R = lambda c: F.round(c, 4).alias(c)


def lines(t: Tables):
    """The line dataset with derived order columns."""
    return unified_lines(O.derive_order_columns(t.orders), t.items, t.products, t.customers)


def order_lines(t: Tables):
    """Lines with their order only: for analyses by seller or product."""
    return unified_lines(O.derive_order_columns(t.orders), t.items)


def product_lines(t: Tables):
    """Lines without the customer side: for analyses by category."""
    return unified_lines(O.derive_order_columns(t.orders), t.items, t.products)


def state_lines(t: Tables):
    """Lines without the product side: for analyses by state."""
    return unified_lines(O.derive_order_columns(t.orders), t.items, None, t.customers)


@query("a01_table_scan", """
    SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id, CAST(product_id AS VARCHAR) AS product_id,
           CAST(seller_id AS VARCHAR) AS seller_id, price, shipping_charges FROM sc_items""")
def _(t):
    return conform(t.items, schemas.ITEMS)


@query("a02_missing_source", """
    SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id, order_status
    FROM sc_orders""")
def _(t):
    absent = read_table(t.spark, f"{t.sf_dir}/no_such_table.parquet", schemas.ORDERS, "parquet")
    both = conform(t.orders, schemas.ORDERS).unionByName(absent)
    return both.select("order_id", "customer_id", "order_status")


add_view("text_items", """
    SELECT order_id, order_item_id,
           CASE WHEN order_id % 17 = 0 THEN 'unknown' WHEN order_id % 19 = 0 THEN NULL
                ELSE CAST(CAST(price AS DECIMAL(14,2)) AS VARCHAR) END AS price,
           CASE WHEN order_id % 13 = 0 THEN 'not a date' ELSE '2001-02-03 04:05:06' END AS stamp
    FROM sc_items""")


def text_items(t):
    key = F.col("order_id")
    return t.items.select(
        "order_id", "order_item_id",
        F.when(key % 17 == 0, "unknown").when(key % 19 != 0, F.col("price").cast("decimal(14,2)").cast("string"))
        .alias("price"),
        F.when(key % 13 == 0, "not a date").otherwise("2001-02-03 04:05:06").alias("stamp"),
    )


@query("a03_validate_frame", """
    SELECT 'order_id' AS column_name, 'required' AS check_name, CAST(0 AS BIGINT) AS bad_rows, TRUE AS ok
    UNION ALL SELECT 'seller_id', 'required', 1, FALSE
    UNION ALL SELECT 'price', 'numeric', count(*) FILTER (price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL),
                     count(*) FILTER (price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL) = 0 FROM text_items
    UNION ALL SELECT 'stamp', 'date', count(*) FILTER (stamp IS NOT NULL AND TRY_CAST(stamp AS TIMESTAMP) IS NULL),
                     count(*) FILTER (stamp IS NOT NULL AND TRY_CAST(stamp AS TIMESTAMP) IS NULL) = 0 FROM text_items""")
def _(t):
    return Q.validate_frame(text_items(t), ["order_id", "seller_id"], ["price"], ["stamp"])


@query("a04_clean_frame", """
    SELECT order_id, order_item_id,
           round(coalesce(TRY_CAST(price AS DOUBLE), (SELECT median(TRY_CAST(price AS DOUBLE)) FROM text_items)), 4)
               AS price,
           strftime(TRY_CAST(stamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp FROM text_items""")
def _(t):
    cleaned = Q.clean_frame(text_items(t), ["price"], ["stamp"])
    return cleaned.select("order_id", "order_item_id", R("price"),
                          F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("a05_normalize_tokens", """
    SELECT order_id, order_item_id,
           CASE WHEN order_id % 5 < 4 THEN NULL ELSE 'seller ' || seller_id END AS seller_id,
           CASE WHEN order_id % 7 = 0 THEN NULL WHEN order_id % 7 = 1 THEN 0.0E0 ELSE round(price, 2) END AS total_sales,
           '(' || order_item_id || ',1,1)' AS arima_params
    FROM sc_items""")
def _(t):
    key = F.col("order_id")
    raw = t.items.select(
        "order_id", "order_item_id",
        F.when(key % 5 == 0, "").when(key % 5 == 1, "N/A").when(key % 5 == 2, "n/a").when(key % 5 == 3, "NA")
        .otherwise(F.concat(F.lit("seller "), "seller_id")).alias("seller_id"),
        F.when(key % 7 == 0, "-Infinity").when(key % 7 == 1, "abc")
        .otherwise(F.col("price").cast("decimal(14,2)").cast("string")).alias("total_sales"),
        F.concat(F.lit('"('), "order_item_id", F.lit(',1,1)"')).alias("arima_params"),
    )
    return Q.normalize_tokens(raw, ["total_sales"])


@query("a06_normalize_demand", """
    SELECT product_category_name, order_year, order_month,
           strftime(CASE WHEN order_month % 4 = 0 THEN make_date(order_year, order_month, 15)
                         ELSE make_date(order_year, order_month, 1) END, '%Y-%m-%d') AS "date",
           CAST("count" AS DOUBLE) AS "count" FROM demand""")
def _(t):
    from harborline.operators.demand import monthly_sales

    month = F.col("order_month")
    raw = monthly_sales(product_lines(t)).select(
        "product_category_name", "order_year", "order_month", F.col("order_count"),
        F.when(month % 2 == 0, F.lit(None).cast("long")).otherwise(F.col("order_count")).alias("count"),
        F.when(month % 4 == 0, F.format_string("%04d-%02d-15", "order_year", "order_month"))
        .when(month % 4 == 1, "garbled").alias("date"),
    )
    out = Q.normalize_demand(raw)
    return out.select("product_category_name", "order_year", "order_month",
                      F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


@query("a14_bundle_status", """
    SELECT 'lines' AS table_name, count(*) AS "rows", 'present' AS status, TRUE AS required FROM unified
    UNION ALL SELECT 'demand', count(*), 'present', TRUE FROM demand
    UNION ALL SELECT 'forecast_report', 0, 'missing', TRUE
    UNION ALL SELECT 'state_metrics', count(*), 'empty', FALSE FROM states WHERE customer_state IS NULL""")
def _(t):
    from harborline.operators.demand import monthly_demand

    # Three of the counts read the joined lines: written down once.
    all_lines = pinned(lines(t).select("product_category_name", "order_year", "order_month", "customer_state"))
    return Q.bundle_status(
        {"lines": all_lines, "demand": monthly_demand(all_lines), "forecast_report": None,
         "state_metrics": all_lines.where(F.col("customer_state").isNull())},
        ["lines", "demand", "forecast_report"],
    )


_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S",
            "%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m-%d-%Y %H:%M:%S",
            "%m/%d/%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f")
add_view("text_dates", """
    SELECT o_orderkey AS order_id,
           CASE WHEN o_orderkey % 10 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS ordered
    FROM orders""")
add_view("date_hits", " UNION ALL ".join(
    f"SELECT {i} AS f, count(try_strptime(ordered, '{f}')) AS hits FROM text_dates" for i, f in enumerate(_FORMATS)))


@query("b01_date_format", "SELECT order_id, strftime(CASE (SELECT f FROM date_hits ORDER BY hits DESC, f LIMIT 1) "
       + " ".join(f"WHEN {i} THEN try_strptime(ordered, '{f}')" for i, f in enumerate(_FORMATS))
       + " END, '%Y-%m-%d %H:%M:%S') AS ordered FROM text_dates")
def _(t):
    raw = t.orders.select("order_id", F.when(F.col("order_id") % 10 == 0, "pending").otherwise(
        F.date_format("order_purchase_timestamp", "MM/dd/yyyy")).alias("ordered"))
    return parse_dates(raw, "ordered").select(
        "order_id", F.date_format("ordered", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


@query("b02_order_month", """
    SELECT order_id, CAST(year(order_purchase_timestamp) AS INT) AS order_year,
           CAST(month(order_purchase_timestamp) AS INT) AS order_month FROM sc_orders""")
def _(t):
    return O.with_order_month(t.orders).select("order_id", "order_year", "order_month")


# Ship dates lie before the order date on about half the lines: the case that must become NULL.
add_view("shipped", """
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, o_orderdate AS purchased, l_shipdate AS shipped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def shipped(t):
    ship = t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
                                    F.col("l_shipdate").alias("order_delivered_timestamp"))
    return t.orders.drop("order_delivered_timestamp").join(ship, "order_id").withColumn(
        "order_approved_at", F.col("order_delivered_timestamp"))


@query("b03_processing_time", """
    SELECT order_id, order_item_id,
           CASE WHEN date_diff('day', purchased, shipped) >= 0 THEN CAST(date_diff('day', purchased, shipped) AS INT) END
               AS whole_days,
           CASE WHEN shipped >= purchased THEN round(epoch(shipped - purchased) / 86400.0E0, 4) END AS fractional_days
    FROM shipped""")
def _(t):
    whole = O.with_whole_days(shipped(t)).withColumnRenamed("processing_time", "whole_days")
    return O.with_fractional_days(whole).select(
        "order_id", "order_item_id", "whole_days", F.round("processing_time", 4).alias("fractional_days"))


@query("b04_delivery_days", """
    SELECT order_id, order_item_id, CASE WHEN date_diff('day', purchased, shipped) >= 0
           THEN CAST(date_diff('day', purchased, shipped) AS INT) END AS delivery_days FROM shipped""")
def _(t):
    return O.with_whole_days(shipped(t)).select("order_id", "order_item_id", "delivery_days")


@query("b05_fractional_delivery", """
    SELECT order_id, round(epoch(order_delivered_timestamp - order_purchase_timestamp) / 86400.0E0, 4)
               AS actual_delivery_days,
           round(epoch(order_estimated_delivery_date - order_purchase_timestamp) / 86400.0E0, 4)
               AS estimated_delivery_days FROM sc_orders_gaps""")
def _(t):
    return O.with_fractional_days(t.orders_gaps).select(
        "order_id", R("actual_delivery_days"), R("estimated_delivery_days"))


@query("b06_on_time", """
    SELECT order_id,
           CASE WHEN order_delivered_timestamp IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
                THEN CAST(CAST(order_delivered_timestamp AS DATE) <= CAST(order_estimated_delivery_date AS DATE) AS INT)
                END AS on_time_by_date,
           CASE WHEN order_delivered_timestamp IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
                THEN CAST(order_delivered_timestamp <= order_estimated_delivery_date AS INT) END AS on_time_by_duration
    FROM sc_orders_gaps""")
def _(t):
    by_date = O.with_on_time(t.orders_gaps).withColumnRenamed("on_time_delivery", "on_time_by_date")
    return O.with_on_time(by_date, "durations").select(
        "order_id", "on_time_by_date", F.col("on_time_delivery").alias("on_time_by_duration"))


add_view("gap_lines", """
    SELECT o.order_id, i.order_item_id, o.order_purchase_timestamp, o.order_delivered_timestamp,
           p.product_category_name,
           greatest(floor(epoch(coalesce(order_delivered_timestamp, order_estimated_delivery_date)
                                - order_purchase_timestamp) / 86400), 1) AS raw_days,
           coalesce(order_delivered_timestamp, order_estimated_delivery_date) IS NULL AS unknown
    FROM sc_orders_gaps o JOIN sc_items i ON o.order_id = i.order_id
    LEFT JOIN sc_products p ON i.product_id = p.product_id""")
add_view("gap_days", """
    WITH m AS (SELECT product_category_name AS c, median(raw_days) AS med FROM gap_lines WHERE NOT unknown GROUP BY 1),
         k AS (SELECT g.*, coalesce(CASE WHEN NOT unknown THEN raw_days END, m.med) AS known
               FROM gap_lines g LEFT JOIN m ON g.product_category_name = m.c)
    SELECT *, least(greatest(coalesce(known, (SELECT median(known) FROM k)), 1.0E0), 30.0E0) AS days FROM k""")


def gap_lines(t):
    return unified_lines(t.orders_gaps, t.items, t.products, t.customers)


@query("b07_delivery_days_ladder", """
    SELECT order_id, order_item_id, CAST(days AS DOUBLE) AS delivery_days FROM gap_days""")
def _(t):
    return O.impute_delivery_days(gap_lines(t)).select("order_id", "order_item_id", "delivery_days")


@query("b08_delivered_stamp", """
    SELECT order_id, order_item_id, strftime(coalesce(order_delivered_timestamp,
           order_purchase_timestamp + INTERVAL '1' SECOND * CAST(days * 86400 AS INT)), '%Y-%m-%d %H:%M:%S')
           AS delivered FROM gap_days""")
def _(t):
    out = O.impute_delivered(O.impute_delivery_days(gap_lines(t)))
    return out.select("order_id", "order_item_id",
                      F.date_format("order_delivered_timestamp", "yyyy-MM-dd HH:mm:ss").alias("delivered"))


@query("b09_synthetic_stamps", """
    WITH p AS (SELECT o_orderkey AS order_id,
                      CAST(make_date(year(o_orderdate), month(o_orderdate), 15) AS TIMESTAMP) AS purchased FROM orders)
    SELECT order_id, strftime(purchased, '%Y-%m-%d %H:%M:%S') AS purchased,
           strftime(purchased + INTERVAL '1' HOUR * CAST(24 + order_id % 24 AS INT), '%Y-%m-%d %H:%M:%S') AS approved,
           strftime(purchased + INTERVAL '1' HOUR * CAST(24 + order_id % 24 + 24 * (3 + order_id % 5) AS INT),
                    '%Y-%m-%d %H:%M:%S') AS delivered,
           strftime(purchased + INTERVAL '1' DAY * CAST(5 + order_id % 6 AS INT), '%Y-%m-%d %H:%M:%S') AS estimated
    FROM p""")
def _(t):
    bare = O.with_order_month(t.orders).select("order_id", "order_year", "order_month")
    out = O.synthesize_stamps(bare)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("order_id", text(O.PURCHASE).alias("purchased"), text(O.APPROVED).alias("approved"),
                      text(O.DELIVERED).alias("delivered"), text(O.ESTIMATED).alias("estimated"))


@query("b10_process_orders", """
    SELECT order_id, CAST(date_diff('day', order_purchase_timestamp, order_approved_at) AS INT) AS processing_time,
           CAST(coalesce(date_diff('day', order_purchase_timestamp, order_delivered_timestamp), 7) AS INT)
               AS delivery_days,
           coalesce(CAST(CAST(order_delivered_timestamp AS DATE) <= CAST(order_estimated_delivery_date AS DATE) AS DOUBLE),
                    0.5E0) AS on_time_delivery,
           CAST(date_diff('day', order_purchase_timestamp, order_approved_at) + 5 AS INT) AS short_delivery_days,
           strftime(CAST(order_approved_at AS DATE) + INTERVAL 7 DAY, '%Y-%m-%d') AS short_estimate
    FROM sc_orders_gaps""")
def _(t):
    full = O.process_orders(t.orders_gaps).select("order_id", "processing_time", "delivery_days", "on_time_delivery")
    short = O.process_orders(t.orders_gaps.drop(O.DELIVERED, O.ESTIMATED)).select(
        "order_id", F.col("delivery_days").alias("short_delivery_days"),
        F.date_format(O.ESTIMATED, "yyyy-MM-dd").alias("short_estimate"))
    return full.join(short, "order_id")


@query("b11_repair_money", """
    SELECT order_id, order_item_id, nullif(abs(price), 0.0E0) AS price,
           nullif(abs(shipping_charges), 0.0E0) AS shipping_charges FROM sc_items_dirty""")
def _(t):
    return I.repair_money(t.items_dirty).select("order_id", "order_item_id", "price", "shipping_charges")


add_view("money", """
    SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, nullif(abs(price), 0) AS price,
           nullif(abs(shipping_charges), 0) AS ship, product_category_name AS cat
    FROM sc_items_dirty i LEFT JOIN sc_products p ON i.product_id = p.product_id""")


@query("b12_item_value_ladder", """
    SELECT m.order_id, m.order_item_id, m.product_id, round(coalesce(m.price, p.price, c.price, a.price, 50.0E0), 4) AS price,
           round(coalesce(m.ship, p.ship, c.ship, a.ship, 10.0E0), 4) AS shipping_charges
    FROM money m
    LEFT JOIN (SELECT product_id, median(price) AS price, median(ship) AS ship FROM money GROUP BY 1) p
        ON m.product_id = p.product_id
    LEFT JOIN (SELECT cat, median(price) AS price, median(ship) AS ship FROM money GROUP BY 1) c ON m.cat = c.cat
    CROSS JOIN (SELECT median(price) AS price, median(ship) AS ship FROM money) a""")
def _(t):
    out = I.impute_item_values(t.items_dirty, t.products)
    return out.select("order_id", "order_item_id", "product_id", R("price"), R("shipping_charges"))


@query("b13_product_global_ladder", """
    SELECT m.order_id, m.order_item_id, m.product_id, round(coalesce(m.price, p.price, a.price), 4) AS price,
           round(coalesce(m.shipping_charges, p.ship, a.ship), 4) AS shipping_charges
    FROM sc_items_dirty m
    LEFT JOIN (SELECT product_id, median(price) AS price, median(shipping_charges) AS ship FROM sc_items_dirty GROUP BY 1) p
        ON m.product_id = p.product_id
    CROSS JOIN (SELECT median(price) AS price, median(shipping_charges) AS ship FROM sc_items_dirty) a""")
def _(t):
    out = I.impute_missing_values(t.items_dirty)
    return out.select("order_id", "order_item_id", "product_id", R("price"), R("shipping_charges"))


@query("b19_total_value", """
    SELECT order_id, order_item_id, round(price + shipping_charges, 4) AS total_value FROM sc_items""")
def _(t):
    return I.with_total_value(t.items).select("order_id", "order_item_id", R("total_value"))


@query("c01_unified_lines", """
    SELECT order_id, order_item_id, product_id, customer_id, seller_id, order_year::INT AS order_year,
           order_month::INT AS order_month, product_category_name, customer_state, price,
           round(processing_time, 4) AS processing_time, delivery_days::INT AS delivery_days, on_time_delivery
    FROM unified""")
def _(t):
    return lines(t).select("order_id", "order_item_id", "product_id", "customer_id", "seller_id", "order_year",
                           "order_month", "product_category_name", "customer_state", "price", R("processing_time"),
                           "delivery_days", "on_time_delivery")


@query("d06_dataset_summary", """
    SELECT count(*) AS total_rows, count(DISTINCT order_id) AS total_orders,
           count(DISTINCT product_id) AS total_products, count(DISTINCT customer_id) AS total_customers FROM unified""")
def _(t):
    return dataset_summary(lines(t))
