"""The given tables presented as orders, items, products and customers, for Spark and as SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One definition per view, usable as a common table expression. Later views may use earlier ones.
VIEW_SQL = {
    "sc_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               o_orderdate + INTERVAL '1' HOUR * CAST(24 + o_orderkey % 24 AS INT) AS order_approved_at,
               o_orderdate + INTERVAL '1' HOUR * CAST(24 + o_orderkey % 24 + 24 * (3 + o_orderkey % 5) AS INT)
                   AS order_delivered_timestamp,
               o_orderdate + INTERVAL '1' DAY * CAST(5 + o_orderkey % 6 AS INT) AS order_estimated_delivery_date
        FROM orders""",
    "sc_orders_gaps": """
        SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
               CASE WHEN order_id % 11 = 0 THEN NULL ELSE order_delivered_timestamp END AS order_delivered_timestamp,
               CASE WHEN order_id % 77 = 0 THEN NULL ELSE order_estimated_delivery_date END
                   AS order_estimated_delivery_date
        FROM sc_orders""",
    "sc_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_extendedprice AS price, floor(l_extendedprice * l_tax * 100.0E0 + 0.5E0) / 100.0E0 AS shipping_charges
        FROM lineitem""",
    "sc_items_dirty": """
        SELECT order_id, order_item_id, product_id, seller_id,
               CASE WHEN order_id % 17 = 0 THEN NULL WHEN order_id % 19 = 0 THEN 0.0E0
                    WHEN order_id % 23 = 0 THEN -price ELSE price END AS price,
               CASE WHEN order_id % 29 = 0 THEN NULL ELSE shipping_charges END AS shipping_charges
        FROM sc_items""",
    "sc_products": """
        SELECT p_partkey AS product_id, p_type AS product_category_name, p_brand AS product_subcategory,
               CAST(p_size * 100 AS DOUBLE) AS product_weight_g, CAST(10 + p_size % 30 AS DOUBLE) AS product_length_cm,
               CAST(5 + p_partkey % 20 AS DOUBLE) AS product_height_cm,
               CAST(5 + p_partkey % 15 AS DOUBLE) AS product_width_cm
        FROM part""",
    "sc_products_dirty": """
        SELECT product_id,
               CASE WHEN product_id % 31 = 0 THEN NULL ELSE product_category_name END AS product_category_name,
               product_subcategory,
               CASE WHEN product_id % 13 = 0 THEN NULL ELSE product_weight_g END AS product_weight_g,
               CASE WHEN product_id % 37 = 0 THEN NULL ELSE product_length_cm END AS product_length_cm,
               product_height_cm, product_width_cm
        FROM sc_products""",
    "sc_customers": """
        SELECT c_custkey AS customer_id, n_name AS customer_state, c_mktsegment AS customer_city
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    # Orders with the derived columns of the order operators.
    "ord": """
        SELECT *, year(order_purchase_timestamp) AS order_year, month(order_purchase_timestamp) AS order_month,
               epoch(order_approved_at - order_purchase_timestamp) / 86400.0E0 AS processing_time,
               date_diff('day', order_purchase_timestamp, order_delivered_timestamp) AS delivery_days,
               CASE WHEN order_delivered_timestamp <= order_estimated_delivery_date THEN 1 ELSE 0 END
                   AS on_time_delivery
        FROM sc_orders""",
    # The line-grain dataset.
    "unified": """
        SELECT o.*, i.order_item_id, i.product_id, i.seller_id, i.price, i.shipping_charges,
               p.product_category_name, p.product_subcategory, c.customer_state, c.customer_city
        FROM ord o JOIN sc_items i ON o.order_id = i.order_id
        LEFT JOIN sc_products p ON i.product_id = p.product_id
        LEFT JOIN sc_customers c ON o.customer_id = c.customer_id""",
    # Monthly demand per category, and per sub-category without the unfinished last month.
    "demand": """
        SELECT product_category_name, order_year, order_month, count(*) AS "count", sum(price) AS total_sales,
               make_date(order_year, order_month, 1) AS "date"
        FROM unified WHERE product_category_name IS NOT NULL GROUP BY ALL""",
    "finished_until": """
        SELECT CASE WHEN last_day(m) - m < 3 THEN last_day(m) + 1 ELSE CAST(date_trunc('month', m) AS DATE) END AS day
        FROM (SELECT max(CAST(order_purchase_timestamp AS DATE)) AS m FROM sc_orders)""",
    "series": """
        SELECT product_subcategory AS series, make_date(order_year, order_month, 1) AS "month",
               CAST(count(*) AS DOUBLE) AS y
        FROM unified WHERE product_subcategory IS NOT NULL
                       AND order_purchase_timestamp < (SELECT day FROM finished_until)
        GROUP BY ALL""",
    "sellers": """
        SELECT seller_id, count(*) AS order_count, avg(processing_time) AS avg_processing_time,
               avg(delivery_days) AS avg_delivery_days, sum(price) AS total_sales,
               sum(shipping_charges) AS shipping_costs, sum(price) / count(*) AS avg_order_value,
               sum(shipping_charges) / sum(price) * 100 AS shipping_ratio,
               coalesce(avg(on_time_delivery), 0.5E0) * 100 AS on_time_delivery_rate
        FROM unified GROUP BY seller_id""",
    "states": """
        SELECT customer_state, count(*) AS order_count, avg(processing_time) AS avg_processing_time,
               avg(delivery_days) AS avg_delivery_days, sum(price) AS total_sales,
               avg(on_time_delivery) * 100 AS on_time_delivery_rate
        FROM unified GROUP BY customer_state""",
}


def add_view(name: str, sql: str) -> None:
    """Let a catalog module name a shared step of its SQL."""
    VIEW_SQL[name] = sql


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, directly or through other views."""
    used: set[str] = set()

    def collect(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                used.add(name)
                collect(body)

    collect(sql)
    parts = [f"{name} AS ({body})" for name, body in VIEW_SQL.items() if name in used]
    body = sql.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """The adapted tables of one scale-factor folder as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.col("o_orderdate")
        hours = (F.lit(24) + key % 24).cast("int")
        delivered = (F.lit(24) + key % 24 + 24 * (3 + key % 5)).cast("int")
        return self.raw("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"),
            day.alias("order_purchase_timestamp"),
            F.timestamp_add("HOUR", hours, day).alias("order_approved_at"),
            F.timestamp_add("HOUR", delivered, day).alias("order_delivered_timestamp"),
            F.timestamp_add("DAY", (F.lit(5) + key % 6).cast("int"), day).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def orders_gaps(self) -> DataFrame:
        key = F.col("order_id")
        return self.orders.withColumns({
            "order_delivered_timestamp": F.when(key % 11 != 0, F.col("order_delivered_timestamp")),
            "order_estimated_delivery_date": F.when(key % 77 != 0, F.col("order_estimated_delivery_date")),
        })

    @cached_property
    def items(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            price.alias("price"), (F.floor(price * F.col("l_tax") * 100.0 + 0.5) / 100.0).alias("shipping_charges"),
        )

    @cached_property
    def items_dirty(self) -> DataFrame:
        key, price = F.col("order_id"), F.col("price")
        return self.items.withColumns({
            "price": F.when(key % 17 == 0, F.lit(None)).when(key % 19 == 0, F.lit(0.0)).when(key % 23 == 0, -price)
            .otherwise(price),
            "shipping_charges": F.when(key % 29 != 0, F.col("shipping_charges")),
        })

    @cached_property
    def products(self) -> DataFrame:
        size, key = F.col("p_size"), F.col("p_partkey")
        return self.raw("part").select(
            key.alias("product_id"), F.col("p_type").alias("product_category_name"),
            F.col("p_brand").alias("product_subcategory"),
            (size * 100).cast("double").alias("product_weight_g"),
            (10 + size % 30).cast("double").alias("product_length_cm"),
            (5 + key % 20).cast("double").alias("product_height_cm"),
            (5 + key % 15).cast("double").alias("product_width_cm"),
        )

    @cached_property
    def products_dirty(self) -> DataFrame:
        key = F.col("product_id")
        return self.products.withColumns({
            "product_category_name": F.when(key % 31 != 0, F.col("product_category_name")),
            "product_weight_g": F.when(key % 13 != 0, F.col("product_weight_g")),
            "product_length_cm": F.when(key % 37 != 0, F.col("product_length_cm")),
        })

    @cached_property
    def customers(self) -> DataFrame:
        nations = self.raw("nation").select("n_nationkey", F.col("n_name").alias("customer_state"))
        return (
            self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("c_custkey").alias("customer_id"), "customer_state",
                    F.col("c_mktsegment").alias("customer_city"))
        )
