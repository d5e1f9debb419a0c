"""The line-grain dataset every analysis reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unified_lines(
    orders: DataFrame, items: DataFrame, products: DataFrame | None = None, customers: DataFrame | None = None
) -> DataFrame:
    """Orders inner join lines, left join products and customers; one row per order line.

    A left join that adds no needed column still costs a join, so an analysis leaves out the side it does not read.
    No side is hinted: the optimizer broadcasts a side whose size it knows to be small, and splits skewed keys
    otherwise. Products and customers are joined before the wide line frame is shuffled again.
    """
    buyers = orders if customers is None else orders.join(customers, "customer_id", "left")
    lines = items if products is None else items.join(products, "product_id", "left")
    return buyers.join(lines, "order_id", "inner")


def dataset_summary(lines: DataFrame) -> DataFrame:
    """Rows and distinct orders, products and customers in one row."""
    return lines.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("product_id").alias("total_products"),
        F.count_distinct("customer_id").alias("total_customers"),
    )
