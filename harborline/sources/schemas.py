"""Declared schemas of the input tables, the result tables and the run store."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


ORDERS = _schema(
    ("order_id", _S), ("customer_id", _S), ("order_status", _S), ("order_purchase_timestamp", _TS),
    ("order_approved_at", _TS), ("order_delivered_timestamp", _TS), ("order_estimated_delivery_date", _TS),
)
ITEMS = _schema(
    ("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
    ("price", _D), ("shipping_charges", _D),
)
PRODUCTS = _schema(
    ("product_id", _S), ("product_category_name", _S), ("product_weight_g", _D),
    ("product_length_cm", _D), ("product_height_cm", _D), ("product_width_cm", _D),
)
CUSTOMERS = _schema(
    ("customer_id", _S), ("customer_zip_code_prefix", _S), ("customer_city", _S), ("customer_state", _S),
)
INPUT_TABLES = {"orders": ORDERS, "items": ITEMS, "products": PRODUCTS, "customers": CUSTOMERS}

# File names of the CSV distribution of the four tables (fixed values).
CSV_NAMES = {
    "orders": "df_Orders.csv",
    "items": "df_OrderItems.csv",
    "products": "df_Products.csv",
    "customers": "df_Customers.csv",
}

DIMENSIONS = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
STAMPS = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_timestamp", "order_estimated_delivery_date",
)
