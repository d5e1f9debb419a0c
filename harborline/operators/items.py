"""Prices and shipping charges of order lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.quantiles import SORTED_ROWS, exact_medians, medians_of_sized_keys, scalar_struct
from ..session import pinned, pinned_counted

# The last resort when no value of a column is known.
LAST_RESORT = {"price": 50.0, "shipping_charges": 10.0, "freight_value": 10.0}


def repair_money(df: DataFrame, columns: Sequence[str] = ("price", "shipping_charges")) -> DataFrame:
    """Negative amounts become positive; zero counts as missing."""
    return df.withColumns({c: F.nullif(F.abs(finite(c)), F.lit(0.0)) for c in columns if c in df.columns})


def _product_step(
    items: DataFrame, columns: Sequence[str], buckets: int | None, sorted_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per product: its lines (`n`) and known amounts (`__k_` and the column), the same for products that leave a missing
    amount to a coarser median, and the medians (`__p_` and the column)."""
    sizes = pinned(items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(finite(c)).alias(f"__k_{c}") for c in columns]))
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | _lacks(c)
    medians = medians_of_sized_keys(
        items, {c: f"__p_{c}" for c in columns}, "product_id", sizes.select("product_id", "n"), buckets, sorted_rows)
    return sizes, sizes.where(lacking), medians


def _lacks(column: str) -> Column:
    """No line meets the median of a product without a known amount, or without an id."""
    known = F.col(f"__k_{column}")
    return (known == 0) | (F.col("product_id").isNull() & (known < F.col("n")))


def _overall(items: DataFrame, columns: Sequence[str], sizes: DataFrame, asked: bool, buckets: int | None) -> Column:
    """The medians of all lines, of which the ladder reads none where finer medians serve every line."""
    if not asked:
        return F.struct(*[F.lit(None).cast("double").alias(c) for c in columns])
    rows = sizes.agg(F.sum("n")).first()[0]
    return scalar_struct(exact_medians(items, {c: c for c in columns}, (), buckets, rows))


def impute_item_values(
    items: DataFrame,
    products: DataFrame | None = None,
    columns: Sequence[str] = ("price", "shipping_charges"),
    last_resort: Mapping[str, float] = LAST_RESORT,
    buckets: int | None = None,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Fill missing or zero amounts by the product's median, then the category's, then the overall one, then a constant.

    Medians are exact and taken over known amounts only. The category step needs `products`. Of the categories, only those
    are sorted that a product without a known amount asks for; all lines are sorted only if something is still missing.
    """
    columns = [c for c in columns if c in items.columns]
    known = repair_money(items, columns)
    sizes, lone, medians = _product_step(known, columns, buckets, sorted_rows)
    filled = known.join(medians, "product_id", "left")
    steps = ["__p_"]
    left = lone
    if products is not None:
        category = products.select("product_id", F.col("product_category_name").alias("__category"))
        filled = filled.join(category, "product_id", "left")
        left = lone.join(category, "product_id", "left")
        wanted, found = pinned_counted(left.where(F.col("__category").isNotNull()).select("__category").distinct())
        if found:
            members = category.join(wanted, "__category", "left_semi")
            rows = sizes.join(members, "product_id").agg(F.sum("n")).first()[0]
            by_category = pinned(exact_medians(
                known.join(members, "product_id"), {c: f"__c_{c}" for c in columns}, ["__category"], buckets, rows))
            filled = filled.join(by_category, "__category", "left")
            left = left.join(by_category, "__category", "left")
            steps.append("__c_")
    still = F.lit(False)
    for c in columns:
        still = still | (_lacks(c) & F.col(f"__c_{c}").isNull() if "__c_" in steps else _lacks(c))
    filled = filled.withColumn("__all", _overall(known, columns, sizes, not left.where(still).isEmpty(), buckets))
    values = {
        c: F.coalesce(F.col(c), *[F.col(s + c) for s in steps], F.col("__all")[c], F.lit(last_resort.get(c, 1.0)))
        for c in columns
    }
    return filled.withColumns(values).select(*items.columns)


def impute_missing_values(
    items: DataFrame, columns: Sequence[str] = ("price", "shipping_charges"), buckets: int | None = None
) -> DataFrame:
    """The shorter ladder: only NULLs are filled, by the product's median, then the overall one, then 0."""
    columns = [c for c in columns if c in items.columns]
    sizes, lone, medians = _product_step(items, columns, buckets, SORTED_ROWS)
    overall = _overall(items, columns, sizes, not lone.isEmpty(), buckets)
    filled = items.join(medians, "product_id", "left").withColumn("__all", overall)
    values = {c: F.coalesce(F.col(c), F.col(f"__p_{c}"), F.col("__all")[c], F.lit(0.0)) for c in columns}
    return filled.withColumns(values).select(*items.columns)


def with_total_value(df: DataFrame) -> DataFrame:
    """total_value = price plus shipping_charges, else plus freight_value, else price alone."""
    extra = next((c for c in ("shipping_charges", "freight_value") if c in df.columns), None)
    return df.withColumn("total_value", F.col("price") + F.col(extra) if extra else F.col("price"))
