"""Exact row numbers, running totals and ranks without ever holding a frame, or a key, in one task.

Spark's range partitioner deals the rows out by the key and order columns; every range is sorted by its own task, which
may spill, and written. A row's place in its range is its number in the written order, so nothing is buffered. What lies
before a range is a sum over at most MOST_RANGES counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

# One range for so many rows; never more ranges than this, so that what the driver and one task hold stays bounded.
ROWS_PER_RANGE, MOST_RANGES = 250_000, 4_096
# monotonically_increasing_id() counts the rows of a partition in its lower bits.
ROW_BITS = 33


def range_count(rows: int) -> int:
    """Ranges for a number of rows."""
    return min(MOST_RANGES, max(1, -(-rows // ROWS_PER_RANGE)))


def _ordering(order_by: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order_by]


def with_sort_bucket(
    df: DataFrame, order_by: Sequence[tuple[str, bool]], name: str = "__b", buckets: int | None = None,
    rows: int | None = None, place: str = "__at",
) -> DataFrame:
    """Write the frame in order; add the number of a row's range, and its place in the range from 0.

    `buckets` is the number of ranges, `rows` an upper bound of the number of rows if one is known; else they are counted.
    Rows that differ in an order column can be told apart by the cuts, so a frequent first value fills many ranges.
    """
    n = buckets or range_count(df.count() if rows is None else rows)
    order = _ordering(order_by)
    # The sample behind the cuts differs from run to run: what reads the ranges twice must read the written ones.
    placed = pinned(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(
        place, F.monotonically_increasing_id()))
    return placed.withColumn(name, F.shiftright(place, ROW_BITS)).withColumn(
        place, F.col(place).bitwiseAND(F.lit((1 << ROW_BITS) - 1)))


def _same(keys: Sequence[str]) -> Column:
    return F.expr(" AND ".join(["__b = __ob", *[f"`{k}` <=> __k{i}" for i, k in enumerate(keys)]]))


def _spans(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For the keys that stand in several ranges: what lies before each of them, and the key's total.

    The ranges follow the keys, so all such keys together stand in at most twice as many places as there are ranges.
    """
    own = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys)
    spread = sizes.selectExpr(
        *[f"`{k}` AS __k{i}" for i, k in enumerate(keys)], "__b AS __ob", "__n AS __here", f"count(1) OVER ({own}) AS __places",
        f"sum(__n) OVER ({own} ORDER BY __b) - __n AS __before", f"sum(__n) OVER ({own}) AS __whole")
    return F.broadcast(spread.where("__places > 1").drop("__places"))


def with_running_total(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[tuple[str, bool]], weight: Column, name: str, total: str,
    buckets: int | None = None, rows: int | None = None, wanted: str | None = None,
) -> DataFrame:
    """Sum of `weight` per key up to and with the row in the given order, and the key's whole sum.

    A key may hold any share of the rows: it is summed range by range. Of such a key, ranges that do not meet `wanted`, a
    condition over the sums `before`, `upto` (with the range) and `total`, are left out before their rows are shuffled.
    """
    keys = list(keys)
    n = buckets or range_count(df.count() if rows is None else rows)
    marked = with_sort_bucket(df, [*[(k, True) for k in keys], *order_by], "__b", n)
    marked = marked.withColumn("__w", weight)
    inside = Window.partitionBy(*keys, "__b")
    upto = F.sum("__w").over(inside.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if n == 1:
        # No key stands in two ranges.
        return marked.select(*df.columns, upto.alias(name), F.sum("__w").over(inside).alias(total))
    spans = _spans(marked.groupBy(*keys, "__b").agg(F.sum("__w").alias("__n")), keys)
    placed = marked.join(spans, _same(keys), "left")
    if wanted:
        sums = {"before": F.col("__before"), "upto": F.expr("__before + __here"), "total": F.col("__whole")}
        placed = placed.withColumns(sums).where(f"before IS NULL OR {wanted}").drop(*sums)
    out = placed.withColumns({"__upto": upto, "__total": F.sum("__w").over(inside)})
    return out.selectExpr(*[f"`{c}`" for c in df.columns], f"__upto + coalesce(__before, 0L) AS `{name}`",
                          f"coalesce(__whole, __total) AS `{total}`")


def with_row_number(
    df: DataFrame,
    order_by: Sequence[tuple[str, bool]],
    name: str = "row_number",
    partition_by: Sequence[str] = (),
    total: str | None = None,
    buckets: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Row number from 1 per key (or over the frame), as exact as an unpartitioned window.

    The order columns should identify a row; `total` names an extra column with the group's row count. Writing the sorted
    rows is a job of its own, and so is counting them unless `rows` bounds their number.
    """
    columns = [*df.columns, name, *([total] if total else [])]
    if partition_by:
        return with_running_total(df, partition_by, order_by, F.lit(1).cast("long"), name, total or "__total", buckets, rows).select(
            *columns)
    marked = with_sort_bucket(df, order_by, "__b", buckets, rows)
    ranges = Window.partitionBy(F.lit(0)).orderBy("__ob")
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = marked.groupBy(F.col("__b").alias("__ob")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__ob", (F.sum("__n").over(ranges) - F.col("__n")).alias("__before"), F.sum("__n").over(every).alias("__whole"))
    out = marked.join(F.broadcast(sizes), F.col("__b") == F.col("__ob"))
    return out.withColumns({name: F.col("__before") + F.col("__at") + 1, **({total: F.col("__whole")} if total else {})}).select(
        *columns)


def average_ranks(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """For each listed column and each of its values: the mean rank of the rows holding it, and the row count.

    Rows with one value are counted before anything is sorted, so ties cost nothing. Output: metric, value,
    mean_rank, rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.metric", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bound = None if buckets else len(columns) * df.count()
    placed = with_running_total(counts, ["metric"], [("value", True)], F.col("n"), "upto", "rows", buckets, bound)
    return placed.select("metric", "value", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("mean_rank"), "rows")
