"""Rolling statistics and anomaly repair over ordered lines.

A key may hold any share of the rows. Keys of up to a chunk's length are dealt out whole and sorted once. Only rows of longer
keys get their exact position along the key; these keys are cut into chunks of fixed length, and each chunk carries copies of
the few rows beyond its edges that its windows need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.quantiles import exact_medians
from ..functions.ranking import with_row_number
from ..session import pinned, pinned_counted
from .series import array_median

CHUNK_ROWS = 65_536


def _chunked(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], halo: int, chunk_rows: int, buckets: int | None
) -> DataFrame:
    """Adds __pos (from 0), __chunk, and __own: whether the row belongs to the chunk or is an edge copy."""
    numbered = with_row_number(df, [(c, True) for c in order_by], "__rn", keys, "__total", buckets)
    placed = numbered.withColumn("__pos", F.col("__rn") - 1).withColumn("__home", F.floor(F.col("__pos") / chunk_rows))
    offset = F.col("__pos") % chunk_rows
    before = F.when((offset < halo) & (F.col("__home") > 0), F.col("__home") - 1)
    after = F.when(
        (offset >= chunk_rows - halo) & ((F.col("__home") + 1) * chunk_rows < F.col("__total")), F.col("__home") + 1)
    spread = placed.withColumn("__chunk", F.explode(F.array_compact(F.array(F.col("__home"), before, after))))
    return spread.withColumn("__own", F.col("__chunk") == F.col("__home")).drop("__rn", "__home")


def _key_statistics(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias("__key_mean"), F.stddev_samp(column).alias("__key_std"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return left.join(renamed, same, how).drop(*[f"__j{i}" for i in range(len(keys))])


def _along_keys(
    df: DataFrame, column: str, keys: Sequence[str], order_by: Sequence[str], halo: int, chunk_rows: int,
    buckets: int | None, local: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """`local` of the rows with their key's statistics and a window along the key, without the edge copies."""
    def chunks(rows: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
        chunked = _chunked(rows, keys, order_by, halo, chunk_rows, buckets)
        with_stats = _null_safe_join(chunked, spread(_key_statistics(rows, column, keys)), keys)
        return local(with_stats, Window.partitionBy(*keys, "__chunk").orderBy("__pos")).where("__own").drop(
            "__pos", "__chunk", "__own", "__total")

    if not keys:
        return chunks(df, lambda stats: stats)
    # At most one key for every `chunk_rows` rows.
    long, found = pinned_counted(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk_rows).select(*keys))
    short = _null_safe_join(df, F.broadcast(long), keys, "left_anti") if found else df
    w = Window.partitionBy(*keys).orderBy(*order_by)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = local(short.withColumns(
        {"__key_mean": F.avg(column).over(every), "__key_std": F.stddev_samp(column).over(every)}), w)
    if found:
        out = out.unionByName(chunks(_null_safe_join(df, F.broadcast(long), keys, "left_semi"), F.broadcast))
    return out


def _with_rolling(df: DataFrame, column: str, window, width: int, exclude_center: bool) -> DataFrame:
    """Adds __roll_mean and __roll_std of a full centred window; NULL at the ends of a key."""
    half = width // 2
    span = window.rowsBetween(-half, half)
    full = F.count(column).over(span) == width
    if not exclude_center:
        return df.withColumns({"__roll_mean": F.when(full, F.avg(column).over(span)),
                               "__roll_std": F.when(full, F.stddev_samp(column).over(span))})
    near = {f"__at{f.__name__}{k}": f(column, k).over(window) for f in (F.lag, F.lead) for k in range(1, half + 1)}
    out = df.withColumns({**near, "__full": full})
    values = [F.col(c) for c in near]
    out = out.withColumn("__roll_mean", F.when(F.col("__full"), sum(values[1:], values[0]) / len(values)))
    squares = [(v - F.col("__roll_mean")) * (v - F.col("__roll_mean")) for v in values]
    spread = F.sqrt(sum(squares[1:], squares[0]) / (len(values) - 1))
    return out.withColumn("__roll_std", spread).drop(*near, "__full")


def rolling_statistics(
    df: DataFrame, column: str, partition_by: Sequence[str], order_by: Sequence[str], window_size: int = 5,
    chunk_rows: int = CHUNK_ROWS, buckets: int | None = None,
) -> DataFrame:
    """Centred rolling mean and sample deviation; the key's own where the window is not full, and the key's deviation
    where the rolling one is 0. Adds rolling_mean and rolling_std."""
    keys = list(partition_by)
    out = _along_keys(df, column, keys, order_by, window_size // 2, chunk_rows, buckets,
                      lambda rows, w: _with_rolling(rows, column, w, window_size, False))
    return out.select(
        *df.columns, F.coalesce("__roll_mean", "__key_mean").alias("rolling_mean"),
        F.coalesce(F.nullif("__roll_std", F.lit(0.0)), "__key_std").alias("rolling_std"))


def repair_anomalies(
    df: DataFrame, column: str, partition_by: Sequence[str], order_by: Sequence[str], window_size: int = 5,
    z_threshold: float = 3.0, exclude_center: bool = True, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None,
) -> DataFrame:
    """Replace values far from their neighbourhood by the median of normal values within `window_size` rows, else by the
    key's median. Adds `is_anomaly`.

    A value's score uses the mean and deviation of the centred window, without the value itself unless
    `exclude_center` is off; the key's own statistics stand in at the ends and for a deviation of 0.
    """
    keys = list(partition_by)
    half = window_size // 2

    def scored(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rolled = _with_rolling(rows, column, w, window_size, exclude_center).withColumns({
            "__mean": F.coalesce("__roll_mean", "__key_mean"),
            "__std": F.coalesce(F.nullif("__roll_std", F.lit(0.0)), "__key_std"),
        })
        z = F.try_divide(F.col(column) - F.col("__mean"), F.col("__std"))
        flagged = rolled.withColumn("__odd", F.coalesce(F.abs(z) > z_threshold, F.lit(False)))
        normal = F.when(~F.col("__odd"), F.col(column))
        # Offsets are cheap for every row; the array is built for anomalies only, which are not their own neighbours.
        offsets = {f"__{f.__name__}{k}": f(normal, k).over(w) for f in (F.lag, F.lead) for k in range(1, window_size + 1)}
        return flagged.withColumns(offsets).withColumn("__near", F.when(
            F.col("__odd"), array_median(F.array_compact(F.array(*offsets))))).drop(*offsets)

    near = _along_keys(df, column, keys, order_by, window_size + half, chunk_rows, buckets, scored)
    near, rows = pinned_counted(near.select(*df.columns, "__odd", "__near"))
    # Few keys have an anomaly without a normal value around; only their medians are taken.
    # Written down, as their medians, so that the sizes are known before the rows would be dealt out for a join.
    asked = near
    if keys:
        lone = pinned(near.where(F.col("__odd") & F.col("__near").isNull()).select(*keys).distinct())
        asked = _null_safe_join(near, lone, keys, "left_semi")
    medians = pinned(exact_medians(asked, {column: "__key_median"}, keys, buckets, rows))
    out = _null_safe_join(near, medians, keys)
    value = F.when(F.col("__odd"), F.coalesce("__near", "__key_median")).otherwise(F.col(column))
    return out.withColumn(column, value).select(*df.columns, F.col("__odd").alias("is_anomaly"))
