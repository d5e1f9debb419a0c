"""Exact interpolated quantiles of whole columns or of groups of any size.

Equal values are counted before the first sort. The counts are summed up along the sorted values range by range, and
the rows a wanted rank falls on are picked out. Any number of columns, groupings and frames share one such pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned_counted
from .ranking import with_running_total

Asked = Mapping[str, Mapping[str, float]]
# Rows of a key that one task sorts.
SORTED_ROWS = 65_536


def _known_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    def known(c: str) -> str:
        return f"CASE WHEN abs(CAST(`{c}` AS DOUBLE)) < double('Infinity') THEN CAST(`{c}` AS DOUBLE) END"

    pairs = ", ".join(f"named_struct('metric', {i}, 'value', {known(c)})" for i, c in enumerate(columns))
    return df.select(*keys, F.expr(f"inline(array({pairs}))")).where("value IS NOT NULL")


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per key, column (by its number from 0) and value as (keys, metric, value, n); NULL, NaN and infinite values
    are left out."""
    return _known_values(df, columns, keys).groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


class Level(NamedTuple):
    """Value counts under some keys, and the quantiles asked of their columns in order: {column: {output name: share}}."""

    counts: DataFrame
    asked: Asked
    keys: Sequence[str] = ()


def quantiles_of_levels(levels: Sequence[Level], buckets: int | None = None, rows: int | None = None) -> list[DataFrame]:
    """The quantiles of several sets of value counts from one sort of them all.

    `rows` bounds the number of all counts, if known. Each result has one row per key of its level, or one row.
    """
    stacked = None
    for i, level in enumerate(levels):
        own = level.counts.select(
            F.lit(i).alias("level"), *[F.col(k).alias(f"k{i}_{j}") for j, k in enumerate(level.keys)], "metric", "value", "n")
        stacked = own if stacked is None else stacked.unionByName(own, allowMissingColumns=True)
    keys = [c for c in stacked.columns if c not in ("metric", "value", "n")]
    hits = [f"level = {i} AND ({_hit(level.asked, 'before <= {high} AND upto > {low}')})" for i, level in enumerate(levels)]
    summed = with_running_total(
        stacked, [*keys, "metric"], [("value", True)], F.col("n"), "upto", "total", buckets, rows, f"({' OR '.join(hits)})")
    ranked = summed.withColumn("first", F.expr("upto - n"))
    return [_picked(ranked.where(f"level = {i}"), level, i) for i, level in enumerate(levels)]


def _ends(share: float) -> dict[str, str]:
    """The two ranks, from 0, that a quantile lies between."""
    at = f"(total - 1) * {float(share)!r}D"
    return {"low": f"floor({at})", "high": f"ceil({at})", "at": at}


def _hit(asked: Asked, test: str) -> str:
    """Condition that a row or range holds one of the ranks asked of its metric."""
    return " OR ".join(f"metric = {j} AND {test.format(**_ends(share))}"
                       for j, shares in enumerate(asked.values()) for share in shares.values())


def _picked(ranked: DataFrame, level: Level, i: int) -> DataFrame:
    outputs = []
    for j, shares in enumerate(level.asked.values()):
        for label, share in shares.items():
            end = _ends(share)
            below, above = (f"max(CASE WHEN metric = {j} AND first <= {end[k]} AND upto > {end[k]} THEN value END)"
                            for k in ("low", "high"))
            part = f"max(CASE WHEN metric = {j} THEN {end['at']} - {end['low']} END)"
            outputs.append(F.expr(f"{below} + ({above} - {below}) * {part}").alias(label))
    names = [F.col(f"k{i}_{j}").alias(k) for j, k in enumerate(level.keys)]
    holds = "(first <= {low} AND upto > {low} OR first <= {high} AND upto > {high})"
    return ranked.where(_hit(level.asked, holds)).groupBy(*names).agg(*outputs)


def exact_quantiles(
    df: DataFrame, columns: Asked, keys: Sequence[str] = (), buckets: int | None = None, rows: int | None = None
) -> DataFrame:
    """One row per key with the asked quantiles, linearly interpolated between neighbouring ranks.

    `columns` maps a numeric column to {output name: share}. NULL and NaN values are left out. Without keys the
    result has one row. The sorted value counts are written, which is a job of its own; `rows` bounds the rows of the
    frame, which are counted otherwise.
    """
    bound = None if buckets else len(columns) * (df.count() if rows is None else rows)
    return quantiles_of_levels([Level(value_counts(df, list(columns), keys), columns, keys)], buckets, bound)[0]


def exact_medians(
    df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = (), buckets: int | None = None, rows: int | None = None
) -> DataFrame:
    """`exact_quantiles` at one half; `columns` maps a column to its output name."""
    return exact_quantiles(df, {c: {out: 0.5} for c, out in columns.items()}, keys, buckets, rows)


def medians_of_sized_keys(
    df: DataFrame, columns: Mapping[str, str], key: str, sizes: DataFrame, buckets: int | None = None, most: int = SORTED_ROWS,
) -> DataFrame:
    """`exact_medians` of the keys that are not NULL, with `sizes` (key and its rows as `n`) known.

    The values of a key of up to `most` rows are dealt out and sorted once, in one task; those of longer keys range by range.
    """
    long, found = pinned_counted(sizes.where(F.col("n") > most).where(F.col(key).isNotNull()))
    # At most one key for every `most` rows.
    short = df.where(F.col(key).isNotNull())
    if found:
        short = short.join(F.broadcast(long.select(key)), key, "left_anti")
    w = Window.partitionBy("k0_0", "metric").orderBy("value")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = _known_values(short, list(columns), [key]).withColumnRenamed(key, "k0_0").withColumns(
        {"upto": F.row_number().over(w), "total": F.count(F.lit(1)).over(every)}).withColumn("first", F.col("upto") - 1)
    asked = {c: {out: 0.5} for c, out in columns.items()}
    medians = _picked(ranked, Level(ranked, asked, [key]), 0)
    if found:
        rows = long.agg(F.sum("n")).first()[0]
        medians = medians.unionByName(
            exact_medians(df.join(F.broadcast(long.select(key)), key, "left_semi"), columns, [key], buckets, rows))
    return medians


def counted_median(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median of a column with few possible values (whole days): values are counted first, so the state of the
    final aggregate holds one entry per possible value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(0.5), F.col("__n")).alias(name))


def scalar_struct(df: DataFrame) -> Column:
    """A frame of at most one row as a struct of literals, NULLs when the frame is empty.

    The row is computed here, once: a subquery would be run again by every plan that the column goes into.
    """
    row = df.first()
    return F.struct(*[F.lit(row and row[f.name]).cast(f.dataType).alias(f.name) for f in df.schema])
