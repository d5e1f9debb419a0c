"""Exact k nearest rows without comparing all pairs.

Donors are put into cells between quantile cuts of each coordinate, and cells into coarser ones. Every cell carries the
number of donors in it and the box they fill. The cells around a query give a first limit, which bounds the cell codes it
begins with. From there it descends to the finest cells: the boxes give the least and the largest distance to anything in
a cell, the cells that surely hold k donors lower the limit, and cells that begin beyond it are dropped. Only the donors of
the cells left at the end are measured. No join is on the group alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .columns import bind_value

STEP_BITS = 2
MAX_CUT_BITS = 8
# Cells of one level a query begins with, unless the coarsest level has more: two for each coordinate at most.
FRONTIER = 64
# Distances are compared after rounding, so that equal ones computed in another order stay equal.
DISTANCE_DIGITS = 9


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = None
    for a, b in zip(left, right):
        part = (a - b) * (a - b)
        total = part if total is None else total + part
    return total


def _cut_table(cuts: Column, buckets: int) -> Column:
    """The cuts (`fine`), every stride-th of them (`coarse`), and those standing at two places or more (`heavy`)."""
    stride = max(2, math.isqrt(buckets))
    return bind_value(cuts, lambda c: bind_value(F.array_distinct(c), lambda fine: F.struct(
        fine.alias("fine"),
        F.filter(fine, lambda _, i: i % stride == 0).alias("coarse"),
        F.array_distinct(F.filter(c, lambda v, i: (i > 0) & (v == F.get(c, F.greatest(i - 1, F.lit(0)))))).alias("heavy"),
        F.lit(stride).alias("stride"),
    )))


def cut_points(value: Column, buckets: int) -> Column:
    """Aggregate: sorted distinct cut values of a double column, from a mergeable sketch of bounded size.

    The result holds all cuts (`fine`), every stride-th of them (`coarse`), and the values standing at two cuts or more
    (`heavy`): those that fill whole buckets of their own.
    """
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    sketch = F.percentile_approx(value, shares, F.lit(10 * buckets))
    return _cut_table(F.array_sort(F.coalesce(sketch, F.array())), buckets)


def locate(value: Column, cuts: Column) -> Column:
    """Bucket number: 2i between cut i-1 and cut i, 2i+1 on cut i, -1 for NULL.

    The coarse cuts are probed first and then one stretch of the fine ones, so a lookup costs about two square
    roots of the number of cuts.
    """
    skipped = F.greatest(F.size(F.filter(cuts["coarse"], lambda c: c < value)) - 1, F.lit(0)) * cuts["stride"]
    below = bind_value(skipped, lambda s: s + F.size(F.filter(F.slice(cuts["fine"], s + 1, cuts["stride"]),
                                                       lambda c: c < value)))
    code = bind_value(below, lambda b: 2 * b + F.coalesce(F.get(cuts["fine"], b) == value, F.lit(False)).cast("int"))
    return F.when(value.isNull(), F.lit(-1)).otherwise(code)


def _cut_bits(df: DataFrame) -> int:
    return max(4, min(MAX_CUT_BITS, (df.count() // 250_000).bit_length()))


def _box_distances(places: Sequence[str], at: Sequence[str]) -> tuple[Column, Column]:
    """Least and largest squared distance from a query to the donors of a cell."""
    least = most = F.lit(0.0)
    for p, q in zip(places, at):
        low, high, x = F.col(f"__lo_{p}"), F.col(f"__hi_{p}"), F.col(q)
        outside = F.greatest(low - x, x - high, F.lit(0.0))
        across = F.greatest(F.abs(x - low), F.abs(x - high))
        least, most = least + outside * outside, most + across * across
    return least, most


def _starts(
    asked: DataFrame, tree: DataFrame, cuts: Column, group: Sequence[str], places: Sequence[str], at: Sequence[str],
    cells: Sequence[str], shifts: Sequence[int], k: int,
) -> DataFrame:
    """The cells every query begins with: at most FRONTIER of one level, which cover all that can be among the nearest.

    The cells around the query itself that hold k donors give a first limit. It bounds the codes in every coordinate, and
    the finest level with few enough codes in that box is taken. All joins are equalities on whole cell codes.
    """
    fields = list(zip(places, at, cells))
    located = asked.withColumn("__cuts", cuts).withColumns(
        {c: locate(F.col(q), F.col("__cuts")[p]) for p, q, c in fields}).drop("__cuts")
    homes = located.withColumn("__level", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumns(
        {c: F.expr(f"shiftright({c}, __level)") for c in cells})
    near = homes.join(tree, [*group, "__level", *cells], "left")
    limit = F.min(F.when(F.col("__n") >= k, _box_distances(places, at)[1]))
    limited = near.groupBy(*group, "query_id", *at).agg(F.coalesce(limit * (1 + 1e-9) + 1e-7, F.lit(float("inf"))).alias("__limit"))
    ends = limited.withColumn("__cuts", cuts)
    for p, q, c in fields:
        for side, x in (("from", F.col(q) - F.sqrt("__limit")), ("to", F.col(q) + F.sqrt("__limit"))):
            ends = ends.withColumn(f"{c}_{side}", locate(x, F.col("__cuts")[p]))
    level = F.lit(shifts[0])
    for s in shifts[1:]:
        many = " * ".join(f"CAST(shiftright({c}_to, {s}) - shiftright({c}_from, {s}) + 1 AS DOUBLE)" for c in cells)
        level = F.when(F.expr(many) <= FRONTIER, F.lit(s)).otherwise(level)
    ends = ends.withColumn("__level", level)
    for c in cells:
        ends = ends.withColumn(c, F.expr(f"explode(sequence(shiftright({c}_from, __level), shiftright({c}_to, __level)))"))
    return ends.select(*group, "query_id", *at, "__limit", "__level", *cells)


def nearest_rows(
    queries: DataFrame, donors: DataFrame, query_id: str, donor_id: str, places: Sequence[str], k: int,
    payload: Sequence[str] = (), group: Sequence[str] = (), cut_bits: int | None = None,
) -> DataFrame:
    """The k donors nearest to each query within its group, by Euclidean distance, equal distances by donor id.

    `places` are complete numeric coordinates of both frames; group columns are never NULL. Output: the group columns,
    query_id, donor_id, distance2 (squared), rank, and the payload columns of the donor.
    """
    places = list(places)
    if not group:
        one = {"__all": F.lit(1)}
        return nearest_rows(queries.withColumns(one), donors.withColumns(one), query_id, donor_id, places, k, payload,
                            ["__all"], cut_bits).drop("__all")
    group = list(group)
    bits = cut_bits or _cut_bits(donors)
    cells = [f"__c{i}" for i in range(len(places))]
    # Of donors at one and the same point only the first k can be among anybody's nearest.
    here = Window.partitionBy(*group, *places).orderBy(donor_id)
    kept = (
        donors.select(*group, donor_id, *places, *payload)
        .withColumn("__r", F.row_number().over(here)).where(F.col("__r") <= k).drop("__r")
    )
    kept = pinned(kept)
    cuts = kept.agg(
        F.struct(*[cut_points(F.col(p), 2 ** bits).alias(p) for p in places]).alias("s")).scalar()
    placed = kept.withColumn("__cuts", cuts).withColumns(
        {c: locate(F.col(p), F.col("__cuts")[p]) for c, p in zip(cells, places)}).drop("__cuts")
    placed = pinned(placed)

    finest = pinned(placed.groupBy(*group, *cells).agg(
        F.count(F.lit(1)).alias("__n"), *[F.min(p).alias(f"__lo_{p}") for p in places],
        *[F.max(p).alias(f"__hi_{p}") for p in places]))

    # Codes run to 2 * cuts, one bit more than the cuts.
    shifts = list(range(0, bits + 1, STEP_BITS))[::-1]

    def boxes(shift: int) -> DataFrame:
        up = {c: F.shiftright(c, shift) for c in cells} if shift else {}
        return finest.withColumns(up).groupBy(*group, *cells).agg(
            F.sum("__n").alias("__n"), *[F.min(f"__lo_{p}").alias(f"__lo_{p}") for p in places],
            *[F.max(f"__hi_{p}").alias(f"__hi_{p}") for p in places]).withColumn("__level", F.lit(shift))

    tree = pinned(reduce(DataFrame.unionByName, map(boxes, shifts)))
    at = [f"__q{i}" for i in range(len(places))]
    asked = queries.select(*group, F.col(query_id).alias("query_id"),
                           *[F.col(p).cast("double").alias(q) for p, q in zip(places, at)])
    starts = pinned(_starts(asked, tree, cuts, group, places, at, cells, shifts, k))
    parents = [f"__p{i}" for i in range(len(cells))]
    own = Window.partitionBy(*group, "query_id")
    found: DataFrame | None = None
    for shift in shifts:
        level = tree.where(F.col("__level") == shift).drop("__level")
        pairs = starts.where(F.col("__level") == shift).drop("__level").join(level, [*group, *cells])
        if found is not None:
            below = level.withColumns({p: F.shiftright(c, STEP_BITS) for p, c in zip(parents, cells)})
            pairs = pairs.unionByName(found.join(below, [*group, *parents]).drop(*parents))
        least, most = _box_distances(places, at)
        pairs = pairs.withColumns({"__least": least, "__most": most})
        sure = F.sum("__n").over(own.orderBy("__most").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        pairs = pairs.withColumn("__sure", sure)
        limit = F.coalesce(F.min(F.when(F.col("__sure") >= k, F.col("__most"))).over(own), F.lit(float("inf")))
        limit = F.least(limit * (1 + 1e-9) + 1e-7, "__limit")
        pairs = pairs.withColumn("__limit", limit).where(F.col("__least") <= F.col("__limit"))
        found = pairs.select(*group, "query_id", *at, "__limit", *[F.col(c).alias(p) for c, p in zip(cells, parents)])
    near = found.join(
        placed.withColumnsRenamed(dict(zip(cells, parents))).withColumnRenamed(donor_id, "donor_id"),
        [*group, *parents])
    distance = squared_distance([F.col(q) for q in at], [F.col(p).cast("double") for p in places])
    near = near.withColumn("distance2", F.round(distance, DISTANCE_DIGITS))
    order = own.orderBy("distance2", "donor_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        *group, "query_id", "donor_id", "distance2", "rank", *payload)
