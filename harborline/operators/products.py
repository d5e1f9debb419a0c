"""Product dimensions: imputation ladders, nearest-neighbour imputation, caps and the report."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.neighbours import nearest_rows
from ..functions.quantiles import exact_medians, exact_quantiles, scalar_struct
from ..session import pinned
from ..sources.schemas import DIMENSIONS

CATEGORY = "product_category_name"
CATEGORY_NEIGHBOURS = 5
GLOBAL_NEIGHBOURS = 10


def impute_by_category(
    products: DataFrame, columns: Sequence[str] = DIMENSIONS, buckets: int | None = None
) -> DataFrame:
    """Missing dimensions become the category's median, else the overall one."""
    columns = [c for c in columns if c in products.columns]
    by_category = exact_medians(
        products.where(F.col(CATEGORY).isNotNull()), {c: f"__c_{c}" for c in columns}, [CATEGORY], buckets)
    filled = products.join(by_category, CATEGORY, "left")
    known = filled.withColumns({c: F.coalesce(F.col(c), F.col(f"__c_{c}")) for c in columns}).select(*products.columns)
    overall = scalar_struct(exact_medians(known, {c: c for c in columns}, (), buckets))
    return known.withColumn("__all", overall).withColumns(
        {c: F.coalesce(F.col(c), F.col("__all")[c]) for c in columns}).drop("__all")


def cap_dimensions(
    products: DataFrame, columns: Sequence[str] = DIMENSIONS, share: float = 0.995, buckets: int | None = None
) -> DataFrame:
    """Dimensions held between 0 and their own upper quantile."""
    columns = [c for c in columns if c in products.columns]
    caps = scalar_struct(exact_quantiles(products, {c: {c: share} for c in columns}, (), buckets))
    return products.withColumn("__cap", caps).withColumns(
        {c: clip(c, 0.0, F.col("__cap")[c]) for c in columns}).drop("__cap")


def impute_category_by_vote(
    products: DataFrame, columns: Sequence[str] = DIMENSIONS, k: int = 5
) -> DataFrame:
    """A missing category becomes the most frequent one among the k nearest products, the first by name on a tie.

    Distance is Euclidean over z-scored dimensions, a missing dimension counting as the mean. Equal distances are
    taken in product order. Adds nothing else.
    """
    columns = [c for c in columns if c in products.columns]
    base = pinned(products)
    stats = base.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).alias("s")).scalar()
    scored = base.withColumn("__s", stats).select(
        "product_id", CATEGORY,
        *[F.coalesce(F.try_divide(F.col(c) - F.col("__s")[f"m_{c}"], F.col("__s")[f"s_{c}"]), F.lit(0.0)).alias(f"z{i}")
          for i, c in enumerate(columns)])
    places = [f"z{i}" for i in range(len(columns))]
    fixed = pinned(scored)
    missing = fixed.where(F.col(CATEGORY).isNull()).select("product_id", *places)
    known = fixed.where(F.col(CATEGORY).isNotNull())
    near = nearest_rows(missing, known, "product_id", "product_id", places, k, payload=[CATEGORY])
    votes = near.groupBy("query_id", CATEGORY).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("query_id").orderBy(F.desc("n"), CATEGORY)
    chosen = votes.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(
        F.col("query_id").alias("product_id"), F.col(CATEGORY).alias("__vote"))
    return base.join(chosen, "product_id", "left").withColumn(CATEGORY, F.coalesce(CATEGORY, "__vote")).select(
        *products.columns)


def _patterns(df: DataFrame, columns: Sequence[str]) -> list[tuple[bool, ...]]:
    """Which combinations of known dimensions occur: at most sixteen."""
    flags = df.select(*[F.col(c).isNotNull().alias(c) for c in columns]).distinct()
    return [tuple(bool(row[c]) for c in columns) for row in flags.collect()]


def _neighbour_means(
    base: DataFrame, columns: Sequence[str], group: str | None, k: int, limit: str | None = None
) -> DataFrame:
    """(product_id, dim, value): the mean of a missing dimension over the nearest products that have it.

    Distance runs over the dimensions both products have, scaled up to all of them. Each combination of missing
    dimension, dimensions known to the asker and dimensions shared is a group of its own, in which every coordinate is
    known; the nearest of all groups are then merged. `limit` names a column with a smaller k for some rows.
    """
    number = len(columns)
    by = [group] if group else []
    asking: dict[str, list[tuple[int, str]]] = {}
    giving: dict[str, list[tuple[int, str, str]]] = {}
    masks = ["".join("1" if known else "0" for known in pattern) for pattern in _patterns(base, columns)]
    for target in range(number):
        givers = [m for m in masks if m[target] == "1"]
        for asker in (m for m in masks if m[target] == "0" and "1" in m):
            for giver in givers:
                shared = "".join("1" if a == b == "1" else "0" for a, b in zip(asker, giver))
                if "1" in shared:
                    giving.setdefault(giver, []).append((target, asker, shared))
                    if (target, shared) not in asking.setdefault(asker, []):
                        asking[asker].append((target, shared))
    if not giving:
        kind = base.schema["product_id"].dataType.simpleString()
        return base.sparkSession.createDataFrame([], f"product_id {kind}, dim int, value double")

    mask = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in columns])

    def spread(cases: dict[str, list[tuple[int, str, str]]]) -> DataFrame:
        """A row per product and case it belongs to, from one scan; there are as many cases as combinations."""
        of_mask = F.coalesce(*[F.when(mask == m, F.array(*[
            F.struct(F.lit(t).alias("dim"), F.lit(f"{t}|{a}|{h}").alias("case"), F.lit(h).alias("shared")) for t, a, h in found
        ])) for m, found in cases.items()])
        rows = base.select(*base.columns, F.inline(of_mask))
        places = [F.when(F.substring("shared", i + 1, 1) == "1", F.col(c)).otherwise(0.0).alias(f"x{i}")
                  for i, c in enumerate(columns)]
        scale = F.lit(float(number)) / F.length(F.replace("shared", F.lit("0"), F.lit("")))
        return rows.select(*by, "case", "product_id", "dim", F.get(F.array(*columns), F.col("dim")).alias("value"),
                           scale.alias("scale"), *places)

    places = [f"x{i}" for i in range(number)]
    asked = spread({m: [(t, m, shared) for t, shared in found] for m, found in asking.items()}).withColumn(
        "asker", F.concat_ws("|", "dim", "product_id"))
    near = nearest_rows(asked, spread(giving), "asker", "product_id", places, k, ["value", "scale"], [*by, "case"])
    apart = F.round(F.col("distance2") * F.col("scale"), 9)
    over_all = Window.partitionBy("query_id").orderBy(apart, "donor_id")
    ranked = near.withColumn("__r", F.row_number().over(over_all))
    parts = F.split("query_id", r"\|", 2)
    ranked = ranked.select(
        parts[1].cast(base.schema["product_id"].dataType).alias("product_id"), parts[0].cast("int").alias("dim"),
        "value", "__r")
    if limit:
        allowed = base.select("product_id", F.col(limit).alias("__k"))
        ranked = ranked.join(allowed, "product_id").where(F.col("__r") <= F.col("__k"))
    else:
        ranked = ranked.where(F.col("__r") <= k)
    return ranked.groupBy("product_id", "dim").agg(F.avg("value").alias("value"))


def _with_filled(base: DataFrame, means: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = means.groupBy("product_id").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("value"))).alias(f"__n_{c}") for i, c in enumerate(columns)])
    joined = base.join(wide, "product_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__n_{c}")) for c in columns}).select(*base.columns)


def impute_by_neighbours(products: DataFrame, columns: Sequence[str] = DIMENSIONS, buckets: int | None = None) -> DataFrame:
    """Missing dimensions from similar products: first within the category, then overall.

    A category of at least five products uses its five nearest (four when it has five), and its mean for a product that
    shares no dimension with any other; a smaller one uses its median. What is still missing takes the ten nearest of
    all products, then the overall mean.
    """
    columns = [c for c in columns if c in products.columns]
    base = pinned(products)
    sizes = base.where(F.col(CATEGORY).isNotNull()).groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("__size"), *[F.avg(c).alias(f"__mean_{c}") for c in columns])
    small = exact_medians(base.where(F.col(CATEGORY).isNotNull()), {c: f"__med_{c}" for c in columns}, [CATEGORY], buckets)
    known = pinned(base.join(sizes, CATEGORY, "left").withColumn(
        "__k", F.least(F.lit(CATEGORY_NEIGHBOURS), F.col("__size") - 1)))
    large = known.where(F.col("__size") >= 5)
    means = _neighbour_means(large, columns, CATEGORY, CATEGORY_NEIGHBOURS, "__k")
    filled = _with_filled(known, means, columns).join(small, CATEGORY, "left")
    first = filled.withColumns({
        c: F.coalesce(F.col(c), F.when(F.col("__size") >= 5, F.col(f"__mean_{c}")).otherwise(F.col(f"__med_{c}")))
        for c in columns
    }).select(*products.columns)
    second = pinned(first)
    means = _neighbour_means(second, columns, None, GLOBAL_NEIGHBOURS)
    overall = second.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    done = _with_filled(second, means, columns).withColumn("__all", overall)
    return done.withColumns({c: F.coalesce(F.col(c), F.col("__all")[c]) for c in columns}).drop("__all")


def prepare_products(products: DataFrame, columns: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Category vote, neighbour imputation and caps in the order the analyses use."""
    return cap_dimensions(impute_by_neighbours(impute_category_by_vote(products, columns), columns), columns)
