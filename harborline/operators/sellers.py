"""Seller metrics, scores, tiers and the tables drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, half_up, one_row
from ..functions.quantiles import exact_medians, exact_quantiles, scalar_struct
from ..functions.ranking import average_ranks, with_row_number
from ..session import pinned, pinned_counted

# Tier codes, 0 is the best.
TIER_NAMES = {0: "High", 1: "Medium", 2: "Low"}
BASE_FEATURES = ("log_order_count", "log_total_sales", "avg_processing_time", "avg_delivery_days", "avg_order_value")


def _tier_frame(df: DataFrame) -> DataFrame:
    """Three rows, one per tier."""
    tiers = df.sparkSession.range(3).select(F.col("id").cast("int").alias("prediction"))
    return tiers.withColumn("performance", tier_name(F.col("prediction")))


def tier_name(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(name)) for c, name in TIER_NAMES.items()])


def seller_metrics(lines: DataFrame) -> DataFrame:
    """Lines, times, sales, shipping, order value, shipping share and on-time rate (in percent, 50 where unknown)."""
    sales, shipping, n = F.sum("price"), F.sum("shipping_charges"), F.count("order_id")
    return lines.groupBy("seller_id").agg(
        n.alias("order_count"),
        F.avg("processing_time").alias("avg_processing_time"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        sales.alias("total_sales"),
        shipping.alias("shipping_costs"),
        F.try_divide(sales, n).alias("avg_order_value"),
        (F.try_divide(shipping, sales) * 100).alias("shipping_ratio"),
        (F.coalesce(F.avg(F.col("on_time_delivery").cast("double")), F.lit(0.5)) * 100).alias("on_time_delivery_rate"),
    )


def winsorize(
    df: DataFrame, column: str, low: float | None = 0.0, high: float | None = 0.99, buckets: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Hold a column between two of its own quantiles; a side given as None is left open."""
    asked = {k: v for k, v in (("lo", low), ("hi", high)) if v is not None}
    caps = scalar_struct(exact_quantiles(df, {column: asked}, (), buckets, rows))
    out = df.withColumn("__caps", caps)
    held = clip(column, F.col("__caps")["lo"] if "lo" in asked else None,
                F.col("__caps")["hi"] if "hi" in asked else None)
    return out.withColumn(column, held).drop("__caps")


def rescale(
    df: DataFrame, column: str, low: float = 0.0, high: float = 100.0, output: str | None = None,
    constant: float | None = None,
) -> DataFrame:
    """Min-max scaling into [low, high]. A column with one value keeps it, or becomes `constant` when given."""
    name = output or f"normalized_{column}"
    ends = one_row(df, F.min(finite(column)).alias("lo"), F.max(finite(column)).alias("hi"))
    out = df.withColumn("__e", ends)
    spread = F.col("__e")["hi"] - F.col("__e")["lo"]
    scaled = F.lit(low) + (F.col(column) - F.col("__e")["lo"]) * F.lit(high - low) / F.nullif(spread, F.lit(0.0))
    flat = F.col(column).cast("double") if constant is None else F.lit(constant)
    value = F.when(spread < 1e-6, flat).otherwise(F.coalesce(scaled, F.lit(low)))
    return out.withColumn(name, value).drop("__e")


def seller_features(sellers: DataFrame, buckets: int | None = None) -> DataFrame:
    """The frame sellers are scored and clustered on: medians for missing numbers, sales capped at the 99th
    percentile, logs of the skewed columns, and the two ratios. The seller frame is written down first, because four
    aggregates read it."""
    numeric = [n for n, t in sellers.dtypes if t in ("int", "bigint", "double", "float") and n != "seller_id"]
    fixed, rows = pinned_counted(sellers)
    medians = scalar_struct(exact_medians(fixed, {c: c for c in numeric}, (), buckets, rows))
    out = fixed.withColumn("__m", medians)
    out = out.withColumns({c: F.coalesce(finite(c), F.col("__m")[c]) for c in numeric}).drop("__m")
    out = winsorize(out, "total_sales", None, 0.99, buckets, rows)
    out = out.withColumns({
        "log_total_sales": F.log1p("total_sales"), "log_order_count": F.log1p("order_count"),
    })
    if "avg_order_value" not in sellers.columns:
        out = _ratio_with_median(out, "avg_order_value", F.try_divide("total_sales", "order_count"), buckets, rows)
    if "on_time_delivery_rate" not in sellers.columns and "on_time_delivery" in sellers.columns:
        out = out.withColumn("on_time_delivery_rate", F.col("on_time_delivery") * 100)
    if "shipping_costs" in sellers.columns:
        ratio = F.try_divide("shipping_costs", "total_sales") * 100
        out = _ratio_with_median(out, "shipping_ratio", ratio, buckets, rows)
    return out


def _ratio_with_median(df: DataFrame, name: str, ratio: Column, buckets: int | None, rows: int) -> DataFrame:
    out = df.withColumn(name, finite(ratio))
    middle = scalar_struct(exact_medians(out, {name: "m"}, (), buckets, rows))
    return out.withColumn(name, F.coalesce(F.col(name), middle["m"]))


def feature_names(features: DataFrame) -> list[str]:
    """The clustering columns of a feature frame."""
    return [*BASE_FEATURES, *[c for c in ("on_time_delivery_rate", "shipping_ratio") if c in features.columns]]


def _with_maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("__max", one_row(df, *[F.max(c).alias(c) for c in columns]))


def _share(column: str) -> Column:
    return F.try_divide(F.col(column).cast("double"), F.col("__max")[column].cast("double"))


def volume_score(sellers: DataFrame, name: str = "seller_score") -> DataFrame:
    """Score of four equal parts: orders, order value, processing time (less is better) and on-time rate."""
    out = _with_maxima(sellers, ["order_count", "avg_order_value", "avg_processing_time"])
    score = (
        _share("order_count") * 25 + _share("avg_order_value") * 25 + (1 - _share("avg_processing_time")) * 25
        + F.col("on_time_delivery_rate") / 100 * 25
    )
    return out.withColumn(name, score).drop("__max")


def balanced_score(features: DataFrame, name: str = "score") -> DataFrame:
    """Score over log volume and times; without an on-time rate the two times count for more."""
    out = _with_maxima(features, ["log_order_count", "log_total_sales", "avg_processing_time", "avg_delivery_days"])
    timed = "on_time_delivery_rate" in features.columns
    weight = 20 if timed else 30
    score = (
        _share("log_order_count") * 15 + _share("log_total_sales") * 25
        + (1 - _share("avg_processing_time")) * weight + (1 - _share("avg_delivery_days")) * weight
    )
    if timed:
        score = score + F.col("on_time_delivery_rate") / 100 * 20
    return out.withColumn(name, score).drop("__max")


def equal_thirds(scored: DataFrame, score: str = "score", buckets: int | None = None) -> DataFrame:
    """Tiers of equal size by score, ties by seller: the lowest third is Low, the next Medium, the rest High.

    The scored frame is written down first, so that a seller's score is the same wherever the plan reads it.
    """
    fixed, rows = pinned_counted(scored)
    ranked = with_row_number(fixed, [(score, True), ("seller_id", True)], "__rn", total="__n", buckets=buckets, rows=rows)
    third = F.floor(F.col("__n") / 3)
    code = F.when(F.col("__rn") <= third, 2).when(F.col("__rn") <= 2 * third, 1).otherwise(0)
    return ranked.withColumn("prediction", code).withColumn("performance", tier_name(F.col("prediction"))).drop(
        "__rn", "__n"
    )


def quantile_thirds(scored: DataFrame, score: str = "seller_score", buckets: int | None = None) -> DataFrame:
    """Tiers by the score's one-third and two-third quantiles, edges belonging to the lower tier."""
    fixed, rows = pinned_counted(scored)
    edges = scalar_struct(exact_quantiles(fixed, {score: {"a": 1 / 3, "b": 2 / 3}}, (), buckets, rows))
    code = F.when(F.col(score) <= F.col("__q")["a"], 2).when(F.col(score) <= F.col("__q")["b"], 1).otherwise(0)
    return fixed.withColumn("__q", edges).withColumn("prediction", code).drop("__q")


def tier_sellers(sellers: DataFrame, buckets: int | None = None) -> DataFrame:
    """Features, balanced score and equal thirds in one go."""
    return equal_thirds(balanced_score(seller_features(sellers, buckets)), buckets=buckets)


def tier_interpretation(tiers: DataFrame) -> DataFrame:
    """Per tier: label, count, share, and mean sales, times, order count and on-time rate."""
    n = tiers.agg(F.count(F.lit(1))).scalar()
    on_time = F.avg("on_time_delivery_rate") if "on_time_delivery_rate" in tiers.columns else F.lit(None).cast("double")
    grouped = tiers.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("count"), F.avg("total_sales").alias("avg_sales"),
        F.avg("avg_processing_time").alias("avg_processing_time"), F.avg("avg_delivery_days").alias("avg_delivery_days"),
        F.avg("order_count").alias("avg_order_count"), on_time.alias("avg_on_time_rate"),
    )
    out = _tier_frame(tiers).join(grouped, "prediction", "left").withColumn("__n", n)
    count = F.coalesce(F.col("count"), F.lit(0).cast("long"))
    return out.withColumns({
        "count": count, "percentage": F.coalesce(F.try_divide(count * 100.0, F.col("__n")), F.lit(0.0)),
    }).drop("__n")


def tier_metrics(sellers: DataFrame) -> DataFrame:
    """Count, total and mean sales and mean times per tier that occurs; missing numbers count as 0."""
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    return sellers.where(F.col("prediction").isNotNull()).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("count"), F.sum(zero("total_sales")).alias("total_sales"),
        F.avg(zero("total_sales")).alias("avg_sales"), F.avg(zero("avg_processing_time")).alias("avg_processing_time"),
        F.avg(zero("avg_delivery_days")).alias("avg_delivery_days"),
    )


def complete_tier_metrics(sellers: DataFrame) -> DataFrame:
    """All three tiers with zeros where empty, mean on-time rate and share of sellers."""
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    grouped = sellers.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("count"), F.avg(zero("avg_processing_time")).alias("avg_processing_time"),
        F.avg(zero("avg_delivery_days")).alias("avg_delivery_days"), F.avg(zero("order_count")).alias("avg_order_count"),
        F.sum(zero("total_sales")).alias("total_sales"), F.avg(zero("on_time_delivery_rate")).alias("avg_on_time_rate"),
    )
    n = sellers.agg(F.count(F.lit(1))).scalar()
    joined = _tier_frame(sellers).join(grouped, "prediction", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in grouped.columns if c != "prediction"}
    share = F.coalesce(F.try_divide(F.col("count") * 100.0, F.col("__n")), F.lit(0.0))
    return joined.withColumns(filled).withColumn("__n", n).withColumn("percentage", share).drop("__n")


def tier_distribution(tiers: DataFrame) -> DataFrame:
    """Sellers per tier with the share rounded to one decimal."""
    n = tiers.agg(F.count(F.lit(1))).scalar()
    grouped = tiers.groupBy("prediction").agg(F.count(F.lit(1)).alias("count")).withColumn("__n", n)
    return grouped.withColumns({
        "performance": tier_name(F.col("prediction")), "percentage": F.round(F.col("count") / F.col("__n") * 100, 1),
    }).drop("__n")


def tier_five_numbers(
    tiers: DataFrame,
    columns: Sequence[str] = ("avg_processing_time", "avg_delivery_days", "order_count", "total_sales"),
    buckets: int | None = None,
) -> DataFrame:
    """Minimum, quartiles and maximum of each metric per tier, as (prediction, metric, five numbers)."""
    shares = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    wide = exact_quantiles(
        tiers, {c: {f"{c}__{s}": p for s, p in shares.items()} for c in columns}, ["prediction"], buckets
    )
    return wide.select("prediction", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}__{s}").alias(s) for s in shares]) for c in columns
    ])))


def benchmark_matrix(tiers: DataFrame) -> DataFrame:
    """Tier means scaled to 0..1 over the tiers; times are turned round first, a metric equal in all tiers is 0.5."""
    pairs = {"avg_order_count": "order_count", "avg_processing_time": "avg_processing_time",
             "avg_delivery_days": "avg_delivery_days", "avg_sales": "total_sales", "avg_order_value": "avg_order_value"}
    if "on_time_delivery_rate" in tiers.columns:
        pairs["avg_on_time_rate"] = "on_time_delivery_rate"
    means = tiers.groupBy("prediction").agg(*[F.avg(c).alias(m) for m, c in pairs.items()])
    ends = one_row(means, *[F.min(m).alias(f"lo_{m}") for m in pairs], *[F.max(m).alias(f"hi_{m}") for m in pairs])
    out = means.withColumn("__e", ends)
    scaled = {}
    for m in pairs:
        low, high = F.col("__e")[f"lo_{m}"], F.col("__e")[f"hi_{m}"]
        gain = high - F.col(m) if m in ("avg_processing_time", "avg_delivery_days") else F.col(m) - low
        scaled[m] = F.when(high > low, gain / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.5))
    return out.withColumns(scaled).withColumn("performance", tier_name(F.col("prediction"))).drop("__e")


def long_comparison(wide: DataFrame, ids: Sequence[str] = ("prediction", "performance")) -> DataFrame:
    """Metric columns as rows (ids, metric, value)."""
    metrics = [c for c in wide.columns if c not in ids]
    numbers = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return numbers.unpivot(list(ids), metrics, "metric", "value")


def clean_sellers(df: DataFrame) -> DataFrame:
    """Unparsable numbers become 0; a tier outside 0..2 becomes 1."""
    numbers = ("total_sales", "avg_processing_time", "avg_delivery_days", "order_count", "on_time_delivery_rate")
    out = df.withColumns({
        c: F.coalesce(finite(F.col(c).try_cast("double")), F.lit(0.0)) for c in numbers if c in df.columns
    })
    code = F.col("prediction").try_cast("int")
    return out.withColumn("prediction", F.when(code.isin(0, 1, 2), code).otherwise(1))


def scatter_frame(sellers: DataFrame, buckets: int | None = None) -> DataFrame:
    """Points of the seller chart: capped sales and processing time scaled to 0..100 (50 when constant), and a bubble
    size held in 20..100. The cap is the 99th percentile of positive sales."""
    cleaned = clean_sellers(sellers)
    caps = exact_quantiles(cleaned.where(F.col("total_sales") > 0), {"total_sales": {"hi": 0.99}}, (), buckets).scalar()
    capped = cleaned.withColumn("total_sales", F.least("total_sales", caps))
    out = rescale(rescale(capped, "total_sales", output="x", constant=50.0), "avg_processing_time", output="y",
                  constant=50.0)
    return out.select(F.col("prediction").alias("cluster"), F.col("seller_id").alias("name"), "x", "y",
                      clip("order_count", 20.0, 100.0).alias("z"))


def star_ratings(sellers: DataFrame) -> DataFrame:
    """One to five stars: 5, 3 or 1 by tier, moved by half the relative gap to the tier's mean processing time and
    on-time rate, each rounded to whole stars. Tier means have at most three rows."""
    cleaned = clean_sellers(sellers)
    means = cleaned.groupBy("prediction").agg(
        F.avg("avg_processing_time").alias("__time"), F.avg("on_time_delivery_rate").alias("__rate")
    )
    out = cleaned.join(F.broadcast(means), "prediction")
    base = F.when(F.col("prediction") == 0, 5).when(F.col("prediction") == 1, 3).otherwise(1)
    faster = (F.col("__time") - F.col("avg_processing_time")) / F.nullif(F.col("__time"), F.lit(0.0)) * 0.5
    better = (F.col("on_time_delivery_rate") - F.col("__rate")) / F.nullif(F.col("__rate"), F.lit(0.0)) * 0.5
    moved = base + F.when(F.col("__time") > 0, half_up(faster)).otherwise(0) + F.when(
        F.col("__rate") > 0, half_up(better)).otherwise(0)
    return out.withColumn("stars", clip(moved, F.lit(1).cast("long"), F.lit(5).cast("long"))).drop("__time", "__rate")


def percentile_ranks(df: DataFrame, columns: dict[str, bool], buckets: int | None = None) -> DataFrame:
    """Percentile ranks 0..100, ties sharing their mean rank. `columns` maps a column to whether more is better;
    the other way round the rank is subtracted from 100. Adds `<column>_percentile`.

    The frame is written down first: the ranks are joined back on the values themselves.
    """
    fixed = pinned(df)
    ranks = average_ranks(fixed, list(columns), buckets)
    out = fixed
    for i, (c, ascending) in enumerate(columns.items()):
        own = ranks.where(F.col("metric") == c).select(
            F.col("value").alias(f"__v{i}"), (F.col("mean_rank") / F.col("rows")).alias(f"__p{i}"))
        out = out.join(own, F.col(c).cast("double") == F.col(f"__v{i}"), "left")
        share = F.col(f"__p{i}") if ascending else 1 - F.col(f"__p{i}")
        out = out.withColumn(f"{c}_percentile", share * 100).drop(f"__v{i}", f"__p{i}")
    return out


def performance_report(tiers: DataFrame, buckets: int | None = None) -> DataFrame:
    """Sellers with a weighted percentile score, best tier first, then by sales."""
    last, more = ("on_time_delivery_rate", True) if "on_time_delivery_rate" in tiers.columns else (
        "avg_delivery_days", False)
    columns = {"total_sales": True, "order_count": True, "avg_processing_time": False, last: more}
    ranked = percentile_ranks(tiers, columns, buckets)
    weights = dict(zip(columns, (0.3, 0.2, 0.25, 0.25)))
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.col(f"{c}_percentile") * w
    kept = ["seller_id", "performance", "performance_score", "order_count", "total_sales", "avg_order_value",
            "avg_processing_time", "avg_delivery_days", "prediction",
            *[c for c in ("on_time_delivery_rate", "shipping_ratio") if c in tiers.columns]]
    out = ranked.withColumn("performance_score", F.round(score, 2))
    return out.select(*kept).orderBy("prediction", F.desc("total_sales"), "seller_id")


# Texts of the improvement recommendations.
_ADVICE = {
    "processing_time": (
        "Optimize order processing workflow to reduce processing time",
        ". Consider implementing automated order processing.",
        "Reduce processing time by at least 25%",
    ),
    "delivery_time": (
        "Improve delivery logistics and carrier selection",
        ". Consider partnering with faster shipping carriers.",
        "Reduce delivery time by at least 20%",
    ),
    "order_volume": (
        "Increase visibility through promotional activities",
        ". Consider product bundling strategies.",
        "Increase order volume by at least 30%",
    ),
    "on_time_delivery": (
        "Improve on-time delivery rate through better inventory management",
        "",
        "Achieve at least 90% on-time delivery rate",
    ),
}


def improvement_recommendations(tiers: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per seller below High and area to improve, with text, action and priority."""
    compared = ["avg_processing_time", "avg_delivery_days", "order_count"]
    middle = scalar_struct(exact_medians(tiers, {c: c for c in compared}, (), buckets))
    below = tiers.where(F.col("performance") != "High").withColumn("__m", middle)
    low = F.col("performance") == "Low"
    late = F.col("on_time_delivery_rate") < 85 if "on_time_delivery_rate" in tiers.columns else F.lit(False)
    cases = {
        "processing_time": (low | (F.col("avg_processing_time") > F.col("__m")["avg_processing_time"]),
                            F.col("avg_processing_time") > 3),
        "delivery_time": (low | (F.col("avg_delivery_days") > F.col("__m")["avg_delivery_days"]),
                          F.col("avg_delivery_days") > 7),
        "order_volume": (F.col("order_count") < F.col("__m")["order_count"], F.col("order_count") < 20),
        "on_time_delivery": (late, F.lit(False)),
    }
    found = F.array_compact(F.array(*[
        F.when(applies, F.struct(
            F.lit(area).alias("improvement_area"),
            F.concat(F.lit(_ADVICE[area][0]), F.when(serious, _ADVICE[area][1]).otherwise("")).alias("recommendation"),
            F.lit(_ADVICE[area][2]).alias("suggested_action"),
        )) for area, (applies, serious) in cases.items()
    ]))
    return below.select(
        "seller_id", "performance", F.when(low, "High").otherwise("Medium").alias("priority"), F.inline(found)
    )


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int, tier: int | None = None) -> DataFrame:
    """One page of a sorted listing, optionally of one tier."""
    chosen = df if tier is None else df.where(F.col("prediction") == tier)
    return chosen.orderBy(*order).offset(number * size).limit(size)
