"""Mixing sources by temperature: shares to the power of an exponent, realised as permuted passes over every source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind_value
from ..session import pinned
from .common import cells, hidden

SEED = "mix"
MAX_REPEATS = 2.0
BISECTIONS = 60
STREAM_BLOCKS = 1_000
ROWS_PER_CELL = 500
HASH_BITS = 60


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for: a greatest number of passes over a source, or a part of the greatest entropy.

    `budget` is the number of tokens of the mixture; without one it is the least that uses every row at least once.
    """

    max_repeats: float | None = MAX_REPEATS
    entropy: float | None = None
    budget: int | None = None


def keyed_hash(*parts: Column) -> Column:
    """60 bits of MD5 as a long: the place of a row in a permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Runs of non-space, at least 1 so that every row has a place in the mixture."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long"), F.lit(1).cast("long"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weights(counts: Column, alpha: Column) -> Column:
    """Shares to the power of alpha, summing to 1; counts are divided by the greatest first, which changes nothing."""
    top = F.array_max(counts)
    return bind_value(F.transform(counts, lambda c: F.pow(c / top, alpha)),
                      lambda w: bind_value(_total(w), lambda t: F.transform(w, lambda x: x / t)))


def _repeats(counts: Column, weights: Column, budget: int | None) -> Column:
    """Passes over each source: budget x weight / tokens; without a budget the least pass is exactly one."""
    ratio = F.zip_with(weights, counts, lambda w, c: w / c)
    if budget is not None:
        return F.transform(ratio, lambda r: F.lit(float(budget)) * r)
    return bind_value(F.array_min(ratio), lambda least: F.transform(ratio, lambda r: r / least))


def _meets(counts: Column, alpha: Column, target: Target) -> Column:
    """Whether the exponent is high enough for the limit: higher means nearer to the sources' own shares."""
    weights = _weights(counts, alpha)
    if target.entropy is not None:
        entropy = bind_value(weights, lambda w: -_total(F.transform(w, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0))))
        return entropy <= F.lit(target.entropy) * F.log(F.size(counts).cast("double")) + F.lit(1e-12)
    return bind_value(weights, lambda w: F.array_max(_repeats(counts, w, target.budget))) <= F.lit(target.max_repeats + 1e-9)


def source_plan(light: DataFrame, target: Target) -> DataFrame:
    """Per source: tokens, weight, repeats (passes, with fraction), full passes and tokens of the last, partial pass.

    `light` holds `source` and `tokens`. The exponent is the least in [0, 1] that meets the target, by bisection inside
    one expression over the array of source totals: one number per source, whatever the number of rows.
    """
    sources = light.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("s"))
    counts = F.col("s.tokens")
    half = lambda a: (a["low"] + a["high"]) / 2
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)),
        F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        lambda a, _: bind_value(_meets(counts, half(a), target), lambda ok: F.struct(
            F.when(ok, a["low"]).otherwise(half(a)).alias("low"), F.when(ok, half(a)).otherwise(a["high"]).alias("high"))),
    )
    alpha = F.when(_meets(counts, F.lit(0.0), target), F.lit(0.0)).otherwise(span["high"])
    weighed = one.where(F.size("s") > 0).withColumn("alpha", alpha).withColumn("w", _weights(counts, F.col("alpha")))
    weighed = weighed.withColumn("r", _repeats(counts, F.col("w"), target.budget))
    rows = weighed.select("alpha", F.explode(F.arrays_zip("s", "w", "r")).alias("x"))
    snapped = F.when(F.abs(F.col("repeats") - F.round("repeats")) < 1e-9, F.round("repeats")).otherwise(F.col("repeats"))
    return (
        rows.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), "alpha",
                    F.col("x.w").alias("weight"), F.col("x.r").alias("repeats"))
        .withColumn("repeats", snapped)
        .withColumn("full", F.floor("repeats").cast("long"))
        .withColumn("rest", (F.col("repeats") - F.col("full")) * F.col("tokens"))
    )


def passes(light: DataFrame, target: Target = Target(), seed: str = SEED) -> DataFrame:
    """The source plan with `last_hash`: in the partial pass, rows whose permutation hash is at most this are taken.

    `light` holds `source`, `tokens` and `h`, written down. Tokens are summed per source and hash cell, cells are summed up
    in order, and only the cell in which the budget ends is looked into, so no source is ever sorted in one task. Rows
    of one hash (copies of an id) are taken together or not at all, within the budget.
    """
    plan = pinned(source_plan(light, target))
    rows = light.count()
    bits = max(0, (cells(rows, ROWS_PER_CELL) - 1).bit_length())
    cell = F.shiftright("h", HASH_BITS - bits)
    over = Window.partitionBy("source").orderBy("cell")
    upto = (
        light.groupBy("source", cell.alias("cell")).agg(F.sum("tokens").alias("n"))
        .withColumn("before", F.sum("n").over(over) - F.col("n"))
    )
    ends = pinned(
        upto.join(plan.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        .select("of", F.col("cell").alias("end_cell"), "before", "rest")
    )
    inside = Window.partitionBy("of").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        light.join(ends, F.col("source").eqNullSafe(F.col("of")) & (cell == F.col("end_cell")))
        .withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
        .groupBy("of", "end_cell").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("h"))
        .select("of", F.coalesce("h", F.shiftleft("end_cell", HASH_BITS - bits) - 1).alias("last_hash"))
    )
    # A source whose partial pass is empty ends before its first row.
    return pinned(plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn(
        "last_hash", F.when(F.col("rest") <= 0, F.lit(-1).cast("long")).otherwise(F.coalesce("last_hash", F.lit(-1).cast("long")))))


def _light(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str) -> DataFrame:
    return pinned(docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
                              token_count(F.col(text_column)).alias("tokens"),
                              keyed_hash(F.lit(seed), F.lit("last"), F.col(id_column)).alias("h")))


def mixture(
    docs: DataFrame, target: Target = Target(), id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", seed: str = SEED,
) -> DataFrame:
    """One row per use of a document in the mixture.

    Output: the id, `source`, `tokens`, `weight` and `repeats` of the source, `epoch` (pass, from 0) and `block` of the
    mixed stream (0 to 999). Each pass is a permutation of the source of its own; a row's block follows from how far through
    all passes of its source it stands, so every block holds the sources at their weights. NULL is a source of its own;
    NULL and empty texts count as one token; repeated rows are rows like any other; an empty table gives no rows; extra
    columns are not read.
    """
    light = _light(docs, id_column, text_column, source_column, seed)
    plan = passes(light, target, seed).withColumnRenamed("source", "of").withColumnRenamed("tokens", "of_tokens")
    used = light.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "copies", F.col("full") + F.when(F.col("h") <= F.col("last_hash"), 1).otherwise(0))
    rows = used.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = F.when(F.col("epoch") == F.col("full"), F.col("h")).otherwise(keyed_hash(F.lit(seed), F.col("epoch"), F.col("id")))
    place = (F.col("epoch") + own / F.lit(float(1 << HASH_BITS))) / F.col("repeats")
    block = F.least(F.floor(place * STREAM_BLOCKS), F.lit(STREAM_BLOCKS - 1).cast("long"))
    return rows.select(F.col("id").alias(id_column), "source", "tokens", "weight", "repeats", "epoch", block.alias("block"))


def mixed_documents(docs: DataFrame, target: Target = Target(), seed: str = SEED) -> DataFrame:
    """The documents as often as the mixture uses them, with all their columns. Texts are not shuffled."""
    light = _light(docs, "doc_id", "text", "source", seed)
    h, of, full, last = (hidden(docs, n) for n in ("mix_h", "mix_of", "mix_full", "mix_last"))
    plan = passes(light, target, seed).select(
        F.col("source").alias(of), F.col("full").alias(full), F.col("last_hash").alias(last))
    marked = docs.withColumn(h, keyed_hash(F.lit(seed), F.lit("last"), F.col("doc_id")))
    used = marked.join(plan, F.col("source").cast("string").eqNullSafe(F.col(of)))
    copies = (F.col(full) + F.when(F.col(h) <= F.col(last), 1).otherwise(0)).cast("int")
    return used.withColumn(h, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
