"""Validation, cleaning and token normalisation of incoming frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, to_number
from ..functions.quantiles import exact_medians, scalar_struct

# Texts that stand for a missing value, and the fields read as numbers.
MISSING_TOKENS = ("", "N/A", "n/a", "NA", "Infinity", "-Infinity")
NUMERIC_FIELDS = (
    "avg_historical_demand", "forecast_demand", "min_forecast", "max_forecast", "growth_rate", "mape", "rmse", "mae",
    "order_count", "count", "avg_processing_time", "avg_delivery_days", "total_sales", "safety_stock",
    "reorder_point", "next_month_forecast", "on_time_delivery", "perfect_order_rate", "inventory_turnover",
    "lead_time_days", "days_between_orders", "avg_item_cost",
)
COUNT_COLUMNS = ("order_count", "count", "order_id_count", "count(order_id)")


def validate_frame(
    df: DataFrame, required: Sequence[str] = (), numeric: Sequence[str] = (), dates: Sequence[str] = ()
) -> DataFrame:
    """One row per check (column_name, check_name, bad_rows, ok), computed in a single pass over the frame.

    A missing required column counts as one bad row; numeric and date checks apply to columns that exist.
    """
    checks: list[tuple[str, str, Column]] = []
    for c in required:
        checks.append((c, "required", F.lit(0 if c in df.columns else 1).cast("long")))
    for kind, names, target in (("numeric", numeric, "double"), ("date", dates, "timestamp")):
        for c in (n for n in names if n in df.columns):
            broken = F.col(c).isNotNull() & F.col(c).try_cast(target).isNull()
            checks.append((c, kind, F.coalesce(F.sum(broken.cast("long")), F.lit(0).cast("long"))))
    aggregates = [value.alias(f"v{i}") for i, (_, _, value) in enumerate(checks)]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("check_name"), F.col(f"v{i}").alias("bad_rows"))
        for i, (c, kind, _) in enumerate(checks)
    ])
    return df.agg(F.count(F.lit(1)).alias("n"), *aggregates).select(F.inline(rows)).withColumn(
        "ok", F.col("bad_rows") == 0
    )


def is_valid(report: DataFrame) -> DataFrame:
    """The checks of `validate_frame` folded into one row."""
    return report.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("valid"))


def clean_frame(
    df: DataFrame, numeric: Sequence[str] = (), dates: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Coerce columns; unparsable numbers become the column's exact median, unparsable dates NULL."""
    numeric = [c for c in numeric if c in df.columns]
    out = df.withColumns({c: to_number(c) for c in numeric})
    out = out.withColumns({c: F.col(c).try_cast("timestamp") for c in dates if c in df.columns})
    if not numeric:
        return out
    medians = scalar_struct(exact_medians(out, {c: c for c in numeric}, buckets=buckets))
    filled = out.withColumn("__m", medians)
    return filled.withColumns({c: F.coalesce(F.col(c), F.col("__m")[c]) for c in numeric}).drop("__m")


def normalize_tokens(df: DataFrame, numeric: Sequence[str] = NUMERIC_FIELDS) -> DataFrame:
    """Missing-value texts become NULL, listed numeric fields that do not parse become 0, and one pair of quotes
    around arima_params is removed."""
    changed = {}
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind == "string":
            value = F.when(~value.isin(*MISSING_TOKENS), value)
            if name == "arima_params":
                value = F.regexp_replace(value, r"""^["'](.+)["']$""", "$1")
        if name in numeric:
            # A number followed by other text still counts as that number.
            text = F.trim(value.cast("string"))
            lead = F.regexp_substr(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"))
            parsed = finite(lead.try_cast("double"))
            value = F.when(value.isNotNull(), F.coalesce(parsed, F.lit(0.0)))
        changed[name] = value
    return df.withColumns(changed)


def count_column(columns: Sequence[str]) -> str | None:
    """The column that holds the demand count, by the fixed order of preference."""
    return next((c for c in COUNT_COLUMNS if c in columns), None)


def normalize_demand(df: DataFrame) -> DataFrame:
    """Demand rows with a `date` (given, else first day of year and month, else NULL) and a filled `count`."""
    names = df.columns
    candidates: list[Column] = []
    if "date" in names:
        candidates.append(F.to_date(F.col("date").try_cast("timestamp")))
    year = next((c for c in ("order_year", "year") if c in names), None)
    month = next((c for c in ("order_month", "month") if c in names), None)
    if year and month:
        y, m = F.col(year).try_cast("int"), F.col(month).try_cast("int")
        candidates.append(F.when(m.between(1, 12), F.make_date(y, m, F.lit(1))))
    counts = [F.col(c).try_cast("double") for c in ("count", "order_count") if c in names]
    out = df.withColumn("date", F.coalesce(*candidates) if candidates else F.lit(None).cast("date"))
    return out.withColumn("count", F.coalesce(*counts, F.lit(0.0)))


def discover_demand(df: DataFrame) -> DataFrame:
    """A demand frame of unknown layout as (all columns, year, month, date, demand).

    The count column is the preferred one, else the first numeric column. Without year and month they are taken from
    the first column whose name speaks of a date or timestamp, else from columns naming a year and a month.
    """
    numeric_kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    chosen = count_column(df.columns) or next((n for n, t in df.dtypes if t in numeric_kinds), None)
    names = df.columns
    if "year" in names and "month" in names:
        year, month = F.col("year"), F.col("month")
    else:
        stamp = next((c for c in names if "timestamp" in c.lower() or "date" in c.lower()), None)
        if stamp:
            moment = F.col(stamp).try_cast("timestamp")
            year, month = F.year(moment), F.month(moment)
        else:
            y = next((c for c in names if "year" in c.lower()), None)
            m = next((c for c in names if "month" in c.lower()), None)
            year = F.col(y) if y and m else F.lit(None)
            month = F.col(m) if y and m else F.lit(None)
    out = df.withColumns({"year": year.try_cast("int"), "month": month.try_cast("int")})
    out = out.withColumn("date", F.when(F.col("month").between(1, 12), F.make_date("year", "month", F.lit(1))))
    return out.withColumn("demand", F.col(chosen).try_cast("double") if chosen else F.lit(None).cast("double"))


def imputation_report(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column: values missing before, missing after, and changed although present before."""
    pairs = before.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]).join(
        after.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]), key
    )
    sums = []
    for c in columns:
        b, a = F.col(f"b_{c}"), F.col(f"a_{c}")
        for metric, flag in (
            ("original_missing", b.isNull()), ("final_missing", a.isNull()),
            ("capped_values_count", b.isNotNull() & ~b.eqNullSafe(a)),
        ):
            sums.append(F.coalesce(F.sum(flag.cast("long")), F.lit(0).cast("long")).alias(f"{metric}|{c}"))
    wide = pairs.agg(*sums)
    long = wide.unpivot([], [F.col(f"`{n}`") for n in wide.columns], "label", "n")
    parts = F.split("label", r"\|")
    return long.select(parts[1].alias("column_name"), parts[0].alias("metric"), "n")


def bundle_status(frames: Mapping[str, DataFrame | None], required: Sequence[str]) -> DataFrame:
    """Per expected table: its row count and whether it is missing, empty or present."""
    given = {n: f for n, f in frames.items() if f is not None}
    spark = next(iter(given.values())).sparkSession
    counts = [
        given[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), F.lit(1).alias("found"), "rows")
        if n in given else
        spark.range(1).select(F.lit(n).alias("table_name"), F.lit(0).alias("found"), F.lit(0).cast("long").alias("rows"))
        for n in dict.fromkeys([*required, *frames])
    ]
    status = F.when(F.col("found") == 0, "missing").when(F.col("rows") == 0, "empty").otherwise("present")
    return reduce(DataFrame.unionByName, counts).select(
        "table_name", "rows", status.alias("status"), F.col("table_name").isin(*required).alias("required")
    )
