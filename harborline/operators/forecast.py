"""Forecast frames: bounds, intervals, fallback forecasts, error metrics and the forecast report.

A forecast frame has columns series, step (from 1), month, forecast, lower_ci, upper_ci. Series frames are those of
`operators.series`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, half_up

Z95 = 1.96
# Error metrics of the last fallback, as shares of the mean, and its MAPE.
FALLBACK_MAE, FALLBACK_RMSE, FALLBACK_MAPE = 0.15, 0.2, 25.0
MOVING_AVERAGE_MAPE = 30.0


def _newest(df: DataFrame, depth: int) -> list[Column]:
    """Aggregates v1 (newest) to v<depth> of a frame ranked by `__r` from the end."""
    return [F.max(F.when(F.col("__r") == k, F.col("y"))).alias(f"v{k}") for k in range(1, depth + 1)]


def series_profile(series: DataFrame, depth: int = 9) -> DataFrame:
    """One row per series: n, last month, mean, deviation, the newest values, and the means the bounds use."""
    back = Window.partitionBy("series").orderBy(F.desc("month"))
    ranked = series.withColumn("__r", F.row_number().over(back))
    part = lambda a, b: F.avg(F.when(F.col("__r").between(a, b), F.col("y")))
    return ranked.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.max("month").alias("last_month"), F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"), part(1, 6).alias("recent_mean"), part(1, 3).alias("last3"),
        F.avg(F.when(F.col("__r") > 3, F.col("y"))).alias("before3"), *_newest(ranked, depth),
    )


def _steps(df: DataFrame, periods: int) -> DataFrame:
    out = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return out.withColumn("month", F.add_months("last_month", F.col("step")))


def bound_forecasts(model: DataFrame, profile: DataFrame, as_written: bool = False) -> DataFrame:
    """Hold model forecasts (series, step, forecast) within what recent history supports, never below 0.

    From six months on, the first step stays within 0.6 and 1.6 of the last three months' mean, and later steps
    between a decline and a growth path of at most 40 and 50 percent; the lower path wins. Shorter series stay within
    0.7 and 1.5 of their mean. `as_written` lets both paths follow the sign of recent growth, so that they cross.
    """
    kept = profile.select("series", "n", "mean", "last3", "before3")
    joined = model.join(kept, "series")
    growth = F.col("last3") / F.nullif(F.col("before3"), F.lit(0.0)) - 1
    up, down = growth * 2, growth * 2
    if not as_written:
        up, down = F.greatest(up, F.lit(0.0)), F.least(down, F.lit(0.0))
    ceiling = F.col("last3") * F.pow(1 + F.least(up, F.lit(0.5)), F.col("step"))
    floor = F.greatest(F.col("last3") * F.pow(1 + F.greatest(down, F.lit(-0.4)), F.col("step")), F.lit(1.0))
    first = F.greatest(F.least(F.col("forecast"), F.col("last3") * 1.6), F.col("last3") * 0.6)
    later = F.greatest(F.least(F.col("forecast"), ceiling), floor)
    long_run = F.when(F.col("before3") > 0, F.when(F.col("step") == 1, first).otherwise(later)).otherwise(
        F.col("forecast"))
    short = F.greatest(F.least(F.col("forecast"), F.col("mean") * 1.5), F.col("mean") * 0.7)
    value = F.greatest(F.when(F.col("n") >= 6, long_run).otherwise(short), F.lit(0.0))
    return joined.withColumn("forecast", value).select(*model.columns)


def with_intervals(df: DataFrame, deviation: Column, widening: float = 0.15) -> DataFrame:
    """Adds lower_ci (not below 0) and upper_ci: 1.96 deviations, wider by `widening` per step."""
    margin = deviation * (1 + (F.col("step") - 1) * F.lit(widening)) * F.lit(Z95)
    return df.withColumns({
        "lower_ci": F.greatest(F.col("forecast") - margin, F.lit(0.0)), "upper_ci": F.col("forecast") + margin,
    })


def interval_deviation(rmse: Column | str | None = "rmse") -> Column:
    """Hold-out error, else 1.2 deviations of the series, else a fifth of its mean."""
    spread = F.when(F.col("std") > 0, F.col("std") * 1.2).otherwise(F.col("mean") * 0.2)
    if rmse is None:
        return spread
    return F.coalesce(F.col(rmse) if isinstance(rmse, str) else rmse, spread)


def moving_average(profile: DataFrame, periods: int = 6) -> DataFrame:
    """Weighted mean of the last three months (0.7 newest, 0.2, 0.1) along the recent trend, with intervals and errors.

    The trend compares the last three months with the three before, held in -0.3..0.5. MAPE comes from forecasting the
    last three months. Under three months the last value repeats. Columns beyond a forecast frame: mae, rmse, mape.
    """

    v = lambda k: F.col(f"v{k}")
    mean3 = lambda skip: (v(skip + 1) + v(skip + 2) + v(skip + 3)) / 3.0
    # Kept as columns of their own, each computed once: level and trend on all months, and without the last three.
    measured = profile
    for skip in (0, 3):
        before = mean3(skip + 3)
        trend = F.when(
            (F.col("n") - skip >= 6) & (before > 0), clip(mean3(skip) / F.nullif(before, F.lit(0.0)) - 1, -0.3, 0.5))
        level = v(skip + 1) * 0.7 + v(skip + 2) * 0.2 + v(skip + 3) * 0.1
        measured = measured.withColumns({f"__t{skip}": F.coalesce(trend, F.lit(0.0)), f"__l{skip}": level})

    def value(skip: int, step: Column) -> Column:
        moved = F.greatest(F.col(f"__l{skip}") * (1 + F.col(f"__t{skip}") * step / 3), F.lit(1.0))
        return F.when(F.col("n") - skip >= 3, moved).otherwise(v(skip + 1))

    measured = measured.withColumns({f"__p{s}": value(3, F.lit(float(s))) for s in (1, 2, 3)})
    measured = measured.withColumns({f"__e{s}": pair_error(v(4 - s), F.col(f"__p{s}")) for s in (1, 2, 3)})
    errors = F.array_compact(F.array("__e1", "__e2", "__e3"))
    held_out = F.coalesce(
        F.try_divide(F.aggregate(errors, F.lit(0.0), lambda total, e: total + e), F.size(errors)), F.lit(50.0))
    spread = F.when(F.col("std") > 0, F.col("std")).otherwise(F.col("mean") * 0.15)
    measured = measured.withColumns({
        "rmse": spread, "mae": spread * 0.8,
        "mape": F.when(F.col("n") >= 6, held_out).otherwise(F.lit(MOVING_AVERAGE_MAPE)),
    })
    stepped = _steps(measured, periods)
    out = stepped.withColumn("forecast", value(0, F.col("step").cast("double")))
    return with_intervals(out, F.col("rmse"), 0.2).select(
        "series", "step", "month", "forecast", "lower_ci", "upper_ci", "mae", "rmse", "mape")


def trend_fallback(series: DataFrame, profile: DataFrame, periods: int = 6) -> DataFrame:
    """Damped weighted straight line from the last value, for when no model is left.

    Weights run from 0.5 to 1 along the series; the slope is at most a fifth of the mean per month and fades with the
    step; values stay within half and one and a half of the last value, and at least 1. Under four months the last
    value shrinks by 2 percent a month. Columns beyond a forecast frame: growth_rate, mae, rmse, mape.
    """
    along = Window.partitionBy("series").orderBy("month")
    x = (F.row_number().over(along) - 1).cast("double")
    placed = series.withColumns({"__x": x, "__n": F.count(F.lit(1)).over(Window.partitionBy("series"))})
    w = F.lit(0.5) + F.try_divide(F.col("__x") * 0.5, (F.col("__n") - 1).cast("double"))
    weighted = placed.withColumn("__w", F.coalesce(w, F.lit(0.5)))
    sums = weighted.groupBy("series").agg(
        F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__x")).alias("wx"),
        F.sum(F.col("__w") * F.col("y")).alias("wy"), F.sum(F.col("__w") * F.col("__x") * F.col("__x")).alias("wxx"),
        F.sum(F.col("__w") * F.col("__x") * F.col("y")).alias("wxy"),
    )
    joined = profile.select("series", "n", "last_month", "mean", "v1").join(sums, "series")
    slope = F.coalesce(F.try_divide(
        F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    ), F.lit(0.0))
    joined = joined.withColumn("typical", F.greatest(F.abs("mean"), F.lit(1.0)))
    limit = F.col("typical") * 0.2
    joined = joined.withColumn("slope", F.greatest(F.least(slope, limit), -limit))

    def line(step: Column) -> Column:
        point = F.col("v1") + F.col("slope") * step / (1 + (step - 1) * 0.2)
        return F.greatest(F.greatest(F.least(point, F.col("v1") * 1.5), F.col("v1") * 0.5), F.lit(1.0))

    enough = F.col("n") >= 4
    step = F.col("step").cast("double")
    change = F.when(
        F.col("v1") > 0, (line(F.lit(1.0)) - F.col("v1")) / F.nullif(F.col("v1"), F.lit(0.0)) * 100
    ).otherwise(F.lit(0.0))
    out = _steps(joined, periods).withColumns({
        "forecast": F.when(enough, line(step)).otherwise(
            F.greatest(F.col("v1") * F.pow(F.lit(0.98), step), F.lit(1.0))),
        "growth_rate": F.when(enough, clip(change, -30.0, 50.0)).otherwise(F.lit(-2.0)),
        "mae": F.col("typical") * FALLBACK_MAE, "rmse": F.col("typical") * FALLBACK_RMSE,
        "mape": F.lit(FALLBACK_MAPE),
    })
    return out.select(
        "series", "step", "month", "forecast", F.greatest(F.col("forecast") * 0.8, F.lit(0.0)).alias("lower_ci"),
        (F.col("forecast") * 1.2).alias("upper_ci"), "growth_rate", "mae", "rmse", "mape")


def pair_error(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error of one pair, at most 100; NULL for a pair that is almost zero."""
    size = F.abs(actual) + F.abs(predicted)
    share = F.abs(predicted - actual) / F.nullif(size / 2, F.lit(0.0)) * 100
    return F.when(size >= 0.0001, F.least(share, F.lit(100.0)))


def error_metrics(pairs: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """mae, rmse and robust mape (50 when no pair counts) of (actual, predicted) rows per key."""
    gap = F.col("predicted") - F.col("actual")
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.coalesce(F.avg(pair_error(F.col("actual"), F.col("predicted"))), F.lit(50.0)).alias("mape"),
    )


def growth_rates(forecast: DataFrame, profile: DataFrame) -> DataFrame:
    """First forecast against the mean of the last six months (or all), held in -50..60; 0 under two months."""
    first = forecast.where(F.col("step") == 1).select("series", F.col("forecast").alias("__f"))
    base = F.col("recent_mean")
    raw = F.when(base > 0, (F.col("__f") - base) / F.nullif(base, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    rate = F.when((F.col("n") >= 2) & F.col("__f").isNotNull(), clip(raw, -50.0, 60.0)).otherwise(F.lit(0.0))
    return profile.join(first, "series", "left").select("series", rate.alias("growth_rate"))


def forecast_report(
    forecast: DataFrame, profile: DataFrame, performance: DataFrame, growth: DataFrame | None = None,
    orders: DataFrame | None = None,
) -> DataFrame:
    """One row per forecast series: history and forecast means, extreme bounds, growth, errors and data quality.

    `performance` has series, mae, rmse, mape; `orders` series and arima_params. Without a growth frame growth is the
    forecast mean against the historical mean.
    """
    means = forecast.groupBy("series").agg(
        F.avg("forecast").alias("forecast_demand"), F.min("lower_ci").alias("min_forecast"),
        F.max("upper_ci").alias("max_forecast"),
    )
    out = means.join(profile.select("series", "n", "mean"), "series").join(performance, "series", "left")
    history = F.greatest(F.col("mean"), F.lit(1.0))
    change = (F.col("forecast_demand") - history) / history * 100
    if growth is not None:
        out = out.join(growth.select("series", F.col("growth_rate").alias("__g")), "series", "left")
        change = F.coalesce(F.col("__g"), change)
    params = F.lit("(1,1,1)")
    if orders is not None:
        out = out.join(orders.select("series", "arima_params"), "series", "left")
        params = F.coalesce(F.col("arima_params"), params)
    return out.select(
        F.col("series").alias("category"), params.alias("arima_params"), history.alias("avg_historical_demand"),
        "forecast_demand", "min_forecast", "max_forecast", clip(change, -80.0, 100.0).alias("growth_rate"), "mae", "rmse",
        clip("mape", None, 100.0).alias("mape"),
        F.when(F.col("n") < 8, "Limited").otherwise("Sufficient").alias("data_quality"),
    )


def history_and_forecast(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Past and forecast points of a series in one frame with a type."""
    past = series.select("series", "month", F.col("y").alias("value"), F.lit(None).cast("double").alias("lower_bound"),
                         F.lit(None).cast("double").alias("upper_bound"), F.lit("historical").alias("type"))
    ahead = forecast.select("series", "month", F.col("forecast").alias("value"), F.col("lower_ci").alias("lower_bound"),
                            F.col("upper_ci").alias("upper_bound"), F.lit("forecast").alias("type"))
    return past.unionByName(ahead)


def projection(report: DataFrame, profile: DataFrame, periods: int = 6) -> DataFrame:
    """Six months drawn from a report row: the forecast first, then growth from the last value.

    A fall of more than half, or none at all, compounds; growth is damped with the step. The band is the MAPE, wider
    by a fifth per step. `profile` gives the last value and month of each category.
    """
    last = profile.select(F.col("series").alias("category"), "last_month", F.col("v1").alias("last_value"))
    rows = report.join(last, "category", "left")
    growth = F.coalesce(clip(finite("growth_rate"), -80.0, 100.0), F.lit(0.0)) / 100
    demand = F.coalesce(finite("forecast_demand"), F.lit(0.0))
    base = F.coalesce(
        F.col("last_value"),
        F.when(demand > 0, F.try_divide(demand, 1 + growth)),
        finite("avg_historical_demand"), F.lit(100.0),
    )
    rows = rows.withColumns({"__g": growth, "__b": base, "__d": demand})
    stepped = _steps(rows, periods)
    step = F.col("step").cast("double")
    damped = F.col("__b") * (1 + F.col("__g") / (1 + 0.2 * (step - 1)) * step)
    compound = F.greatest(F.col("__b") * F.pow(1 + F.col("__g"), step), F.lit(1.0))
    value = F.when((F.col("step") == 1) & (F.col("__d") > 0), F.col("__d")).when(F.col("__g") > 0, damped).otherwise(
        compound)
    band = F.coalesce(clip(finite("mape"), None, 100.0), F.lit(20.0)) / 100 * (1 + (step - 1) * 0.2)
    return stepped.withColumn("value", value).select(
        "category", "step", "month", "value", F.greatest(F.col("value") * (1 - band), F.lit(0.0)).alias("lower_bound"),
        (F.col("value") * (1 + band)).alias("upper_bound"))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.round(value, 1))


def interpret(report: DataFrame) -> DataFrame:
    """Confidence label, growth text and advice per report row."""
    growth = F.coalesce(clip(finite("growth_rate"), -80.0, 100.0), F.lit(0.0))
    mape = F.coalesce(clip(finite("mape"), None, 100.0), F.lit(30.0))
    history, rmse = finite("avg_historical_demand"), finite("rmse")
    size = F.concat(_one_decimal(F.abs(growth)), F.lit("%"))
    subject = F.concat(F.lit("The "), F.coalesce(F.col("category"), F.lit("selected")), F.lit(" category shows "))

    # Texts of the interpretation.
    trend = (
        F.when(growth <= -50, F.concat(subject, F.lit("a significant decline ("), size, F.lit("). Consider substantially reducing inventory and investigating market shifts.")))
        .when(growth < -20, F.concat(subject, F.lit("a strong decline ("), size, F.lit("). Consider reducing inventory and exploring product/marketing improvements.")))
        .when(growth < 0, F.concat(subject, F.lit("a moderate decline ("), size, F.lit("). Consider slight inventory reductions while monitoring trends.")))
        .when(growth > 50, F.concat(subject, F.lit("exceptional growth ("), size, F.lit("). Consider significantly increasing inventory and expanding supplier capacity.")))
        .when(growth > 20, F.concat(subject, F.lit("strong growth ("), size, F.lit("). Consider increasing inventory and securing additional supply.")))
        .when(growth > 5, F.concat(subject, F.lit("moderate growth ("), size, F.lit("). Maintain current inventory levels with slight increases.")))
        .otherwise(F.concat(subject, F.lit("stable demand ("), size, F.lit("). Maintain current inventory levels.")))
    )
    lead = (
        F.when(mape > 60, "This forecast has high uncertainty due to volatile historical patterns. Low confidence: ")
        .when(mape > 30, "This forecast has moderate uncertainty. Moderate confidence: ")
        .otherwise("High confidence: ")
    )
    typical = F.when(
        (history > 0) & rmse.isNotNull(),
        F.concat(F.lit(" Typical forecast error is about "),
                 _one_decimal(rmse / F.nullif(history, F.lit(0.0)) * 100), F.lit("% ("),
                 half_up(rmse).cast("string"), F.lit(" units).")),
    ).otherwise("")
    limited = F.concat(
        F.lit("The "), F.coalesce(F.col("category"), F.lit("this")),
        F.lit(" category has limited historical data, which affects forecast reliability. "),
        F.when(history > 0, F.concat(
            F.lit("Historical average demand is "), half_up(history).cast("string"), F.lit(" units. "),
            F.when(finite("growth_rate").isNotNull(), F.concat(
                F.lit("The forecast suggests a "), size, F.when(growth > 0, " growth").otherwise(" decline"),
                F.lit(", but treat this as an estimate given the limited data. ")))
            .otherwise("Growth trends could not be reliably determined. "),
            F.lit("Consider collecting more historical data to improve forecast accuracy.")))
        .otherwise("Insufficient historical data is available for meaningful analysis."),
    )
    advice = (
        F.when(mape > 60, "Recommendation: Consider using qualitative methods (expert opinion, market research) alongside this quantitative forecast.")
        .when(growth > 20, "Recommendation: Develop a scaling plan to handle the projected growth.")
        .when(growth < -20, "Recommendation: Develop a plan to gradually reduce inventory while maintaining service levels.")
        .otherwise("Recommendation: Review inventory policies quarterly to ensure alignment with demand patterns.")
    )
    label = F.when(mape > 60, "Low Confidence").when(mape > 30, "Medium Confidence").otherwise("High Confidence")
    return report.select(
        "category", label.alias("confidence"),
        F.when(F.col("data_quality") == "Limited", limited).otherwise(F.concat(lead, trend, typical)).alias(
            "interpretation"),
        advice.alias("advice"),
    )


def quality_bands(report: DataFrame) -> DataFrame:
    """Accuracy band by MAPE, growth band by growth held in -50..60, and the three-colour MAPE band of the table."""
    mape = finite("mape")
    growth = clip(finite("growth_rate"), -50.0, 60.0)
    shown = F.coalesce(F.nullif(mape, F.lit(0.0)), F.lit(30.0))
    return report.select(
        "category", clip(mape, None, 100.0).alias("mape"), growth.alias("growth_rate"),
        F.when(mape < 15, "good").when(mape < 30, "medium").when(mape.isNotNull(), "poor").alias("accuracy_band"),
        F.when(growth > 5, "good").when(growth > -5, "medium").when(growth.isNotNull(), "poor").alias("growth_band"),
        F.when(shown < 10, "green").when(shown < 20, "orange").otherwise("red").alias("mape_colour"),
    )


def performance_extract(report: DataFrame) -> DataFrame:
    """Error metrics per category for a table; zero or missing errors are NULL, missing growth is 0."""
    name = next((c for c in ("category", "product_category") if c in report.columns), None)
    seen = lambda c: F.nullif(finite(c), F.lit(0.0)).alias(c)
    quality = F.coalesce(F.col("data_quality"), F.lit("Unknown")) if "data_quality" in report.columns else F.lit("Unknown")
    return report.where(F.col(name).isNotNull()).select(
        F.col(name).alias("category"), seen("mape"), seen("rmse"), seen("mae"),
        F.coalesce(finite("growth_rate"), F.lit(0.0)).alias("growth_rate"), quality.alias("data_quality"))


def by_accuracy(report: DataFrame) -> DataFrame:
    """Report rows with the smallest MAPE first."""
    return report.where(F.col("mape").isNotNull()).orderBy("mape", "category")


def by_growth(report: DataFrame) -> DataFrame:
    """Report rows with the largest growth first."""
    return report.where(F.col("growth_rate").isNotNull()).orderBy(F.desc("growth_rate"), "category")


def pack_forecasts(forecast: DataFrame, growth: DataFrame | None = None) -> DataFrame:
    """One row per series with its forecast and bound arrays in step order."""
    steps = F.array_sort(F.collect_list(F.struct("step", "forecast", "lower_ci", "upper_ci")))
    packed = forecast.groupBy("series").agg(steps.alias("s"))
    out = packed.select(
        F.col("series").alias("category"), F.transform("s", lambda p: p["forecast"]).alias("forecast_values"),
        F.transform("s", lambda p: p["lower_ci"]).alias("lower_ci"),
        F.transform("s", lambda p: p["upper_ci"]).alias("upper_ci"),
    )
    if growth is not None:
        out = out.join(growth.withColumnRenamed("series", "category"), "category", "left")
    return out


def unpack_forecasts(packed: DataFrame) -> DataFrame:
    """The reverse of `pack_forecasts`: one row per series and step."""
    zipped = F.arrays_zip("forecast_values", "lower_ci", "upper_ci")
    return packed.select(F.col("category").alias("series"), F.posexplode(zipped).alias("i", "p")).select(
        "series", (F.col("i") + 1).alias("step"), F.col("p.forecast_values").alias("forecast"),
        F.col("p.lower_ci").alias("lower_ci"), F.col("p.upper_ci").alias("upper_ci"))
