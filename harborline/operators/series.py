"""Monthly series: gaps, outliers, autocorrelation, spectrum, seasonality, decomposition and stationarity.

A series frame has columns series, month (first day, DATE) and y (DOUBLE), one row per series and month. It is the
result of an aggregation, so a series is never longer than the calendar it covers and its windows stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import bind_value
from ..session import pinned

MAX_LAG = 36
PLOT_LAGS = 24
DEFAULT_PERIOD = 12



def along() -> WindowSpec:
    return Window.partitionBy("series").orderBy("month")


def whole() -> WindowSpec:
    return Window.partitionBy("series")


def as_series(demand: DataFrame, key: str, value: str = "count", month: str = "date") -> DataFrame:
    """A demand frame as a series frame."""
    return demand.select(F.col(key).alias("series"), F.col(month).cast("date").alias("month"),
                         F.col(value).cast("double").alias("y"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds pos (from 0 along the months) and n (length of the series)."""
    return df.withColumns({"pos": F.row_number().over(along()) - 1, "n": F.count(F.lit(1)).over(whole())})


def array_median(values: Column) -> Column:
    """Median of a short array; NULL when it is empty."""
    return bind_value(F.array_sort(values), lambda s: F.when(F.size(s) > 0, (
        F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0))


def fill_months(df: DataFrame, method: str = "linear") -> DataFrame:
    """Every month between a series' first and last row; missing values by `method`.

    linear goes straight between neighbours and carries the last value on, ffill and bfill repeat a neighbour, mean
    takes the series' mean, zero is zero. Each row is stretched to the month before its successor, so no calendar is
    built and nothing is joined. All windows read one sort of the given rows; nothing is sorted after the stretching.
    """
    if method not in ("linear", "ffill", "bfill", "mean", "zero"):
        raise ValueError(f"unknown method {method!r}")
    kept = df.select("series", "month", "y").where(F.col("month").isNotNull())
    if method in ("linear", "ffill", "bfill"):
        # Of the rows without a value only those at the ends of a series say anything: how far it reaches.
        ends = {"__first": F.row_number().over(along()) == 1, "__last": F.lead("month").over(along()).isNull()}
        kept = kept.withColumns(ends).where(F.col("y").isNotNull() | F.col("__first") | F.col("__last")).drop(*ends)
    elif method == "mean":
        kept = kept.withColumn("__mean", F.avg("y").over(along().rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    reach = F.coalesce(F.add_months(F.lead("month").over(along()), -1), F.col("month"))
    placed = kept.withColumns({
        "__to": reach, "__next": F.lead("y").over(along()), "__past": F.coalesce("y", F.lag("y").over(along()))})
    months = placed.withColumn("__months", F.sequence("month", "__to", F.expr("interval 1 month"))).drop("month", "__to")
    # __i counts the months from the row's own.
    stretched = months.select(
        "*", F.size("__months").alias("__n"), F.posexplode("__months").alias("__i", "month")).drop("__months")
    own = F.when(F.col("__i") == 0, F.col("y"))
    value = {
        "zero": lambda: F.coalesce(own, F.lit(0.0)),
        "mean": lambda: F.coalesce(own, "__mean"),
        "ffill": lambda: F.col("__past"),
        "bfill": lambda: F.coalesce(own, "__next"),
        "linear": lambda: F.when(own.isNotNull(), own).when(F.col("__next").isNull(), F.col("__past")).otherwise(
            F.col("y") + (F.col("__next") - F.col("y")) * F.col("__i") / F.col("__n")),
    }[method]()
    return stretched.select("series", "month", value.alias("y"))


def repair_outliers(df: DataFrame) -> DataFrame:
    """Replace values outside the tighter of the quartile and deviation bounds by the median of in-bound values within
    two months, else of all in-bound values. Series under four values stay. Adds `repaired`."""
    q1, q3 = F.percentile("y", F.lit(0.25)).over(whole()), F.percentile("y", F.lit(0.75)).over(whole())
    stats = df.withColumns({
        "__q1": q1, "__q3": q3, "__mean": F.avg("y").over(whole()), "__sd": F.stddev_samp("y").over(whole()),
        "__n": F.count(F.lit(1)).over(whole()),
    })
    spread = F.col("__q3") - F.col("__q1")
    low = F.greatest(F.col("__q1") - 2.0 * spread, F.col("__mean") - 3.0 * F.col("__sd"))
    high = F.least(F.col("__q3") + 2.0 * spread, F.col("__mean") + 3.0 * F.col("__sd"))
    marked = stats.withColumn("__in", F.col("y").between(low, high))
    kept = F.when(F.col("__in"), F.col("y"))
    near = F.collect_list(kept).over(along().rowsBetween(-2, 2))
    out = marked.withColumns({"__near": near, "__all": F.percentile(kept, F.lit(0.5)).over(whole())})
    bad = (F.col("__n") >= 4) & ~F.col("__in")
    value = F.when(bad, F.coalesce(array_median(F.col("__near")), F.col("__all"))).otherwise(F.col("y"))
    return out.select("series", "month", value.alias("y"), F.coalesce(bad, F.lit(False)).alias("repaired"))


def packed_series(series: DataFrame) -> DataFrame:
    """One row per series: values in month order, length, last month."""
    points = F.array_sort(F.collect_list(F.struct("month", "y")))
    packed = series.groupBy("series").agg(points.alias("p"), F.max("month").alias("last_month"))
    return packed.select("series", "last_month", F.transform("p", lambda x: x["y"]).alias("y"), F.size("p").alias("n"))


def _lag_pairs(packed: DataFrame, first: int, max_lag: int) -> DataFrame:
    """Values (a, b) a lag apart, for lags up to `max_lag` and below half the length.

    The pairs of a series are unrolled next to it and summed up where they are, so no values are shuffled or joined.
    """
    top = F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int") - 1)
    lagged = packed.where(F.col("n") >= 2 * (first + 1)).withColumn("lag", F.explode(F.sequence(F.lit(first), top)))
    a = F.slice("y", 1, F.col("n") - F.col("lag"))
    b = F.slice("y", F.col("lag") + 1, F.col("n") - F.col("lag"))
    return lagged.select("series", "n", "lag", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("x")).select(
        "series", "n", "lag", "x.a", "x.b")


def autocorrelations(df: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Pearson correlation of a series with itself shifted, for lags below both `max_lag`+1 and half its length."""
    pairs = _lag_pairs(packed_series(df), 1, max_lag)
    # A constant part has no correlation; the built-in correlation would divide by its zero deviation.
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    out = pairs.groupBy("series", "n", "lag").agg(F.try_divide(F.covar_pop("a", "b"), spread).alias("acf"))
    return out.withColumn("n", F.col("n").cast("long"))


def periodogram(df: DataFrame) -> DataFrame:
    """Share of each frequency k (1 to half the length less 1) in the absolute discrete Fourier transform of the
    centred series."""
    centred = numbered(df).withColumn("__c", F.col("y") - F.avg("y").over(whole()))
    waves = centred.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(1)))))
    waves = waves.where(F.col("k") <= F.floor(F.col("n") / 2) - 1)
    angle = F.lit(2 * math.pi) * F.col("k") * F.col("pos") / F.col("n")
    sums = waves.groupBy("series", "n", "k").agg(
        F.sum(F.col("__c") * F.cos(angle)).alias("re"), F.sum(F.col("__c") * F.sin(angle)).alias("im")
    )
    sized = sums.withColumn("size", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    total = F.sum("size").over(whole())
    return sized.select("series", "n", "k", F.try_divide("size", total).alias("power"))


def _peaks(df: DataFrame, order: str, value: str, least: float) -> DataFrame:
    """Rows strictly above their two neighbours on each side and above `least`."""
    w = Window.partitionBy("series").orderBy(order)
    sides = [F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w), F.lead(value, 2).over(w)]
    marked = df.withColumns({f"__s{i}": s for i, s in enumerate(sides)})
    top = F.col(value) > least
    for i in range(4):
        top = top & (F.col(value) > F.col(f"__s{i}"))
    return marked.where(top).drop(*[f"__s{i}" for i in range(4)])


def detect_seasonality(df: DataFrame, default_period: int = DEFAULT_PERIOD) -> DataFrame:
    """Per series: is_seasonal, period, confidence.

    Peaks of the autocorrelation (weight 0.6) and of the spectrum (weight 0.4, at the period its frequency stands for)
    are added per period; the strongest period is snapped to a usual one. Under 24 months nothing is detected. The
    series frame is written down first, because three branches read it.
    """
    return seasonality_of(pinned(df), default_period)


def seasonality_of(df: DataFrame, default_period: int = DEFAULT_PERIOD) -> DataFrame:
    """`detect_seasonality` over a frame that is cheap to read again."""
    by_lag = _peaks(autocorrelations(df), "lag", "acf", 0.3).select(
        "series", F.col("lag").cast("int").alias("period"), (F.col("acf") * 0.6).alias("evidence"))
    by_wave = _peaks(periodogram(df), "k", "power", 0.05).select(
        "series", F.round(F.col("n") / F.col("k")).cast("int").alias("period"), (F.col("power") * 0.4).alias("evidence"))
    found = by_lag.unionByName(by_wave).groupBy("series", "period").agg(F.sum("evidence").alias("evidence"))
    best = found.groupBy("series").agg(
        F.max_by(F.struct("period", "evidence"), F.struct(F.col("evidence"), -F.col("period"))).alias("b")
    )
    period, strength = F.col("b")["period"], F.col("b")["evidence"]
    # Usual periods, the range snapped to each, and the factor on the confidence.
    usual = ((11, 13, 12, 0.9), (3, 4, 4, 0.8), (6, 7, 7, 0.7), (51, 53, 52, 0.85))
    snapped, factor = period, F.lit(0.5)
    for low, high, to, weight in usual:
        snapped = F.when(period.between(low, high), to).otherwise(snapped)
        factor = F.when(period.between(low, high), weight).otherwise(factor)
    lengths = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    joined = lengths.join(best, "series", "left")
    seasonal = (F.col("n") >= 24) & F.col("b").isNotNull()
    return joined.select(
        "series", seasonal.alias("is_seasonal"),
        F.when(seasonal, snapped).otherwise(F.lit(default_period)).alias("period"),
        F.when(seasonal, strength * factor).otherwise(F.lit(0.0)).alias("confidence"),
    )


def decompose(df: DataFrame, period: int = DEFAULT_PERIOD, multiplicative: bool = False) -> DataFrame:
    """Trend, seasonal, residual and adjusted value of every series of at least two periods; others are left out.

    The trend is the centred moving average over one period (half weights at both ends for an even period); its ends
    continue the straight line through the nearest period of trend values. The seasonal part is the mean per phase,
    recentred.
    """
    half = period // 2
    rows = numbered(df).where(F.col("n") >= 2 * period)
    span = along().rowsBetween(-half, half)
    total = F.sum("y").over(span)
    if period % 2 == 0:
        total = total - (F.lag("y", half).over(along()) + F.lead("y", half).over(along())) / 2.0
    inner = F.col("pos").between(F.lit(half), F.col("n") - 1 - half)
    rows = rows.withColumn("__t", F.when(inner, total / period))
    back = F.col("n") - 1 - half
    head = F.col("__t").isNotNull() & (F.col("pos") < F.least(F.lit(half + period), back))
    tail = F.col("__t").isNotNull() & (F.col("pos") < back) & (F.col("pos") >= F.greatest(F.lit(half), back - period))
    x = F.col("pos").cast("double")
    lines = {}
    for name, part in (("h", head), ("t", tail)):
        y_part, x_part = F.when(part, F.col("__t")), F.when(part, x)
        lines[f"__{name}_slope"] = F.regr_slope(y_part, x_part).over(whole())
        lines[f"__{name}_level"] = F.regr_intercept(y_part, x_part).over(whole())
    rows = rows.withColumns(lines)
    trend = (
        F.when(F.col("pos") < half, F.col("__h_slope") * x + F.col("__h_level"))
        .when(F.col("pos") > back, F.col("__t_slope") * x + F.col("__t_level")).otherwise(F.col("__t"))
    )
    rows = rows.withColumns({"trend": trend, "phase": F.col("pos") % period})
    loose = F.try_divide("y", "trend") if multiplicative else F.col("y") - F.col("trend")
    rows = rows.withColumn("__d", loose)
    rows = rows.withColumn("__m", F.avg("__d").over(Window.partitionBy("series", "phase")))
    # The mean over phases counts each phase once, whatever its number of months.
    level = F.avg(F.when(F.col("pos") < period, F.col("__m"))).over(whole())
    rows = rows.withColumn("seasonal", F.try_divide("__m", level) if multiplicative else F.col("__m") - level)
    if multiplicative:
        residual, adjusted = F.try_divide(F.try_divide("y", "seasonal"), F.col("trend")), F.try_divide("y", "seasonal")
    else:
        residual, adjusted = F.col("__d") - F.col("seasonal"), F.col("y") - F.col("seasonal")
    return rows.select("series", "month", "y", "pos", "phase", "trend", "seasonal", residual.alias("residual"),
                       adjusted.alias("adjusted"))


def seasonal_pattern(decomposed: DataFrame) -> DataFrame:
    """The seasonal factor per phase."""
    return decomposed.groupBy("series", "phase").agg(F.avg("seasonal").alias("seasonal_factor"))


# Published response-surface coefficients of the Dickey-Fuller critical values (constant, no trend),
# as powers of 1/T.
CRITICAL_VALUES = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def critical_value(level: str, observations: Column) -> Column:
    b = CRITICAL_VALUES[level]
    t = observations.cast("double")
    return F.lit(b[0]) + b[1] / t + b[2] / (t * t) + b[3] / (t * t * t)


def stationarity(df: DataFrame) -> DataFrame:
    """Dickey-Fuller test with a constant and no lagged differences, from regression sums alone.

    Output: statistic, observations, critical values at 1, 5 and 10 percent, is_stationary, error. Series under four
    values, or with a constant past, carry an error text instead of a statistic.
    """
    steps = df.withColumn("__x", F.lag("y").over(along())).withColumn("__dy", F.col("y") - F.col("__x"))
    sums = steps.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.regr_count("__dy", "__x").alias("observations"),
        F.regr_slope("__dy", "__x").alias("slope"), F.regr_sxx("__dy", "__x").alias("sxx"),
        F.regr_syy("__dy", "__x").alias("syy"), F.regr_sxy("__dy", "__x").alias("sxy"),
    )
    t = F.col("observations")
    rest = F.col("syy") - F.col("slope") * F.col("sxy")
    error = F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (t - 2).cast("double")))
    statistic = F.try_divide("slope", F.try_divide(error, F.sqrt("sxx")))
    out = sums.withColumn("statistic", F.when(F.col("n") >= 4, statistic))
    known = F.col("statistic").isNotNull()
    return out.select(
        "series", "observations", "statistic",
        *[F.when(known, critical_value(p, t)).alias(f"critical_{p[:-1]}") for p in CRITICAL_VALUES],
        F.coalesce(F.col("statistic") < critical_value("5%", t), F.lit(False)).alias("is_stationary"),
        F.when(F.col("n") < 4, "Insufficient data for stationarity test").when(~known, "Constant series")
        .otherwise("").alias("error"),
    )


# A column counts as dependent on those before it when no more than this part of its square sum is left.
DEPENDENT = 1e-10


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _counted_to(last: Column) -> Column:
    """The whole numbers from 1 to `last`, none for 0."""
    return F.slice(F.sequence(F.lit(0), last), F.lit(2), last)


def _swept(gram: Column, pivots: Column) -> Column:
    """Gauss-Jordan steps over the first `pivots` + 1 rows of a square matrix; NULL where a pivot vanishes.

    Of cross products with the target last, they leave the inverse, in the last column the coefficients and in its last
    place the sum of squared residuals.
    """
    def step(m: Column, k: Column) -> Column:
        row_k, pivot = F.get(m, k), F.get(F.get(m, k), k)
        swept = F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when(
            i == k, F.when(j == k, 1.0 / pivot).otherwise(v / pivot)
        ).otherwise(F.when(j == k, -F.get(row, k) / pivot).otherwise(v - F.get(row, k) * F.get(row_k, j) / pivot))))
        return F.when(pivot > DEPENDENT * F.get(F.get(gram, k), k), swept)

    return F.aggregate(F.sequence(F.lit(0), pivots), gram, step)


def _regression(y: Column, steps: Column, lags: Column, start: Column) -> Column:
    """Struct of level coefficient, its factor of the residual variance, squared residuals, rows and lags.

    The step from `start` on is explained by the level before it, `lags` earlier steps and a constant, which centring
    takes out. NULL where the columns depend on each other or the rows do not exceed the coefficients.
    """
    count = F.size(steps) - start
    part = lambda values, back: F.slice(values, start + 1 - back, count)
    columns = F.concat(F.array(part(y, F.lit(0))), F.transform(_counted_to(lags), lambda j: part(steps, j)),
                       F.array(part(steps, F.lit(0))))
    centred = F.transform(columns, lambda c: bind_value(
        F.aggregate(c, F.lit(0.0), lambda total, x: total + x) / count, lambda mean: F.transform(c, lambda v: v - mean)))
    gram = bind_value(centred, lambda z: F.transform(z, lambda a: F.transform(z, lambda b: _dot(a, b))))

    def fitted(g: Column) -> Column:
        last = lags + 1
        whole_sum = F.get(F.get(g, last), last)

        def read(m: Column) -> Column:
            rest = F.get(F.get(m, last), last)
            return F.when(m.isNotNull(), F.struct(
                F.get(F.get(m, F.lit(0)), last).alias("slope"), F.get(F.get(m, F.lit(0)), F.lit(0)).alias("factor"),
                F.when(rest > DEPENDENT * whole_sum, rest).otherwise(F.lit(0.0)).alias("sse"), count.alias("rows"),
                lags.alias("lags")))

        return bind_value(_swept(g, lags), read)

    return F.when(count > lags + 2, bind_value(gram, fitted))


def augmented_stationarity(df: DataFrame) -> DataFrame:
    """The Dickey-Fuller test with lagged differences: least squares by expressions over each series' array.

    The number of lags, up to 12 (n / 100)^(1/4), is the one with the least Akaike criterion, all candidates on the same
    rows; equal ones go to fewer lags. Missing values are left out. A series of fewer than four values, or without a
    regression, has a NULL statistic.
    """
    packed = packed_series(df).select("series", F.filter("y", lambda v: v.isNotNull() & ~F.isnan(v)).alias("y"))
    n = F.size("y")
    long = packed.withColumn("n", n).withColumn("y", F.when(F.col("n") >= 4, F.col("y")))
    most = F.least(F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)
    ready = long.withColumns({
        "most": F.greatest(F.lit(0), most).cast("int"),
        "steps": F.zip_with(F.slice("y", F.lit(2), F.col("n") - 1), F.slice("y", F.lit(1), F.col("n") - 1), lambda b, a: b - a),
    })
    y, steps = F.col("y"), F.col("steps")

    def scored(lags: Column) -> Column:
        return bind_value(_regression(y, steps, lags, F.col("most")), lambda fit: F.when(fit["sse"] > 0, F.struct(
            (fit["rows"] * F.log(fit["sse"] / fit["rows"]) + 2 * (lags + 2)).alias("aic"), lags.alias("lags"))))

    best = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.col("most")), scored), lambda x: x.isNotNull()))
    chosen = ready.withColumn("lags", F.when(F.col("y").isNotNull(), F.coalesce(best["lags"], F.lit(0))))
    fit = F.when(F.col("y").isNotNull(), _regression(y, steps, F.col("lags"), F.col("lags")))
    tested = chosen.withColumn("fit", fit)
    variance = F.col("fit.sse") / (F.col("fit.rows") - F.col("lags") - 2) * F.col("fit.factor")
    t = F.col("observations")
    known = F.col("statistic").isNotNull()
    return tested.select(
        "series", F.coalesce("lags", F.lit(0)).alias("lags"),
        F.coalesce(F.col("fit.rows"), F.size("steps"), F.lit(0)).cast("long").alias("observations"),
        F.when(variance > 0, F.col("fit.slope") / F.sqrt(variance)).alias("statistic"),
    ).select(
        "*", *[F.when(known, critical_value(p, t)).alias(f"critical_{p[:-1]}") for p in CRITICAL_VALUES],
        F.coalesce(F.col("statistic") < critical_value("5%", t), F.lit(False)).alias("is_stationary"),
    )


def differenced(df: DataFrame) -> DataFrame:
    """First differences; the first month of a series drops out."""
    change = df.withColumn("y", F.col("y") - F.lag("y").over(along()))
    return change.where(F.col("y").isNotNull())


def stationary_part(df: DataFrame) -> DataFrame:
    """Each series as it is when it tests stationary, else its first differences. Adds `is_differenced`."""
    tests = stationarity(df).select("series", "is_stationary")
    marked = df.withColumn("__d", F.col("y") - F.lag("y").over(along())).join(tests, "series")
    value = F.when(F.col("is_stationary"), F.col("y")).otherwise(F.col("__d"))
    return marked.select("series", "month", value.alias("y"), (~F.col("is_stationary")).alias("is_differenced")).where(
        F.col("y").isNotNull())


def plot_autocorrelations(df: DataFrame, max_lag: int = PLOT_LAGS) -> DataFrame:
    """Autocorrelation about the whole series' mean and variance, lags 0 to half the length less 1 or `max_lag`."""
    pairs = _lag_pairs(packed_series(df.withColumn("y", F.col("y") - F.avg("y").over(whole()))), 0, max_lag)
    sums = pairs.groupBy("series", "n", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("__c"))
    variance = F.max(F.when(F.col("lag") == 0, F.col("__c"))).over(whole())
    return sums.select("series", F.col("n").cast("long").alias("n"), "lag", F.try_divide("__c", variance).alias("acf"))


def partial_autocorrelations(acf: DataFrame) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over the rows of `plot_autocorrelations`.

    Lag 0 is 1; from a lag whose denominator vanishes on they are NULL.
    """
    sorted_rows = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    packed = acf.groupBy("series").agg(sorted_rows.alias("p")).select("series", F.transform("p", lambda x: x["acf"]).alias("r"))
    r = F.col("r")

    def step(state: Column, k: Column) -> Column:
        before = F.slice(r, F.lit(2), k - 1)
        below = 1.0 - _dot(state["phi"], before)
        last = (F.get(r, k) - _dot(state["phi"], F.reverse(before))) / F.when(F.abs(below) >= 1e-12, below)
        return bind_value(last, lambda x: F.struct(
            F.concat(F.zip_with(state["phi"], F.reverse(state["phi"]), lambda a, b: a - x * b), F.array(x)).alias("phi"),
            F.concat(state["pacf"], F.array(x)).alias("pacf")))

    # Cut out of `r`, so that their elements may be NULL like those added later.
    start = F.struct(F.slice(r, 1, 0).alias("phi"), F.slice(F.concat(F.array(F.lit(1.0)), r), 1, 1).alias("pacf"))
    values = F.aggregate(_counted_to(F.size(r) - 1), start, step)["pacf"]
    return packed.select("series", F.posexplode(values).alias("lag", "pacf"))


def split_in_time(df: DataFrame, share: float = 0.8, least: int = 0) -> DataFrame:
    """Marks each row train or test; the first floor(share * n) months (at least `least`) train."""
    cut = F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(least))
    return numbered(df).withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("test"))


def recent_means(df: DataFrame) -> DataFrame:
    """Per series: length and the means of the last six (or all), last three and the three before."""
    back = Window.partitionBy("series").orderBy(F.desc("month"))
    ranked = df.withColumn("__r", F.row_number().over(back))
    part = lambda a, b: F.avg(F.when(F.col("__r").between(a, b), F.col("y")))
    return ranked.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), part(1, 6).alias("recent_mean"), part(1, 3).alias("last3_mean"),
        part(4, 6).alias("prior3_mean"),
    )
