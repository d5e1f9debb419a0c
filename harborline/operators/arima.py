"""Per-series model search and forecasts, spread over series and candidates.

A series travels as one row holding its values; candidates are rows next to it, so the grid is a plain explode and each
row is one small least-squares fit in an Arrow batch. Coefficients come from two regressions: a long autoregression
gives residuals, then the series is regressed on its own and the residuals' lags.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .forecast import (
    bound_forecasts, growth_rates, interval_deviation, moving_average, series_profile, trend_fallback, with_intervals,
)
from .series import fill_months, packed_series, repair_outliers, seasonality_of

# The fitting functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_P, MAX_D, MAX_Q = 3, 2, 3
DEFAULT_ORDER = (1, 1, 1, 0, 0, 0, 0)
ORDER_FIELDS = ("p", "d", "q", "sp", "sd", "sq", "s")


def _difference(y: np.ndarray, lag: int, times: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The differenced values, and the levels needed to undo each difference."""
    levels = []
    for _ in range(times):
        levels.append(y)
        y = y[lag:] - y[:-lag] if len(y) > lag else y[:0]
    return y, levels


def _lagged(x: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k:len(x) - k] for k in lags]) if lags else np.empty((len(x) - start, 0))


def _solve(design: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    if design.shape[0] <= design.shape[1]:
        return None
    beta, _, rank, _ = np.linalg.lstsq(design, target, rcond=None)
    return beta if rank == design.shape[1] and np.isfinite(beta).all() else None


def fit_forecast(y: np.ndarray, order: tuple[int, ...], steps: int) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Forecast of `steps` values, Akaike's criterion, and the coefficients; None when the fit is singular or explodes.

    `order` is (p, d, q, P, D, Q, s). A constant is fitted when nothing is differenced.
    """
    p, d, q, sp, sd, sq, s = order
    plain, by_season = _difference(y, s, sd) if s > 1 else (y, [])
    w, by_step = _difference(plain, 1, d)
    ar = [*range(1, p + 1), *[s * j for j in range(1, sp + 1)]]
    ma = [*range(1, q + 1), *[s * j for j in range(1, sq + 1)]]
    constant = d + sd == 0
    residuals = np.zeros(len(w))
    start = max([0, *ar])
    if ma:
        long = max(1, min(max([*ar, *ma]) + 2, len(w) // 3))
        if len(w) <= 2 * long + 1:
            return None
        design = np.column_stack([_lagged(w, list(range(1, long + 1)), long), np.ones(len(w) - long)])
        beta = _solve(design, w[long:])
        if beta is None:
            return None
        residuals[long:] = w[long:] - design @ beta
        start = max(start, long + max(ma))
    if len(w) <= start + 1:
        return None
    design = np.column_stack([
        _lagged(w, ar, start), _lagged(residuals, ma, start), *([np.ones(len(w) - start)] if constant else [])])
    if design.shape[1] == 0:
        return None
    beta = _solve(design, w[start:])
    if beta is None:
        return None
    fitted_errors = w[start:] - design @ beta
    sse, count = float(fitted_errors @ fitted_errors), len(fitted_errors)
    aic = count * np.log(max(sse, 1e-12) / count) + 2 * (len(beta) + 1)
    residuals[start:] = fitted_errors
    values, errors = list(w), list(residuals)
    for _ in range(steps):
        terms = [*[values[-k] for k in ar], *[errors[-k] for k in ma], *([1.0] if constant else [])]
        values.append(float(np.dot(beta, terms)))
        errors.append(0.0)
    ahead = np.array(values[len(w):])
    for level in reversed(by_step):
        ahead = level[-1] + np.cumsum(ahead)
    for level in reversed(by_season):
        past = list(level)
        for step in ahead:
            past.append(past[-s] + step)
        ahead = np.array(past[len(level):])
    if not np.isfinite(ahead).all() or np.abs(ahead).max(initial=0.0) > 1e3 * (np.abs(y).max() + 1.0):
        return None
    return ahead, float(aic), beta


def _hold_out(y: np.ndarray, order: tuple[int, ...], least: int = 0) -> np.ndarray | None:
    """Errors (forecast minus actual, and the actual) over the last fifth."""
    cut = max(int(0.8 * len(y)), least)
    fit = fit_forecast(y[:cut], order, len(y) - cut) if len(y) > cut else None
    return None if fit is None else np.stack([fit[0], y[cut:]])


def _score_udf():
    @F.pandas_udf("rmse double, aic double")
    def score(y: pd.Series, order: pd.DataFrame) -> pd.DataFrame:
        """Hold-out error from 12 months on, else (or when that fails) Akaike's criterion on all months."""
        rows = []
        for values, candidate in zip(y, order[list(ORDER_FIELDS)].itertuples(index=False, name=None)):
            series = np.asarray(values, float)
            pair = _hold_out(series, candidate) if len(series) >= 12 else None
            if pair is not None and pair.shape[1] >= 2:
                rows.append((float(np.sqrt(np.mean((pair[0] - pair[1]) ** 2))), None))
            else:
                fit = fit_forecast(series, candidate, 1)
                rows.append((None, None if fit is None else fit[1]))
        return pd.DataFrame(rows, columns=["rmse", "aic"], dtype=float)

    return score


def _final_udf(periods: int):
    @F.pandas_udf("forecast array<double>, mae double, rmse double, mape double")
    def final(y: pd.Series, order: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for values, chosen in zip(y, order[list(ORDER_FIELDS)].itertuples(index=False, name=None)):
            series = np.asarray(values, float)
            fit = fit_forecast(series, chosen, periods)
            pair = _hold_out(series, chosen, 3)
            if fit is None or (pair is None and len(series) > max(int(0.8 * len(series)), 3)):
                rows.append((None, None, None, None))
                continue
            if pair is None:
                rows.append((fit[0], None, None, None))
                continue
            gap, size = np.abs(pair[0] - pair[1]), np.abs(pair[0]) + np.abs(pair[1])
            counts = size >= 0.0001
            shares = np.minimum(gap[counts] / (size[counts] / 2) * 100, 100)
            rows.append((fit[0], float(gap.mean()), float(np.sqrt((gap ** 2).mean())),
                         float(shares.mean()) if counts.any() else 50.0))
        return pd.DataFrame(rows, columns=["forecast", "mae", "rmse", "mape"])

    return final


def candidate_grid(
    packed: DataFrame, seasonality: DataFrame, max_p: int = MAX_P, max_d: int = MAX_D, max_q: int = MAX_Q
) -> DataFrame:
    """Every series with its candidate orders: p, d, q without p = q = 0, and eight seasonal variants of each where a
    season is clear and covered twice. Series under six months get none."""
    joined = packed.join(seasonality, "series", "left").where(F.col("n") >= 6)
    clear = F.col("is_seasonal") & (F.col("confidence") > 0.5) & (F.col("n") >= 2 * F.col("period"))
    grid = joined.withColumn("__clear", F.coalesce(clear, F.lit(False)))
    for name, most in (("p", max_p), ("d", max_d), ("q", max_q)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(most))))
    grid = grid.where((F.col("p") > 0) | (F.col("q") > 0))
    for name in ("sp", "sd", "sq"):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("__clear").cast("int"))))
    grid = grid.withColumn("s", F.when(F.col("__clear"), F.col("period").cast("int")).otherwise(0))
    return grid.select("series", "y", "n", F.struct(*ORDER_FIELDS).alias("o"))


def search_orders(
    series: DataFrame, max_p: int = MAX_P, max_d: int = MAX_D, max_q: int = MAX_Q
) -> DataFrame:
    """The best order per series: least hold-out error from 12 months on, else least Akaike criterion, else (1,1,1).

    Output: series, order (struct), rmse, aic, arima_params. Candidates are spread over all tasks, however few series
    there are.
    """
    fixed = pinned(series)
    packed = packed_series(fixed)
    grid = candidate_grid(packed, seasonality_of(fixed), max_p, max_d, max_q).repartition("series", "o")
    scored = grid.withColumn("score", _score_udf()("y", "o")).select("series", "o", "score.rmse", "score.aic")
    usable = scored.where(F.col("rmse").isNotNull() | F.col("aic").isNotNull())
    rank = F.struct(F.col("rmse").isNull(), F.coalesce("rmse", F.lit(0.0)), F.coalesce("aic", F.lit(0.0)), F.col("o"))
    best = usable.groupBy("series").agg(F.min_by(F.struct("o", "rmse", "aic"), rank).alias("b"))
    default = F.struct(*[F.lit(v).alias(n) for n, v in zip(ORDER_FIELDS, DEFAULT_ORDER)])
    out = packed.select("series").join(best, "series", "left").select(
        "series", F.coalesce("b.o", default).alias("order"), F.col("b.rmse").alias("rmse"), F.col("b.aic").alias("aic"))
    return out.withColumn("arima_params", order_text("order"))


def order_text(order: str):
    """(p,d,q) or (p,d,q)x(P,D,Q,s)."""
    field = lambda n: F.col(f"{order}.{n}")
    plain = F.format_string("(%d,%d,%d)", field("p"), field("d"), field("q"))
    seasonal = F.format_string("x(%d,%d,%d,%d)", field("sp"), field("sd"), field("sq"), field("s"))
    return F.when(field("s") > 1, F.concat(plain, seasonal)).otherwise(plain)


def model_forecasts(series: DataFrame, orders: DataFrame, periods: int = 6) -> tuple[DataFrame, DataFrame]:
    """Unbounded forecasts (series, step, forecast) with the chosen orders, and the hold-out errors per series."""
    joined = packed_series(series).join(orders.select("series", "order"), "series").repartition("series")
    fitted = joined.select("series", _final_udf(periods)("y", "order").alias("f")).where(
        F.col("f.forecast").isNotNull())
    points = fitted.select("series", F.posexplode("f.forecast").alias("i", "forecast")).select(
        "series", (F.col("i") + 1).alias("step"), "forecast")
    return points, fitted.select("series", "f.mae", "f.rmse", "f.mape")


def forecast_all(
    series: DataFrame, periods: int = 6, orders: DataFrame | None = None, max_p: int = MAX_P, max_d: int = MAX_D,
    max_q: int = MAX_Q,
) -> DataFrame:
    """Forecasts of every series with the method that worked: model, else moving average, else trend.

    Gaps count as 0 and outliers are repaired before modelling. Output: series, step, month, forecast, lower_ci,
    upper_ci, mae, rmse, mape, growth_rate, arima_params, model.
    """
    # Written down where several branches read on: the cleaned series, the orders found, and the chosen forecasts.
    cleaned = pinned(repair_outliers(fill_months(series, "zero")).drop("repaired"))
    orders = pinned(orders if orders is not None else search_orders(cleaned, max_p, max_d, max_q))
    profile = series_profile(cleaned)
    points, errors = model_forecasts(cleaned, orders, periods)
    bounded = bound_forecasts(points, profile).join(errors, "series").join(
        profile.select("series", "n", "last_month", "mean", "std"), "series").where(F.col("n") >= 4)
    by_model = with_intervals(bounded, interval_deviation()).withColumn(
        "month", F.add_months("last_month", F.col("step")))
    fields = ["forecast", "lower_ci", "upper_ci", "mae", "rmse", "mape"]
    # Each method as one struct per series and step, so that a whole row comes from one method.
    pick = lambda df, name: df.select(
        "series", "step", "month", F.struct(*fields, F.lit(name).alias("model")).alias(name))
    averaged = pick(moving_average(profile.where(F.col("n") >= 4), periods), "moving_average")
    trended = pick(trend_fallback(cleaned, profile, periods), "trend")
    joined = trended.join(averaged.drop("month"), ["series", "step"], "left").join(
        pick(by_model, "arima").drop("month"), ["series", "step"], "left")
    chosen = joined.select("series", "step", "month", F.coalesce("arima", "moving_average", "trend").alias("c"))
    flat = pinned(chosen.select("series", "step", "month", "c.*"))
    growth = growth_rates(flat, profile)
    return flat.join(growth, "series").join(orders.select("series", "arima_params"), "series", "left").withColumn(
        "arima_params", F.when(F.col("model") == "arima", F.col("arima_params")).otherwise(F.col("model")))


def forecast_top(
    demand: DataFrame, top_n: int = 5, periods: int = 6, category: str = "product_category_name", **grid: int
) -> DataFrame:
    """Forecasts of the categories with the most demand: one semi join in front of one job for all of them."""
    from .demand import top_categories
    from .series import as_series

    chosen = top_categories(demand, top_n, category).select(category)
    return forecast_all(as_series(demand.join(chosen, category, "left_semi"), category), periods, **grid)
