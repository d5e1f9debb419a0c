"""Small literal inputs with known results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.functions import quantiles
from harborline.functions.dates import parse_dates
from harborline.operators import arima as X
from harborline.operators import demand as D
from harborline.operators import forecast as P
from harborline.operators import geography as G
from harborline.operators import inventory as H
from harborline.operators import items as I
from harborline.operators import orders as O
from harborline.operators import products as R
from harborline.operators import quality as Q
from harborline.operators import sellers as S
from harborline.operators import series as Z
from harborline.operators.anomalies import repair_anomalies


def months(n, start=2020):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def series_frame(spark, *series):
    rows = [(name, m, float(v)) for name, values in series for m, v in zip(months(len(values)), values) if v is not None]
    return spark.createDataFrame(rows, "series string, month date, y double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_tokens(spark):
    raw = spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(zip(
        ["N/A", "Infinity", "", "12.5", "abc", "12abc"], ['"(1,1,1)"', "'x'", "", "NA", "(2,0,1)", None]))],
        "i int, mape string, arima_params string")
    out = Q.normalize_tokens(raw).orderBy("i").collect()
    assert [r["mape"] for r in out] == [None, None, None, 12.5, 0.0, 12.0]
    assert [r["arima_params"] for r in out] == ["(1,1,1)", "x", None, None, "(2,0,1)", None]


def test_validate_and_clean(spark):
    raw = spark.createDataFrame([("1", "2020-01-01"), ("x", "no"), ("3", None), (None, "2020-01-03")], "a string, d string")
    report = {(r["column_name"], r["check_name"]): r["bad_rows"] for r in
              Q.validate_frame(raw, ["a", "b"], ["a"], ["d"]).collect()}
    assert report == {("a", "required"): 0, ("b", "required"): 1, ("a", "numeric"): 1, ("d", "date"): 1}
    assert not Q.is_valid(Q.validate_frame(raw, ["b"])).first()["valid"]
    cleaned = Q.clean_frame(raw, ["a"], ["d"]).collect()
    assert sorted(r["a"] for r in cleaned) == [1.0, 2.0, 2.0, 3.0]
    assert sum(r["d"] is None for r in cleaned) == 2


def test_day_comes_before_month(spark):
    raw = spark.createDataFrame([("03/04/2020",), (None,)], "d string")
    assert [r["d"] for r in parse_dates(raw, "d").collect()] == [dt.datetime(2020, 4, 3), None]
    mixed = spark.createDataFrame([("03/04/2020",), ("03/25/2020",)], "d string")
    assert parse_dates(mixed, "d").where("d = '2020-03-25'").count() == 1


def order(spark, *rows):
    return spark.createDataFrame(
        [(i, *[None if x is None else dt.datetime.fromisoformat(x) for x in row]) for i, row in enumerate(rows)],
        "order_id int, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz")


def test_times_and_on_time(spark):
    orders = order(spark, ("2020-01-02", "2020-01-01", "2020-01-01", "2020-01-05"),
                   ("2020-01-01", "2020-01-01 12:00", "2020-01-05", "2020-01-05"),
                   ("2020-01-01", "2020-01-03", "2020-01-06", "2020-01-05"), ("2020-01-01", "2020-01-03", None, "2020-01-05"))
    whole = O.with_whole_days(orders)
    assert column(whole, "processing_time", "order_id") == [None, 0, 2, 2]
    assert column(whole, "delivery_days", "order_id") == [None, 4, 5, None]
    assert column(O.with_fractional_days(orders), "processing_time", "order_id") == [None, 0.5, 2.0, 2.0]
    assert column(O.with_on_time(orders), "on_time_delivery", "order_id") == [1, 1, 0, None]


def test_delivery_days_ladder(spark):
    orders = order(spark, ("2020-01-01", None, None, "2020-01-11"), ("2020-01-01", None, "2020-01-01", None),
                   ("2020-01-01", None, "2020-02-15", None), ("2020-01-01", None, None, None))
    lines = orders.withColumn("product_category_name", F.lit("a"))
    out = O.impute_delivery_days(lines)
    assert column(out, "delivery_days", "order_id") == [10.0, 1.0, 30.0, 10.0]
    assert column(O.impute_delivered(out), "order_delivered_timestamp", "order_id")[3] == dt.datetime(2020, 1, 11)


@pytest.mark.parametrize("buckets", [None, 16])
def test_product_median_wins(spark, buckets):
    items = spark.createDataFrame([(1, "p", 0.0), (2, "p", 5.0), (3, "q", 11.0), (4, "q", -8.0), (5, "r", None), (6, "s", None)],
                                  "order_id int, product_id string, price double")
    products = spark.createDataFrame([("p", "c"), ("q", "c"), ("r", "c"), ("s", "d")],
                                     "product_id string, product_category_name string")
    out = I.impute_item_values(items, products, buckets=buckets)
    assert column(out, "price", "order_id") == [5.0, 5.0, 11.0, 8.0, 8.0, 8.0]
    nothing = spark.createDataFrame([(1, "p", None, 0.0)], "order_id int, product_id string, price double, shipping_charges double")
    row = I.impute_item_values(nothing, products).first()
    assert (row["price"], row["shipping_charges"]) == (50.0, 10.0)


def test_ladder_sorts_only_what_is_asked(spark, monkeypatch):
    """All amounts were counted and sorted by ranges three times over, by product, category and as a whole."""
    summed = []
    ranges = quantiles.with_running_total
    monkeypatch.setattr(quantiles, "with_running_total", lambda df, keys, *rest: summed.append(keys) or ranges(df, keys, *rest))
    lines = [(i, "p", float(i)) for i in range(1, 9)] + [(9, "p", None), (10, "q", 3.0), (11, "q", 0.0)]
    products = spark.createDataFrame([("p", "c"), ("q", "c"), ("r", "c"), ("s", None), ("q", "d")],
                                     "product_id string, product_category_name string")

    def prices(extra=(), **how):
        items = spark.createDataFrame(lines + list(extra), "order_id int, product_id string, price double")
        out = I.impute_item_values(items, products, ["price"], **how)
        return sorted((r["order_id"], r["price"]) for r in out.where("order_id > 8").collect())

    served = [(9, 4.5), (10, 3.0), (10, 3.0), (11, 3.0), (11, 3.0)]
    assert prices() == served and summed == []
    assert prices(sorted_rows=4) == served and len(summed) == 1
    # r has no known amount: its category's are p's and q's. Lines of s, of an unknown and of no product get the overall one.
    coarser = [(12, "r", None), (13, "s", 0.0), (14, "x", None), (15, None, None), (16, None, 100.0)]
    expected = served + [(12, 4.0), (13, 4.5), (14, 4.5), (15, 4.5), (16, 100.0)]
    assert prices(coarser) == prices(coarser, sorted_rows=4, buckets=3) == expected
    missing = I.impute_missing_values(
        spark.createDataFrame([(1, "p", 2.0), (2, "p", None), (3, "q", None), (4, None, None), (5, "p", float("nan"))],
                              "order_id int, product_id string, price double"), ["price"])
    assert column(missing, "price", "order_id")[:4] == [2.0, 2.0, 2.0, 2.0]


def test_anomaly_in_the_middle(spark):
    values = [10.0] * 5 + [1000.0] + [10.0] * 5
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, i int, v double")
    assert repair_anomalies(df, "v", ["key"], ["i"]).agg(F.max("v")).first()[0] == 10.0
    assert repair_anomalies(df, "v", ["key"], ["i"], exclude_center=False).agg(F.max("v")).first()[0] == 1000.0


def test_category_growth(spark):
    rows = [(c, m, v) for c, values in (("a", [10, 10, 10, 20, 20, 20]), ("b", [100, 104]), ("c", [5]))
            for m, v in zip(months(6), values)]
    df = spark.createDataFrame(rows, "product_category_name string, date date, count int")
    out = {r["product_category_name"]: (r["growth"], r["trend"]) for r in D.category_growth(df).collect()}
    assert out == {"a": (100.0, "up"), "b": (4.0, "flat"), "c": (0.0, "flat")}


def test_percentile_ranks_and_thirds(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 20, 20, 30])], "seller_id int, v double")
    assert column(S.percentile_ranks(df, {"v": True}), "v_percentile", "seller_id") == [25.0, 62.5, 62.5, 100.0]
    seven = spark.createDataFrame([(i, float(i)) for i in range(7)], "seller_id int, score double")
    sizes = {r["performance"]: r["count"] for r in S.equal_thirds(seven, buckets=8).groupBy("performance").count().collect()}
    assert sizes == {"Low": 2, "Medium": 2, "High": 3}


def test_tied_top_category(spark):
    counts = spark.createDataFrame([("s", "b", 3), ("s", "a", 3), ("s", "c", 1)],
                                   "customer_state string, product_category_name string, order_count int")
    assert G.top_category_by_state(counts).count() == 2
    assert G.top_category_by_state(counts, "first").first()["product_category_name"] == "a"


def test_month_gaps(spark):
    gaps = series_frame(spark, ("a", [10, None, None, 16]))
    assert column(Z.fill_months(gaps), "y", "month") == [10.0, 12.0, 14.0, 16.0]
    assert column(Z.fill_months(gaps, "zero"), "y", "month") == [10.0, 0.0, 0.0, 10.0 + 6.0]
    assert column(Z.fill_months(gaps, "bfill"), "y", "month") == [10.0, 16.0, 16.0, 16.0]
    assert column(Z.fill_months(gaps), "month", "month") == months(4)


@pytest.mark.parametrize("method, expected", [
    ("linear", [None, None, 4.0, 5.0, 6.0, 8.0, 8.0, 8.0]), ("ffill", [None, None, 4.0, 4.0, 6.0, 8.0, 8.0, 8.0]),
    ("bfill", [4.0, 4.0, 4.0, 6.0, 6.0, 8.0, None, None]), ("mean", [6.0, 6.0, 4.0, 6.0, 6.0, 8.0, 6.0, 6.0]),
    ("zero", [0.0, 0.0, 4.0, 0.0, 6.0, 8.0, 0.0, 0.0]),
])
def test_month_gaps_with_unknown_values(spark, method, expected):
    """Rows without a value are gaps too, also at both ends of a series; rows without a month count for nothing."""
    y = [None, None, 4.0, None, 6.0, 8.0, None, None]
    rows = [("a", m, v) for i, (m, v) in enumerate(zip(months(8), y)) if i not in (1, 6)] + [("a", None, 5.0), ("b", months(1)[0], None)]
    out = Z.fill_months(spark.createDataFrame(rows, "series string, month date, y double"), method)
    assert column(out.where("series = 'a'"), "month", "month") == months(8)
    assert column(out.where("series = 'a'"), "y", "month") == expected
    assert column(out.where("series = 'b'"), "y", "month") == [0.0 if method == "zero" else None]


def test_series_outlier(spark):
    out = Z.repair_outliers(series_frame(spark, ("a", [10, 11, 9, 10, 100, 10, 11, 9, 10, 10, 11, 10])))
    assert column(out, "y", "month")[4] == 10.0
    assert sum(column(out, "repaired", "month")) == 1


@pytest.mark.parametrize("values, model, as_written, ours", [
    ([10] * 5 + [11] * 3, 11, [11, 15.84, 19.008], [11, 11, 11]),
    ([10] * 5 + [20] * 3, 20, [20, 180, 540], [20, 20, 20]),
    ([10] * 5 + [5] * 3, 5, [5, 1.8, 1.08], [5, 5, 5]),
])
def test_forecast_bounds(spark, values, model, as_written, ours):
    profile = P.series_profile(series_frame(spark, ("a", values)))
    points = spark.createDataFrame([("a", i, float(model)) for i in (1, 2, 3)], "series string, step int, forecast double")
    assert np.allclose(column(P.bound_forecasts(points, profile), "forecast", "step"), ours)
    written = column(P.bound_forecasts(points, profile, as_written=True), "forecast", "step")
    assert np.allclose(written, as_written)


def test_moving_average_and_trend(spark):
    profile = P.series_profile(series_frame(spark, ("a", [10, 10, 10, 20, 20, 20])))
    assert np.allclose(column(P.moving_average(profile, 3), "forecast", "step"), [23.3333, 26.6667, 30.0], atol=1e-4)
    line = series_frame(spark, ("a", [10, 12, 14, 16]))
    out = P.trend_fallback(line, P.series_profile(line), 3)
    assert np.allclose(column(out, "forecast", "step"), [18, 19.3333, 20.2857], atol=1e-4)
    assert out.first()["growth_rate"] == pytest.approx(12.5)
    short = series_frame(spark, ("a", [100]))
    out = P.trend_fallback(short, P.series_profile(short), 2)
    assert np.allclose(column(out, "forecast", "step"), [98, 96.04])
    assert out.first()["growth_rate"] == -2.0


def test_error_metrics(spark):
    pairs = spark.createDataFrame([("a", 100.0, 110.0), ("a", 0.0, 0.0), ("a", 50.0, 150.0)],
                                  "series string, actual double, predicted double")
    row = P.error_metrics(pairs).first()
    assert np.allclose([row["mape"], row["mae"], row["rmse"]], [54.7619, 36.6667, 58.0230], atol=1e-4)


def test_bands(spark):
    report = spark.createDataFrame([("a", 14.9, 5.0), ("b", 15.0, 5.1), ("c", 30.0, -5.0)],
                                   "category string, mape double, growth_rate double")
    out = P.quality_bands(report)
    assert column(out, "accuracy_band", "category") == ["good", "medium", "poor"]
    assert column(out, "growth_band", "category") == ["medium", "good", "poor"]


def test_stock_rules(spark):
    row = spark.range(1).select(
        H.safety_stock(F.lit(100.0), F.lit(20.0), F.lit(9.0)).alias("safety"),
        H.reorder_point(F.lit(100.0), F.lit(30.0), F.lit(9.0)).alias("point"),
        H.growth_adjusted(F.lit(30.0), F.lit(30.0)).alias("more"),
        H.order_quantity(H.annual_demand(F.lit(100.0), F.lit(30.0)), F.lit(50.0)).alias("eoq"),
        H.order_gap_days(F.lit(1560.0), F.lit(124.9)).alias("gap"),
        H.safety_stock(F.lit(100.0), F.lit(None).cast("double"), F.lit(9.0)).alias("one_month"),
    ).first()
    assert np.allclose(list(row), [30, 60, 34.5, 124.9, 29.2234, 30], atol=1e-4)


def test_priorities(spark):
    df = spark.createDataFrame([(12.4,), (7.0,), (3.0,), (-1.0,)], "growth_rate double")
    rows = H.with_priority(df).collect()
    assert [r["priority"] for r in rows] == ["High", "Medium", "Medium", "Low"]
    assert rows[0]["recommendation"] == "Increase safety stock by 12%"
    assert rows[3]["recommendation"] == "Consider reducing safety stock"


def test_recommendation_default_row(spark):
    report = spark.createDataFrame([("gone", 5.0)], "category string, growth_rate double")
    lines = spark.createDataFrame([], "order_id int, product_category_name string, order_year int, order_month int, price double")
    row = H.recommend_from_report(report, lines).collect()
    assert len(row) == 1 and row[0]["category"] == "Default" and row[0]["reorder_point"] == 50.0


def test_neighbour_imputation(spark):
    nan = None
    rows = [(i, "a", float(i), 1.0, 1.0, 1.0) for i in range(1, 7)] + [(10, "a", nan, 1.0, 1.0, 1.0), (11, "a", 3.0, nan, 1.0, 1.0),
            (12, "b", nan, 2.0, 2.0, 2.0), (13, "b", 8.0, 2.0, 2.0, 2.0), (14, None, nan, nan, nan, nan)]
    df = spark.createDataFrame(rows, "product_id int, product_category_name string, product_weight_g double, "
                               "product_length_cm double, product_height_cm double, product_width_cm double")
    out = {r["product_id"]: r for r in R.impute_by_neighbours(df).collect()}
    # Five equal distances: the lowest ids count.
    assert out[10]["product_weight_g"] == pytest.approx(3.0)
    assert out[11]["product_length_cm"] == pytest.approx(1.0)
    # A category of two uses its median, a product without any dimension the overall mean.
    assert out[12]["product_weight_g"] == 8.0
    assert out[14]["product_height_cm"] == pytest.approx(np.mean([1.0] * 8 + [2.0] * 2))


def test_order_search_recovers_an_autoregression():
    rng = np.random.default_rng(4)
    y = np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.6 * y[i - 1] + rng.normal()
    _, _, beta = X.fit_forecast(y + 50, (1, 0, 0, 0, 0, 0, 0), 3)
    assert abs(beta[0] - 0.6) < 0.1


def test_search_beats_seasonal_repeat(spark):
    rng = np.random.default_rng(8)
    t = np.arange(72)
    y = 100 + t + rng.normal(scale=4, size=72)
    df = series_frame(spark, ("a", y), ("short", [5, 6, 7]))
    out = {r["series"]: r for r in X.search_orders(df, 2, 1, 1).collect()}
    cut = int(0.8 * 72)
    repeat = np.sqrt(np.mean((y[cut:] - np.resize(y[cut - 12:cut], 72 - cut)) ** 2))
    assert out["a"]["rmse"] < repeat
    assert out["short"]["arima_params"] == "(1,1,1)"


def test_season_is_found_and_used(spark):
    t = np.arange(96)
    y = 100 + 40 * np.sin(2 * np.pi * t / 12)
    df = series_frame(spark, ("a", y))
    row = Z.detect_seasonality(df).first()
    assert row["is_seasonal"] and row["period"] == 12 and row["confidence"] > 0.5
    noisy = series_frame(spark, ("a", y + np.random.default_rng(1).normal(size=96)))
    assert "x(" in X.search_orders(noisy, 1, 1, 1).first()["arima_params"]


def test_constant_series(spark):
    df = series_frame(spark, ("flat", [7] * 30), ("tiny", [4, 5]))
    assert Z.autocorrelations(df).where("acf IS NOT NULL").count() == 0
    assert Z.detect_seasonality(df).where("is_seasonal").count() == 0
    out = {r["series"]: r for r in Z.stationarity(df).collect()}
    assert out["flat"]["error"] == "Constant series" and out["tiny"]["error"].startswith("Insufficient")
    assert Z.augmented_stationarity(df).where("statistic IS NOT NULL").count() == 0
    acf = Z.plot_autocorrelations(Z.stationary_part(df).drop("is_differenced"))
    assert Z.partial_autocorrelations(acf).where("lag > 0 AND pacf IS NOT NULL").count() == 0
    assert Z.decompose(df).where("trend IS NULL").count() == 0
    assert Z.decompose(df, multiplicative=True).where("seasonal <> 1").count() == 0


def test_overall_median_counts_filled_rows(spark):
    """Nine lines of ten are of one category; one category has no known day and one line no category."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "big", start + dt.timedelta(days=5)) for i in range(5)] + [(10 + i, "big", None) for i in range(85)]
    rows += [(200 + i, "small", start + dt.timedelta(days=20)) for i in range(8)] + [(300, "unknown", None), (301, None, None)]
    df = spark.createDataFrame(
        [(i, c, start, d, None) for i, c, d in rows],
        "id int, product_category_name string, order_purchase_timestamp timestamp_ntz, order_delivered_timestamp timestamp_ntz, "
        "order_estimated_delivery_date timestamp_ntz")
    got = {r["id"]: r["delivery_days"] for r in O.impute_delivery_days(df).collect()}
    assert len(got) == 100 and got[300] == got[301] == got[50] == got[0] == 5.0 and got[200] == 20.0
    alone = {r["id"]: r["delivery_days"] for r in O.impute_delivery_days(df, None).collect()}
    assert alone[300] == alone[50] == 20.0


def least_squares(y, lags, start):
    dy = np.diff(y)
    rows = np.arange(start, len(dy))
    x = np.column_stack([y[rows], *[dy[rows - j] for j in range(1, lags + 1)], np.ones(len(rows))])
    if len(rows) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    beta = np.linalg.lstsq(x, dy[rows], rcond=None)[0]
    sse = ((dy[rows] - x @ beta) ** 2).sum()
    factor = (np.linalg.pinv(x, rcond=1e-14)[0] ** 2).sum()
    return beta[0] / np.sqrt(sse / (len(rows) - x.shape[1]) * factor), sse, len(rows)


def slow_dickey_fuller(y):
    most = max(0, min(int(np.ceil(12.0 * (len(y) / 100.0) ** 0.25)), len(y) // 2 - 2))
    scores = {}
    for lags in range(most + 1):
        fit = least_squares(y, lags, most)
        if fit:
            scores[lags] = fit[2] * np.log(fit[1] / fit[2]) + 2 * (lags + 2)
    lags = min(scores, key=lambda k: (scores[k], k)) if scores else 0
    fit = least_squares(y, lags, lags)
    return lags, fit[2] if fit else len(y) - 1, fit and fit[0]


def test_augmented_test_against_least_squares(spark):
    rng = np.random.default_rng(5)
    made = {f"s{n}{kind}": values for n in (4, 5, 7, 12, 30, 84) for kind, values in (
        ("walk", 1000 + rng.normal(size=n).cumsum()), ("noise", 50 + rng.normal(size=n)),
        ("season", 1e6 + 1e3 * np.sin(np.arange(n) / 2) + rng.normal(size=n)))}
    got = {r["series"]: r for r in Z.augmented_stationarity(series_frame(spark, *made.items())).collect()}
    assert set(got) == set(made)
    for name, y in made.items():
        lags, count, statistic = slow_dickey_fuller(y)
        assert (got[name]["lags"], got[name]["observations"]) == (lags, count), name
        assert (statistic is None) == (got[name]["statistic"] is None), name
        assert statistic is None or abs(got[name]["statistic"] - statistic) < 1e-6 * max(1, abs(statistic)), name


def test_partial_autocorrelation_solves_yule_walker(spark):
    y = np.random.default_rng(2).normal(size=90).cumsum()
    acf = Z.plot_autocorrelations(series_frame(spark, ("a", y), ("two", y[:3])))
    rho = [r["acf"] for r in acf.where("series = 'a'").orderBy("lag").collect()]
    got = {r["lag"]: r["pacf"] for r in Z.partial_autocorrelations(acf).where("series = 'a'").collect()}
    assert sorted(got) == list(range(len(rho))) and got[0] == 1.0
    for k in range(1, len(rho)):
        table = [[rho[abs(i - j)] for j in range(k)] for i in range(k)]
        assert abs(np.linalg.solve(table, rho[1:k + 1])[-1] - got[k]) < 1e-8
    assert Z.partial_autocorrelations(acf).where("series = 'two'").count() == acf.where("series = 'two'").count()


def test_forecast_chain_falls_back(spark):
    df = series_frame(spark, ("flat", [7] * 30), ("tiny", [4, 5]), ("live", 50 + np.random.default_rng(0).normal(size=40)))
    out = X.forecast_all(df, 4, max_p=1, max_d=1, max_q=1)
    assert out.count() == 12 and out.where("forecast < 0 OR lower_ci < 0 OR lower_ci > forecast").count() == 0
    used = {r["series"]: r["model"] for r in out.select("series", "model").distinct().collect()}
    assert used["tiny"] == "trend" and used["flat"] == "moving_average" and used["live"] == "arima"
