"""Forecast frames, reports and reorder recommendations."""

from pyspark.sql import functions as F

from harborline.operators import demand as D
from harborline.operators import forecast as P
from harborline.operators import inventory as H
from harborline.operators import metrics as M
from harborline.operators import quality as Q
from harborline.operators import sellers as S
from harborline.operators import series as Z
from harborline.session import pinned

from .base import query
from .demand import finished_lines
from .intake import R, lines, order_lines, product_lines
from .sellers import rounded, sellers
from .series import product_series, series, text
from .views import add_view


def _profile(source: str) -> str:
    newest = ", ".join(f"max(y) FILTER (r = {k}) AS v{k}" for k in range(1, 10))
    return f"""
    SELECT series, count(*) AS n, max("month") AS last_month, avg(y) AS mean, stddev_samp(y) AS std,
           avg(y) FILTER (r <= 6) AS recent_mean, avg(y) FILTER (r <= 3) AS last3, avg(y) FILTER (r > 3) AS before3,
           {newest}
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY "month" DESC) AS r FROM {source}) GROUP BY 1"""


def _moving(source: str, periods: int) -> str:
    def value(skip: int, step: str) -> str:
        v = [f"v{skip + k}" for k in range(1, 7)]
        trend = (f"CASE WHEN n - {skip} >= 6 AND ({v[3]} + {v[4]} + {v[5]}) / 3 > 0 THEN least(greatest("
                 f"(({v[0]} + {v[1]} + {v[2]}) / 3) / (({v[3]} + {v[4]} + {v[5]}) / 3) - 1, -0.3E0), 0.5E0) ELSE 0.0E0 END")
        return (f"CASE WHEN n - {skip} >= 3 THEN greatest(({v[0]} * 0.7E0 + {v[1]} * 0.2E0 + {v[2]} * 0.1E0) * "
                f"(1 + {trend} * {step} / 3), 1.0E0) ELSE {v[0]} END")

    def error(s: int) -> str:
        a, f = f"v{4 - s}", value(3, f"{s}.0E0")
        return f"CASE WHEN abs({a}) + abs({f}) >= 0.0001 THEN least(abs({f} - {a}) / ((abs({a}) + abs({f})) / 2) * 100, 100.0E0) END"

    spread = "CASE WHEN std > 0 THEN std ELSE mean * 0.15E0 END"
    return f"""
    SELECT series, CAST(step AS INT) AS step, CAST(last_month + INTERVAL 1 MONTH * CAST(step AS INT) AS DATE) AS "month",
           {value(0, "step")} AS forecast, {spread} AS rmse, ({spread}) * 0.8E0 AS mae,
           CASE WHEN n < 6 THEN 30.0E0
                ELSE coalesce(list_avg([{error(1)}, {error(2)}, {error(3)}]), 50.0E0) END AS mape
    FROM {source} CROSS JOIN (SELECT unnest(range(1, {periods + 1})) AS step) s"""


_BOUNDS = """greatest(forecast - rmse * (1 + (step - 1) * 0.2E0) * 1.96E0, 0.0E0) AS lower_ci,
           forecast + rmse * (1 + (step - 1) * 0.2E0) * 1.96E0 AS upper_ci"""
add_view("prof", _profile("series"))
add_view("moving", f"SELECT *, {_BOUNDS} FROM ({_moving('prof', 6)})")
add_view("product_prof", _profile("product_series"))
add_view("product_moving", f"SELECT *, {_BOUNDS} FROM ({_moving('product_prof', 6)})")
add_view("cat_series", """
    SELECT product_category_name AS series, make_date(order_year, order_month, 1) AS "month", CAST(count(*) AS DOUBLE) AS y
    FROM unified WHERE order_purchase_timestamp < (SELECT day FROM finished_until) GROUP BY ALL""")
add_view("cat_prof", _profile("cat_series"))
add_view("cat_moving", f"SELECT *, {_BOUNDS} FROM ({_moving('cat_prof', 6)})")
_MONTH = """strftime("month", '%Y-%m-%d') AS "month" """


def category_series(t):
    return Z.as_series(D.monthly_demand(finished_lines(t)), "product_category_name")


@query("f15_moving_average", f"""
    SELECT series, step, {_MONTH}, round(forecast, 4) AS forecast, round(lower_ci, 4) AS lower_ci,
           round(upper_ci, 4) AS upper_ci, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape
    FROM product_moving""")
def _(t):
    return text(P.moving_average(P.series_profile(product_series(t))))


add_view("line_fit", """
    SELECT series, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy
    FROM (SELECT *, CASE WHEN n > 1 THEN 0.5E0 + x * 0.5E0 / (n - 1) ELSE 0.5E0 END AS w
          FROM (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY "month") - 1.0E0 AS x,
                       count(*) OVER (PARTITION BY series) AS n FROM product_series)) GROUP BY 1""")


@query("f16_trend_fallback", """
    WITH a AS (SELECT p.*, greatest(abs(mean), 1.0E0) AS typical,
                      CASE WHEN w * wxx - wx * wx <> 0 THEN (w * wxy - wx * wy) / (w * wxx - wx * wx) ELSE 0.0E0 END AS raw
               FROM product_prof p JOIN line_fit l ON p.series = l.series),
         b AS (SELECT *, greatest(least(raw, typical * 0.2E0), -typical * 0.2E0) AS slope FROM a),
         c AS (SELECT b.*, CAST(step AS INT) AS step,
                      greatest(greatest(least(v1 + slope * step / (1 + (step - 1) * 0.2E0), v1 * 1.5E0), v1 * 0.5E0), 1.0E0) AS f,
                      greatest(greatest(least(v1 + slope, v1 * 1.5E0), v1 * 0.5E0), 1.0E0) AS f1
               FROM b CROSS JOIN (SELECT unnest(range(1, 7)) AS step) s),
         d AS (SELECT *, CASE WHEN n >= 4 THEN f ELSE greatest(v1 * pow(0.98E0, step), 1.0E0) END AS forecast FROM c)
    SELECT series, step, strftime(CAST(last_month + INTERVAL 1 MONTH * step AS DATE), '%Y-%m-%d') AS "month",
           round(forecast, 4) AS forecast, round(forecast * 0.8E0, 4) AS lower_ci, round(forecast * 1.2E0, 4) AS upper_ci,
           round(CASE WHEN n < 4 THEN -2.0E0 WHEN v1 > 0 THEN least(greatest((f1 - v1) / v1 * 100, -30.0E0), 50.0E0)
                      ELSE 0.0E0 END, 4) AS growth_rate,
           round(typical * 0.15E0, 4) AS mae, round(typical * 0.2E0, 4) AS rmse, 25.0E0 AS mape FROM d""")
def _(t):
    base = product_series(t)
    return text(P.trend_fallback(base, P.series_profile(base)))


@query("f17_short_series", """
    WITH s AS (SELECT o_orderkey AS series, count(*) AS n, sum(l_quantity) AS y
               FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT series, CAST(step AS INT) AS step, round(greatest(y * pow(0.98E0, step), 1.0E0), 4) AS forecast,
           -2.0E0 AS growth_rate FROM s CROSS JOIN (SELECT unnest(range(1, 4)) AS step) t""")
def _(t):
    # One month per order: every series is short. Written down, so that the joined lines are not sorted for the profile and
    # for the line fit in the same tasks.
    line = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    short = pinned(line.groupBy(F.col("o_orderkey").alias("series")).agg(
        F.max(F.trunc("o_orderdate", "month")).alias("month"), F.sum("l_quantity").alias("y")))
    return text(P.trend_fallback(short, P.series_profile(short), 3), "series", "step", "forecast", "growth_rate")


add_view("naive_model", """
    SELECT p.*, CAST(step AS INT) AS step, v1 * (0.4E0 + 0.45E0 * step) AS model
    FROM product_prof p CROSS JOIN (SELECT unnest(range(1, 5)) AS step) s""")


def naive_model(t):
    profile = P.series_profile(product_series(t))
    stepped = P._steps(profile, 4)
    return stepped.select("series", "step", (F.col("v1") * (0.4 + 0.45 * F.col("step"))).alias("forecast")), profile


def _bounded(as_written: bool) -> str:
    up = "2 * g" if as_written else "greatest(2 * g, 0.0E0)"
    down = "2 * g" if as_written else "least(2 * g, 0.0E0)"
    return f"""
    WITH g AS (SELECT *, CASE WHEN before3 > 0 THEN last3 / before3 - 1 END AS g FROM naive_model),
         b AS (SELECT *, last3 * pow(1 + least({up}, 0.5E0), step) AS hi,
                      greatest(last3 * pow(1 + greatest({down}, -0.4E0), step), 1.0E0) AS lo FROM g)
    SELECT series, step, round(greatest(CASE
        WHEN n < 6 THEN greatest(least(model, mean * 1.5E0), mean * 0.7E0)
        WHEN before3 IS NULL OR before3 <= 0 THEN model
        WHEN step = 1 THEN greatest(least(model, last3 * 1.6E0), last3 * 0.6E0)
        ELSE greatest(least(model, hi), lo) END, 0.0E0), 4) AS forecast FROM b"""


@query("f13_bounds", _bounded(False))
def _(t):
    model, profile = naive_model(t)
    return text(P.bound_forecasts(model, profile))


@query("f13_bounds_as_written", _bounded(True))
def _(t):
    model, profile = naive_model(t)
    return text(P.bound_forecasts(model, profile, as_written=True))


@query("f14_intervals", """
    WITH d AS (SELECT *, CASE WHEN std > 0 THEN std * 1.2E0 ELSE mean * 0.2E0 END * (1 + (step - 1) * 0.15E0) * 1.96E0 AS m
               FROM naive_model)
    SELECT series, step, round(model, 4) AS forecast, round(greatest(model - m, 0.0E0), 4) AS lower_ci,
           round(model + m, 4) AS upper_ci FROM d""")
def _(t):
    model, profile = naive_model(t)
    joined = model.join(profile.select("series", "std", "mean"), "series")
    return text(P.with_intervals(joined, P.interval_deviation(None)), "series", "step", "forecast", "lower_ci", "upper_ci")


@query("f19_error_metrics", """
    WITH z AS (SELECT series, coalesce(y, 0) AS actual,
                      lag(coalesce(y, 0)) OVER (PARTITION BY series ORDER BY "month") AS predicted FROM product_calendar)
    SELECT series, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 4) AS rmse,
           round(coalesce(avg(CASE WHEN abs(actual) + abs(predicted) >= 0.0001
                 THEN least(abs(predicted - actual) / ((abs(actual) + abs(predicted)) / 2) * 100, 100.0E0) END), 50.0E0), 4)
               AS mape FROM z WHERE predicted IS NOT NULL GROUP BY 1""")
def _(t):
    filled = Z.fill_months(product_series(t), "zero")
    pairs = filled.select("series", F.col("y").alias("actual"), F.lag("y").over(Z.along()).alias("predicted"))
    return text(P.error_metrics(pairs.where(F.col("predicted").isNotNull())))


add_view("growths", """
    SELECT p.series, CASE WHEN n < 2 OR recent_mean <= 0 THEN 0.0E0
           ELSE least(greatest((forecast - recent_mean) / recent_mean * 100, -50.0E0), 60.0E0) END AS growth_rate
    FROM prof p JOIN moving m ON p.series = m.series AND m.step = 1""")


@query("f20_growth_rates", "SELECT series, round(growth_rate, 4) AS growth_rate FROM growths")
def _(t):
    profile = P.series_profile(series(t))
    return text(P.growth_rates(P.moving_average(profile), profile))


add_view("report", """
    SELECT m.series AS category, '(1,1,1)' AS arima_params, greatest(any_value(p.mean), 1.0E0) AS avg_historical_demand,
           avg(forecast) AS forecast_demand, min(lower_ci) AS min_forecast, max(upper_ci) AS max_forecast,
           least(greatest(any_value(g.growth_rate), -80.0E0), 100.0E0) AS growth_rate, any_value(mae) AS mae,
           any_value(rmse) AS rmse, least(any_value(mape), 100.0E0) AS mape,
           CASE WHEN any_value(p.n) < 8 THEN 'Limited' ELSE 'Sufficient' END AS data_quality
    FROM moving m JOIN prof p ON m.series = p.series JOIN growths g ON m.series = g.series GROUP BY 1""")


def report(t):
    profile = P.series_profile(series(t))
    forecast = P.moving_average(profile)
    performance = forecast.where("step = 1").select("series", "mae", "rmse", "mape")
    return P.forecast_report(forecast, profile, performance, P.growth_rates(forecast, profile))


_REPORT = ("SELECT category, arima_params, data_quality, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in ("avg_historical_demand", "forecast_demand", "min_forecast", "max_forecast",
                                      "growth_rate", "mae", "rmse", "mape")) + " FROM report")


@query("f21_forecast_report", _REPORT)
def _(t):
    return rounded(report(t))


@query("a12_forecast_lookup", _REPORT + " WHERE category = 'Brand#13'")
def _(t):
    from harborline.sources.runstore import lookup

    return rounded(lookup(report(t), "category", "Brand#13"))


@query("t06_history_and_forecast", """
    SELECT series, strftime("month", '%Y-%m-%d') AS "month", round(y, 4) AS "value", NULL::DOUBLE AS lower_bound,
           NULL::DOUBLE AS upper_bound, 'historical' AS type FROM series
    UNION ALL SELECT series, strftime("month", '%Y-%m-%d'), round(forecast, 4), round(lower_ci, 4), round(upper_ci, 4),
                     'forecast' FROM moving""")
def _(t):
    base = series(t)
    return text(P.history_and_forecast(base, P.moving_average(P.series_profile(base))))


@query("t07_by_accuracy", "SELECT category, round(mape, 4) AS mape FROM report ORDER BY report.mape, category")
def _(t):
    return P.by_accuracy(report(t)).select("category", R("mape"))


@query("t07_by_growth", """
    SELECT category, round(growth_rate, 4) AS growth_rate FROM report ORDER BY report.growth_rate DESC, category""")
def _(t):
    return P.by_growth(report(t)).select("category", R("growth_rate"))


@query("f23_projection", """
    WITH s AS (SELECT r.*, p.v1 AS b, p.last_month, r.growth_rate / 100 AS g, CAST(step AS INT) AS step,
                      r.mape / 100 * (1 + (step - 1) * 0.2E0) AS band
               FROM report r JOIN prof p ON r.category = p.series CROSS JOIN (SELECT unnest(range(1, 7)) AS step) x),
         v AS (SELECT *, CASE WHEN step = 1 AND forecast_demand > 0 THEN forecast_demand
                              WHEN g > 0 THEN b * (1 + g / (1 + 0.2E0 * (step - 1)) * step)
                              ELSE greatest(b * pow(1 + g, step), 1.0E0) END AS val FROM s)
    SELECT category, step, strftime(CAST(last_month + INTERVAL 1 MONTH * step AS DATE), '%Y-%m-%d') AS "month",
           round(val, 4) AS "value", round(greatest(val * (1 - band), 0.0E0), 4) AS lower_bound,
           round(val * (1 + band), 4) AS upper_bound FROM v""")
def _(t):
    return text(P.projection(report(t), P.series_profile(series(t))))


add_view("wild_report", """
    SELECT r.* REPLACE (growth_rate * 4 AS growth_rate, mape * 2.5E0 AS mape,
                        CASE WHEN category < 'Brand#2' THEN 'Limited' ELSE data_quality END AS data_quality) FROM report r""")


def wild_report(t):
    """The report with growth and errors spread out, so that every text occurs."""
    return report(t).withColumns({
        "growth_rate": F.col("growth_rate") * 4, "mape": F.col("mape") * 2.5,
        "data_quality": F.when(F.col("category") < "Brand#2", "Limited").otherwise(F.col("data_quality")),
    })


@query("f24_interpretation", """
    WITH c AS (SELECT *, least(greatest(growth_rate, -80.0E0), 100.0E0) AS g, least(mape, 100.0E0) AS m,
                      printf('%.1f', round(abs(least(greatest(growth_rate, -80.0E0), 100.0E0)), 1)) || '%' AS size FROM wild_report)
    SELECT category, CASE WHEN m > 60 THEN 'Low Confidence' WHEN m > 30 THEN 'Medium Confidence' ELSE 'High Confidence' END
               AS confidence,
           CASE WHEN data_quality = 'Limited' THEN 'The ' || category || ' category has limited historical data, which affects forecast reliability. Historical average demand is '
                || CAST(CAST(floor(avg_historical_demand + 0.5) AS BIGINT) AS VARCHAR) || ' units. The forecast suggests a ' || size
                || CASE WHEN g > 0 THEN ' growth' ELSE ' decline' END || ', but treat this as an estimate given the limited data. Consider collecting more historical data to improve forecast accuracy.'
           ELSE CASE WHEN m > 60 THEN 'This forecast has high uncertainty due to volatile historical patterns. Low confidence: '
                     WHEN m > 30 THEN 'This forecast has moderate uncertainty. Moderate confidence: ' ELSE 'High confidence: ' END
                || 'The ' || category || ' category shows ' || CASE
                WHEN g <= -50 THEN 'a significant decline (' || size || '). Consider substantially reducing inventory and investigating market shifts.'
                WHEN g < -20 THEN 'a strong decline (' || size || '). Consider reducing inventory and exploring product/marketing improvements.'
                WHEN g < 0 THEN 'a moderate decline (' || size || '). Consider slight inventory reductions while monitoring trends.'
                WHEN g > 50 THEN 'exceptional growth (' || size || '). Consider significantly increasing inventory and expanding supplier capacity.'
                WHEN g > 20 THEN 'strong growth (' || size || '). Consider increasing inventory and securing additional supply.'
                WHEN g > 5 THEN 'moderate growth (' || size || '). Maintain current inventory levels with slight increases.'
                ELSE 'stable demand (' || size || '). Maintain current inventory levels.' END
                || ' Typical forecast error is about ' || printf('%.1f', round(rmse / avg_historical_demand * 100, 1)) || '% ('
                || CAST(CAST(floor(rmse + 0.5) AS BIGINT) AS VARCHAR) || ' units).' END AS interpretation,
           CASE WHEN m > 60 THEN 'Recommendation: Consider using qualitative methods (expert opinion, market research) alongside this quantitative forecast.'
                WHEN g > 20 THEN 'Recommendation: Develop a scaling plan to handle the projected growth.'
                WHEN g < -20 THEN 'Recommendation: Develop a plan to gradually reduce inventory while maintaining service levels.'
                ELSE 'Recommendation: Review inventory policies quarterly to ensure alignment with demand patterns.' END AS advice
    FROM c""")
def _(t):
    return P.interpret(wild_report(t))


@query("f25_quality_bands", """
    WITH c AS (SELECT category, mape AS m, least(greatest(growth_rate, -50.0E0), 60.0E0) AS g FROM wild_report)
    SELECT category, round(least(m, 100.0E0), 4) AS mape, round(g, 4) AS growth_rate,
           CASE WHEN m < 15 THEN 'good' WHEN m < 30 THEN 'medium' ELSE 'poor' END AS accuracy_band,
           CASE WHEN g > 5 THEN 'good' WHEN g > -5 THEN 'medium' ELSE 'poor' END AS growth_band,
           CASE WHEN m < 10 THEN 'green' WHEN m < 20 THEN 'orange' ELSE 'red' END AS mape_colour FROM c""")
def _(t):
    return rounded(P.quality_bands(wild_report(t)))


@query("f26_performance_extract", """
    SELECT category, round(mape, 4) AS mape, round(rmse, 4) AS rmse, round(mae, 4) AS mae,
           round(growth_rate, 4) AS growth_rate, data_quality FROM report""")
def _(t):
    return rounded(P.performance_extract(report(t)))


@query("f27_discover_demand", """
    SELECT product_category_name, order_year::INT AS "year", order_month::INT AS "month",
           strftime("date", '%Y-%m-%d') AS "date", CAST("count" AS DOUBLE) AS demand FROM demand""")
def _(t):
    raw = D.monthly_sales(product_lines(t)).select("product_category_name", "order_year", "order_month", "order_count")
    return Q.discover_demand(raw).select(
        "product_category_name", "year", "month", F.date_format("date", "yyyy-MM-dd").alias("date"), "demand")


@query("f28_pack_forecasts", """
    SELECT m.series AS category, string_agg(CAST(CAST(round(forecast * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS f,
           string_agg(CAST(CAST(round(upper_ci * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS u,
           round(any_value(g.growth_rate), 4) AS growth_rate
    FROM moving m JOIN growths g ON m.series = g.series GROUP BY 1""")
def _(t):
    profile = P.series_profile(series(t))
    forecast = P.moving_average(profile)
    packed = P.pack_forecasts(forecast, P.growth_rates(forecast, profile))
    join = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 100, 0).cast("long").cast("string")), ",")
    return packed.select("category", join("forecast_values").alias("f"), join("upper_ci").alias("u"), R("growth_rate"))


@query("f28_unpack_forecasts", """
    SELECT series, step, round(forecast, 4) AS forecast, round(lower_ci, 4) AS lower_ci, round(upper_ci, 4) AS upper_ci
    FROM moving""")
def _(t):
    return text(P.unpack_forecasts(P.pack_forecasts(P.moving_average(P.series_profile(series(t))))))


# Forecasts moved away from the mean by category, so that every branch of the stock rules is taken.
add_view("stock_inputs", """
    SELECT f.category, f.next_month_forecast, d.m, d.sd, s.lead, s.cost
    FROM (SELECT series AS category, forecast * (0.2E0 + 0.45E0 * (length(series) % 5)) AS next_month_forecast
          FROM cat_moving WHERE step = 1) f
    LEFT JOIN (SELECT product_category_name AS c, avg("count") AS m, stddev_samp("count") AS sd FROM demand GROUP BY 1) d
        ON f.category = d.c
    LEFT JOIN (SELECT product_category_name AS c, avg(delivery_days) AS lead, avg(price) AS cost FROM unified GROUP BY 1) s
        ON f.category = s.c""")
add_view("stock", """
    SELECT *, CASE WHEN g > 20 THEN least(s0 * (1 + g / 100 * 0.5E0), s0 * 2)
                   WHEN g < -20 THEN greatest(s0 * (1 + g / 100 * 0.3E0), s0 * 0.6E0) ELSE s0 END AS safety,
           greatest(m * 12 * (1 + g / 100), m * 6) AS yearly
    FROM (SELECT *, least(greatest((f - m) / m * 100, -50.0E0), 150.0E0) AS g,
                 greatest(1.645E0 * coalesce(sd, 0) * sqrt(lead / 30), 0.3E0 * m) AS s0
          FROM (SELECT *, least(greatest(next_month_forecast, m * 0.5E0), m * 2.5E0) AS f FROM stock_inputs))""")
add_view("recommended", """
    SELECT category AS product_category, category, m AS avg_monthly_demand, safety AS safety_stock,
           m * (lead / 30) + safety AS reorder_point, f AS next_month_forecast, f AS forecast_demand, g AS growth_rate,
           lead AS lead_time_days, sqrt(2 * yearly * 50 / (cost * 0.2E0)) AS order_quantity,
           least(365 / (yearly / sqrt(2 * yearly * 50 / (cost * 0.2E0))), 90.0E0) AS days_between_orders,
           cost AS avg_item_cost, abs(g) > 20 AS adjusted_for_growth FROM stock""")


def stock_inputs(t):
    forecast = P.moving_average(P.series_profile(category_series(t))).where("step = 1").select(
        F.col("series").alias("category"),
        (F.col("forecast") * (0.2 + 0.45 * (F.length("series") % 5))).alias("next_month_forecast"))
    all_lines = product_lines(t)
    return H.category_inputs(all_lines, D.monthly_demand(all_lines), forecast)


def recommended(t):
    return H.recommend(stock_inputs(t))


@query("c05_inventory_inputs", """
    SELECT category, round(next_month_forecast, 4) AS next_month_forecast, round(m, 4) AS avg_monthly_demand,
           round(sd, 4) AS demand_std, round(lead, 4) AS lead_time_days, round(cost, 4) AS avg_item_cost FROM stock_inputs""")
def _(t):
    return rounded(stock_inputs(t))


@query("h01_safety_stock", "SELECT category, round(s0, 4) AS safety_stock FROM stock")
def _(t):
    safe = H.safety_stock(F.col("avg_monthly_demand"), F.col("demand_std"), F.col("lead_time_days"))
    return stock_inputs(t).select("category", F.round(safe, 4).alias("safety_stock"))


@query("h02_reorder_point", "SELECT category, round(m * lead / 30 + s0, 4) AS reorder_point FROM stock")
def _(t):
    mean, lead = F.col("avg_monthly_demand"), F.col("lead_time_days")
    point = H.reorder_point(mean, H.safety_stock(mean, F.col("demand_std"), lead), lead)
    return stock_inputs(t).select("category", F.round(point, 4).alias("reorder_point"))


@query("h03_bounded_forecast", "SELECT category, round(f, 4) AS forecast, round(g, 4) AS growth_rate FROM stock")
def _(t):
    mean = F.col("avg_monthly_demand")
    held = H.bounded_forecast(F.col("next_month_forecast"), mean)
    return stock_inputs(t).select("category", F.round(held, 4).alias("forecast"),
                                  F.round(H.growth_of(held, mean), 4).alias("growth_rate"))


@query("h04_growth_adjusted", "SELECT category, round(safety, 6) AS safety_stock FROM stock")
def _(t):
    return rounded(recommended(t).select("category", "safety_stock"), 6)


@query("h05_order_quantity", """
    SELECT category, round(order_quantity, 4) AS order_quantity, round(days_between_orders, 4) AS days_between_orders
    FROM recommended""")
def _(t):
    return recommended(t).select("category", R("order_quantity"), R("days_between_orders"))


_RECOMMENDED = ("avg_monthly_demand", "safety_stock", "reorder_point", "next_month_forecast", "forecast_demand",
                "growth_rate", "lead_time_days", "order_quantity", "days_between_orders", "avg_item_cost")


@query("h06_recommendations", "SELECT product_category, category, adjusted_for_growth, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _RECOMMENDED) + " FROM recommended")
def _(t):
    return rounded(recommended(t), 6)


add_view("thin_report", """
    SELECT series AS category, avg(forecast) AS forecast_demand, any_value(mape) - 25 AS growth_rate FROM cat_moving GROUP BY 1""")


@query("h07_recommend_from_report", """
    WITH h AS (SELECT product_category_name AS c, avg("count") AS m FROM demand GROUP BY 1),
         p AS (SELECT product_category_name AS c, avg(price) AS cost FROM unified GROUP BY 1),
         a AS (SELECT r.category, h.m, r.forecast_demand AS f, r.growth_rate AS g, cost,
                      greatest(1.645E0 * h.m * 0.3E0 * sqrt(7.0E0 / 30), h.m * 0.3E0) AS safety
               FROM thin_report r JOIN h ON r.category = h.c JOIN p ON r.category = p.c)
    SELECT category AS product_category, category, round(m, 6) AS avg_monthly_demand, round(safety, 6) AS safety_stock,
           round(m * 7.0E0 / 30 + safety, 6) AS reorder_point, round(f, 6) AS next_month_forecast,
           round(f, 6) AS forecast_demand, round(g, 6) AS growth_rate, 7.0E0 AS lead_time_days,
           round(365 / (m * 12 / sqrt(2 * m * 12 * 50 / (cost * 0.2E0))), 6) AS days_between_orders,
           round(cost, 6) AS avg_item_cost FROM a""")
def _(t):
    forecast = P.moving_average(P.series_profile(category_series(t)))
    thin = forecast.groupBy(F.col("series").alias("category")).agg(
        F.avg("forecast").alias("forecast_demand"), (F.max("mape") - 25).alias("growth_rate"))
    return rounded(H.recommend_from_report(thin, product_lines(t)), 6)


@query("h08_backfill", """
    SELECT category, category AS product_category, round(m, 6) AS avg_monthly_demand, round(m * 0.3E0, 6) AS safety_stock,
           round(m + m * 0.3E0, 6) AS reorder_point FROM stock""")
def _(t):
    bare = stock_inputs(t).select("category", "avg_monthly_demand")
    return rounded(H.backfill(bare), 6)


@query("h09_lead_time_demand", """
    SELECT category AS name, round(safety_stock, 6) AS safety_stock,
           round(greatest(reorder_point - safety_stock, 0.0E0), 6) AS lead_time_demand,
           round(next_month_forecast, 6) AS next_month_forecast FROM recommended""")
def _(t):
    return rounded(H.lead_time_demand(recommended(t)), 6)


add_view("prioritised", """
    SELECT category, growth_rate, CASE WHEN growth_rate > 10 THEN 'High' WHEN growth_rate > 0 THEN 'Medium' ELSE 'Low' END AS priority,
           CASE WHEN growth_rate > 10 THEN 'Increase safety stock by ' || CAST(CAST(floor(growth_rate + 0.5) AS BIGINT) AS VARCHAR) || '%'
                WHEN growth_rate > 5 THEN 'Maintain elevated safety stock levels'
                WHEN growth_rate > 0 THEN 'Maintain current safety stock levels' ELSE 'Consider reducing safety stock' END AS recommendation,
           CASE WHEN growth_rate > 10 THEN 'High growth category requires additional inventory to prevent stockouts.'
                WHEN growth_rate > 0 THEN 'Moderate growth category indicates stable demand.'
                ELSE 'Declining demand suggests reducing inventory investment.' END AS explanation FROM wild_report""")


@query("h10_priority", "SELECT category, priority, recommendation, explanation FROM prioritised")
def _(t):
    return H.with_priority(wild_report(t)).select("category", "priority", "recommendation", "explanation")


@query("d22_priority_counts", """SELECT priority, count(*) AS "count" FROM prioritised GROUP BY 1""")
def _(t):
    return H.priority_counts(wild_report(t))


@query("t04_largest_recommendations", """
    SELECT product_category, round(reorder_point, 4) AS reorder_point FROM recommended
    ORDER BY recommended.reorder_point DESC, product_category LIMIT 3""")
def _(t):
    return H.largest_recommendations(recommended(t), 3).select("product_category", R("reorder_point"))


add_view("summary_rows", """
    SELECT 1 AS position, 'Total Orders' AS metric, (SELECT count(*)::DOUBLE FROM sc_orders) AS "value", '' AS a, '' AS z, 0 AS d
    UNION ALL SELECT 2, 'Total Products', (SELECT count(*)::DOUBLE FROM sc_products), '', '', 0
    UNION ALL SELECT 3, 'Total Sellers', (SELECT count(DISTINCT seller_id)::DOUBLE FROM unified), '', '', 0
    UNION ALL SELECT 4, 'Average Order Value', (SELECT avg(price) FROM unified), '$', '', 2
    UNION ALL SELECT 5, 'Average Processing Time', (SELECT avg(processing_time) FROM unified), '', ' days', 2
    UNION ALL SELECT 6, 'Average Delivery Days', (SELECT avg(delivery_days) FROM unified), '', ' days', 2
    UNION ALL SELECT 7, 'On-Time Delivery Rate', (SELECT avg(on_time_delivery) * 100 FROM unified), '', '%', 2
    UNION ALL SELECT 8, 'Forecast Accuracy (Avg MAPE)', (SELECT avg(mape) FROM report), '', '%', 2""")
add_view("summary_text", """
    SELECT position, metric, "value", a || CASE WHEN d = 0 THEN CAST(CAST("value" AS BIGINT) AS VARCHAR)
           ELSE CAST(CAST(round("value", 2) AS DECIMAL(20,2)) AS VARCHAR) END || z AS formatted FROM summary_rows""")


def summary(t):
    return M.performance_summary(order_lines(t), t.orders, t.products, report(t))


@query("d11_performance_summary", """
    SELECT CAST(position AS INT) AS position, metric, round("value", 4) AS "value", formatted FROM summary_text""")
def _(t):
    return rounded(summary(t))


@query("b25_parse_metric", """
    SELECT metric, round(CASE WHEN position <= 3 THEN "value" ELSE round("value", 2) END, 4) AS parsed FROM summary_text""")
def _(t):
    return summary(t).select("metric", F.round(M.parse_metric("formatted"), 4).alias("parsed"))


@query("d15_summary_kpis", """
    SELECT round(max("value") FILTER (position = 5), 2) AS avg_processing_time,
           round(max("value") FILTER (position = 6), 2) AS avg_delivery_days,
           round(max("value") FILTER (position = 7), 2) AS on_time_delivery, max("value") FILTER (position = 1) AS total_orders,
           max("value") FILTER (position = 2) AS total_products, round(max("value") FILTER (position = 4), 2) AS average_order_value,
           round(max("value") FILTER (position = 8), 2) AS forecast_accuracy FROM summary_rows""")
def _(t):
    return M.summary_kpis(summary(t))


@query("d15_kpis", """
    SELECT round((SELECT avg(avg_processing_time) FROM sellers), 4) AS avg_processing_time,
           round((SELECT avg(growth_rate) FROM report), 4) AS forecast_growth,
           (SELECT CAST(sum("count") AS BIGINT) FROM demand) AS total_demand,
           round((SELECT avg(on_time_delivery_rate) FROM sellers), 4) AS on_time_delivery,
           round((SELECT avg(on_time_delivery_rate) FROM sellers) * 0.9E0, 4) AS perfect_order_rate,
           8.0E0 AS inventory_turnover,
           round((SELECT sum(total_sales) / sum(order_count) FROM sellers), 4) AS average_order_value,
           round((SELECT 100 - least(avg(mape), 100.0E0) FROM report), 4) AS forecast_accuracy,
           'on_time_delivery,perfect_order_rate,inventory_turnover' AS estimated_fields""")
def _(t):
    return rounded(M.kpis(D.monthly_demand(product_lines(t)), sellers(t), report(t)))


@query("d16_growth_kpi", """
    SELECT round(avg(least(greatest(growth_rate, -80.0E0), 100.0E0)), 4) AS growth FROM wild_report""")
def _(t):
    return rounded(M.growth_kpi(wild_report(t)))


@query("d27_summary_report", """
    WITH tops AS (SELECT product_category_name AS c, CAST(sum("count") AS BIGINT) AS n,
                         row_number() OVER (ORDER BY sum("count") DESC, product_category_name) AS i FROM demand GROUP BY 1),
         best AS (SELECT *, row_number() OVER (ORDER BY reorder_point DESC, product_category) AS i FROM recommended),
         u AS (SELECT count(DISTINCT order_id) AS o, count(DISTINCT product_id) AS p, count(DISTINCT customer_id) AS c,
                      CAST(CAST(round(avg(processing_time), 2) AS DECIMAL(20,2)) AS VARCHAR) AS pt,
                      CAST(CAST(round(avg(delivery_days), 2) AS DECIMAL(20,2)) AS VARCHAR) AS dd,
                      CAST(CAST(round(avg(on_time_delivery) * 100, 2) AS DECIMAL(20,2)) AS VARCHAR) AS ot,
                      CAST(CAST(round(avg(on_time_delivery) * 95, 2) AS DECIMAL(20,2)) AS VARCHAR) AS po FROM unified)
    SELECT 'Dataset Summary' AS section, 1 AS position, '- Total Orders: ' || o AS line FROM u
    UNION ALL SELECT 'Dataset Summary', 2, '- Total Products: ' || p FROM u
    UNION ALL SELECT 'Dataset Summary', 3, '- Total Customers: ' || c FROM u
    UNION ALL SELECT 'Top Product Categories by Demand', CAST(i AS INT), i || '. ' || c || ': ' || n || ' orders' FROM tops WHERE i <= 10
    UNION ALL SELECT 'Seller Performance Analysis', prediction + 1, '- ' || performance || ' Performers: ' || count(*) || ' sellers ('
        || CAST(CAST(round(count(*) * 100.0E0 / (SELECT count(*) FROM tiered), 1) AS DECIMAL(10,1)) AS VARCHAR) || '%)'
        FROM tiered GROUP BY prediction, performance
    UNION ALL SELECT 'Inventory Recommendations', CAST(i AS INT), '- ' || product_category || ': Reorder at '
        || CAST(floor(reorder_point) AS BIGINT) || ' units, Safety stock: ' || CAST(floor(safety_stock) AS BIGINT)
        || ' units, Growth rate: ' || CAST(CAST(round(growth_rate, 1) AS DECIMAL(20,1)) AS VARCHAR) || '%' FROM best WHERE i <= 5
    UNION ALL SELECT 'Supply Chain Performance Metrics', 1, '- Average Processing Time: ' || pt || ' days' FROM u
    UNION ALL SELECT 'Supply Chain Performance Metrics', 2, '- Average Delivery Time: ' || dd || ' days' FROM u
    UNION ALL SELECT 'Supply Chain Performance Metrics', 3, '- On-Time Delivery Rate: ' || ot || '%' FROM u
    UNION ALL SELECT 'Supply Chain Performance Metrics', 4, '- Perfect Order Rate: ' || po || '%' FROM u""")
def _(t):
    # The joined lines are written down once; months and sellers are read off that.
    all_lines = pinned(lines(t).select(
        "order_id", "order_item_id", "product_id", "customer_id", "seller_id", "product_category_name", "order_year", "order_month",
        "price", "shipping_charges", "processing_time", "delivery_days", "on_time_delivery"))
    return M.summary_report(all_lines, D.monthly_demand(all_lines), S.tier_sellers(S.seller_metrics(all_lines)), recommended(t),
                            M.line_performance(all_lines))
