"""Monthly series per sub-category, and per product where natural gaps occur."""

from pyspark.sql import functions as F

from harborline.operators import demand as D
from harborline.operators import series as S

from .base import query
from .demand import finished_lines
from .intake import R, order_lines, product_lines
from .views import add_view


def series(t):
    """Demand per sub-category and month without the unfinished last month."""
    return S.as_series(D.monthly_demand(finished_lines(t), "product_subcategory"), "product_subcategory")


def product_series(t):
    """Demand per product and month: sparse, with gaps inside."""
    return S.as_series(D.monthly_demand(order_lines(t), "product_id"), "product_id")


def seller_series(t):
    """Sales per seller and month."""
    sales = D.monthly_sales(order_lines(t), "seller_id").withColumn("date", F.make_date("order_year", "order_month", F.lit(1)))
    return S.as_series(sales, "seller_id", "total_sales")


def text(df, *columns):
    """Months as text, doubles rounded."""
    chosen = columns or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[
        F.date_format(c, "yyyy-MM-dd").alias(c) if kinds[c] == "date" else R(c) if kinds[c] == "double" else F.col(c)
        for c in chosen])


add_view("product_series", """
    SELECT product_id AS series, make_date(order_year, order_month, 1) AS "month", CAST(count(*) AS DOUBLE) AS y
    FROM unified GROUP BY ALL""")
add_view("seller_series", """
    SELECT seller_id AS series, make_date(order_year, order_month, 1) AS "month", sum(price) AS y
    FROM unified GROUP BY ALL""")
add_view("product_calendar", """
    SELECT c.series, c."month", s.y FROM (SELECT series, CAST(unnest(generate_series(CAST(min("month") AS TIMESTAMP),
           CAST(max("month") AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS "month" FROM product_series GROUP BY 1) c
    LEFT JOIN product_series s ON c.series = s.series AND c."month" = s."month" """)


@query("f01_fill_linear", """
    WITH p AS (SELECT *, row_number() OVER w AS i FROM product_calendar WINDOW w AS (PARTITION BY series ORDER BY "month")),
         q AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS ya, first_value(y IGNORE NULLS) OVER b AS yb,
                      last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia,
                      first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib FROM p
               WINDOW a AS (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      b AS (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, strftime("month", '%Y-%m-%d') AS "month",
           round(CASE WHEN y IS NOT NULL THEN y ELSE ya + (yb - ya) * (i - ia) / (ib - ia) END, 4) AS y FROM q""")
def _(t):
    return text(S.fill_months(product_series(t), "linear"))


@query("f01_fill_zero", """
    SELECT series, strftime("month", '%Y-%m-%d') AS "month", coalesce(y, 0.0E0) AS y FROM product_calendar""")
def _(t):
    return text(S.fill_months(product_series(t), "zero"))


@query("f01_fill_neighbours", """
    SELECT series, strftime("month", '%Y-%m-%d') AS "month",
           last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY "month"
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
           first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY "month"
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
           round(coalesce(y, avg(y) OVER (PARTITION BY series)), 4) AS mean FROM product_calendar""")
def _(t):
    base = product_series(t)
    ways = {m: S.fill_months(base, m).withColumnRenamed("y", m) for m in ("ffill", "bfill", "mean")}
    out = ways["ffill"].join(ways["bfill"], ["series", "month"]).join(ways["mean"], ["series", "month"])
    return text(out)


add_view("bounds", """
    SELECT s.*, greatest(q1 - 2 * (q3 - q1), m - 3 * sd) AS lo, least(q3 + 2 * (q3 - q1), m + 3 * sd) AS hi, n
    FROM seller_series s JOIN (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, avg(y) AS m,
                                      stddev_samp(y) AS sd, count(*) AS n FROM seller_series GROUP BY 1) b
    ON s.series = b.series""")


@query("f02_repair_outliers", """
    WITH k AS (SELECT *, y BETWEEN lo AND hi AS inside, CASE WHEN y BETWEEN lo AND hi THEN y END AS kept FROM bounds),
         r AS (SELECT *, median(kept) OVER (PARTITION BY series ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
                      AS near, median(kept) OVER (PARTITION BY series) AS overall FROM k)
    SELECT series, strftime("month", '%Y-%m-%d') AS "month",
           round(CASE WHEN n >= 4 AND NOT inside THEN coalesce(near, overall) ELSE y END, 4) AS y,
           n >= 4 AND NOT inside AS repaired FROM r""")
def _(t):
    return text(S.repair_outliers(seller_series(t)))


add_view("posed", """
    SELECT series, "month", y, row_number() OVER (PARTITION BY series ORDER BY "month") - 1 AS pos,
           count(*) OVER (PARTITION BY series) AS n FROM series""")
add_view("acf", """
    SELECT a.series, a.n, l.lag, corr(a.y, b.y) AS acf FROM posed a
    CROSS JOIN (SELECT unnest(range(1, 37)) AS lag) l
    JOIN posed b ON a.series = b.series AND b.pos = a.pos + l.lag
    WHERE l.lag <= least(36, a.n // 2 - 1) GROUP BY ALL""")
add_view("waves", """
    SELECT series, n, k, sqrt(pow(sum(c * cos(2 * pi() * k * pos / n)), 2) + pow(sum(c * sin(2 * pi() * k * pos / n)), 2)) AS size
    FROM (SELECT *, y - avg(y) OVER (PARTITION BY series) AS c, unnest(range(1, n // 2)) AS k FROM posed)
    GROUP BY ALL""")
add_view("spectrum", """
    SELECT series, n, k, size / sum(size) OVER (PARTITION BY series) AS power FROM waves""")


@query("f03_autocorrelation", "SELECT series, n, CAST(lag AS INT) AS lag, round(acf, 4) AS acf FROM acf")
def _(t):
    return text(S.autocorrelations(series(t)))


@query("f04_periodogram", "SELECT series, n, k, round(power, 4) AS power FROM spectrum")
def _(t):
    return text(S.periodogram(series(t)).withColumn("k", F.col("k").cast("long")))


_TWO_SIDES = " AND ".join(f"{{v}} > {f}({{v}}, {i}) OVER (PARTITION BY series ORDER BY {{o}})"
                           for f in ("lag", "lead") for i in (1, 2))


@query("f05_seasonality", f"""
    WITH pa AS (SELECT series, CAST(lag AS INT) AS period, acf * 0.6E0 AS e FROM acf
                QUALIFY acf > 0.3 AND {_TWO_SIDES.format(v='acf', o='lag')}),
         ps AS (SELECT series, CAST(round(n / k) AS INT) AS period, power * 0.4E0 AS e FROM spectrum
                QUALIFY power > 0.05 AND {_TWO_SIDES.format(v='power', o='k')}),
         f AS (SELECT series, period, sum(e) AS e FROM (SELECT * FROM pa UNION ALL SELECT * FROM ps) GROUP BY ALL),
         b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY e DESC, period) = 1),
         s AS (SELECT DISTINCT series, n FROM posed)
    SELECT s.series, n >= 24 AND e IS NOT NULL AS is_seasonal,
           CAST(CASE WHEN n < 24 OR e IS NULL THEN 12 WHEN period BETWEEN 11 AND 13 THEN 12 WHEN period BETWEEN 3 AND 4 THEN 4
                WHEN period BETWEEN 6 AND 7 THEN 7 WHEN period BETWEEN 51 AND 53 THEN 52 ELSE period END AS INT) AS period,
           round(CASE WHEN n < 24 OR e IS NULL THEN 0.0E0 WHEN period BETWEEN 11 AND 13 THEN e * 0.9E0
                      WHEN period BETWEEN 3 AND 4 THEN e * 0.8E0 WHEN period BETWEEN 6 AND 7 THEN e * 0.7E0
                      WHEN period BETWEEN 51 AND 53 THEN e * 0.85E0 ELSE e * 0.5E0 END, 4) AS confidence
    FROM s LEFT JOIN b ON s.series = b.series""")
def _(t):
    return text(S.detect_seasonality(series(t)))


def _decomposition(multiplicative: bool) -> str:
    loose = "y / trend" if multiplicative else "y - trend"
    seasonal = "m / level" if multiplicative else "m - level"
    residual = "y / seasonal / trend" if multiplicative else "loose - seasonal"
    adjusted = "y / seasonal" if multiplicative else "y - seasonal"
    return f"""
    WITH c AS (SELECT *, CASE WHEN pos BETWEEN 6 AND n - 7 THEN
                  (sum(y) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
                   - (lag(y, 6) OVER (PARTITION BY series ORDER BY pos) + lead(y, 6) OVER (PARTITION BY series ORDER BY pos))
                     / 2) / 12 END AS t FROM posed WHERE n >= 24),
         e AS (SELECT series, regr_slope(t, pos) FILTER (pos < least(18, n - 7)) AS hs,
                      regr_intercept(t, pos) FILTER (pos < least(18, n - 7)) AS hi,
                      regr_slope(t, pos) FILTER (pos < n - 7 AND pos >= greatest(6, n - 19)) AS ts,
                      regr_intercept(t, pos) FILTER (pos < n - 7 AND pos >= greatest(6, n - 19)) AS ti FROM c GROUP BY 1),
         d AS (SELECT c.*, pos % 12 AS phase, CASE WHEN pos < 6 THEN hs * pos + hi WHEN pos > n - 7 THEN ts * pos + ti
                      ELSE t END AS trend FROM c JOIN e ON c.series = e.series),
         l AS (SELECT *, {loose} AS loose FROM d),
         p AS (SELECT series, phase, avg(loose) AS m FROM l GROUP BY ALL),
         v AS (SELECT series, avg(m) AS level FROM p GROUP BY 1),
         s AS (SELECT l.*, {seasonal} AS seasonal FROM l JOIN p ON l.series = p.series AND l.phase = p.phase
               JOIN v ON l.series = v.series)
    SELECT series, strftime("month", '%Y-%m-%d') AS "month", CAST(phase AS INT) AS phase, round(trend, 4) AS trend,
           round(seasonal, 4) AS seasonal, round({residual}, 4) AS residual, round({adjusted}, 4) AS adjusted FROM s"""


@query("f06_decompose_additive", _decomposition(False))
def _(t):
    return text(S.decompose(series(t)), "series", "month", "phase", "trend", "seasonal", "residual", "adjusted")


@query("f06_decompose_multiplicative", _decomposition(True))
def _(t):
    return text(S.decompose(series(t), multiplicative=True), "series", "month", "phase", "trend", "seasonal",
                "residual", "adjusted")


@query("f06_seasonal_pattern", f"""
    SELECT series, phase, round(avg(seasonal), 4) AS seasonal_factor FROM ({_decomposition(False)}) GROUP BY ALL""")
def _(t):
    return text(S.seasonal_pattern(S.decompose(series(t))))


def _crit(level: str) -> str:
    b = S.CRITICAL_VALUES[level]
    return f"({b[0]} + {b[1]} / obs + {b[2]} / (obs * obs) + {b[3]} / (obs * obs * obs))"


add_view("fuller", """
    SELECT series, count(*) AS n, regr_count(dy, x)::BIGINT AS obs, regr_slope(dy, x) AS slope, regr_sxx(dy, x) AS sxx,
           regr_syy(dy, x) - regr_slope(dy, x) * regr_sxy(dy, x) AS sse
    FROM (SELECT *, lag(y) OVER w AS x, y - lag(y) OVER w AS dy FROM series
          WINDOW w AS (PARTITION BY series ORDER BY "month")) GROUP BY 1""")


@query("f07_stationarity", f"""
    SELECT series, obs AS observations, round(slope / (sqrt(sse / (obs - 2)) / sqrt(sxx)), 4) AS statistic,
           round({_crit('1%')}, 4) AS critical_1, round({_crit('5%')}, 4) AS critical_5,
           round({_crit('10%')}, 4) AS critical_10,
           slope / (sqrt(sse / (obs - 2)) / sqrt(sxx)) < {_crit('5%')} AS is_stationary, '' AS error FROM fuller""")
def _(t):
    return text(S.stationarity(series(t)))


# Per series and number of lags: the regression's columns (level, earlier steps, step), centred, on rows from `start` on,
# their cross products, and those after elimination. The first fit compares lags on equal rows, the second uses all rows.
_FITS = """SELECT * FROM (
    WITH RECURSIVE a AS (
        SELECT series, list(y ORDER BY "month") AS y, count(*) AS n,
               CAST(greatest(0, least(ceil(12.0E0 * pow(count(*) / 100.0E0, 0.25)), count(*) // 2 - 2)) AS INT) AS most
        FROM series GROUP BY 1),
    b AS (SELECT *, list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS dy FROM a WHERE n >= 4),
    c AS (SELECT *, unnest(range(0, most + 1)) AS lags FROM b),
    d AS (SELECT series, lags, most AS start, y, dy FROM c UNION ALL SELECT series, lags, lags, y, dy FROM c WHERE lags <> most),
    e AS (SELECT series, lags, start, len(dy) - start AS obs, list_concat([y[start + 1 : len(dy)]],
                 list_transform(range(1, lags + 1), lambda j: dy[start + 1 - j : len(dy) - j]), [dy[start + 1 : len(dy)]]) AS z
          FROM d WHERE len(dy) - start > lags + 2),
    g AS (SELECT series, lags, start, obs,
                 list_transform(z, lambda u: list_transform(z, lambda v:
                     list_sum(list_transform(list_zip(u, v), lambda p: p[1] * p[2])))) AS g
          FROM (SELECT * REPLACE (list_transform(z, lambda u: list_transform(u, lambda x: x - list_avg(u))) AS z) FROM e)),
    s AS (SELECT *, 1 AS k FROM g UNION ALL
          SELECT series, lags, start, obs, list_transform(range(1, lags + 3), lambda i: list_transform(range(1, lags + 3), lambda j:
                     CASE WHEN i = k AND j = k THEN 1 / g[k][k] WHEN i = k THEN g[k][j] / g[k][k]
                          WHEN j = k THEN -g[i][k] / g[k][k] ELSE g[i][j] - g[i][k] * g[k][j] / g[k][k] END)), k + 1
          FROM s WHERE k <= lags + 1),
    f AS (SELECT series, lags, start, obs, g[1][lags + 2] AS slope, g[1][1] AS factor, g[lags + 2][lags + 2] AS sse
          FROM s WHERE k = lags + 2),
    best AS (SELECT f.series, f.lags FROM f JOIN a ON f.series = a.series AND f.start = a.most
             QUALIFY row_number() OVER (PARTITION BY f.series ORDER BY obs * ln(sse / obs) + 2 * (f.lags + 2), f.lags) = 1),
    r AS (SELECT f.*, slope / sqrt(sse / (obs - lags - 2) * factor) AS t FROM f JOIN best USING (series, lags)
          WHERE f.start = f.lags)"""


@query("f07_stationarity_augmented", _FITS + f"""
    SELECT series, CAST(lags AS INT) AS lags, CAST(obs AS BIGINT) AS observations, round(t, 4) AS statistic,
           round({_crit('1%')}, 4) AS critical_1, round({_crit('5%')}, 4) AS critical_5,
           round({_crit('10%')}, 4) AS critical_10, t < {_crit('5%')} AS is_stationary FROM r)""")
def _(t):
    return text(S.augmented_stationarity(series(t)))


_PLOT_ACF = """
    WITH d AS (SELECT s.series, s."month", CASE WHEN slope / (sqrt(sse / (obs - 2)) / sqrt(sxx)) < """ + _crit("5%") + """
                      THEN y ELSE y - lag(y) OVER (PARTITION BY s.series ORDER BY "month") END AS y
               FROM series s JOIN fuller f ON s.series = f.series),
         c AS (SELECT series, y - avg(y) OVER (PARTITION BY series) AS c, count(*) OVER (PARTITION BY series) AS n,
                      row_number() OVER (PARTITION BY series ORDER BY "month") AS pos FROM d WHERE y IS NOT NULL),
         v AS (SELECT series, sum(c * c) AS v FROM c GROUP BY 1)
    SELECT a.series, a.n, CAST(lag AS INT) AS lag, sum(a.c * b.c) / any_value(v.v) AS acf
    FROM c a CROSS JOIN (SELECT unnest(range(0, 25)) AS lag) l
    JOIN c b ON a.series = b.series AND b.pos = a.pos + l.lag JOIN v ON a.series = v.series
    WHERE lag <= least(24, a.n // 2 - 1) GROUP BY ALL"""


@query("f08_plot_acf", f"SELECT * REPLACE (round(acf, 4) AS acf) FROM ({_PLOT_ACF})")
def _(t):
    return text(S.plot_autocorrelations(S.stationary_part(series(t)).drop("is_differenced")))


@query("f08_plot_pacf", f"""SELECT * FROM (
    WITH RECURSIVE r AS (SELECT series, list(acf ORDER BY lag) AS r FROM ({_PLOT_ACF}) GROUP BY 1),
    w AS (SELECT series, r, 0 AS lag, CAST([] AS DOUBLE[]) AS phi, 1.0E0 AS pacf FROM r UNION ALL
          SELECT series, r, lag, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda p: p[1] - last * p[2]), last), last
          FROM (SELECT series, r, lag + 1 AS lag, phi,
                       (r[lag + 2] - coalesce(list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[lag + 2 - i])), 0))
                       / (1 - coalesce(list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[i + 1])), 0)) AS last
                FROM w WHERE lag + 1 < len(r)))
    SELECT series, lag, round(pacf, 4) AS pacf FROM w)""")
def _(t):
    acf = S.plot_autocorrelations(S.stationary_part(series(t)).drop("is_differenced"))
    return text(S.partial_autocorrelations(acf))


@query("f09_split_in_time", """
    SELECT series, strftime("month", '%Y-%m-%d') AS "month", y,
           CASE WHEN pos < floor(0.8E0 * n) THEN 'train' ELSE 'test' END AS part FROM posed""")
def _(t):
    return text(S.split_in_time(series(t)), "series", "month", "y", "part")


@query("e09_recent_means", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY "month" DESC) AS r FROM series)
    SELECT series, count(*) AS n, round(avg(y) FILTER (r <= 6), 4) AS recent_mean,
           round(avg(y) FILTER (r <= 3), 4) AS last3_mean, round(avg(y) FILTER (r BETWEEN 4 AND 6), 4) AS prior3_mean
    FROM r GROUP BY 1""")
def _(t):
    return text(S.recent_means(series(t)))


@query("a11_array_json", """
    SELECT product_category_name, to_json(list(CAST("count" AS DOUBLE) ORDER BY "date")) AS forecast_values,
           CAST(sum("count") AS DOUBLE) AS total FROM demand GROUP BY 1""")
def _(t):
    from harborline.sources.runstore import decode_arrays, encode_arrays

    nested = D.nested_series(D.monthly_demand(product_lines(t))).select(
        "product_category_name",
        F.transform("points", lambda p: p["count"].cast("double")).alias("forecast_values"))
    back = decode_arrays(encode_arrays(nested))
    total = F.aggregate("forecast_values", F.lit(0.0), lambda a, x: a + x)
    return encode_arrays(back.withColumn("total", total))


def category_demand(t):
    """Monthly demand per category without the unfinished last month."""
    return D.monthly_demand(finished_lines(t))
