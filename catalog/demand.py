"""Monthly demand, states, and datasets' metrics."""

from pyspark.sql import functions as F

from harborline.operators import demand as D
from harborline.operators import geography as G
from harborline.operators import metrics as M
from harborline.operators import orders as O

from .base import query
from .intake import R, lines, order_lines, product_lines, state_lines
from .views import add_view


def demand(t):
    return D.monthly_demand(product_lines(t))


def finished_lines(t):
    """Order lines with their categories without those of an unfinished last month."""
    return product_lines(t).where(F.to_date("order_purchase_timestamp") < D.finished_until(t.orders))


@query("d30_finished_months", """
    SELECT product_category_name, make_date(order_year, order_month, 1)::VARCHAR AS "date", count(*) AS "count"
    FROM unified WHERE product_category_name IS NOT NULL
                   AND order_purchase_timestamp < (SELECT day FROM finished_until) GROUP BY ALL""")
def _(t):
    return D.monthly_demand(finished_lines(t)).select(
        "product_category_name", F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


@query("d01_monthly_demand", """
    SELECT product_category_name, order_year::INT AS order_year, order_month::INT AS order_month, "count",
           strftime("date", '%Y-%m-%d') AS "date" FROM demand""")
def _(t):
    return demand(t).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("d02_monthly_sales", """
    SELECT product_category_name, order_year::INT AS order_year, order_month::INT AS order_month,
           "count" AS order_count, round(total_sales, 4) AS total_sales FROM demand""")
def _(t):
    return D.monthly_sales(product_lines(t)).withColumn("total_sales", R("total_sales"))


@query("d03_state_metrics", """
    SELECT customer_state, order_count, round(avg_processing_time, 4) AS avg_processing_time,
           round(avg_delivery_days, 4) AS avg_delivery_days, round(total_sales, 4) AS total_sales,
           round(on_time_delivery_rate, 4) AS on_time_delivery_rate FROM states""")
def _(t):
    return G.state_metrics(state_lines(t)).select("customer_state", "order_count", R("avg_processing_time"),
                                            R("avg_delivery_days"), R("total_sales"), R("on_time_delivery_rate"))


@query("d03_state_metrics_half", """
    SELECT c.customer_state, count(*) AS order_count,
           round(avg(CASE WHEN o.order_delivered_timestamp IS NULL OR o.order_estimated_delivery_date IS NULL THEN 0.5E0
                          WHEN o.order_delivered_timestamp <= o.order_estimated_delivery_date THEN 1.0E0
                          ELSE 0.0E0 END), 4) AS on_time_delivery_rate
    FROM sc_orders_gaps o JOIN sc_items i ON o.order_id = i.order_id
    LEFT JOIN sc_customers c ON o.customer_id = c.customer_id GROUP BY 1""")
def _(t):
    from harborline.operators.unify import unified_lines

    gaps = unified_lines(O.derive_order_columns(t.orders_gaps), t.items, t.products, t.customers)
    return G.state_metrics(gaps, "half").select("customer_state", "order_count", R("on_time_delivery_rate"))


add_view("state_categories", """
    SELECT customer_state, product_category_name, count(*) AS order_count FROM unified
    WHERE product_category_name IS NOT NULL GROUP BY ALL""")


@query("d04_category_by_state", "SELECT * FROM state_categories")
def _(t):
    return G.category_by_state(lines(t))


@query("e01_top_category_ties", """
    SELECT customer_state, product_category_name, order_count FROM state_categories
    QUALIFY rank() OVER (PARTITION BY customer_state ORDER BY order_count DESC) = 1""")
def _(t):
    return G.top_category_by_state(G.category_by_state(lines(t)))


@query("e01_top_category_first", """
    SELECT customer_state, product_category_name, order_count FROM state_categories
    QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY order_count DESC, product_category_name) = 1""")
def _(t):
    return G.top_category_by_state(G.category_by_state(lines(t)), "first")


@query("c04_states_with_top_category", """
    WITH top AS (SELECT * FROM state_categories
                 QUALIFY row_number() OVER (PARTITION BY customer_state
                                            ORDER BY order_count DESC, product_category_name) = 1)
    SELECT s.customer_state, s.order_count, round(s.total_sales, 4) AS total_sales,
           top.product_category_name AS top_category, top.order_count AS top_category_orders
    FROM states s LEFT JOIN top ON s.customer_state = top.customer_state""")
def _(t):
    all_lines = lines(t)
    top = G.top_category_by_state(G.category_by_state(all_lines), "first")
    return G.states_with_top_category(G.state_metrics(all_lines), top).select(
        "customer_state", "order_count", R("total_sales"), "top_category", "top_category_orders")


@query("t01_top_categories", """
    SELECT product_category_name, CAST(sum("count") AS BIGINT) AS total_count FROM demand GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return D.top_categories(demand(t))


@query("t02_top_states", """
    SELECT customer_state, order_count FROM states ORDER BY order_count DESC, customer_state LIMIT 10""")
def _(t):
    return G.leading_states(G.state_metrics(state_lines(t))).select("customer_state", "order_count")


@query("t02_fastest_states", """
    SELECT customer_state, round(avg_delivery_days, 4) AS avg_delivery_days FROM states
    ORDER BY states.avg_delivery_days, customer_state LIMIT 10""")
def _(t):
    return G.fastest_states(G.state_metrics(state_lines(t))).select("customer_state", R("avg_delivery_days"))


@query("t05_busiest_categories", """
    SELECT product_category_name, count(*) AS active_months FROM demand GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(t):
    return D.busiest_categories(demand(t))


@query("d07_line_performance", """
    SELECT round(avg(processing_time), 4) AS avg_processing_time, round(avg(delivery_days), 4) AS avg_delivery_days,
           round(avg(on_time_delivery) * 100, 4) AS on_time_delivery_rate,
           round(avg(on_time_delivery) * 95, 4) AS perfect_order_rate,
           round(sum(price) / count(DISTINCT order_id), 4) AS avg_order_value, 8.0E0 AS inventory_turnover,
           FALSE AS is_estimated FROM unified""")
def _(t):
    out = M.line_performance(order_lines(t))
    return out.select(R("avg_processing_time"), R("avg_delivery_days"), R("on_time_delivery_rate"),
                      R("perfect_order_rate"), R("avg_order_value"), "inventory_turnover", "is_estimated")


add_view("order_sums", """
    SELECT order_id, sum(price) AS price, sum(shipping_charges) AS ship FROM sc_items GROUP BY 1""")
add_view("order_months", """
    SELECT month(order_purchase_timestamp) AS m, count(*) AS n FROM sc_orders GROUP BY 1""")


@query("d08_order_performance", """
    SELECT round(avg(on_time_delivery) * 100, 4) AS on_time_delivery_rate,
           round(avg(processing_time), 4) AS avg_processing_time,
           round(stddev_samp(processing_time), 4) AS processing_time_std,
           round(avg(delivery_days), 4) AS avg_delivery_days, round(stddev_samp(delivery_days), 4) AS delivery_days_std,
           round(avg(on_time_delivery) * 100 * 0.97E0 * 0.99E0, 6) AS perfect_order_rate,
           8.0E0 AS inventory_turnover, 45.625E0 AS days_of_supply, 3.0E0 AS return_rate, '' AS estimated_values,
           (SELECT round(avg(price), 4) FROM order_sums) AS average_order_value,
           (SELECT round(avg(ship) / avg(price) * 100, 4) FROM order_sums) AS shipping_cost_ratio,
           (SELECT CAST(m AS INT) FROM order_months ORDER BY n DESC, m LIMIT 1) AS peak_order_month,
           (SELECT round(max(n) / avg(n), 4) FROM order_months) AS peak_to_average_ratio
    FROM ord""")
def _(t):
    out = M.order_performance(O.derive_order_columns(t.orders), t.items)
    return out.select(*[
        F.array_join(c, ",").alias(c) if c == "estimated_values"
        else F.round(c, 6).alias(c) if c == "perfect_order_rate" else R(c) if dt == "double" else F.col(c)
        for c, dt in out.dtypes])


@query("d08_order_performance_defaults", """
    SELECT 85.0E0 AS on_time_delivery_rate, 1.0E0 AS avg_processing_time, 0.3E0 AS processing_time_std,
           7.0E0 AS avg_delivery_days, 2.0E0 AS delivery_days_std, round(85 * 0.97E0 * 0.99E0, 4) AS perfect_order_rate,
           'on_time_delivery_rate,avg_processing_time,avg_delivery_days' AS estimated_values,
           (SELECT CAST(m AS INT) FROM order_months ORDER BY n DESC, m LIMIT 1) AS peak_order_month""")
def _(t):
    return M.order_performance(t.orders).select(
        "on_time_delivery_rate", "avg_processing_time", "processing_time_std", "avg_delivery_days",
        "delivery_days_std", R("perfect_order_rate"), F.array_join("estimated_values", ",").alias("estimated_values"),
        "peak_order_month")


@query("d09_order_values", """
    SELECT round(avg(price), 4) AS average_order_value, round(avg(ship) / avg(price) * 100, 4) AS shipping_cost_ratio
    FROM order_sums""")
def _(t):
    return M.order_values(t.items).select(R("average_order_value"), R("shipping_cost_ratio"))


@query("d10_order_seasonality", """
    SELECT (SELECT CAST(m AS INT) FROM order_months ORDER BY n DESC, m LIMIT 1) AS peak_order_month,
           (SELECT round(max(n) / avg(n), 4) FROM order_months) AS peak_to_average_ratio""")
def _(t):
    return M.order_seasonality(t.orders).select("peak_order_month", R("peak_to_average_ratio"))


@query("d17_demand_per_month", """
    SELECT strftime("date", '%Y-%m-%d') AS "date", CAST(sum("count") AS BIGINT) AS total,
           count(DISTINCT product_category_name) AS categories FROM demand GROUP BY 1""")
def _(t):
    return D.demand_per_month(demand(t)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("d18_demand_heatmap", "SELECT product_category_name, order_year::INT AS order_year, " + ", ".join(
    f"""coalesce(CAST(sum("count") FILTER (order_month = {m}) AS BIGINT), 0) AS m{m}""" for m in range(1, 13))
    + " FROM demand GROUP BY 1, 2")
def _(t):
    return D.demand_heatmap(demand(t))


@query("d19_category_totals", """
    SELECT product_category_name, CAST(sum("count") AS BIGINT) AS total_demand,
           round(avg("count"), 4) AS avg_monthly_demand, count(*) AS months FROM demand GROUP BY 1""")
def _(t):
    return D.category_totals(demand(t)).withColumn("avg_monthly_demand", R("avg_monthly_demand"))


@query("d20_order_shares", """
    WITH r AS (SELECT customer_state, order_count,
                      row_number() OVER (ORDER BY order_count DESC, customer_state) AS place FROM states)
    SELECT CASE WHEN place <= 5 THEN customer_state ELSE 'Others' END AS name, CAST(sum(order_count) AS BIGINT) AS "value",
           round(sum(order_count) * 100.0E0 / (SELECT sum(order_count) FROM r), 4) AS percentage FROM r GROUP BY 1""")
def _(t):
    return G.order_shares(G.state_metrics(state_lines(t))).withColumn("percentage", R("percentage"))


@query("d21_region_highlights", """
    SELECT (SELECT customer_state FROM states ORDER BY order_count DESC, 1 LIMIT 1) AS most_orders,
           (SELECT customer_state FROM states ORDER BY avg_delivery_days, 1 LIMIT 1) AS fastest_delivery,
           (SELECT customer_state FROM states ORDER BY total_sales DESC, 1 LIMIT 1) AS highest_sales""")
def _(t):
    return G.region_highlights(G.state_metrics(state_lines(t)))


@query("d29_nested_series", """
    SELECT product_category_name, string_agg("count", ',' ORDER BY "date") AS counts, count(*) AS months
    FROM demand GROUP BY 1""")
def _(t):
    nested = D.nested_series(demand(t))
    return nested.select(
        "product_category_name",
        F.array_join(F.transform("points", lambda p: p["count"].cast("string")), ",").alias("counts"),
        F.size("points").cast("long").alias("months"))


@query("e02_month_changes", """
    WITH c AS (SELECT *, lag("count") OVER (PARTITION BY product_category_name ORDER BY "date") AS p FROM demand)
    SELECT product_category_name, strftime("date", '%Y-%m-%d') AS "date", coalesce("count" - p, 0) AS change,
           round(coalesce(("count" - p) / p * 100.0E0, 0.0E0), 4) AS percent_change FROM c""")
def _(t):
    return D.month_changes(demand(t)).select(
        "product_category_name", F.date_format("date", "yyyy-MM-dd").alias("date"), "change", R("percent_change"))


@query("e03_category_growth", """
    WITH n AS (SELECT product_category_name AS c, "count" AS v, count(*) OVER (PARTITION BY product_category_name) AS n,
                      row_number() OVER (PARTITION BY product_category_name ORDER BY "date") AS a,
                      row_number() OVER (PARTITION BY product_category_name ORDER BY "date" DESC) AS b FROM demand),
         e AS (SELECT c, max(n) AS months, avg(v) FILTER (a <= CASE WHEN n >= 6 THEN 3 ELSE 1 END) AS f,
                      avg(v) FILTER (b <= CASE WHEN n >= 6 THEN 3 ELSE 1 END) AS l FROM n GROUP BY c),
         g AS (SELECT *, CASE WHEN months >= 2 AND f > 0 THEN least(greatest((l - f) / f * 100, -99.0E0), 1000.0E0)
                              ELSE 0.0E0 END AS growth FROM e)
    SELECT c AS product_category_name, months, round(f, 4) AS first_value, round(l, 4) AS last_value,
           round(growth, 4) AS growth, CASE WHEN growth > 5 THEN 'up' WHEN growth < -5 THEN 'down' ELSE 'flat' END AS trend
    FROM g""")
def _(t):
    return D.category_growth(demand(t)).select(
        "product_category_name", "months", R("first_value"), R("last_value"), R("growth"), "trend")


@query("b27_thousands_label", """
    SELECT product_category_name, order_year::INT AS order_year, order_month::INT AS order_month,
           CASE WHEN total_sales >= 1000 THEN CAST(CAST(round(total_sales / 1000, 0) AS BIGINT) AS VARCHAR) || 'K'
                ELSE CAST(CAST(round(total_sales, 0) AS BIGINT) AS VARCHAR) END AS label FROM demand""")
def _(t):
    return D.monthly_sales(product_lines(t)).select("product_category_name", "order_year", "order_month",
                                            M.format_thousands("total_sales").alias("label"))
