"""Properties of the physical plans, the whole analysis, and the sources."""

import re

import catalog
import pytest
from pyspark.sql import functions as F

from harborline.operators import demand as D
from harborline.operators import series as Z
from harborline.operators.demand import finished_until
from harborline.operators.orders import missing_stamps, synthesize_stamps
from harborline.plans.analysis import analyse, dashboard, input_checks
from harborline.session import configure, scratch_path
from harborline.sources import runstore as U
from harborline.sources import schemas
from harborline.sources.schemas import CSV_NAMES
from harborline.sources.tables import load_tables, read_table, write_results


def plan(frame, mode="formatted"):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(catalog.QUERIES["d01_monthly_demand"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "c_custkey" not in text


def test_filter_reaches_the_scan(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(
        raw.where("o_orderstatus = 'F'").select("o_orderkey"))


@pytest.mark.parametrize("name", ["d01_monthly_demand", "d02_monthly_sales", "d05_seller_metrics", "c01_unified_lines",
                                  "b07_delivery_days_ladder", "e01_top_category_first", "b02_order_month",
                                  "b15_category_vote", "c06_distance_join", "b16_neighbour_imputation"])
def test_no_python_and_no_product_joins(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert word not in text, word


def test_lines_meet_group_medians_where_they_are(spark, sf_dir):
    text = plan(catalog.QUERIES["b07_delivery_days_ladder"](spark, sf_dir), "simple")
    assert "hashpartitioning(product_category_name" not in text


def test_lines_are_not_gathered_in_one_task(spark, sf_dir):
    """Only the sizes of the ranges meet in a single partition; over a key, rows are summed range by range."""
    from harborline.functions.ranking import with_row_number

    items = catalog.views.Tables(spark, sf_dir).items
    order = [("price", True), ("order_id", True)]
    text = plan(with_row_number(items, order, "rn", buckets=16), "simple")
    assert "Window [row_number()" not in text
    gathered = [line for line in text.splitlines() if "Window [" in line]
    assert gathered and all("sum(__n" in line for line in gathered)
    text = plan(with_row_number(items, order, "rn", ["product_id"], buckets=16), "simple")
    window = [line for line in text.splitlines() if "Window [" in line and "AS __upto" in line]
    assert window and all("windowspecdefinition(product_id" in line and " __b#" in line for line in window)


def test_neighbour_cases_come_from_one_scan(spark, sf_dir, monkeypatch):
    """The missing patterns are spread from one scan of the products on either side, not from a branch per case."""
    from harborline.operators import products

    seen = []
    monkeypatch.setattr(products, "nearest_rows", lambda asked, given, *rest: seen.extend((asked, given)) or kept(asked, given, *rest))
    kept = catalog.products.nearest_rows
    products.impute_by_neighbours(catalog.views.Tables(spark, sf_dir).products_dirty)
    assert seen and all(plan(frame).count("Location:") == 1 for frame in seen)


def test_what_one_task_holds_does_not_follow_the_rows():
    from harborline.functions import ranking

    assert [ranking.range_count(10**k) for k in (0, 5, 7, 9)] == [1, 1, 40, 4000]
    assert ranking.range_count(10**15) == ranking.MOST_RANGES


@pytest.mark.parametrize("buckets", [16, 4000])
def test_keys_in_several_ranges_are_few(spark, buckets):
    """The broadcast sums hold at most two rows for each range, however many keys there are."""
    from harborline.functions import ranking

    rows = spark.range(40_000).selectExpr("id", "IF(id % 3 = 0, -1, id % 5000) AS k")
    marked = ranking.with_sort_bucket(rows, [("k", True), ("id", True)], "__b", buckets)
    spans = ranking._spans(marked.groupBy("k", "__b").agg(F.count("id").alias("__n")), ["k"])
    assert 0 < spans.count() <= 2 * buckets
    got = ranking.with_row_number(rows, [("id", True)], "rn", ["k"], "n", buckets)
    want = got.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY id) AS w", "count(1) OVER (PARTITION BY k) AS m")
    assert want.where("rn <> w OR n <> m").count() == 0 and want.count() == 40_000


def test_missing_source_and_csv(spark, tmp_path):
    assert read_table(spark, f"{tmp_path}/none.csv", schemas.ORDERS).schema == schemas.ORDERS
    items = tmp_path / "df_OrderItems.csv"
    items.write_text("order_id,product_id,seller_id,freight_value,price\no1,p,s,2.5,10\no2,p,s,bad,\n")
    tables = load_tables(spark, str(tmp_path))
    assert tables["orders"].count() == 0
    rows = tables["items"].orderBy("order_id").collect()
    assert [(r["order_item_id"], r["price"], r["shipping_charges"]) for r in rows] == [(None, 10.0, 2.5), (None, None, None)]


def test_run_store(spark):
    store = U.RunStore(spark, scratch_path(spark, "test-runs"))
    packed = spark.createDataFrame([("a", [1.0, 2.5], [0.5, 1.0])], "category string, forecast_values array<double>, lower_ci array<double>")
    assert store.store("forecasts", packed, "20240101000000") == 1
    assert store.store("forecasts", packed, "20240102000000") == 1
    read = U.read_forecasts(store.collection("forecasts"), "a", "20240101000000")
    assert read.first()["forecast_values"] == [1.0, 2.5] and read.first()["run_id"] == "20240101000000"
    assert "PartitionFilters: [isnotnull(run_id" in plan(store.collection("forecasts").where("run_id = '20240102000000'"))
    removed = {r["collection"]: r["n"] for r in store.delete_run("20240101000000").collect()}
    assert removed == {**dict.fromkeys(U.COLLECTIONS, 0), "forecasts": 1}
    assert store.collection("forecasts").select("run_id").first()[0] == "20240102000000"
    assert store.delete_run("absent").agg(F.sum("n")).first()[0] == 0
    with pytest.raises(ValueError):
        store.delete_run("")


def test_whole_analysis_and_dashboard(spark, sf_dir):
    t = catalog.views.Tables(spark, sf_dir)
    tables = {"orders": t.orders_gaps, "items": t.items_dirty, "products": t.products_dirty, "customers": t.customers}
    results = analyse(tables, top_n=3, periods=3, max_p=1, max_d=1, max_q=1)
    assert results["top_categories"].count() == 3
    assert results["forecasts"].select(F.size("forecast_values")).distinct().collect()[0][0] == 3
    assert results["reorder_recommendations"].where("reorder_point IS NULL OR days_between_orders > 90").count() == 0
    assert results["monthly_demand"].agg(F.sum("count")).first()[0] == t.items.count()
    assert results["cluster_centers"].count() == 3
    assert results["seller_kmeans"].where("cluster IS NOT NULL").count() == results["seller_clusters"].count()
    assert {r["table_name"] for r in results["input_checks"].where("ok").collect()} == set(tables)
    folder = scratch_path(spark, "test-results")
    kept = {n: f for n, f in results.items() if n != "summary_report"}
    stored = {n: spark.read.parquet(p) for n, p in write_results(kept, folder).items()}
    frames = dashboard(stored)
    assert {r["status"] for r in frames["status"].collect()} == {"present"}
    assert frames["kpis"].first()["total_demand"] == t.items.count()
    for frame in frames.values():
        assert frame.count() > 0


def test_input_checks_find_bad_values(spark):
    items = spark.createDataFrame([("1", "p", "9.5", "x"), ("2", "q", "cheap", None)], "order_id string, product_id string, price string, shipping_charges string")
    found = {(r["table_name"], r["column_name"], r["check_name"]): r["bad_rows"] for r in input_checks({"items": items}).collect()}
    assert found["items", "price", "numeric"] == 1 and found["items", "shipping_charges", "numeric"] == 1
    assert found["items", "seller_id", "required"] == 1 and found["items", "order_id", "required"] == 0


def test_growth_of_empty_demand(spark):
    empty = spark.createDataFrame([], "product_category_name string, date date, count int")
    assert D.category_growth(empty).count() == 0 and D.month_changes(empty).count() == 0


def test_day_first_stamps_and_absent_columns_are_loaded(spark, tmp_path):
    (tmp_path / CSV_NAMES["orders"]).write_text(
        "order_id,customer_id,order_purchase_timestamp\n1,c,25/12/2000 10:30:00\n2,c,03/01/2001 00:00:00\n3,c,2001-02-01 08:00:00\n4,c,\n")
    orders = load_tables(spark, str(tmp_path))["orders"]
    assert "order_approved_at" not in orders.columns
    stamps = {str(r["order_id"]): str(r["order_purchase_timestamp"]) for r in orders.collect()}
    assert stamps == {"1": "2000-12-25 10:30:00", "2": "2001-01-03 00:00:00", "3": "2001-02-01 08:00:00", "4": "None"}
    full = synthesize_stamps(orders)
    assert missing_stamps(full.columns) == []
    row = full.where("order_id = 1").first()
    assert 24 <= (row["order_approved_at"] - row["order_purchase_timestamp"]).total_seconds() / 3600 <= 47


def test_unfinished_last_month(spark):
    def until(*days):
        frame = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp_ntz("d").alias("s"))
        return str(frame.select(finished_until(frame, "s").alias("day")).distinct().first()["day"])

    assert until("2001-07-15 00:00:00", "2001-08-01 00:00:00") == "2001-08-01"
    assert until("2001-08-28 23:00:00") == "2001-08-01"
    assert until("2001-08-29 00:00:00") == "2001-09-01"
    assert until("2001-12-31 00:00:00", None) == "2002-01-01"


@pytest.mark.parametrize("method", ["linear", "ffill", "bfill", "mean", "zero"])
def test_months_are_filled_after_one_sort(spark, method):
    """The stretched months are three times the rows: sorting them again held three such sorts in one task."""
    rows = spark.createDataFrame([("a", "2020-01-01", 1.0)], "series string, month string, y double")
    text = plan(Z.fill_months(rows.withColumn("month", F.col("month").cast("date")), method), "simple")
    assert len(re.findall(r"\bSort \[", text)) == 1 and text.index("Generate") < text.index("Sort [")


def test_merged_partitions_stay_small(spark):
    """Unless the session says otherwise: 64 MB of compressed narrow rows are more than a GB in a task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    session = spark.newSession()
    session.conf.unset(key)
    assert configure(session).conf.get(key) == "8m"
    session.conf.set(key, "32m")
    assert configure(session).conf.get(key) == "32m"


def test_short_series_read_one_written_copy(spark, sf_dir):
    """Profile and line fit each sorted all joined lines in the tasks that fit the lines."""
    text = plan(catalog.QUERIES["f17_short_series"](spark, sf_dir))
    assert "l_orderkey" not in text and "o_orderkey" not in text
