"""Month totals kept from a file stream equal those of one batch over the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.streaming import demand as K

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def day(month, number, hour=0):
    return dt.datetime(2024, month, number, hour)


BATCHES = [
    [(1, day(1, 5), "view", 1.5), (2, day(1, 9), "buy", 2.0), (3, day(2, 1), "view", 0.25)],
    [(4, day(3, 2), "view", 1.0), (5, day(1, 31), "view", 4.0), (6, None, "view", 9.0), (7, day(3, 3), None, 9.0)],
    [(8, day(1, 1), "buy", None), (9, day(3, 3), "buy", float("nan")), (10, day(2, 29), "view", -0.25)],
]


def totals(df):
    return {(r["event_type"], r["date"]): (r["count"], float(r["total"])) for r in df.collect()}


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("at_once", [False, True])
def test_three_batches_with_late_rows(spark, tmp_path, at_once):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for number, rows in enumerate(BATCHES):
        deliver(spark, rows, source)
        if not at_once or number == 2:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            K.keep_month_totals(stream, target, "event_type").awaitTermination()
            want = K.month_totals(spark.read.schema(SCHEMA).parquet(source), "event_type")
            assert totals(K.read_month_totals(spark, target, "event_type")) == totals(want)
    got = totals(K.read_month_totals(spark, target, "event_type"))
    assert got["view", dt.date(2024, 1, 1)] == (2, 5.5) and got["buy", dt.date(2024, 1, 1)] == (2, 2.0)
    # A batch tried again replaces its own rows.
    last = spark.read.parquet(f"{target}/{K.PARTS}").agg(F.max("batch")).first()[0]
    K.month_totals(spark.createDataFrame(BATCHES[-1], SCHEMA), "event_type").write.mode("overwrite").parquet(
        f"{target}/{K.PARTS}/batch={last}")
    if not at_once:
        assert totals(K.read_month_totals(spark, target, "event_type")) == got


def test_repeated_events_count_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([BATCHES[0][0], BATCHES[0][1]], [BATCHES[0][1], (11, day(1, 10), "buy", 1.0)]):
        deliver(spark, rows, source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        K.keep_month_totals(stream, target, "event_type", repeats_within="10 days").awaitTermination()
    got = totals(K.read_month_totals(spark, target, "event_type"))
    assert got["buy", dt.date(2024, 1, 1)] == (2, 3.0)


def test_a_stream_without_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, [], source)
    K.keep_month_totals(spark.readStream.schema(SCHEMA).parquet(source), target, "event_type").awaitTermination()
    assert K.read_month_totals(spark, target, "event_type").count() == 0
