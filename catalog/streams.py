"""Totals kept up to date from the event stream."""

from pyspark.sql import functions as F

from harborline.session import scratch_path
from harborline.streaming import demand as K

from .base import query


def kept(t, stream, **options):
    folder = scratch_path(t.spark, "month-totals")
    running = K.keep_month_totals(stream, folder, "event_type", **options)
    running.awaitTermination()
    return K.read_month_totals(t.spark, folder, "event_type").select(
        "event_type", F.date_format("date", "yyyy-MM-dd").alias("date"), "count",
        F.round(F.col("total").cast("double"), 4).alias("total"))


@query("d31_monthly_events", """
    SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d') AS "date", count(*) AS "count",
           round(CAST(sum(CAST(coalesce("value", 0) AS DECIMAL(38,6))) AS DOUBLE), 4) AS total
    FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""")
def _(t):
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return kept(t, stream)
