"""Monthly counts and sums of an event stream, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import finite

PARTS = "monthly"


def month_totals(events: DataFrame, key: str, stamp: str = "ts", value: str = "value") -> DataFrame:
    """Events and their summed value by key and month, as a batch. Rows without a key or a stamp are left out.

    Values are summed as decimals, so the total does not depend on how the rows fell into batches; missing and non-finite
    values and those of 10^24 or more count as 0.
    """
    amount = F.coalesce(finite(value).try_cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)"))
    return (
        events.where(F.col(key).isNotNull() & F.col(stamp).isNotNull())
        .groupBy(key, F.to_date(F.trunc(stamp, "month")).alias("date"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum(amount).cast("decimal(38,6)").alias("total"))
    )


def keep_month_totals(
    events: DataFrame, path: str, key: str, stamp: str = "ts", value: str = "value", repeats_within: str | None = None,
    event_id: str = "event_id", **trigger,
) -> StreamingQuery:
    """Write the month totals of every micro-batch of a stream below `path`; `read_month_totals` merges them.

    A batch adds a few rows per key and month and replaces what an earlier try of the same batch left, so a restarted query
    counts nothing twice. Late rows simply add to their month, however late. With `repeats_within` (an interval such as
    "2 days") an event delivered again within that time of event time is dropped first: the watermark bounds the ids kept
    in state, and rows older than it are dropped with them.
    """
    nothing = month_totals(events.sparkSession.createDataFrame([], events.schema), key, stamp, value)
    nothing.write.mode("ignore").parquet(f"{path}/{PARTS}/batch=-1")
    if repeats_within:
        events = events.withWatermark(stamp, repeats_within).dropDuplicatesWithinWatermark([event_id])

    def add(batch: DataFrame, number: int) -> None:
        month_totals(batch, key, stamp, value).write.mode("overwrite").parquet(f"{path}/{PARTS}/batch={number}")

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_month_totals(spark, path: str, key: str) -> DataFrame:
    """The totals of all batches so far, one row per key and month."""
    parts = spark.read.parquet(f"{path}/{PARTS}").drop("batch")
    return parts.groupBy(key, "date").agg(F.sum("count").alias("count"), F.sum("total").cast("decimal(38,6)").alias("total"))
