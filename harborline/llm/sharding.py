"""Shards balanced in bytes, tokens and rows by vector bin packing of groups of equal texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .common import cell_of, cells

SHARDS = 40
OVERHEAD_BYTES = 16
# A group that no shard could hold is cut so that no piece is more than this part of a shard in any dimension.
PIECES_PER_SHARD = 32
# Items of at least these parts of all the data are placed level by level, the largest first.
LEVELS = (1 / 4_000, 1 / 400_000)
ITEMS_PER_CELL = 4_096
ROWS_PER_CELL = 1_000
# Bytes weigh most in the dot product, so that sizes come out near equal.
WEIGHTS = (100.0, 1.0, 1.0)
GROUP = ["k1", "k2", "size"]
ITEM = [*GROUP, "piece"]


def place(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of every item, largest first, each to where its dot product with the residual capacity is highest.

    `items` (n, d) and `room` (shards, d) are in the same units; `room` is used up in place. Of equal products the first
    shard is taken. Minimising the squared residual of all dimensions is the same choice.
    """
    order = np.lexsort((np.arange(len(items)), -items.sum(axis=1)))
    chosen = np.zeros(len(items), dtype=np.int64)
    for i in order:
        best = int(np.argmax(room @ items[i]))
        chosen[i] = best
        room[best] -= items[i]
    return chosen


def _measures(rows: pd.DataFrame, totals: np.ndarray) -> np.ndarray:
    return rows[["bytes", "tokens", "rows"]].to_numpy(dtype=float) / totals * np.sqrt(WEIGHTS)


def _packer(room: np.ndarray, totals: np.ndarray):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ITEM).reset_index(drop=True)
        # Cells start at different shards, so that what is left over does not meet in the first ones.
        back = np.roll(np.arange(len(room)), int(rows["cell"].iloc[0]) % len(room))
        rows["shard"] = back[place(_measures(rows, totals), room[back].copy())].astype("int32")
        return rows[[*ITEM, "shard", "bytes", "tokens", "rows"]]

    return pack


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Shard and slot of every row.

    Output: the id, `size` (UTF-8 bytes plus 16), `tokens` (runs of non-space), `text_crc32`, `law` (always `bytes`),
    `shard`, `slot` (gapless from 0 in every shard), `grown_shard` (NULL under this law). Rows of equal text form a group
    and stay together unless the group is more than a whole shard in some dimension; then ids are hashed into pieces. NULL text is an
    empty text of size 16, repeated rows are rows like any other, a NULL id counts as an id, an empty table gives no
    rows, and columns other than id and text are not read.

    Groups are first summed, so only one row of each is packed. The few items above the first level (at most a bounded
    number, since each is a fixed part of the whole) are packed together; the others are dealt over cells, each of which
    packs its own items into an equal part of what the shards still lack, so small items mend what large ones left.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    light = pinned(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(F.encode(text, "UTF-8")).alias("k2"),
        F.xxhash64(text).alias("k1"),
    ))
    sums = light.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    totals = np.array([max(1, x or 0) for x in sums], dtype=float)
    share = F.greatest(
        F.sum("size") / F.lit(totals[0]), F.sum("tokens") / F.lit(totals[1]), F.count(F.lit(1)) / F.lit(totals[2]))
    # Each hot group holds more than a shard's part of one of three totals, so there are fewer than 3 x shards.
    hot = (
        light.groupBy(*GROUP).agg((share * shards).alias("load")).where("load > 1")
        .select(*GROUP, F.ceil(F.col("load") * PIECES_PER_SHARD).cast("int").alias("pieces"))
    )
    light = pinned(light.join(F.broadcast(hot), GROUP, "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64(F.lit("piece"), "id"), F.col("pieces")), F.lit(0)).cast("long")
    ).drop("pieces"))
    items = light.groupBy(*ITEM).agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    part = F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(("bytes", "tokens", "rows"), totals)])
    level = F.lit(len(LEVELS))
    for k, least in reversed(list(enumerate(LEVELS))):
        level = F.when(part >= least, F.lit(k)).otherwise(level)
    items = pinned(items.withColumn("level", level))
    schema = "k1 long, k2 long, size long, piece long, shard int, bytes long, tokens long, rows long"
    held = np.zeros((shards, 3))
    placed = []
    for k in range(len(LEVELS) + 1):
        here = items.where(F.col("level") == k)
        stats = here.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
        if not stats[0]:
            continue
        number = 1 if k == 0 else cells(stats[0], ITEMS_PER_CELL)
        level_sum = np.array(stats[1:], dtype=float) / totals * np.sqrt(WEIGHTS)
        room = (level_sum / shards + held.mean(axis=0) - held) / number

        done = pinned(here.withColumn("cell", cell_of(number, F.lit("cell"), *map(F.col, ITEM)))
                      .groupBy("cell").applyInPandas(_packer(room, totals), schema))
        placed.append(done)
        if k < len(LEVELS):
            for row in done.groupBy("shard").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).collect():
                held[row[0]] += np.array(row[1:], dtype=float) / totals * np.sqrt(WEIGHTS)
    where = spark.createDataFrame([], schema)
    for done in placed:
        where = where.unionByName(done)
    number = cells(int(sums[2]), ROWS_PER_CELL)
    rows = pinned(light.join(where.select(*ITEM, "shard"), ITEM).withColumn(
        "cell", cell_of(number, F.lit("slot"), F.col("id"))))
    over = Window.partitionBy("shard").orderBy("cell")
    before = (
        rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", (F.sum("n").over(over) - F.col("n")).alias("before"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("id", "k1", "k2")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(before, ["shard", "cell"])
        .select(
            F.col("id").alias(id_column), "size", "tokens", F.col("k2").alias("text_crc32"), F.lit("bytes").alias("law"),
            "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
