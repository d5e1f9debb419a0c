"""Trie of conversation prefixes: a saturating count-min sketch keeps unshared tails out of the shuffles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import with_row_number
from ..session import pinned
from .common import small_batches

# A conversation's turns are ordered, and a node's ids joined, in parts of at most this many.
PART = 4_096
# A conversation shares the first turns of the first of its family: conversations in families of this size, up to this many.
FAMILY, MOST_SHARED = 5, 8
# Cells of a sketch row: four for each prefix, between these bounds. Beyond the upper one the screen lets more prefixes
# through to the exact grouping; results do not depend on it. Two rows of one byte a cell in a task, one bit in the end.
LEAST_CELLS, MOST_CELLS, CELLS_PER_BLOCK = 1 << 16, 1 << 24, 1 << 16
NODE = ["depth", "d1", "d2"]


def ordered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`conv_id`, `pos` (from 1), `mark` (digest of role and text) and `size` (UTF-8 bytes of the text) of every turn.

    Turns are ordered by number, a missing one first, and equal numbers by role and digest. A NULL role or text is an
    empty one; rows without a conversation id are left out. A conversation of any length is ordered in parts.
    """
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = pinned(conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256)).alias("mark"),
        F.octet_length(what).cast("long").alias("size"),
    ).where("conv_id IS NOT NULL"))
    long = pinned(turns.groupBy("conv_id").count().where(F.col("count") > PART).select("conv_id"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    columns = ["conv_id", "pos", "mark", "size"]
    short = turns.join(long, "conv_id", "left_anti").withColumn(
        "pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")).select(*columns)
    if long.isEmpty():
        return short
    return short.unionByName(with_row_number(
        turns.join(long, "conv_id", "left_semi"), [("turn", True), ("role", True), ("mark", True)], "pos", ["conv_id"],
    ).withColumn("pos", F.col("pos").cast("long")).select(*columns))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are taken from the first conversation of their family, and their lengths.

    With h = CRC-32 of the decimal id, modulo 9, a conversation is the first h turns of conversation id - id % 5 (none if
    there is none) and its own turns behind its first h. Output: rows of `conv_id`, `depth`, `mark`, `size`, `len`, and one
    row of `conv_id`, `len` per conversation. The turns should be cheap to read again.
    """
    counts = pinned(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    of_base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = counts.withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)))
    shared = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = pinned(known.join(of_base, "base", "left").withColumn("shared", shared).select(
        "conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = turns.join(convs, "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "mark", "size", "len")
    first = turns.where(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv_id", "base")
    begun = first.join(convs, "base").where(F.col("pos") <= F.col("h")).select(
        "conv_id", F.col("pos").alias("depth"), "mark", "size", "len")
    return own.unionByName(begun), convs.select("conv_id", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """Digest of every prefix and of the one before it, and its bytes so far.

    A prefix's digest is the exclusive or of hashes of its (depth, turn) pairs, two of 64 bits each; being associative,
    it is made in parts and a conversation of any length is never read by one task.
    """
    salted = rows.select(
        "conv_id", "depth", "size", "len", F.floor((F.col("depth") - 1) / PART).alias("part"),
        *[F.xxhash64(F.lit(k), "depth", "mark").alias(f"x{k}") for k in (1, 2)])
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    parts = salted.where(F.col("len") > PART).groupBy("conv_id", "part").agg(
        F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"), F.sum("size").alias("t"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("conv_id", "part", F.bit_xor("t1").over(before).alias("a1"), F.bit_xor("t2").over(before).alias("a2"),
                         F.sum("t").over(before).alias("a"))
    running = salted.withColumns({
        "r1": F.bit_xor("x1").over(inside), "r2": F.bit_xor("x2").over(inside), "r": F.sum("size").over(inside)})
    joined = running.join(ahead, ["conv_id", "part"], "left")
    none = F.lit(0).cast("long")
    full = joined.withColumns({
        "d1": F.col("r1").bitwiseXOR(F.coalesce("a1", none)), "d2": F.col("r2").bitwiseXOR(F.coalesce("a2", none)),
        "upto": F.col("r") + F.coalesce("a", none)})
    return full.select("conv_id", "depth", "len", "size", "upto", "d1", "d2",
                       F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2"))


def _cells(lane: pa.Array, cells: int) -> np.ndarray:
    return lane.to_numpy(zero_copy_only=False).astype(np.int64) & cells - 1


def single_cells(digests: DataFrame, cells: int) -> np.ndarray:
    """Count-min sketch of two rows over `d1` and `d2`, counting to two: True where a cell was met exactly once.

    Every task fills a sketch of its own and hands over its blocks; the blocks are added up where they meet.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, cells), dtype=np.uint8)
        for batch in batches:
            for k in (0, 1):
                cell, n = np.unique(_cells(batch.column(k), cells), return_counts=True)
                seen[k, cell] = np.minimum(seen[k, cell] + n, 2)
        for block, part in enumerate(seen.reshape(-1, CELLS_PER_BLOCK)):
            if part.any():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "cells": pa.array([part.tobytes()])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for block, group in groupby(rows, key=lambda row: row[0]):
            total = np.zeros(CELLS_PER_BLOCK, dtype=np.uint8)
            for _, part in group:
                total = np.minimum(total + np.frombuffer(part, np.uint8), 2)
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "single": pa.array([np.packbits(total == 1).tobytes()])})

    blocks = digests.select("d1", "d2").mapInArrow(fill, "block int, cells binary")
    added = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, single binary")
    single = np.zeros(2 * cells, dtype=bool)
    for row in added.toLocalIterator():
        at = row["block"] * CELLS_PER_BLOCK
        single[at : at + CELLS_PER_BLOCK] = np.unpackbits(np.frombuffer(row["single"], np.uint8)).astype(bool)
    return single.reshape(2, cells)


def screened(digests: DataFrame) -> DataFrame:
    """Add `alone` and `parent_alone`: the sketch proves that no other conversation has this prefix, or the one before."""
    rows = digests.count()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * rows).bit_length()))
    single = np.packbits(single_cells(digests, cells), axis=1)

    def probe(a: pa.Array, b: pa.Array) -> np.ndarray:
        known = np.zeros(len(a), dtype=bool)
        for k, lane in enumerate((a, b)):
            cell = _cells(lane, cells)
            known |= (single[k, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {name: batch.column(name) for name in batch.schema.names}
            deeper = batch.column("depth").to_numpy(zero_copy_only=False) > 1
            held["alone"] = pa.array(probe(held["d1"], held["d2"]))
            held["parent_alone"] = pa.array(probe(held["p1"], held["p2"]) & deeper)
            yield pa.record_batch(held)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in digests.schema)
    return digests.mapInArrow(run, f"{fields}, alone boolean, parent_alone boolean")


def ids_digest(members: DataFrame, keys: list[str], count: str) -> DataFrame:
    """SHA-256 of the ascending decimal ids of every group, joined by commas.

    `members` holds the keys, `conv_id` and the group's size in `count`. A small group is joined at once. The ids of a
    large one are numbered without sorting it whole, joined in parts, and the parts read one after the other by the one
    task that a digest in order needs.
    """
    digits = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    joined = F.array_join(digits, ",")
    small = members.where(F.col(count) <= PART).groupBy(*keys).agg(F.sha2(joined, 256).alias("ends_sha256"))
    large = members.where(F.col(count) > PART)
    if large.isEmpty():
        return small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, group in groupby(rows, key=lambda row: row[:-1]):
            digest = hashlib.sha256()
            for k, row in enumerate(group):
                digest.update(("," if k else "").encode() + row[-1].encode())
            yield pa.record_batch({**{name: pa.array([v], pa.int64()) for name, v in zip(keys, key)},
                                   "ends_sha256": pa.array([digest.hexdigest()])})

    numbered = with_row_number(large.select(*keys, "conv_id"), [("conv_id", True)], "number", keys)
    parts = numbered.groupBy(*keys, F.floor((F.col("number") - 1) / PART).alias("part")).agg(joined.alias("ids"))
    streams = parts.repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "ids")
    kinds = ", ".join(f"{k} long" for k in keys)
    return small.unionByName(streams.mapInArrow(run, f"{kinds}, ends_sha256 string"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty one.

    `rows` holds `conv_id`, `depth` (from 1 without gaps), `mark`, `size`, `len`; `convs` one row of `conv_id` and `len` per
    conversation. Output: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens` (bytes of the subtree's turns that need not be stored again) and `ends_sha256`.

    A prefix that the sketch proves unshared begins a tail without branches, whose nodes are written where they stand.
    The other prefixes are grouped exactly. What a node's subtree holds is summed over its members, not level by level:
    a member adds the leaf it is the smallest of, and the bytes from the node down to the last prefix of which it is not
    the smallest member.
    """
    seen = pinned(screened(pinned(prefixes(rows))))
    convs = pinned(convs)
    whole = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.coalesce(F.sum((F.col("len") > 0).cast("long")), F.lit(0))).first()
    n_convs, least, n_begun = whole
    local = F.col("alone") | F.col("parent_alone")
    tails, shared = seen.where(local), seen.where(~local)
    heads = tails.where("NOT parent_alone")
    ends_here = F.col("depth") == F.col("len")
    number = F.count(F.lit(1))

    found = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("rep"), number.alias("n_convs"), F.sum(ends_here.cast("long")).alias("n_ends"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    found = pinned(found)
    kids = found.select(*above).unionByName(heads.select(*above)).groupBy(*NODE).agg(number.alias("n_children"))
    kids = pinned(kids)
    nodes = pinned(found.join(kids, NODE, "left").na.fill(0, ["n_children"]))

    members = pinned(shared.join(nodes.select(*NODE, "rep", "n_children", "n_ends"), NODE).select(
        "conv_id", *NODE, "size", "upto", ends_here.alias("ends"), (F.col("rep") != F.col("conv_id")).alias("other"),
        "n_children", "n_ends"))
    leaf = F.when(F.col("ends"), (~F.col("other") & (F.col("n_children") == 0)).cast("long"))
    # The end of a conversation that is not among these rows is a leaf of its own.
    of_conv = pinned(members.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("other"), F.col("upto"))), F.lit(0)).alias("covered"),
        F.coalesce(F.max(leaf), F.lit(1)).alias("leaf")))
    below = members.join(of_conv, "conv_id").groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("other"), F.col("covered") - F.col("upto") + F.col("size")).otherwise(0)).alias("saved_tokens"))

    root = {k: F.lit(0).cast("long") for k in NODE}
    turnless = convs.where("len = 0")
    ending = members.where("ends").select(*NODE, "conv_id", "n_ends").unionByName(
        turnless.select(*[v.alias(k) for k, v in root.items()], "conv_id", F.lit(n_convs - n_begun).cast("long").alias("n_ends")))
    digests = ids_digest(ending, NODE, "n_ends")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"),
                           F.col("rep").alias("up"))
    # No node above among the exact ones: the parent is a tail's, and its only member this one.
    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.coalesce("up", "conv_id"))
    linked = nodes.withColumnRenamed("rep", "conv_id").join(parents, ["depth", "p1", "p2"], "left").withColumn(
        "parent_conv_id", parent.cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.sha2(F.lit(""), 256)
    exact = linked.join(below, NODE).join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    begun = heads.join(parents, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", parent.cast("long"))
    rest = tails.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    chains = begun.unionByName(rest, allowMissingColumns=True).withColumns({
        "n_convs": one, "n_children": F.when(ends_here, zero).otherwise(one), "n_leaves": one, "saved_tokens": zero,
        "ends_sha256": F.when(ends_here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)})

    if not n_convs:
        return exact.unionByName(chains, allowMissingColumns=True).select(*columns)
    sums = of_conv.agg(F.coalesce(F.sum("covered"), F.lit(0)), F.coalesce(F.sum((F.col("leaf") == 0).cast("long")), F.lit(0))).first()
    children = kids.where("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    top = rows.sparkSession.range(1).select(
        F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_convs).cast("long").alias("n_convs"), F.lit(children).cast("long").alias("n_children"),
        F.lit(n_begun - sums[1] if n_begun else 1).cast("long").alias("n_leaves"), F.lit(sums[0]).cast("long").alias("saved_tokens"),
        zero.alias("d1"), zero.alias("d2"),
    ).join(digests.where("depth = 0"), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return top.select(*columns).unionByName(exact.select(*columns)).unionByName(chains.select(*columns))


def conversation_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`prefix_trie` of the rebuilt conversations of a table of turns.

    NULL roles and texts are empty; a missing turn number comes first; equal numbers are ordered by role and digest and
    a repeated row is one more turn. Rows without a conversation id are left out. A conversation whose beginning comes
    from elsewhere and that has no turns of its own left may be without turns: it belongs to the root alone. An empty
    table gives no rows. Extra columns are not read.
    """
    small_batches(conversations.sparkSession)
    rows, convs = rebuilt(pinned(ordered_turns(conversations, conv, turn, role, text)))
    return prefix_trie(rows, convs)
