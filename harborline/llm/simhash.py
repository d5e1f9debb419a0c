"""SimHash near-duplicates by anchor points of a covering code.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of one of their halves. Each half of
32 bits is covered by anchors: 23 bits by the codewords of the perfect binary Golay code (covering radius 3), the other
nine bits as they are. A fingerprint is at home at the anchor nearest to its half, and is replicated to every anchor within
covering radius plus one that can be the home of a half one bit away: six codewords and nine single-bit changes, 15 in
all. So any two fingerprints to be linked meet at the home anchor of either one, in a half where they are one bit apart.
At an anchor only its residents are compared, each with everything replicated there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .common import hidden, small_batches
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 3

# Fixed values of the binary Golay code of length 23: generator polynomial, check bits and covering radius.
GOLAY_GENERATOR, CHECK_BITS, RADIUS, CODE_BITS = 0b110001110101, 11, 3, 23
FREE_BITS = 32 - CODE_BITS
REACH = 15
# Rows of one anchor compared at a time; an anchor with more rows is cut into blocks and every pair of blocks is compared.
BLOCK_ROWS = 2_048
# Runs up to this long are compared by shifted columns, longer ones row by row with a spanning forest.
SHORT_RUN = 16


def simhash(text: str | None) -> int:
    """Unsigned SimHash of a text: majority bit over the XXH64 of its word shingles, repeats included.

    A-Z are lower-cased and words are runs of anything but ASCII white space. A text of fewer words than a shingle is one
    shingle; NULL or no word gives zero. A bit is set if more than half of the shingles have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(SHINGLE_WORDS, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    places = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[p], SEED) for p in places], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _simhashes(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The SimHash as a signed long holding the same 64 bits."""
    return F.pandas_udf(_simhashes, "long")(text)


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of single bytes at their places, and the error pattern of every remainder."""

    def remainder(word: int) -> int:
        for i in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
            if word >> i & 1:
                word ^= GOLAY_GENERATOR << (i - CHECK_BITS)
        return word

    of_byte = np.array([[remainder(b << 8 * k & (1 << CODE_BITS) - 1) for b in range(256)] for k in range(3)], dtype=np.int64)
    pattern = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(RADIUS + 1):
        for places in combinations(range(CODE_BITS), weight):
            word = sum(1 << p for p in places)
            pattern[remainder(word)] = word
    return of_byte, pattern


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Number of the one codeword within the covering radius of each 23-bit word."""
    of_byte, pattern = _syndromes()
    left = of_byte[0][words & 255] ^ of_byte[1][words >> 8 & 255] ^ of_byte[2][words >> 16]
    return (words ^ pattern[left]) >> CHECK_BITS


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of each 32-bit half, and the 15 anchors (home first) it is replicated to.

    A slot that would repeat an anchor holds -1.
    """
    word, free = halves & (1 << CODE_BITS) - 1, halves >> CODE_BITS
    home = nearest_codeword(word)
    near = np.stack([nearest_codeword(word ^ (1 << k)) for k in range(CODE_BITS)], axis=1)
    near.sort(axis=1)
    fresh = np.concatenate([np.ones((len(word), 1), bool), near[:, 1:] != near[:, :-1]], axis=1) & (near != home[:, None])
    near = np.where(fresh, near, -1)
    near = -np.sort(-near, axis=1)[:, : REACH - FREE_BITS - 1]
    reach = np.full((len(word), REACH), -1, dtype=np.int64)
    reach[:, 0] = home << FREE_BITS | free
    reach[:, 1 : 1 + near.shape[1]] = np.where(near >= 0, near << FREE_BITS | free[:, None], -1)
    reach[:, REACH - FREE_BITS :] = home[:, None] << FREE_BITS | (free[:, None] ^ (1 << np.arange(FREE_BITS)))
    return reach[:, 0], reach


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = values.view(np.uint64)
        for side in (0, 1):
            half = (bits >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            _, reach = anchors(half)
            kept = (reach >= 0).ravel()
            key = (reach + (side << 32)).ravel()[kept]
            resident = np.zeros(reach.shape, bool)
            resident[:, 0] = True
            yield pa.record_batch({
                "anchor": key, "fp": np.repeat(values, REACH)[kept], "id": np.repeat(ids, REACH)[kept],
                "resident": pa.array(resident.ravel()[kept]),
            })


def _forest(fp: np.ndarray, ids: np.ndarray, resident: np.ndarray, visitor: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of one block pair: residents against visitors."""
    label = np.arange(len(fp))
    for i in np.flatnonzero(resident):
        close = np.flatnonzero(visitor & (np.bitwise_count(fp ^ fp[i]) <= THRESHOLD))
        joined = np.unique(np.append(label[close], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined[1:])] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return ids[moved].tolist(), ids[label[moved]].tolist()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit cut by a batch edge is carried over."""
    kept: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pa.RecordBatch:
        edge = (rows[["anchor", "i", "j"]] != rows[["anchor", "i", "j"]].shift()).any(axis=1).to_numpy()
        unit = np.cumsum(edge)
        fp, ids = rows["fp"].to_numpy().view(np.uint64), rows["id"].to_numpy()
        resident, visitor = rows["resident"].to_numpy(), rows["visitor"].to_numpy()
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(rows)))
        a, b = [], []
        short = np.repeat(size <= SHORT_RUN, size)
        for shift in range(1, min(SHORT_RUN, len(rows))):
            x = np.flatnonzero(short[:-shift] & (unit[:-shift] == unit[shift:]))
            if not len(x):
                break
            y = x + shift
            met = (resident[x] & visitor[y]) | (resident[y] & visitor[x])
            near = met & (np.bitwise_count(fp[x] ^ fp[y]) <= THRESHOLD)
            a.extend(ids[x[near]].tolist())
            b.extend(ids[y[near]].tolist())
        for s, n in zip(first[size > SHORT_RUN], size[size > SHORT_RUN]):
            part = slice(s, s + n)
            more_a, more_b = _forest(fp[part], ids[part], resident[part], visitor[part])
            a.extend(more_a)
            b.extend(more_b)
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
        last = (rows[["anchor", "i", "j"]] == rows[["anchor", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        kept = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield links(rows.iloc[:cut].reset_index(drop=True))
    if kept is not None and len(kept):
        yield links(kept)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints at most three bits apart, enough to connect whatever is connected.

    `prints` holds `fp` (long) and `id` (long), one row per fingerprint, written down already. Output: `a`, `b` (ids). An
    anchor with at most 16 rows gives all its links, a larger one a spanning forest of them.
    """
    spark = prints.sparkSession
    copies = prints.select("fp", "id").mapInArrow(_replicate, "anchor long, fp long, id long, resident boolean")
    count, blocks = F.count(F.lit(1)), lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    crowded = pinned(copies.groupBy("anchor").agg(
        blocks(count).alias("mj"), F.greatest(F.lit(1), blocks(F.sum(F.col("resident").cast("long")))).alias("mi"))
        .where("mj > 1"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = copies.join(crowded, "anchor", "left")
    alone = rows.where("mj IS NULL").select(
        "anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "id", "resident", F.lit(True).alias("visitor"))
    spread = rows.where("mj IS NOT NULL")
    block_i = F.pmod(F.xxhash64("fp"), F.col("mi")).cast("int")
    block_j = F.pmod(F.xxhash64("fp"), F.col("mj")).cast("int")
    homes = spread.where("resident").select(
        "anchor", block_i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("mj") - 1)).alias("j"), "fp", "id",
        F.lit(True).alias("resident"), F.lit(False).alias("visitor"))
    guests = spread.select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("mi") - 1)).alias("i"), block_j.alias("j"), "fp", "id",
        F.lit(False).alias("resident"), F.lit(True).alias("visitor"))
    units = alone.unionByName(homes).unionByName(guests)
    return (
        units.repartition(parts, "anchor", "i", "j")
        .sortWithinPartitions("anchor", "i", "j")
        .mapInArrow(_compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint and component of every row.

    Output: the id, `fp` (signed long), `component_id` (smallest id reachable through links of at most three bits). NULL
    and empty texts have fingerprint zero and link like any other. Repeated rows stay. A row with a NULL id keeps its
    fingerprint, belongs to its fingerprint's component and names none. An empty table gives no rows. Extra columns are
    not read.
    """
    small_batches(docs.sparkSession)
    rows = pinned(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column)).alias("fp")))
    prints = pinned(rows.groupBy("fp").agg(F.min("id").alias("id")))
    links = fingerprint_links(prints.where("id IS NOT NULL"))
    found = connected_components(links)
    classes = pinned(
        prints.join(found, prints["id"] == found["node"], "left")
        .select(F.col("fp").alias("of_fp"), F.coalesce("component", "id").alias("component_id"))
    )
    return rows.join(classes, rows["fp"] == classes["of_fp"]).select(F.col("id").alias(id_column), "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id, of equal ids the one whose text
    hashes lowest, with all its columns.

    Rows count, not ids: unlike texts under one id are judged apart, equal texts under one id leave one row, and a row
    without an id goes only if another row of its component has one or hashes lower. NULL and empty texts are one
    component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    key, fp = F.xxhash64(F.col(text_column)), fingerprint(F.col(text_column))
    rows = pinned(docs.select(F.col(id_column).alias("id"), key.alias("key"), fp.alias("fp")))
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    prints = pinned(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    found = connected_components(fingerprint_links(prints.select("fp", F.col("fp").alias("id"))))
    kept = (
        prints.join(found, prints["fp"] == found["node"], "left")
        .groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first")).select("first.*")
    )
    same = kept.join(rows.withColumnsRenamed({"id": "row_id", "key": "row_key"}),
                     F.col("id").eqNullSafe(F.col("row_id")) & (F.col("key") == F.col("row_key")))
    own_id, own_key, copied = hidden(docs, "kept_id"), hidden(docs, "kept_key"), hidden(docs, "kept_copied")
    chosen = pinned(same.groupBy("id", "key").agg((F.count(F.lit(1)) > 1).alias(copied))
                    .withColumnsRenamed({"id": own_id, "key": own_key}))
    keyed = docs.join(chosen, docs[id_column].eqNullSafe(chosen[own_id]) & (key == chosen[own_key]))
    single = keyed.where(~F.col(copied))
    if not chosen.where(copied).isEmpty():
        single = single.unionByName(keyed.where(copied).dropDuplicates([own_id, own_key]))
    return single.select(*[docs[c] for c in docs.columns])
