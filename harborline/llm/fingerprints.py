"""Document fingerprints from content-defined chunks, and their likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Chunk lengths in bytes, and how many leading hash bits must be zero before and after the normal length.
LEAST, NORMAL, MOST = 12, 32, 128
HARD_BITS, EASY_BITS = 6, 4
GEAR_SEED = 7
WINDOW = 32
ROWS_PER_RUN, MOST_RUNS = 1_000, 100_000

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), GEAR_SEED) for b in range(256)], dtype=np.uint32)


def rolling_hash(data: bytes) -> np.ndarray:
    """Gear hash at every byte, h = 2h + gear[byte] in 32 bits, by doubling the window instead of a loop."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks from `start`, which must be a chunk's start.

    A chunk ends where the hash has EASY_BITS leading zeros (HARD_BITS below the normal length), never below the least
    length and at the most length at the latest; the text's end ends the last one.
    """
    base = max(0, start - WINDOW + 1)
    h = rolling_hash(data[base:])
    places = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (h[places] >> np.uint32(32 - HARD_BITS) == 0).tolist()
    ends, s = [], start
    for p, strong in zip((places + base + 1).tolist(), hard):
        while p - s > MOST:
            s += MOST
            ends.append(s)
        long = p - s
        if long >= NORMAL or (strong and long >= LEAST):
            ends.append(p)
            s = p
    n = len(data)
    while n - s > MOST:
        s += MOST
        ends.append(s)
    if n > s:
        ends.append(n)
    return ends


def _digests(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    """Chunk digests: 56 bits of hash and 8 bits of length."""
    out, digest = [], xxhash.xxh64_intdigest
    for e in ends:
        out.append(digest(data[start:e]) & ~0xFF | e - start)
        start = e
    return out


def as_set(digests: list[int]) -> np.ndarray:
    return np.unique(np.array(digests, dtype=np.uint64))


def as_text(prints: np.ndarray) -> str:
    """16 hexadecimal digits per chunk in ascending order."""
    return prints.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared chunk bytes as part of either set's bytes; the lesser of the two containments. Two empty sets: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    size = lambda x: int((x & np.uint64(0xFF)).sum())
    return size(np.intersect1d(a, b, assume_unique=True)) / max(size(a), size(b))


def fingerprint(text: str | None) -> np.ndarray:
    """The set of chunk digests of a whole text; NULL is an empty text and gives an empty set."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return as_set(_digests(data, chunk_ends(data)))


def compare_texts(text: str, following: str | None) -> tuple:
    """One document against its edited text and against the next one.

    The edited text has its last quarter of code points replaced by as many leading code points of the next document.
    Its chunks are cut anew only from the last chunk that ends within what both texts share.
    """
    data = text.encode("utf-8", "surrogatepass")
    ends = chunk_ends(data)
    digests = _digests(data, ends)
    own = as_set(digests)
    n = len(text)
    quarter = n // 4
    shared = text[: n - quarter].encode("utf-8", "surrogatepass")
    edited = shared + (following or "")[:quarter].encode("utf-8", "surrogatepass")
    kept = sum(1 for e in ends[:-1] if e <= len(shared))
    start = ends[kept - 1] if kept else 0
    edited_set = as_set(digests[:kept] + _digests(edited, chunk_ends(edited, start), start))
    return n, hashlib.sha256(edited).hexdigest(), own, edited_set


SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by run and place; the rows after a run's own are the first of the next run."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    pending = None
    for batch in batches:
        out = []
        runs, tails, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        for run, tail, key, text in zip(runs, tails, ids, texts):
            text = text or ""
            if pending is not None and (pending[0] == run):
                following, other = text, fingerprint(text)
                out.append(_row(pending, following, other))
                pending = None
            if not tail:
                pending = (run, key, text)
            if run < 0:
                out.append(_row(pending, None, None))
                pending = None
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, _TYPES)], names=names)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _row(pending: tuple, following: str | None, other: np.ndarray | None) -> tuple:
    n, digest, own, edited = compare_texts(pending[2], following)
    return (pending[1], n, digest, as_text(own), as_text(edited), likeness(own, edited),
            None if other is None else likeness(own, other))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and that to the next document.

    The next document is that of the next id; of equal ids, that of the next text; after the last comes the first. NULL
    text is an empty text. A row with a NULL id has no next document: nothing replaces its last quarter and `near_next`
    is NULL. Two empty fingerprints are alike. An empty table gives no rows; extra columns are not read.

    Rows are cut into runs of neighbouring ids, about a thousand rows each. The first row of every run is copied to the
    end of the run before, so each run is read alone and in order, and a text is shuffled once.
    """
    spark = small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_column).cast("long").alias("id"))
    rows = ids.where("id IS NOT NULL").count()
    runs = max(1, min(MOST_RUNS, -(-rows // ROWS_PER_RUN)))
    cuts = ids.agg(F.percentile_approx("id", [i / runs for i in range(1, runs)] or [0.5], F.lit(20 * runs))).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def run_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(), side="left").astype(np.int64))

    locate = F.pandas_udf(run_of, "long")
    # One number per run: at most MOST_RUNS.
    first = sorted(ids.where("id IS NOT NULL").groupBy(locate("id").alias("run")).agg(F.min("id").alias("id")).collect())
    before = {row["id"]: first[i - 1]["run"] for i, row in enumerate(first)}

    def run_before(values: pd.Series) -> pd.Series:
        return values.map(before).fillna(-1).astype("int64")

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    known = texts.where("id IS NOT NULL")
    own = known.select(locate("id").alias("run"), F.lit(False).alias("tail"), "id", "text")
    tails = known.select(F.pandas_udf(run_before, "long")("id").alias("run"), F.lit(True).alias("tail"), "id", "text")
    lost = texts.where("id IS NULL").select(F.lit(-1).cast("long").alias("run"), F.lit(False).alias("tail"), "id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("run") < 0, F.xxhash64("text")).otherwise(F.lit(0))
    return (
        own.unionByName(tails.where("run >= 0")).unionByName(lost)
        .repartition(parts, "run", salt)
        .sortWithinPartitions("run", "tail", "id", "text")
        .mapInArrow(_run, SCHEMA)
        .withColumnRenamed("id", id_column)
    )
