"""Importance resampling of documents towards a target text collection by hashed word runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import with_row_number
from ..session import pinned
from .common import byte_slices, small_batches

BUCKETS = 10_000
# A document needs this many words to be drawn; so many in a hundred of those are.
LEAST_WORDS, PERCENT = 20, 25
SALT = "7"

# Text interned at once: its runs take some 40 times as much memory.
BYTES_AT_ONCE = 2 * 1024 * 1024

# Constants of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
# Longer n-grams are hashed one by one.
SHORT = 32

# Lower case for A-Z; and which bytes belong to a word: digits, letters, and all bytes of characters beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of many stretches of `data`, which has eight spare bytes at its end."""
    words = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data.data, strides=(1,))
    with np.errstate(over="ignore"):
        h = P5 + size.astype(np.uint64)
        at, end = start.copy(), start + size
        short = size < SHORT
        while len(lanes := np.flatnonzero(short & (end - at >= 8))):
            lane = _rotated(words[at[lanes]] * P2, 31) * P1
            h[lanes] = _rotated(h[lanes] ^ lane, 27) * P1 + P4
            at[lanes] += 8
        four = np.flatnonzero(short & (end - at >= 4))
        h[four] = _rotated(h[four] ^ halves[at[four]].astype(np.uint64) * P1, 23) * P2 + P3
        at[four] += 4
        while len(ones := np.flatnonzero(short & (end > at))):
            h[ones] = _rotated(h[ones] ^ data[at[ones]].astype(np.uint64) * P5, 11) * P1
            at[ones] += 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        h ^= h >> np.uint64(32)
    if not short.all():
        import xxhash

        for k in np.flatnonzero(~short).tolist():
            h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]].tobytes())
    return h


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of `size` bytes at `a` and `b` are equal, eight bytes at a time."""
    words = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    equal = np.ones(len(a), dtype=bool)
    done, open_ = 0, np.flatnonzero(size > 0)
    while len(open_):
        x = words[a[open_] + done] ^ words[b[open_] + done]
        left = np.minimum(size[open_] - done, 8).astype(np.uint64)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        equal[open_[x != 0]] = False
        done += 8
        open_ = open_[(x == 0) & (size[open_] > done)]
    return equal


class Grams:
    """Word runs of a batch of texts, interned in an open-addressed table.

    `slot` holds the table slot of every occurrence, `owner` its text. A slot stores the run's bucket (CRC-32 of its
    bytes modulo BUCKETS) and its number of occurrences; `taken` lists the slots in use. Equal hashes are told apart by
    their bytes.
    """

    def __init__(self, texts: pa.Array):
        data, start, size, self.owner, self.words = self._runs(texts)
        key = hashes(data, start, size)
        room = 1 << max(4, int(2 * len(start)).bit_length())
        first = np.full(room, -1, dtype=np.int64)
        self.slot = np.full(len(start), -1, dtype=np.int64)
        place = (key & np.uint64(room - 1)).astype(np.int64)
        waiting = np.arange(len(start))
        while len(waiting):
            at = place[waiting]
            free = first[at] < 0
            # Of several runs at one free slot the last written one keeps it; equal runs then meet there.
            first[at[free]] = waiting[free]
            there = first[at]
            equal = (key[there] == key[waiting]) & (size[there] == size[waiting])
            equal[equal] = _same_bytes(data, start[there[equal]], start[waiting[equal]], size[waiting[equal]])
            self.slot[waiting[equal]] = at[equal]
            waiting = waiting[~equal]
            place[waiting] = place[waiting] + 1 & room - 1
        self.taken = np.flatnonzero(first >= 0)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, dtype=np.int64)
        view = memoryview(data)
        begins = start[first[self.taken]]
        ends = begins + size[first[self.taken]]
        self.bucket[self.taken] = [crc32(view[a:b]) % BUCKETS for a, b in zip(begins.tolist(), ends.tolist())]

    @staticmethod
    def _runs(texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Words of all texts joined by single spaces; begin, length and text of all runs of one and two words."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, high)[low:]] if high > low else np.zeros(0, np.uint8)
        inside = _IN_WORD[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets - low] = True
        before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        length = np.flatnonzero(inside & (~after | edge[1:])) + 1 - begin
        owner = np.searchsorted(offsets - low, begin, side="right") - 1
        # Copy the bytes of the words to their new places, one space behind each word.
        new = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64) if len(length) else length
        data = np.full(int((length + 1).sum()) + 8, 32, dtype=np.uint8)
        kept = np.flatnonzero(inside)
        data[kept + np.repeat(new - begin, length)] = raw[kept]
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        start = np.concatenate([new, new[pair]])
        size = np.concatenate([length, length[pair] + 1 + length[pair + 1]]) if len(pair) else length
        return data, start, size, np.concatenate([owner, owner[pair]]), np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of word runs a bucket, over all rows of a one-column frame of texts.

    A task adds up its own buckets before anything is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in (part for whole in batches for part in byte_slices(whole, 0, BYTES_AT_ONCE)):
            grams = Grams(batch.column(0))
            total += np.bincount(grams.bucket[grams.taken], grams.count[grams.taken], BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": used, "n": total[used]})

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Gain of every bucket: floor(1000 ln of the smoothed target share over the smoothed source share), in doubles."""
    s_all, t_all = sum(source.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return np.array([
        math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all)))
        for b in range(BUCKETS)
    ], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """`id`, `n_words`, `n_features` and `weight` of every row of (`id`, `text`): the floored mean gain of its runs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, 1, BYTES_AT_ONCE)):
            grams = Grams(batch.column(1))
            here = gain[grams.bucket[grams.slot]]
            # Whole numbers in doubles: exact up to 2^53.
            total = np.bincount(grams.owner, here, len(batch)).astype(np.int64)
            features = np.bincount(grams.owner, minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grams.words, pa.int64()), pa.array(features, pa.int64()),
                 pa.array(total // np.maximum(features, 1), pa.int64())],
                names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, salt: str = SALT,
) -> DataFrame:
    """Weight, perturbed score and rank of every document; the ranked ones are drawn.

    A document's weight is the mean gain of its runs of one and two words, where a bucket gains by being more frequent in
    `target` than in `docs`. The score adds Gumbel noise made from the id, so that the highest scores are a draw without
    replacement in proportion to the weights. Of the documents with at least `least_words` words the `percent` in a
    hundred with the highest scores have a rank, ties going to the smaller id.

    Both tables are counted whole, 10,000 numbers each reach the driver, and the texts are read a second time for their
    weights: the counts of a text are never written down. Output: the id, `n_features`, `weight`, `score`, `rank`. NULL and
    empty texts, and those without words, have no features and weight 0. A NULL id is hashed as an empty one and ranks
    before equal scores. Repeated rows count and rank as often as they stand there. An empty target has no counts; an
    empty `docs` gives no rows. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    source = dict(bucket_counts(docs.select(text_column)).collect())
    wanted = dict(bucket_counts(target.select(target_column)).collect())
    weighed = weigh(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), gains(source, wanted))
    named = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = pinned(weighed.withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= least_words
    ranked = with_row_number(scored.where(fit), [("score", False), ("id", True)], "place", total="of")
    drawn = F.when(F.col("place") <= F.floor(F.col("of") * percent / F.lit(100)), F.col("place"))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return (
        ranked.withColumn("rank", drawn.cast("long")).select(*rest.columns).unionByName(rest)
        .select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
    )
