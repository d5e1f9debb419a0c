"""Byte-level BPE of whole texts by a file of ranks: long texts in overlapping chunks, stitched where their scans agree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .common import small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Characters of a text that one task reads at once, and how far a chunk reads into the next one.
CHUNK, OVERLAP = 32_768, 256
# The library's matcher can run out of stack on longer texts; those are matched here, piece by piece.
MATCHED_AT_ONCE = 65_536
# A match near the end of a chunk may change with what follows: a contraction looks two characters ahead.
LOOKAHEAD = 3


class Tokenizer:
    """Ids of a text by byte-pair ranks, and its pre-token boundaries."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        # A boundary that every scan meets, wherever it starts: no match goes on across such a change of class.
        self.anchor = regex.compile(r"\S\s|\p{L}[^\s\p{L}]|\p{N}[^\s\p{N}]")
        self.unlike = self._unlike(regex, tiktoken)
        self.first_unlike = chr(min(self.unlike, default=0x10FFFF))

    @staticmethod
    def _unlike(regex, tiktoken) -> dict[int, str]:
        """Characters that the two matchers put into different classes, each with a plain one of the encoder's class."""
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        single = {bytes([b]): b for b in range(256)}
        theirs, ours = {}, {}
        for name, plain in (("\\p{L}", "ā"), ("\\p{N}", "٣"), ("\\s", " ")):
            found = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
            theirs.update(dict.fromkeys(map(ord, found.decode()), plain))
            ours.update(dict.fromkeys(map(ord, regex.findall(name, every)), plain))
        return {c: theirs.get(c, "•") for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}

    def _plain(self, text: str) -> str:
        return text.translate(self.unlike) if text and max(text) >= self.first_unlike else text

    def encode(self, text: str) -> list[int]:
        if len(text) <= MATCHED_AT_ONCE:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for match in self.pattern.finditer(self._plain(text)):
            ids += self.encoding._core_bpe.encode_single_piece(text[match.start() : match.end()].encode())
        return ids

    def scan(self, text: str, nominal: int, overlap: int) -> tuple[list[int], list[int], bool]:
        """Pre-token boundaries of a chunk within the reach of its neighbours, from their own starts, and its certainty.

        The first list holds boundaries near the chunk's start, the second those beyond its `nominal` length. Boundaries
        behind white space are left out: where a run of it ends depends on what follows. The last value says whether the
        chunk holds a boundary that every scan meets, so that those beyond are right whatever came before.
        """
        plain = self._plain(text)
        starts = [m.start() for m in self.pattern.finditer(plain)]
        fit = [b for b in starts if b and not plain[b - 1].isspace()]
        head = [b for b in fit if b <= overlap]
        tail = [b - nominal for b in fit if nominal < b <= len(text) - LOOKAHEAD]
        return head, tail, self.anchor.search(plain, endpos=nominal) is not None

    def digests(self, parts: Iterator[list[int]]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal numbers joined by commas, SHA-256 of the bytes they decode to."""
        count, numbers, raw = 0, hashlib.sha256(), hashlib.sha256()
        for ids in parts:
            if ids:
                numbers.update(b"," * (count > 0) + ",".join(map(self.names.__getitem__, ids)).encode())
                raw.update(b"".join(map(self.token_bytes.__getitem__, ids)))
                count += len(ids)
        return count, numbers.hexdigest(), raw.hexdigest()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's own copy, made once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def _first_pass(docs: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """One row per document, finished if it fits a chunk, and the chunks of the longer ones."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(vocabulary)
        for batch in batches:
            done: list[tuple] = []
            for key, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if len(text) <= chunk:
                    done.append((key, None, *known.digests(iter([known.encode(text)])), None, None, None))
                    continue
                done.append((key, mark, None, None, None, None, None, None))
                for k, at in enumerate(range(0, len(text), chunk)):
                    last = at + chunk >= len(text)
                    done.append((key, mark, None, None, None, k, text[at : at + chunk + overlap], last))
                    if len(done) >= 256:
                        yield rows(done, batch)
                        done = []
            yield rows(done, batch)

    def rows(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = ["id", "mark", "n_tokens", "ids_sha256", "decoded_sha256", "chunk", "slice", "last"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 8, types)], names=names)

    # A repeated row needs a mark of its own; it is fixed when the rows are written.
    marked = docs.select("id", F.expr("uuid()").alias("mark"), "text")
    return marked.mapInArrow(run, f"id {kind.simpleString()}, mark string, n_tokens long, ids_sha256 string, "
                                  "decoded_sha256 string, chunk long, slice string, last boolean")


def _cuts(chunks: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """For every chunk of a long text: where its own part begins and ends, and the segment the part belongs to.

    Two neighbours are cut at their first common boundary in the overlap, if the earlier one is in step with the whole
    text: it is the first, it was cut from a neighbour in step, or it holds a boundary that every scan meets. Others
    share a segment, which is encoded as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(vocabulary)
        for batch in batches:
            marks, numbers, texts = (c.to_pylist() for c in batch.columns)
            found = [known.scan(t, chunk, overlap) for t in texts]
            head, tail, sure = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.string()), pa.array(numbers, pa.int64()), pa.array(head, pa.list_(pa.int32())),
                 pa.array(tail, pa.list_(pa.int32())), pa.array(sure, pa.bool_())],
                names=["mark", "chunk", "head", "tail", "sure"])

    parts = chunks.select("mark", "chunk", "slice").repartition("mark", "chunk")
    scanned = parts.mapInArrow(run, "mark string, chunk long, head array<int>, tail array<int>, sure boolean")
    order = Window.partitionBy("mark").orderBy("chunk")
    agreed = scanned.withColumn("agreed", F.array_min(F.array_intersect("tail", F.lead("head").over(order)))).drop("head", "tail")
    came = F.lag("agreed").over(order)
    # In step: the first chunk, and one that agrees with a chunk in step at its end; NULL takes over what came before.
    event = F.when(F.col("chunk") == 0, True).when(came.isNull(), False).when(F.lag("sure").over(order), True)
    in_step = F.last("event", ignorenulls=True).over(order)
    cut = agreed.withColumn("event", event).withColumn("ends", F.when(F.col("sure") | in_step, F.col("agreed")))
    begun = cut.withColumn("begins", F.lag("ends").over(order))
    return begun.withColumn("segment", F.count("begins").over(order)).select("mark", "chunk", "begins", "ends", "segment")


def _segment_ids(chunks: DataFrame, cuts: DataFrame, vocabulary: str, chunk: int) -> DataFrame:
    """Ids of every segment as unsigned 32-bit numbers; the parts of one segment come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(vocabulary)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (mark, segment), group in groupby(rows, key=lambda row: row[:2]):
            text = "".join(part for *_, part in group)
            ids = np.array(known.encode(text), dtype="<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([segment], pa.int64()), pa.array([ids])],
                                             names=["mark", "segment", "ids"])

    begins = F.coalesce("begins", F.lit(0))
    until = F.when(F.col("last"), F.length("slice")).otherwise(F.lit(chunk) + F.coalesce("ends", F.lit(0)))
    parts = chunks.join(cuts, ["mark", "chunk"]).select(
        "mark", "segment", "chunk", F.substring(F.col("slice"), begins + 1, until - begins).alias("part"))
    return (
        parts.repartition("mark", "segment").sortWithinPartitions("mark", "segment", "chunk")
        .select("mark", "segment", "part").mapInArrow(run, "mark string, segment long, ids binary")
    )


def _long_digests(ids: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of every long text from its segments in order, read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(vocabulary)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for mark, group in groupby(rows, key=lambda row: row[0]):
            n, numbers, raw = known.digests(np.frombuffer(part, "<u4").tolist() for _, _, part in group)
            yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([n], pa.int64()), pa.array([numbers]), pa.array([raw])],
                                             names=["of", "n_tokens", "ids_sha256", "decoded_sha256"])

    ordered = ids.repartition("mark").sortWithinPartitions("mark", "segment")
    return ordered.mapInArrow(run, "of string, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes of every whole text.

    Texts of up to `chunk` characters are encoded where they are read. Longer ones are cut into overlapping chunks that
    are spread over all tasks and scanned on their own; neighbours are cut where both scans have a boundary, and the
    pieces between cuts are encoded apart. Only a text's digest needs its ids in order: they are read as a stream.
    The overlap is shorter than a chunk.
    One pre-token is never cut, so a run of letters of any length is encoded in one task.

    Output: the id, `n_tokens`, `ids_sha256`, `decoded_sha256`. NULL and empty texts have no ids and the digests of
    nothing. Repeated rows and NULL ids stay, each row for itself. An empty table gives no rows; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    first = pinned(_first_pass(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), vocabulary, chunk, overlap))
    chunks = first.where("chunk IS NOT NULL").select("mark", "chunk", "slice", "last")
    cuts = pinned(_cuts(chunks, vocabulary, chunk, overlap))
    found = _long_digests(_segment_ids(chunks, cuts, vocabulary, chunk), vocabulary)
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"]
    short = first.where("chunk IS NULL AND mark IS NULL").select(F.col("id").alias(id_column), *columns)
    long = first.where("chunk IS NULL AND mark IS NOT NULL").select(F.col("id").alias(id_column), "mark")
    return short.unionByName(long.join(found, long["mark"] == found["of"]).select(id_column, *columns))
