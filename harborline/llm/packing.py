"""Best-fit packing of tokenised documents into sequences, by bin completion on the histogram of lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .common import byte_slices, small_batches

CAPACITY = 2048
END_ID = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Words of so many letters at most are kept with their ids in a Python worker; words encoded, bytes cut at once.
WORDS_KEPT, LETTERS_KEPT, WORDS_AT_ONCE, BYTES_AT_ONCE = 400_000, 64, 2_000, 4 * 1024 * 1024
# Branch-and-bound: fillings tried first, and branches and fillings looked at, besides two for each token of the capacity.
PROMISING, NODES = 4, 500
ROWS_PER_CELL = 500

Pattern = tuple[tuple[tuple[int, int], ...], int]


def _space(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    last = len(raw)
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(raw == lead)
        size = 2 if lead == 0xC2 else 3
        at = at[at + size <= last]
        b, c = raw[at + 1], raw[at + size - 1]
        if lead == 0xC2:
            hit = (b == 0x85) | (b == 0xA0)
        elif lead == 0xE1:
            hit = (b == 0x9A) & (c == 0x80)
        elif lead == 0xE2:
            hit = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        else:
            hit = (b == 0x80) & (c == 0x80)
        for k in range(size):
            space[at[hit] + k] = True
    return space


class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary never joins text across certain places, wherever it begins to read: between a character and white space
    behind it, between an ASCII letter and an ASCII mark or digit behind it, and behind a single line end. Texts are cut
    there, equal words of a batch are found by a dictionary, and each is encoded once. Ids of short words are kept in two
    generations: when the younger is full it takes the place of the older, and words that are met move to the younger.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.line_end = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words: those that white space cannot change are encoded together, a line end between them."""
        out: list[bytes | None] = [None] * len(words)
        heads = (w[1:2] if w[0] == " " else w[0] for w in words)
        plain = [k for k, head in enumerate(heads) if head and not head.isspace()]
        for at in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[at : at + WORDS_AT_ONCE]
            ids = self._ids(["\n".join([words[k] for k in part])])[0]
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) != len(part) - 1:
                continue
            begin = [0, *(4 * (ends + 1)).tolist()]
            stop = [*(4 * ends).tolist(), 4 * len(ids)]
            whole = ids.tobytes()
            for k, i, j in zip(part, begin, stop):
                out[k] = whole[i:j]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._ids([words[k] for k in rest])):
            out[k] = ids.tobytes()
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, words))
        fresh = []
        for k, ids in enumerate(found):
            if ids is None:
                ids = found[k] = old.get(words[k])
                if ids is None:
                    fresh.append(k)
                else:
                    young[words[k]] = ids
        for k, ids in zip(fresh, self._encode([words[k] for k in fresh])):
            found[k] = ids
            if len(words[k]) <= LETTERS_KEPT:
                young[words[k]] = ids
        if len(young) > WORDS_KEPT // 2:
            self.young, self.old = {}, young
        return found

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text; NULL is an empty text."""
        whole = pa.record_batch({"text": texts.cast(pa.large_string()).fill_null("")})
        for part in byte_slices(whole, 0, BYTES_AT_ONCE):
            yield from self._some(part.column(0))

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(begin[0]), int(begin[-1])
        if low == high:
            yield from [np.zeros(0, "<u4")] * (len(begin) - 1)
            return
        data = texts.buffers()[2].slice(low, high - low)
        raw = np.frombuffer(data, np.uint8)
        space = _space(raw)
        letter = (raw | 32) - np.uint8(97) < 26
        start = np.zeros(len(raw), dtype=bool)
        start[(begin - low)[begin < high]] = True
        start[1:] |= ~space[:-1] & space[1:] | letter[:-1] & ~letter[1:] & (raw[1:] < 128)
        line = np.flatnonzero(raw[1:-1] == 10) + 1
        start[line[~space[line - 1] & ~space[line + 1]] + 1] = True
        cut = np.append(np.flatnonzero(start), len(raw))
        units = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), data])
        coded = units.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = self._known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(known), "<u4")
        each = size[code]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first[code] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(cut, begin - low)]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[i:j]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document; only a first piece may be shorter than a sequence."""
    head = length % capacity
    whole = [(s, capacity) for s in range(head, length, capacity)]
    return [(0, head), *whole] if head else whole


def tokenised_pieces(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY, with_ids: bool = True,
) -> DataFrame:
    """Token ids of every document with the end id behind, cut into pieces of at most `capacity`.

    Output: the id, `piece`, `start`, `length`, `ids_crc32` and, if asked for, `ids` (little-endian unsigned 32-bit). NULL and
    empty texts are the end id alone; a repeated row gives its pieces again.
    """
    small_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for key, found in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = found.tobytes() + end
                for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * s : 4 * (s + n)]
                    rows.append((key, i, s, n, crc32(part), part)[: 6 if with_ids else 5])
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def lower_bound(counts: np.ndarray) -> int:
    """Least number of sequences any packing needs; `counts[s]` documents have length s.

    The largest, over thresholds t, of: documents too long to share with one of length t, those over half, and what the
    middle lengths need beyond the room beside the latter.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for t in range(0, half + 1):
        top = capacity - t
        over = int(number[-1] - number[top])
        wide = int(number[top] - number[half]) if top > half else 0
        room = wide * capacity - int(total[top] - total[half]) if top > half else 0
        below = int(total[half] - (total[t - 1] if t else 0))
        best = max(best, over + wide + max(0, -(-(below - room) // capacity)))
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing on the histogram, moving all documents of a length and all sequences of one kind at once."""
    capacity = len(counts) - 1
    open_: dict[int, dict[tuple, int]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        for room in sorted(r for r in list(open_) if r >= s):
            # A sequence with room r takes r // s of this length; best fit fills the tightest first.
            for kind, n in list(open_[room].items()):
                k = room // s
                while left and n and k:
                    m = min(n, left // k)
                    if not m:
                        k = left
                        continue
                    open_[room][kind] -= m
                    if not open_[room][kind]:
                        del open_[room][kind]
                    n -= m
                    left -= m * k
                    to = open_.setdefault(room - k * s, {})
                    fuller = (*kind, (s, k))
                    to[fuller] = to.get(fuller, 0) + m
            if not open_[room]:
                del open_[room]
            if not left:
                break
        k = capacity // s
        for per, times in ((k, left // k), (left % k, 1)):
            if per and times:
                to = open_.setdefault(capacity - per * s, {})
                to[((s, per),)] = to.get(((s, per),), 0) + times
    return [(kind, n) for group in open_.values() for kind, n in group.items()]


def _dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the documents of `other` can be grouped so that each group fits into its own document of `one`."""
    bins = list(one)

    def place(k: int) -> bool:
        if k == len(other):
            return True
        tried = set()
        for i, free in enumerate(bins):
            if free >= other[k] and free not in tried:
                tried.add(free)
                bins[i] -= other[k]
                if place(k + 1):
                    return True
                bins[i] += other[k]
        return False

    return sum(one) >= sum(other) and place(0)


def _exact_pairs(counts: np.ndarray, have: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Pairs of lengths that fill the room to the last token, the evenest first."""
    big = have[have * 2 >= room]
    small = room - big
    ok = (counts[small] > 0) & ((big != small) | (counts[big] > 1))
    return [(int(b), int(room - b)) for b in big[ok]]


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of `room`, lazily: one document, then pairs, triples and more; None for one passed over.

    A document as long as the room dominates every other filling. Exact pairs come before other pairs, the evenest first
    since short documents serve best for what is left at the end. A filling is passed over if a document left out could
    take the place of a shorter one in it, or be added, or if one of the fillings before it dominates it.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        yield ()
        return
    if have[-1] == room:
        yield (room,)
        return
    given = _exact_pairs(counts, have, room)
    yield from list(given)

    def maximal(filling: tuple[int, ...], spare: int) -> bool:
        """No document left out fits beside, or in place of a shorter one."""
        used = Counter(filling)
        if not spare:
            return True
        for s in (0, *used):
            between = np.flatnonzero(counts[s + 1 : s + spare + 1]) + s + 1
            if any(counts[x] > used[int(x)] for x in between):
                return False
        return True

    def longer(size: int, top: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...] | None]:
        fit = have[: np.searchsorted(have, min(top, left), side="right")][::-1]
        fit = [s for s in fit.tolist() if counts[s] > chosen.count(s)]
        # The last document is the longest that fits: any other would leave it out.
        if size == 1 and fit:
            yield (*chosen, fit[0]) if maximal((*chosen, fit[0]), left - fit[0]) else None
        elif size == 1:
            yield None
        else:
            for s in fit:
                yield from longer(size - 1, s, left - s, (*chosen, s))

    for size in range(1, room // int(have[0]) + 1):
        for filling in longer(size, room, room, ()):
            if filling is None or filling in given or any(_dominates(g, filling) for g in given):
                yield None
            else:
                given.append(filling)
                yield filling


def promising(counts: np.ndarray, room: int, most: int = PROMISING) -> list[tuple[int, ...]]:
    """At most `most` fillings to begin with: exact pairs, or each of the largest lengths that fit, filled up alike."""
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    if have[-1] == room:
        return [(room,)]
    pairs = _exact_pairs(counts, have, room)
    if pairs:
        return pairs[:most]
    out = []
    for s in have[::-1][:most].tolist():
        using = counts.copy()
        using[s] -= 1
        out.append((s, *promising(using, room - s, 1)[0]))
    return out


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> list[Pattern]:
    """Packing with as few sequences as the search finds; never more than best fit.

    Branch-and-bound around the largest document left. A first search takes only promising fillings, each applied as often
    as the lengths allow, and soon comes down. A second one takes all undominated fillings, made when the search comes back
    to them, and applies them less often too, down to once. A branch ends when its waste exceeds what a better packing than
    the incumbent may waste. The search starts from best fit and stops at the lower bound; each of the two also stops after
    `nodes` + 2 x capacity branches and fillings passed over, and may then miss the optimum.
    """
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    best = best_fit(counts)
    used, least = sum(n for _, n in best), lower_bound(counts)
    total = int((counts * np.arange(capacity + 1)).sum())

    def branches(state: np.ndarray, every: bool) -> Iterator[tuple[dict[int, int], int] | None]:
        top = int(np.flatnonzero(state)[-1])
        beside = state.copy()
        beside[top] -= 1
        first = promising(beside, capacity - top)
        tried: list[tuple[dict[int, int], int]] = []
        for filling in chain(first, fillings(beside, capacity - top) if every else ()):
            if filling is None or len(tried) >= len(first) and filling in first:
                yield None
                continue
            need: dict[int, int] = {top: 1}
            for s in filling:
                need[s] = need.get(s, 0) + 1
            tried.append((need, min(int(state[s]) // k for s, k in need.items())))
            yield tried[-1]
        for need, times in tried if every else ():
            while times > 1:
                times //= 2
                yield need, times

    for every in (False, True):
        # A level of the search: its state, the patterns chosen, their waste, and the branches not yet taken.
        stack: list[tuple[np.ndarray, list[Pattern], int, Iterator]] = [(counts, [], 0, branches(counts, every))] if total else []
        seen = 0
        while stack and used > least:
            state, chosen, waste, rest = stack[-1]
            step = next(rest, ())
            if step == ():
                stack.pop()
                continue
            seen += 1
            if seen > nodes + 2 * capacity:
                break
            if step is None:
                continue
            need, times = step
            waste += (capacity - sum(s * k for s, k in need.items())) * times
            if waste > (used - 1) * capacity - total:
                continue
            after = state.copy()
            for s, k in need.items():
                after[s] -= k * times
            chosen = [*chosen, (tuple(sorted(need.items(), reverse=True)), times)]
            if after.any():
                stack.append((after, chosen, waste, branches(after, every)))
            else:
                best, used = chosen, sum(n for _, n in chosen)
    return best


def _segments(patterns: Sequence[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the documents of a length go: by their number within the length, ascending."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, first = [], 0
    for kind, times in patterns:
        at = 0
        for s, k in kind:
            rows.append((s, taken[s], k, first, at))
            taken[s] += k * times
            at += s * k
        first += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5


def pack(pieces: DataFrame, keys: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to a written frame of pieces with a `length` of 1 to `capacity`.

    Only the histogram of lengths (at most `capacity` numbers) reaches the driver. The solution says how many documents of
    which lengths share a sequence; a piece finds its place from its number among the pieces of its length, counted by hash
    cells so that a length held by very many pieces is not numbered in one task. `keys` tell pieces apart; equal pieces
    are numbered in any order.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    for row in sizes:
        counts[row["length"]] = row["n"]
    size, since, each, first, at = _segments(bin_completion(counts), capacity)
    code = size * (1 << 44) + since

    def locate(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(), number.to_numpy()
        k = np.searchsorted(code, length * (1 << 44) + number, side="right") - 1
        past = number - since[k]
        return pd.DataFrame({"sequence_id": first[k] + past // each[k], "offset": at[k] + past % each[k] * length})

    per_length = spark.createDataFrame(
        [(r["length"], max(1, -(-r["n"] // ROWS_PER_CELL))) for r in sizes], "length long, cells long")
    rows = pinned(pieces.join(F.broadcast(per_length), "length").withColumn(
        "cell", F.pmod(F.xxhash64(*keys), F.col("cells"))).drop("cells"))
    over = Window.partitionBy("length").orderBy("cell")
    before = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "cell", (F.sum("n").over(over) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "cell").orderBy(*keys)
    place = F.pandas_udf(locate, "sequence_id long, offset long")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1).join(before, ["length", "cell"])
    return (
        numbered.withColumn("place", place("length", F.col("before") + F.col("number")))
        .select(*pieces.columns, "place.sequence_id", "place.offset")
    )


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packed pieces of all documents, with the CRC-32 of their ids in place of the ids.

    Output: the id, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`. NULL and empty texts are one piece
    of length 1. Repeated rows are packed as often as they stand there, NULL ids too. An empty table gives no rows; extra
    columns are not read.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    light = pinned(tokenised_pieces(named, with_ids=False))
    return pack(light, ["doc_id", "piece", "start", "ids_crc32"]).withColumnRenamed("doc_id", id_column)
