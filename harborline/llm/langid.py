"""Language identification by unigram piece models that sum over all segmentations of a text."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pinned
from .common import small_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORD_START = "▁"
EDGE = ".,;:!?\"'()[]{}<>«»“”„…-"
# Labelled rows the model is fitted on at most, taken by hash.
TRAINING_ROWS = 20_000
# A longer run of non-space is read as several words of this length, so that products stay within a double.
LONGEST_WORD = 32
# Probability of a character that no piece covers; smoothing count of every piece; training rounds.
UNKNOWN, SMOOTHING, ROUNDS = 1e-7, 0.1, 2
WORDS_KEPT, FLUSH_WORDS = 300_000, 200_000
LATTICE_WORDS = 4_096
HASH_FACTOR = 0x9E3779B97F4A7C15
UNDECIDED = "und"


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Number of every ordinary piece of the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: i for i, p in enumerate(found)}


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


@lru_cache(maxsize=2)
def _hashed_pieces(path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length from 1: ascending hashes of the pieces that long, and their numbers."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for piece, number in pieces(path).items():
        h = 0
        for c in _characters(piece).tolist():
            h = (h * HASH_FACTOR + c) % (1 << 64)
        by_length.setdefault(len(piece), []).append((h, number))
    out = []
    for n in range(1, max(by_length) + 1):
        rows = sorted(by_length.get(n, [(0, -1)]))
        out.append((np.array([h for h, _ in rows], dtype=np.uint64), np.array([k for _, k in rows], dtype=np.int64)))
    return out


def core_of(word: str) -> str:
    """A word without punctuation at its edges; one of punctuation only stays."""
    return word.strip(EDGE) or word


def segments_of(word: str) -> list[str]:
    """What the model reads for one word: the vocabulary's word start and the letters, an overlong word in parts.

    A piece never runs across two words, so the sum over all segmentations of a text is the product over its words.
    """
    if len(word) <= LONGEST_WORD:
        return [WORD_START + word]
    return [WORD_START * (i == 0) + word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]


def words_of(text: str | None) -> list[str]:
    return [part for w in (text or "").lower().split() for part in segments_of(core_of(w))]


class Lattice:
    """All pieces at all places of some words, ordered by where they end, then by word."""

    def __init__(self, words: list[str], path: str):
        unknown = len(pieces(path))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        letters = _characters("".join(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        # A hash of the next n letters at every place, for n = 1, 2, ..., is looked up among the pieces of that length.
        at, hashes, found = np.arange(len(letters)), np.zeros(len(letters), dtype=np.uint64), []
        for n, (known, numbers) in enumerate(_hashed_pieces(path), start=1):
            inside = left[at] >= n
            at, hashes = at[inside], hashes[inside]
            if not len(at):
                break
            hashes = hashes * np.uint64(HASH_FACTOR) + letters[at + n - 1]
            k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = (known[k] == hashes) & (numbers[k] >= 0)
            number = np.where(hit, numbers[k], unknown)
            keep = at if n == 1 else at[hit]
            found.append((owner[keep], place[keep], place[keep] + n, number if n == 1 else number[hit]))
        word, start, end, piece = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        self.words = len(words)
        self.length = sizes
        order = np.argsort(end * len(words) + word, kind="stable")
        self.word, self.start, self.end, self.piece = (c[order] for c in (word, start, end, piece))
        self.edges = np.searchsorted(self.end, np.arange(1, int(self.length.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sum over segmentations of every prefix: (word, length, language); `p` is (pieces + 1, languages)."""
        alpha = np.zeros((self.words, len(self.edges), p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, len(self.edges)):
            s = slice(self.edges[j - 1], self.edges[j])
            w = self.word[s]
            if len(w):
                part = alpha[w, self.start[s]] * p[self.piece[s]]
                heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[heads], j] = np.add.reduceat(part, heads, axis=0)
        return alpha

    def log_total(self, p: np.ndarray) -> np.ndarray:
        alpha = self.forward(p)
        return np.log(alpha[np.arange(self.words), self.length])

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece in every language; `counts` is (word, language)."""
        alpha = self.forward(p)
        total = alpha[np.arange(self.words), self.length]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.words), self.length] = counts / total
        out = np.zeros_like(p)
        for j in range(len(self.edges) - 1, 0, -1):
            s = slice(self.edges[j - 1], self.edges[j])
            w, i, piece = self.word[s], self.start[s], self.piece[s]
            if len(w):
                tail = beta[w, j] * p[piece]
                np.add.at(beta, (w, i), tail)
                np.add.at(out, piece, tail * alpha[w, i])
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        columns = list(zip(*rows)) or [()] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                               names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield flush()
    yield flush()


class LanguageModel:
    """Languages in order and the piece probabilities (pieces and the unknown character last, by language)."""

    def __init__(self, languages: list[str], p: np.ndarray, path: str):
        self.languages, self.p, self.path = languages, p, path


def row_shares(sizes: dict[str, int], bound: int) -> dict[str, int]:
    """Rows each language may give so that all give `bound` at most: small languages all they have, large ones alike."""
    shares = {}
    for left, (lang, size) in zip(range(len(sizes), 0, -1), sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        shares[lang] = min(size, (bound - sum(shares.values())) // left)
    return shares


def train(texts: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities of every language from `lang` and `text`, by expectation-maximisation over all words.

    At most TRAINING_ROWS rows are learned from, shared out by language, so that a rare language stays known however many
    rows the others have (rows equal in id and text are taken or left together). Words are counted first, and each round runs over the distinct words only. What reaches the driver
    is one number per piece and language. Without rows there is no language.
    """
    spark = small_batches(texts.sparkSession)
    rows = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", *[c for c in texts.columns if c == "id"])
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(sizes.values()) > TRAINING_ROWS:
        # Rows of least hash, a tenth below each language's share; taken by a filter, so no task gathers them.
        below = [[F.lit(lang), F.lit(min(2**63 - 1, int(0.9 * share / sizes[lang] * 2**64) - 2**63))]
                 for lang, share in row_shares(sizes, TRAINING_ROWS).items() if share < sizes[lang]]
        limit = F.create_map(*[part for pair in below for part in pair])
        rows = rows.where(F.xxhash64(*rows.columns) <= F.coalesce(limit[F.col("lang")], F.lit(2**63 - 1)))
    words = pinned(rows.mapInArrow(_count_words, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    number = len(pieces(vocabulary))
    p = np.full((number + 1, len(languages)), 1 / (number + 1))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, place = shared.value, {lang: i for i, lang in enumerate(languages)}
            out = np.zeros_like(p)
            for batch in batches:
                for at in range(0, batch.num_rows, LATTICE_WORDS):
                    part = batch.slice(at, LATTICE_WORDS).to_pydict()
                    counts = np.zeros((len(part["word"]), p.shape[1]))
                    counts[np.arange(len(counts)), [place[x] for x in part["lang"]]] = part["n"]
                    out += Lattice(part["word"], vocabulary).expected(p, counts)
            piece, lang = np.nonzero(out)
            yield pa.record_batch({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": out[piece, lang]})

        found = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(
            F.sum("n").alias("n")).toPandas()
        n = np.zeros_like(p)
        n[found["piece"], found["lang"]] = found["n"]
        n[:-1] += SMOOTHING
        p = n / n[:-1].sum(axis=0)
        p[-1] = UNKNOWN
        shared.unpersist()
    return LanguageModel(languages, p, vocabulary)


_SCORES: dict = {"model": None}


def predictor(model: LanguageModel):
    """A column function giving `lang_pred` and `score` (posterior under equal priors) of a text column."""
    languages, path, token = model.languages, model.path, uuid.uuid4().hex
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model.p)

    def predict(texts: pd.Series) -> pd.DataFrame:
        store = _SCORES
        if store["model"] != token or len(store["place"]) > WORDS_KEPT:
            store.update(model=token, place={}, logs=np.zeros((0, len(languages))))
        place = store["place"]
        lists = [(t or "").lower().split() for t in texts]
        fresh = {w for words in lists for w in words if w not in place}
        cores = list({core_of(w) for w in fresh}.difference(place))
        logs = [store["logs"]]
        for at in range(0, len(cores), LATTICE_WORDS):
            parts = [segments_of(w) for w in cores[at : at + LATTICE_WORDS]]
            total = Lattice([x for p in parts for x in p], path).log_total(shared.value)
            heads = np.cumsum([0, *map(len, parts[:-1])])
            logs.append(np.add.reduceat(total, heads, axis=0))
        place.update(zip(cores, range(len(store["logs"]), len(store["logs"]) + len(cores))))
        place.update([(w, place[core_of(w)]) for w in fresh.difference(cores)])
        table = store["logs"] = np.concatenate(logs)
        names, scores = [], []
        for text, words in zip(texts, lists):
            if not languages or not any(map(str.isalpha, text or "")):
                names.append(UNDECIDED)
                scores.append(0.0)
                continue
            total = table[list(map(place.__getitem__, words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))
            names.append(languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    return lambda text: udf(text)


def held_out(id_column: str) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text leaves 1 when divided by 3. NULL ids are not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Predicted language of every whole text, learned from the labelled rows that are not held out.

    Output: the id, `held_out`, `lang_pred`, `score`. NULL text, text without a letter, and any text when there is nothing
    to learn from give `und` with score 0. Ties go to the language first in order. Repeated rows are predicted each; an
    empty table gives no rows; extra columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"),
                       held_out(id_column).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    found = rows.select("id", "held_out", predictor(model)(F.col("text")).alias("p"))
    return found.select(F.col("id").alias(id_column), "held_out", "p.lang_pred", "p.score")
