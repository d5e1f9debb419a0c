"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .common import hidden, small_batches

# The model is fitted on at most so many labelled rows, taken by a hash of their id.
LABELLED_ROWS = 20_000
# Features kept, by strength of their link with the labels; a feature must stand in so many labelled rows.
FEATURES, LEAST_ROWS = 4_096, 8
PREFIXES = (4, 5, 6)
EDGE = " .,;:!?\"'()[]{}<>«»“”„…-"
WORDS_KEPT = 200_000
STEPS, RATE, PENALTY = 400, 0.05, 2e-4
# A row is toxic if grade 1 or more is at least this likely.
REJECT_AT = 0.5


@dataclass
class OrdinalModel:
    """P(grade > k) = logistic(weights . features - thresholds[k]), one weight vector for all thresholds."""

    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceedance(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score, float)[:, None], -40, 40)))


def word_features(word: str) -> tuple[str, ...]:
    """A word and its beginnings, since an insult may carry any ending."""
    return (word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k))


def words_of(text: str | None) -> set[str]:
    """Distinct words of a whole text: lower case, split at white space, punctuation at the edges taken off."""
    found = {w.strip(EDGE) for w in set((text or "").lower().split())}
    found.discard("")
    return found


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in word_features(w)}


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by penalised maximum likelihood (full-batch Adam).

    `rows` holds the feature numbers present in each row, `grades` 0..top.
    """
    n = len(rows)
    index = np.concatenate(rows) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    above = np.array([max(1e-3, (grades > k).mean()) if n else 0.5 for k in range(top)])
    start = np.maximum.accumulate(np.log((1 - above + 1e-6) / above))
    params = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w = params[:features]
        cuts = np.cumsum(np.concatenate([params[features : features + 1], np.exp(params[features + 1 :])]))
        score = np.bincount(owner, w[index], n) if n else np.zeros(0)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        cdf = lambda x: 1 / (1 + np.exp(np.clip(-x, -40, 40)))
        high, low = cdf(edges[grades + 1] - score), cdf(edges[grades] - score)
        likely = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        by_score = (slope_high - slope_low) / likely / max(n, 1)
        gradient = np.zeros_like(params)
        gradient[:features] = np.bincount(index, by_score[owner], features) + PENALTY * w
        by_cut = np.zeros(top)
        for k in range(top):
            by_cut[k] = -(np.sum((slope_high / likely)[grades == k]) - np.sum((slope_low / likely)[grades == k + 1])) / max(n, 1)
        gradient[features] = by_cut.sum()
        for k in range(1, top):
            gradient[features + k] = np.exp(params[features + k]) * by_cut[k:].sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate([params[features : features + 1], np.exp(params[features + 1 :])]))
    return params[:features], cuts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, toxic = Counter(), Counter()
    for batch in batches:
        for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = features_of(text)
            seen.update(found)
            if bad:
                toxic.update(found)
    names = list(seen)
    yield pa.record_batch({
        "feature": pa.array(names, pa.string()), "n": pa.array([seen[f] for f in names], pa.int64()),
        "t": pa.array([toxic[f] for f in names], pa.int64())})


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """At most LABELLED_ROWS labelled texts as `text`, `toxic` (an id with several labels takes the worst one).

    The label rows kept are few by construction, so they are broadcast. An id that stands on several rows gives one text, the
    one of least hash, chosen before the shuffle; so a repeated id cannot break the bound.
    """
    kept = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
        .select(F.col("doc_id").alias("label_id"), "toxic")
    )
    texts = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text"))
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), F.col("text"))
    return (
        texts.join(F.broadcast(kept), "label_id")
        .groupBy("label_id").agg(F.min_by("text", order).alias("text"), F.max("toxic").alias("toxic")).drop("label_id")
    )


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> OrdinalModel:
    """Severity model with grades 0 (clean), 1 (toxic) and 2 (toxic with at least the median number of toxic features).

    Labels say only toxic or not. Features are the words and word beginnings most strongly linked with the label; the grade
    of a toxic row is then read off how many of the strongly toxic ones it holds. Without a toxic and a clean labelled row
    the model has no features and grades everything 0.
    """
    small_batches(docs.sparkSession)
    # Read three times below: written once instead of three scans and three shuffles of its texts.
    sample = pinned(labelled_sample(docs, labels, id_column, text_column))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not t or t == n:
        return OrdinalModel({}, np.zeros(0), np.array([20.0, 21.0]))
    rate = t / n
    strength = (F.col("t") - rate * F.col("n")) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    best = (
        sample.mapInArrow(_count, "feature string, n long, t long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        .where(F.col("n") >= min(LEAST_ROWS, max(2, t // 4)))
        .select("feature", strength.alias("z"))
        .orderBy(F.abs("z").desc(), "feature").limit(FEATURES)
    ).collect()
    features = {row["feature"]: i for i, row in enumerate(best)}
    marks = np.array([row["z"] for row in best])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features[f] for f in features_of(x) if f in features) for x in batch.column(0).to_pylist()]
            yield pa.record_batch({"present": pa.array(found, pa.list_(pa.int32())), "toxic": batch.column(1)})

    rows = sample.mapInArrow(index, "present array<int>, toxic int").toPandas()
    present = [np.asarray(x, dtype=np.int64) for x in rows["present"]]
    bad = rows["toxic"].to_numpy() > 0
    strong = np.array([(marks[p] > 6).sum() for p in present])
    middle = np.median(strong[bad])
    grades = np.where(bad, np.where(strong > middle, 2, 1), 0)
    weights, cuts = fit_ordinal(present, grades, len(features), 2)
    return OrdinalModel(features, weights, cuts)


def scorer(model: OrdinalModel):
    """A column function giving `severity` (expected grade), `grade` and `toxic` of a text column."""
    weight_of = {f: float(model.weights[i]) for f, i in model.features.items()}
    thresholds, known = model.thresholds, {}

    def score(texts: pd.Series) -> pd.DataFrame:
        total = np.zeros(len(texts))
        for row, text in enumerate(texts):
            found = set()
            for w in words_of(text):
                hits = known.get(w)
                if hits is None:
                    hits = tuple(f for f in word_features(w) if f in weight_of)
                    if len(known) > WORDS_KEPT:
                        known.clear()
                    known[w] = hits
                if hits:
                    found.update(hits)
            total[row] = sum(weight_of[f] for f in sorted(found))
        above = OrdinalModel({}, np.zeros(0), thresholds).exceedance(total)
        steps = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": np.argmax(steps[:, :-1] - steps[:, 1:], axis=1).astype("int32"),
                             "toxic": above[:, 0] >= REJECT_AT})

    udf = F.pandas_udf(score, "severity double, grade int, toxic boolean")
    return lambda text: udf(text)


def grade_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Severity of every whole text.

    Output: the id, `severity` (expected grade, 0 to 2), `grade` (the likeliest), `toxic`. NULL and empty texts have no
    feature and get the severity of such a text. Repeated rows are graded each. An empty table gives no rows; extra columns
    are not read.
    """
    rows = docs.select(F.col(id_column), scorer(fit(docs, labels, id_column, text_column))(F.col(text_column)).alias("s"))
    return rows.select(id_column, "s.severity", "s.grade", "s.toxic")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    name = hidden(docs, "severity")
    scored = docs.withColumn(name, scorer(fit(docs, labels))(F.col("text")))
    return scored.where(~F.col(f"{name}.toxic")).drop(name)
