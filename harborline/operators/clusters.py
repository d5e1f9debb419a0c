"""K-means clusters of sellers and the frames that describe them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind_value, finite, one_row
from ..session import pinned

ROUNDS, TOLERANCE = 100, 1e-6


def standardized(features: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The feature columns as an array `scaled` with mean 0 and deviation 1, and the means and deviations.

    A missing or non-finite value counts as the mean; so does every value of a column without spread.
    """
    values = [finite(c) for c in columns]
    row = features.agg(*[F.coalesce(f(v), F.lit(0.0)) for f in (F.avg, F.stddev_samp) for v in values]).first()
    mean, deviation = np.array(row[: len(columns)]), np.array(row[len(columns) :])
    scaled = [
        F.coalesce((v - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) if s else F.lit(0.0)
        for v, m, s in zip(values, mean, deviation)
    ]
    return features.withColumn("scaled", F.array(*scaled)), mean, deviation


def _vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _distances(x: Column, centres: np.ndarray) -> Column:
    """Squared distance of a vector to every centre."""
    return F.transform(F.array(*[_vector(c) for c in centres]), lambda c: _total(
        F.zip_with(x, c, lambda a, b: (a - b) * (a - b))))


def nearest(x: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, from 0; the first on a tie."""
    return bind_value(_distances(x, centres), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)


def spread_starts(vectors: DataFrame, number: int) -> np.ndarray:
    """Up to `number` starting rows: the one of least hash, then each time the row farthest from all before it.

    `vectors` has `scaled` and the hash `place`, which also breaks ties. One narrow scan per start. The first k of them
    are the start of k clusters, so all k share them. Ends early when every row equals a start.
    """
    first = vectors.agg(F.min_by("scaled", "place")).first()[0]
    starts = [] if first is None else [first]
    while starts and len(starts) < number:
        gap = F.array_min(_distances(F.col("scaled"), np.array(starts)))
        far = vectors.agg(F.min_by(F.struct("scaled", gap.alias("gap")), F.struct(-gap, F.col("place")))).first()[0]
        if not far["gap"] > 0:
            break
        starts.append(far["scaled"])
    return np.array(starts)


def cluster_sums(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    """For every k the rows, vector sums and sums of squared lengths of its clusters; one scan for all k.

    A row meets its nearest centre of every k and is summed before it is shuffled, so a task sends one row per cluster.
    """
    x = F.col("scaled")
    width = next(iter(centres.values())).shape[1]
    labels = [F.struct(F.lit(k).alias("k"), nearest(x, c).alias("cluster")) for k, c in centres.items()]
    sums = (
        vectors.select("scaled", F.explode(F.array(*labels)).alias("l")).groupBy("l.k", "l.cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_total(F.transform(x, lambda v: v * v))).alias("squares"),
             F.array(*[F.sum(x[i]) for i in range(width)]).alias("total"))
    ).collect()  # At most 2 + 3 + ... + max_k rows.
    out = {k: (np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))) for k, c in centres.items()}
    for row in sums:
        for kept, value in zip(out[row["k"]], (row["n"], row["total"], row["squares"])):
            kept[row["cluster"]] = value
    return out


def fit_centres(vectors: DataFrame, ks: Sequence[int], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[int, np.ndarray]:
    """Centres for every k that has enough unlike rows. All k move in the same scan; a k whose centres moved less than
    `tolerance` is left out of the following rounds. A centre without rows stays where it is."""
    starts = spread_starts(vectors, max(ks, default=0))
    centres = {k: starts[:k] for k in ks if 1 <= k <= len(starts)}
    moving = dict(centres)
    for _ in range(rounds):
        if not moving:
            break
        for k, (n, total, _) in cluster_sums(vectors, moving).items():
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], moving[k])
            far = np.sqrt(((moved - moving[k]) ** 2).sum(axis=1)).max()
            centres[k] = moving[k] = moved
            if far < tolerance:
                del moving[k]
    return centres


def silhouettes(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette by squared distances of every k: one scan for the sums, one for all the means.

    The mean squared distance of a row to a cluster follows from the cluster's size, vector sum and sum of squares, so no
    two rows are compared. A row alone in its cluster has silhouette 0.
    """
    if not centres:
        return {}
    x = F.col("scaled")
    squares = _total(F.transform(x, lambda v: v * v))

    def mean_of(k: int, n: np.ndarray, total: np.ndarray, squared: np.ndarray) -> Column:
        def gap(c: int) -> Column:
            dot = _total(F.zip_with(x, _vector(total[c] / n[c]), lambda a, b: a * b))
            return squares + F.lit(float(squared[c] / n[c])) - dot * 2

        filled = [c for c in range(k) if n[c] > 0]
        label = nearest(x, centres[k])
        gaps = F.array(*[F.greatest(gap(c), F.lit(0.0)) if n[c] else F.lit(None).cast("double") for c in range(k)])

        def value(s: Column) -> Column:
            own = F.get(s["gaps"], s["label"]) * F.get(s["correction"], s["label"])
            others = F.array_min(F.transform(s["gaps"], lambda g, i: F.when(i != s["label"], g)))
            top = F.greatest(own, others)
            return F.when((F.get(s["sizes"], s["label"]) > 1) & (top > 0), (others - own) / top).otherwise(0.0)

        state = F.struct(gaps.alias("gaps"), label.alias("label"), _vector(n).alias("sizes"),
                         _vector(n / np.maximum(n - 1, 1)).alias("correction"))
        return F.avg(bind_value(state, value)) if len(filled) > 1 else F.lit(0.0)

    sums = cluster_sums(vectors, centres)
    row = vectors.agg(F.count(F.lit(1)), *[mean_of(k, *sums[k]) for k in centres]).first()
    return {k: float(row[i]) for i, k in enumerate(centres, 1)}


def _vectors(scaled: DataFrame, key: str) -> DataFrame:
    """The vectors and their hash, written down: every round scans them."""
    return pinned(scaled.select("scaled", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("place")))


def silhouette_by_k(features: DataFrame, columns: Sequence[str], max_k: int = 10, key: str = "seller_id") -> DataFrame:
    """Silhouette of k-means for k from 2 to `max_k`, as (k, silhouette, best); the smaller k is best on a tie.

    k stays below the number of rows and at most at that of unlike rows.
    """
    vectors = _vectors(standardized(pinned(features), columns)[0], key)
    top = min(max_k, vectors.count() - 1)
    scores = silhouettes(vectors, fit_centres(vectors, range(2, top + 1)))
    best = max(scores, key=lambda k: (scores[k], -k), default=None)
    return features.sparkSession.createDataFrame(
        [(k, score, k == best) for k, score in scores.items()], "k int, silhouette double, best boolean")


def best_k(features: DataFrame, columns: Sequence[str], max_k: int = 10, default: int = 3, key: str = "seller_id") -> int:
    """The k with the best silhouette, the smaller on a tie."""
    row = silhouette_by_k(features, columns, max_k, key).where("best").first()
    return row["k"] if row else default


def cluster_sellers(
    features: DataFrame, columns: Sequence[str], k: int | None = 3, key: str = "seller_id"
) -> tuple[DataFrame, DataFrame, float]:
    """Cluster label per seller, centres in original units, and the silhouette. `k=None` searches k.

    With fewer unlike rows than k each of them is a cluster. Without rows there are no centres and the silhouette is 0.
    """
    fixed = pinned(features)
    k = k or best_k(fixed, columns, key=key)
    scaled, mean, deviation = standardized(fixed, columns)
    vectors = _vectors(scaled, key)
    starts = spread_starts(vectors, k)
    found = fit_centres(vectors, [min(k, len(starts))])
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in columns)
    if not found:
        return fixed.withColumn("cluster", F.lit(None).cast("int")), fixed.sparkSession.createDataFrame([], schema), 0.0
    [centres] = found.values()
    table = fixed.sparkSession.createDataFrame(
        [(i, *map(float, c * deviation + mean)) for i, c in enumerate(centres)], schema)
    labelled = scaled.withColumn("cluster", nearest(F.col("scaled"), centres)).drop("scaled")
    return labelled, table, next(iter(silhouettes(vectors, found).values()))


def order_clusters(labelled: DataFrame, label: str = "prediction") -> DataFrame:
    """Clusters from best (0) to worst by mean sales, processing time and on-time share; one row per cluster."""
    means = labelled.groupBy(label).agg(
        F.avg("total_sales").alias("avg_sales"), F.avg("avg_processing_time").alias("avg_proc_time"),
        F.avg("on_time_delivery_rate").alias("avg_otd"),
    )
    top = one_row(means, F.max("avg_sales").alias("s"), F.max("avg_proc_time").alias("p"))
    scored = means.withColumn("__t", top).withColumn(
        "score",
        F.try_divide("avg_sales", F.col("__t")["s"]) * 40
        + (1 - F.try_divide("avg_proc_time", F.col("__t")["p"])) * 30 + F.col("avg_otd") * 30,
    ).drop("__t")
    # One row per cluster: k rows in all.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), label)) - 1
    return scored.withColumn("performance_cluster", place)


def principal_axes(features: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two principal components per row (pc1, pc2), and per feature its loadings with the explained variance.

    The covariances of all pairs of columns are one aggregate; the axes are those of that small matrix. The sign of an
    axis is fixed so that its largest loading is positive. Missing values count as the mean, columns without spread load 0;
    without spread at all the explained variance is 0.
    """
    scaled, _, _ = standardized(pinned(features), columns)
    x, d = F.col("scaled"), len(columns)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    row = scaled.agg(*[F.coalesce(F.covar_samp(x[i], x[j]), F.lit(0.0)) for i, j in upper]).first()
    covariance = np.zeros((d, d))
    for (i, j), value in zip(upper, row):
        covariance[i, j] = covariance[j, i] = value
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:2].clip(min=0), axes[:, ::-1][:, :2]
    axes = axes * [1.0 if abs(a.max()) >= abs(a.min()) else -1.0 for a in axes.T]
    whole = covariance.trace()
    variance = [float(v / whole) if whole else 0.0 for v in values]
    points = scaled.withColumns({
        f"pc{i + 1}": _total(F.zip_with(x, _vector(axis), lambda a, b: a * b)) for i, axis in enumerate(axes.T)
    }).drop("scaled")
    table = features.sparkSession.createDataFrame(
        [(c, *map(float, axes[j]), *variance) for j, c in enumerate(columns)],
        "feature string, pc1 double, pc2 double, variance1 double, variance2 double")
    return points, table
