"""Clusters and axes against plain NumPy and pairwise distances, and on awkward frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.operators import clusters as C


def frame(spark, rows, width=3):
    columns = [f"f{i}" for i in range(width)]
    schema = "seller_id long, " + ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], schema), columns


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ((0, 0, 0), (4, 0, 2), (0, 5, 1), (6, 6, 6))])


def plain_silhouette(x, labels):
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i, mine].sum() / (mine.sum() - 1)
        b = min(gaps[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def standard(x):
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def test_clusters_are_a_fixed_point(spark, blobs):
    df, columns = frame(spark, blobs)
    labelled, centres, score = C.cluster_sellers(df, columns, 4)
    labels = np.array([r["cluster"] for r in labelled.orderBy("seller_id").collect()])
    z = standard(blobs)
    found = np.array([r[1:] for r in centres.orderBy("cluster").collect()])
    middle = (found - blobs.mean(axis=0)) / blobs.std(axis=0, ddof=1)
    assert (np.argmin(((z[:, None] - middle) ** 2).sum(axis=2), axis=1) == labels).all()
    for c in range(4):
        assert np.allclose(found[c], blobs[labels == c].mean(axis=0))
    assert np.isclose(score, plain_silhouette(z, labels))
    # The four groups come apart.
    assert all(len(set(labels[a : a + 40])) == 1 for a in range(0, 160, 40)) and len(set(labels)) == 4


def test_every_k_like_a_fit_of_its_own(spark, blobs):
    df, columns = frame(spark, blobs)
    rows = {r["k"]: r for r in C.silhouette_by_k(df, columns, 6).collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6] and [k for k, r in rows.items() if r["best"]] == [4]
    for k in (2, 5):
        assert np.isclose(rows[k]["silhouette"], C.cluster_sellers(df, columns, k)[2])
    assert C.best_k(df, columns, 6) == 4


def test_one_scan_serves_every_k(spark, blobs):
    df, columns = frame(spark, blobs)
    vectors = C._vectors(C.standardized(df, columns)[0], "seller_id")
    starts = C.spread_starts(vectors, 4)
    together = C.cluster_sums(vectors, {k: starts[:k] for k in (2, 3, 4)})
    for k in (2, 3, 4):
        alone = C.cluster_sums(vectors, {k: starts[:k]})[k]
        assert all(np.allclose(a, b) for a, b in zip(alone, together[k])) and together[k][0].sum() == 160


def test_starts_are_the_farthest_rows(spark, blobs):
    df, columns = frame(spark, blobs)
    vectors = C._vectors(C.standardized(df, columns)[0], "seller_id")
    starts = C.spread_starts(vectors, 5)
    z = standard(blobs)
    for k in range(1, 5):
        gaps = ((z[:, None] - starts[:k]) ** 2).sum(axis=2).min(axis=1)
        assert np.allclose(starts[k], z[np.argmax(gaps)])


def test_equal_rows_single_row_and_none(spark):
    df, columns = frame(spark, [(1, 2, 3)] * 6)
    labelled, centres, score = C.cluster_sellers(df, columns, 3)
    assert {r["cluster"] for r in labelled.collect()} == {0} and centres.count() == 1 and score == 0.0
    assert C.silhouette_by_k(df, columns).count() == 0 and C.best_k(df, columns) == 3
    df, columns = frame(spark, [(1, 1, 1), (1, 1, 1), (9, 9, 9), (9, 9, 9)])
    labelled, centres, score = C.cluster_sellers(df, columns, 3)
    assert centres.count() == 2 and score == 1.0
    empty = df.limit(0)
    labelled, centres, score = C.cluster_sellers(empty, columns, 3)
    assert labelled.count() == 0 and centres.count() == 0 and score == 0.0
    assert C.silhouette_by_k(empty, columns).count() == 0
    points, axes = C.principal_axes(empty, columns)
    assert points.count() == 0 and axes.agg(F.max("variance1")).first()[0] == 0.0


def test_missing_values_count_as_the_mean(spark):
    df, columns = frame(spark, [(1, 5, None), (2, 5, 1), (3, 5, float("nan")), (None, 5, 3)])
    scaled = [r["scaled"] for r in C.standardized(df, columns)[0].orderBy("seller_id").collect()]
    assert np.allclose(scaled, [(-1, 0, 0), (0, 0, -(2**-0.5)), (1, 0, 0), (0, 0, 2**-0.5)])
    assert C.cluster_sellers(df, columns, 2)[0].where("cluster IS NULL").count() == 0


def test_axes_solve_the_eigenvalue_equation(spark, blobs):
    df, columns = frame(spark, blobs)
    points, table = C.principal_axes(df, columns)
    rows = table.collect()
    covariance = np.cov(standard(blobs).T)
    for name, share in (("pc1", "variance1"), ("pc2", "variance2")):
        v = np.array([r[name] for r in rows])
        assert np.allclose(covariance @ v, rows[0][share] * np.trace(covariance) * v) and np.isclose(v @ v, 1)
        assert v[np.argmax(abs(v))] > 0
        assert np.allclose([r[name] for r in points.orderBy("seller_id").collect()], standard(blobs) @ v)
    assert rows[0]["variance1"] >= rows[0]["variance2"]
