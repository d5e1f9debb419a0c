"""The distributed building blocks against brute force, on skewed data, with the distributed path forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.functions.neighbours import nearest_rows
from harborline.functions.quantiles import counted_median, exact_medians, exact_quantiles
from harborline.functions.ranking import average_ranks, with_row_number, with_sort_bucket
from harborline.operators import anomalies
from harborline.operators.anomalies import repair_anomalies, rolling_statistics


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and one value each hold a third of the rows."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({
        "id": np.arange(n), "name": [f"seller-{i % 13:03d}-{i:06d}" for i in range(n)],
        "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
        "v": np.where(rng.random(n) < 0.34, 5.0, rng.normal(size=n).round(2)),
    })
    return spark.createDataFrame(pdf).repartition(7), pdf


@pytest.mark.parametrize("buckets", [None, 16, 200])
@pytest.mark.parametrize("order", [[("v", True), ("id", True)], [("v", False), ("name", True)], [("name", False)]])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_row_number(skewed, buckets, order, keys):
    df, pdf = skewed
    out = with_row_number(df, order, "rn", keys, total="n", buckets=buckets).toPandas().set_index("id")
    ordered = pdf.sort_values([c for c, _ in order], ascending=[up for _, up in order])
    want = (ordered.groupby("k").cumcount() if keys else pd.Series(range(len(pdf)), index=ordered.index)) + 1
    assert (out["rn"].sort_index() == want.sort_index()).all()
    totals = pdf.groupby("k")["id"].transform("count") if keys else len(pdf)
    assert (out["n"].sort_index() == totals).all()


def test_row_number_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, None), (4, -1.0)], "id int, v double")
    rows = with_row_number(df, [("v", True), ("id", True)], "rn", buckets=8).orderBy("rn").collect()
    assert [r["id"] for r in rows] == [1, 3, 4, 2]


@pytest.mark.parametrize("buckets", [None, 16])
def test_average_ranks(skewed, buckets):
    df, pdf = skewed
    out = average_ranks(df, ["v", "k"], buckets).toPandas()
    for column in ("v", "k"):
        want = pdf.assign(r=pdf[column].rank()).groupby(column)["r"].first()
        got = out[out.metric == column].set_index("value")["mean_rank"]
        assert np.allclose(got.sort_index(), want.sort_index())


@pytest.mark.parametrize("buckets", [None, 16, 300])
def test_quantiles(skewed, buckets):
    df, pdf = skewed
    asked = {"v": {"m": 0.5, "top": 0.995}, "id": {"third": 1 / 3}}
    out = exact_quantiles(df, asked, ["k"], buckets).toPandas().set_index("k").sort_index()
    groups = pdf.groupby("k")
    assert np.allclose(out["m"], groups["v"].median())
    assert np.allclose(out["top"], groups["v"].quantile(0.995))
    assert np.allclose(out["third"], groups["id"].quantile(1 / 3))
    row = exact_quantiles(df, asked, (), buckets).first()
    assert np.allclose([row["m"], row["top"]], [pdf["v"].median(), pdf["v"].quantile(0.995)])


@pytest.mark.parametrize("buckets", [None, 16])
def test_quantiles_skip_missing_and_empty(spark, buckets):
    df = spark.createDataFrame([(1, None), (1, float("nan")), (2, 4.0), (None, 7.0)], "k int, v double")
    out = {r["k"]: r["m"] for r in exact_medians(df, {"v": "m"}, ["k"], buckets).collect()}
    assert out.get(1) is None and out[2] == 4.0 and out[None] == 7.0
    assert exact_medians(df.where("false"), {"v": "m"}, (), buckets).first()["m"] is None
    assert counted_median(df.where("v > 0 AND NOT isnan(v)"), "v", "m").first()["m"] == 5.5


def test_nearest_rows_match_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 1500
    points = np.where(rng.random((n, 3)) < 0.4, 2.0, rng.normal(size=(n, 3)).round(1))
    points[:500] = points[0]  # a third of the donors at one point
    group = np.where(rng.random(n) < 0.5, "a", rng.choice(["b", "c"], n))
    pdf = pd.DataFrame(points, columns=["x", "y", "z"]).assign(id=np.arange(n), g=group)
    asked, given = pdf[pdf.id % 15 == 0], pdf[pdf.id % 15 != 0]
    out = nearest_rows(spark.createDataFrame(asked), spark.createDataFrame(given), "id", "id", ["x", "y", "z"], 4,
                       group=["g"], cut_bits=4).toPandas()
    assert len(out) == 4 * len(asked)
    for q in asked.itertuples():
        own = given[given.g == q.g]
        d = ((own[["x", "y", "z"]].to_numpy() - [q.x, q.y, q.z]) ** 2).sum(axis=1).round(9)
        want = own.assign(d=d).sort_values(["d", "id"]).head(4)["id"].tolist()
        assert out[out.query_id == q.id].sort_values("rank")["donor_id"].tolist() == want


def test_a_query_begins_with_few_cells_in_four_dimensions(spark, monkeypatch):
    from harborline.functions import neighbours

    sizes = []
    kept = neighbours._starts

    def counted(*parts):
        starts = neighbours.pinned(kept(*parts))
        sizes.append(starts.groupBy("query_id").count().agg({"count": "max"}).first()[0])
        return starts

    monkeypatch.setattr(neighbours, "_starts", counted)
    rng = np.random.default_rng(8)
    axes = ["a", "b", "c", "d"]
    pdf = pd.DataFrame(rng.normal(size=(3000, 4)).round(2), columns=axes).assign(id=np.arange(3000))
    pdf.loc[:20, axes] += 50
    asked, given = pdf[pdf.id % 50 == 0], pdf[pdf.id % 50 != 0]
    out = nearest_rows(spark.createDataFrame(asked), spark.createDataFrame(given), "id", "id", axes, 6, cut_bits=6)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    got = out.toPandas()
    for q in asked.itertuples():
        d = ((given[axes].to_numpy() - [q.a, q.b, q.c, q.d]) ** 2).sum(axis=1).round(9)
        want = given.assign(d=d).sort_values(["d", "id"]).head(6)["id"].tolist()
        assert got[got.query_id == q.id].sort_values("rank")["donor_id"].tolist() == want
    assert max(sizes) <= neighbours.FRONTIER


def test_nearest_rows_with_few_donors(spark):
    donors = spark.createDataFrame([(1, 0.0), (2, 5.0)], "id int, x double")
    asked = spark.createDataFrame([(9, 4.0)], "id int, x double")
    out = nearest_rows(asked, donors, "id", "id", ["x"], 5).orderBy("rank").collect()
    assert [(r["donor_id"], r["distance2"]) for r in out] == [(2, 1.0), (1, 16.0)]


def _repair_reference(values, window, limit, exclude):
    s = pd.Series(values)
    half = window // 2
    mean, std = s.rolling(window, center=True).mean(), s.rolling(window, center=True).std()
    if exclude:
        for i in range(half, len(s) - half):
            near = s.iloc[[j for j in range(i - half, i + half + 1) if j != i]]
            mean[i], std[i] = near.mean(), near.std()
    mean, std = mean.fillna(s.mean()), std.fillna(s.std()).replace(0, s.std())
    odd = ((s - mean) / std).abs() > limit
    out = s.copy()
    for i in np.flatnonzero(odd):
        around = s.iloc[max(0, i - window):i + window + 1][~odd.iloc[max(0, i - window):i + window + 1]]
        out[i] = around.median() if len(around) else s.median()
    return out.tolist()


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("chunk_rows", [16, 10_000])
def test_anomaly_repair_across_chunks(spark, exclude, chunk_rows):
    rng = np.random.default_rng(11)
    rows = []
    for key, size in (("hot", 300), ("b", 40), ("c", 1), ("d", 3)):
        values = rng.normal(10, 1, size).round(2)
        values[rng.random(size) < 0.08] *= 20
        rows += [(key, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, i int, v double").repartition(5)
    out = repair_anomalies(df, "v", ["key"], ["i"], exclude_center=exclude, chunk_rows=chunk_rows, buckets=16).toPandas()
    assert len(out) == len(rows)
    for key, part in out.groupby("key"):
        want = _repair_reference([v for k, _, v in rows if k == key], 5, 3.0, exclude)
        assert np.allclose(part.sort_values("i")["v"], want), key


@pytest.mark.parametrize("exclude", [True, False])
def test_only_keys_longer_than_a_chunk_are_numbered(spark, monkeypatch, exclude):
    """Numbering writes and deals out all rows it gets once more; short keys are whole in one task anyway."""
    seen, numbered = [], anomalies.with_row_number

    def spy(df, *rest):
        seen.append({r["key"] for r in df.select("key").distinct().collect()})
        return numbered(df, *rest)

    monkeypatch.setattr(anomalies, "with_row_number", spy)
    rng = np.random.default_rng(5)
    rows = [(key, i, float(v)) for key, size in (("hot", 200), (None, 90), ("b", 40), ("c", 1))
            for i, v in enumerate(np.where(rng.random(size) < 0.1, 500.0, rng.normal(10, 1, size).round(2)))]
    df = spark.createDataFrame(rows, "key string, i int, v double")

    def result(chunk_rows):
        out = repair_anomalies(df, "v", ["key"], ["i"], exclude_center=exclude, chunk_rows=chunk_rows, buckets=4)
        return sorted(map(str, out.collect()))

    whole = result(10_000)
    assert seen == [] and result(50) == whole and seen == [{"hot", None}]
    rolling_statistics(df, "v", ["key"], ["i"], chunk_rows=100, buckets=4).collect()
    assert seen[1:] == [{"hot"}]


def test_rolling_statistics_across_chunks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": "k", "i": np.arange(200), "v": rng.normal(size=200)})
    out = rolling_statistics(spark.createDataFrame(pdf), "v", ["key"], ["i"], chunk_rows=20, buckets=16)
    got = out.orderBy("i").toPandas()
    want = pdf.v.rolling(5, center=True).mean().fillna(pdf.v.mean())
    assert np.allclose(got["rolling_mean"], want)


def test_results_do_not_depend_on_shuffle_partitions(spark, sf_dir):
    import catalog

    seen = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        frame = catalog.QUERIES["g10_performance_report"](spark, sf_dir)
        seen.append(sorted(map(tuple, frame.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


@pytest.mark.parametrize("case", ["padded text", "hot text prefix", "large numbers", "hot large number"])
def test_row_number_on_awkward_keys(spark, case):
    """Long padded ids, one hot 30-character prefix, and whole numbers beyond a double: right ranks, no overfull bucket."""
    n, buckets = 4000, 32
    big = 2**60
    ids = {
        "padded text": [f"{i:028d}" for i in range(n)],
        "hot text prefix": [("x" * 30 if i % 3 else "y") + f"{i:06d}" for i in range(n)],
        "large numbers": [big + i for i in range(n)],
        "hot large number": [big if i % 3 == 0 else big + i for i in range(n)],
    }[case]
    pdf = pd.DataFrame({"key": ids, "line": np.arange(n)[::-1].copy()})
    df = spark.createDataFrame(pdf).repartition(5)
    order = [("key", True), ("line", True)]
    out = with_row_number(df, order, "rn", buckets=buckets).toPandas().sort_values(["key", "line"])
    assert out["rn"].tolist() == list(range(1, n + 1))
    sizes = with_sort_bucket(df, order, "b", buckets).groupBy("b").count().toPandas()["count"]
    assert sizes.max() <= 2.5 * n / buckets
    chunks = rolling_statistics(df.withColumn("v", F.col("line") * 1.0), "v", [], ["key", "line"], chunk_rows=300, buckets=buckets)
    got = chunks.toPandas().sort_values(["key", "line"])["rolling_mean"].to_numpy()
    want = pdf.sort_values(["key", "line"])["line"].rolling(5, center=True).mean().fillna(pdf["line"].mean()).to_numpy()
    assert np.allclose(got, want)


def test_run_ids_stay_what_they_are(spark, tmp_path):
    from harborline.sources.runstore import RunStore, partition_folder

    store = RunStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1.0)], "category string, value double")
    for run_id in ("007", "7", "2024-01-01 10:00", "50% {x}=1"):
        assert store.store("inventory", rows, run_id) == 1
    for run_id in ("007", "2024-01-01 10:00", "50% {x}=1"):
        removed = {r["collection"]: r["n"] for r in store.delete_run(run_id).collect()}
        assert removed["inventory"] == 1
        assert store.collection("inventory").where(F.col("run_id") == run_id).count() == 0
    assert store.collection("inventory").where("run_id = '7'").count() == 1
    for bad in ("", "a/../b", "..", "a\\b"):
        with pytest.raises(ValueError):
            partition_folder(bad)


def test_a_run_stored_twice_is_there_once(spark, tmp_path):
    from harborline.sources.runstore import RunStore

    store = RunStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "category string, value double")
    for _ in range(2):
        assert store.store_run("r1", {"inventory": rows, "forecasts": rows}) == {"inventory": 2, "forecasts": 2}
    assert store.store("inventory", rows.limit(1), "r1") == 1
    assert store.store("inventory", rows.limit(0), "r1") == 0
    assert store.store_run("r1", {"inventory": rows})["inventory"] == 2
    # Broken off between two collections: no mark.
    store.store("inventory", rows, "r2")
    assert store.collection("inventory").count() == 4 and store.finished("inventory").count() == 2
    store.store_run("r2", {"inventory": rows, "forecasts": rows})
    assert sorted(r["run_id"] for r in store.finished_runs().collect()) == ["r1", "r2"]
    removed = {r["collection"]: r["n"] for r in store.delete_run("r1").collect()}
    assert (removed["inventory"], removed["forecasts"], removed["suppliers"]) == (2, 2, 0)
    assert {r["run_id"] for r in store.finished("inventory").collect()} == {"r2"}
    assert [r["run_id"] for r in store.finished_runs().collect()] == ["r2"]
    assert not any("part-" in p.name and p.stat().st_size == 0 for p in tmp_path.rglob("*"))
