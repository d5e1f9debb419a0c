"""The corpus pipeline: each stage's decisions take effect, and the whole run agrees with its parts."""

import corpus_pipeline
from harborline.llm import packing, simhash


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_neardup":
            found = simhash.near_duplicates(before).toPandas()
            assert sorted(kept[name].doc_id) == sorted(found.component_id.unique())
    toxic = set(spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").toPandas().doc_id)
    assert len(toxic & set(kept["toxicity"].doc_id)) <= 0.05 * len(toxic)
    assert set(kept["pseudonyms"].doc_id) == set(kept["mixing"].doc_id) == set(kept["packing"].doc_id)
    assert kept["packing"].groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept["packing"])


def test_repeated_ids_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "quite another text here", "en", "s", 1), (None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "2", "None"]


def test_rows_decide_not_ids(spark):
    one, two = "a b c d e f g h i j", "completely other words stand in this second text"
    rows = [(1, one), (1, two), (2, two), (3, one), (None, one), (None, "alone and without any id"), (4, None), (5, ""), (2, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept_id", "1 AS fp")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(1, one), (1, two), (None, "alone and without any id"), (4, None)], key=str)


def test_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
