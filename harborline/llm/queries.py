"""Registered queries of the corpus operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (bpe, embeddings, fingerprints, html, langid, mixing, oracles, packing, pii, resampling, sharding, simhash,
               toxicity, trie)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op11_importance_resampling": oracles.IMPORTANCE_RESAMPLING,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
}


def _register(build: Callable[..., DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark = configure(spark)
        return build(lambda name: table(spark, sf_dir, name))

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return build


@_register
def op1_temperature_mixing(t) -> DataFrame:
    return mixing.mixture(t("documents"))


@_register
def op2_html_text(t) -> DataFrame:
    return html.extract_pages(t("pages"))


@_register
def op3_chunk_fingerprints(t) -> DataFrame:
    return fingerprints.fingerprint_documents(t("documents"))


@_register
def op4_vector_sharding(t) -> DataFrame:
    return sharding.shard_documents(t("documents"))


@_register
def op5_language_id(t) -> DataFrame:
    return langid.identify(t("documents"))


@_register
def op6_embedding_neardup(t) -> DataFrame:
    return embeddings.near_duplicates(t("embeddings"))


@_register
def op7_toxicity(t) -> DataFrame:
    return toxicity.grade_documents(t("documents"), t("labels"))


@_register
def op8_best_fit_packing(t) -> DataFrame:
    return packing.pack_documents(t("documents"))


@_register
def op9_pseudonyms(t) -> DataFrame:
    return pii.pseudonymise_documents(t("documents"))


@_register
def op10_simhash_neardup(t) -> DataFrame:
    found = simhash.near_duplicates(t("documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@_register
def op11_importance_resampling(t) -> DataFrame:
    return resampling.resample(t("documents"), t("benchmark"))


@_register
def op12_prefix_trie(t) -> DataFrame:
    return trie.conversation_trie(t("conversations"))


@_register
def op13_byte_bpe(t) -> DataFrame:
    return bpe.encode_documents(t("documents"))
