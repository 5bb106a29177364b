"""The registered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, decontaminate, langid, licenses, lines, minhash, quality, secrets, simhash, substrings, toxicity, whiten
from .common import table


def vocabulary() -> str:
    """Path of the public word-level BPE file; ``ETHERLOOM_BPE`` names another."""
    if found := os.environ.get("ETHERLOOM_BPE"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_rules(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_documents(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op9_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity_chain, op2_spaced_seed_decontamination, op3_line_frequency_rules, op4_bpe_round_trip,
        op5_secret_ownership, op6_count_min_substrings, op7_simhash_bk_trees, op8_viterbi_language,
        op9_diagonal_licenses, op10_site_line_dedup, op11_embedding_whitening,
        op12_minhash_stars, op13_source_divergence,
    )
}

ORACLE: dict[str, str] = {"op10_site_line_dedup": lines.ORACLE, "op13_source_divergence": audit.ORACLE}
