"""The queries of the corpus operators: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, quality, quality_model, secrets, toxicity
from .alignment import COUNTS, align, link_figures
from .decontamination import find_leaks
from .html_content import extract_text
from .lm_scoring import score_texts
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import clean_lines
from .scratch import stored
from .secrets import BASE_KINDS, findings, joined, scan_blobs
from .token_counts import count_tokens
from .whitening import whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(docs: DataFrame, by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance of each leak."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base figures, the lines' figures, base_failed, kept."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).drop("text", "clean_text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; documents with crc32(doc_id) mod 4 = 2 are held out of training."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder(labels, 4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(scored, 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_license, licenses, n_license_lines."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; crc32(doc_id) mod 5 = 1 is held out."""
    docs = _read(spark, sf_dir, "documents")
    scored = score_texts(docs, _remainder(docs, 5) == 1)
    return scored.select("doc_id", (_remainder(scored, 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract_text(_read(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    return mix(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; the documents come in two deliveries, of which the second meets the first one's ledger."""
    docs = _read(spark, sf_dir, "documents")
    ledger = stored(scan_blobs(docs.where("lang = 'en'")), "ledger")
    found = findings(docs, ledger=ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    return count_tokens(_read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align(_read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return link_figures(aligned.select("doc_id", *COUNTS, digest, "pairs", "pair_links")).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(_read(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; documents with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.where(_remainder(labels, 5) != 0))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", (_remainder(scored, 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= quality_model.THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_benchmark_decontamination, op3_quality_rules, op4_toxicity, op5_license_scan, op6_lm_scoring, op7_html_extraction, op8_source_mixing, op9_secret_scan, op10_token_counts, op11_token_alignment, op12_embedding_whitening, op13_quality_classifier)
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.oracle_sql(),
    "op5_license_scan": licenses.oracle_sql(),
    "op9_secret_scan": secrets.oracle_sql(),
}
