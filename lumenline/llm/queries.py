"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenline.llm import bpe, conversations, decontamination, fingerprints, html_extraction, language_model, license_scan, line_dedup, quality, resampling, simhash, token_counts, topk
from lumenline.llm.common import shared_folder, table, text_or_empty


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = fingerprints.with_next(
        docs, "doc_id", {"text": "next_text", "sigs": "next_sigs"}, lambda d: fingerprints.with_signatures(d, "text", "sigs")
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = fingerprints.with_signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("sigs")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        fingerprints.jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        fingerprints.jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
    )


def op2_bpe_encoding(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, "text", path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that other sites share, and how many lines it had and lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_spread_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent-network log probabilities of every document."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near copies of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which it holds a window."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"))


def op7_token_counts(
    spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json"), cache: str | None = None
) -> DataFrame:
    """Token counts of every document; without ``cache``, one of this run's own in the shared folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(docs, "text", path, cache)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's threshold, and whether it is accepted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each confirmed license notice of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and a digest of the repaired rows."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = conversations.repair(rows, "conv_id", "turn", "role", "text", ~F.col("dropped"))
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.search(vectors, "vec_id", "v", F.col("id") % 100 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's words, and the rank of those drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"), "doc_id", "text")


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_bpe_encoding": op2_bpe_encoding,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash_components": op5_simhash_components,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_topk": op12_exact_topk,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.oracle_sql(),
    "op11_conversation_repair": conversations.oracle_sql(),
    "op12_exact_topk": topk.oracle_sql(),
    "op13_importance_resampling": resampling.oracle_sql(),
}
