"""The corpus pipeline: quality, spread lines, near copies, benchmark leaks, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.  No stage can be
checked by one SQL statement (a trained model, sketches of fingerprints), so ``ORACLE_SQL`` is None; ``tests/llm`` compares
each stage's rows with a plain version of it.

Rows are taken one by one: a null ``doc_id`` is an id like any other, and rows that share one are told apart, so no stage
drops a row but for its own text.  Null texts are empty ones and stay null; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenline.llm import bpe, decontamination, line_dedup, quality, simhash
from lumenline.llm.common import DOCUMENT_COLUMNS, forget, scratch, table, written

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = quality.classify(docs.withColumn("_row", F.col("text")), table(spark, sf_dir, "labels"))
    return judged.where("accepted").select(*(F.col("_row").alias(c) if c == "text" else F.col(c) for c in DOCUMENT_COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other sites share; n_chars is that of the new text."""
    cleaned = line_dedup.remove_spread_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id (null ids last); all rows without words are one group."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = simhash.similar_documents(rows, "_row", "text", SHINGLE).select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))["_row"]
    kept = written(named.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("_row")), "kept")
    return rows.join(kept, "_row", "left_semi").select(*DOCUMENT_COLUMNS)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item of a shingle's words or more; shorter items stand in texts by chance."""
    return decontamination.without_leaks(docs.select(*DOCUMENT_COLUMNS), "text", table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to the tokens they came from."""
    made = bpe.encode(docs.select("doc_id", "text", "lang", "source"), "text", public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("copies", copies_stage),
    ("leaks", leaks_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and what it wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as made:
            after = written(stage(spark, docs, sf_dir), name)
            made.pop()  # the stage's own rows, written last
        if i:
            forget(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
