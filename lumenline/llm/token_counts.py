"""Token counts with a digest cache.

The cache is a Parquet table (version, digest, n_tokens), a folder a version, so that others are never read: the digest of a text and that of the tokenizer file name a
count for good.  Texts are joined with it by both digests; of those without a count, one of each digest is encoded and
appended to the cache; then every text gets its count by its digest.  A text is normalised only as the count allows: null
becomes the empty text.  (Any other change, such as of white space, could change a byte-level count.)

Digests that have at least one in ``HOT`` of all rows, so at most ``HOT`` of them, get their counts from a broadcast of that
bound; all other rows meet the counts by digest.  No task gets all rows of a text that very many documents share.

The cache only ever gains rows, and a row written twice says the same, so a run that dies half-way leaves it valid: the
next run reads what was committed and encodes the rest.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted once and each gets the count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenline.llm.bpe import version_digest
from lumenline.llm.common import written

CACHE_SCHEMA = "version string, digest string, n_tokens long"
#: A digest is hot if it has at least one in so many rows; there are at most as many hot digests.
HOT = 10_000
#: Texts given to the library at a time: at most so many, and about so many characters.
BATCH_ROWS, BATCH_CHARS = 256, 4_000_000
_LOADED: dict[str, object] = {}


def counter(path: str):
    """A function from texts to token counts, by the library that reads ``path``."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(version, digest, n_tokens) of ``misses`` (digest, text), each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            made = [n for texts in _batches(b.column(1).to_pylist()) for n in count(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * b.num_rows, pa.string()), b.column(0), pa.array(made, pa.int64())], names=["version", "digest", "n_tokens"]
            )

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def read_cache(df: DataFrame, cache: str, version: str) -> DataFrame:
    """The cached counts of one tokenizer version, one row a digest; none where there is no cache yet."""
    spark = df.sparkSession
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, text: str, path: str, cache: str, limit: int = 512) -> DataFrame:
    """``df`` without ``text``, with n_bytes, n_tokens and over_limit; ``cache`` is the table that is read and grows.

    Columns of ``df`` with these names give way to the new ones.
    """
    version = version_digest(path)
    kept = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit", "_digest")]
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.sha2(body, 256).alias("digest"), body.alias("text"))
    # one row a digest and task before rows of a digest meet, so that no task gets all copies of a text
    misses = texts.dropDuplicates(["digest"]).join(read_cache(df, cache, version).select("digest"), "digest", "left_anti")
    encode_misses(misses, path, version).write.mode("append").partitionBy("version").parquet(cache)
    counts = read_cache(df, cache, version).withColumnRenamed("digest", "_digest")
    keyed = written(df.select(*kept, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_digest")), "digests")
    often = keyed.groupBy("_digest").agg(F.count("*").alias("n")).where(F.col("n") > max(1, keyed.count() // HOT))
    hot = written(often.select("_digest").join(counts, "_digest"), "hot")
    light = keyed.join(F.broadcast(hot.select("_digest")), "_digest", "left_anti").join(counts, "_digest")
    heavy = keyed.join(F.broadcast(hot), "_digest")
    return light.unionByName(heavy).drop("_digest").withColumn("over_limit", F.col("n_tokens") > limit)
