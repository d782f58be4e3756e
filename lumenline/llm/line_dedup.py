"""Removal of lines that are spread over many sites.

Per line hash a HyperLogLog sketch of its sites says on how many different sites the line stands.  Sketches are made where
the lines are read and merge by aggregation, so a line on a third of all pages sends one sketch a task and costs no more
than any other.  Only lines whose estimate is near the threshold get rows of (line, site) and an exact distinct count; the
others are clear of it by more than four standard errors.

A spread line is kept in the document with the smallest id that has it and removed from all others, so that a document
copied to many sites keeps one whole copy.  Lines are compared after white space is trimmed and reduced to single spaces;
empty lines stay, and ``min_words`` can be raised to leave lines under so many words alone.

The lines' keys are written once, and counted, checked and looked up from there; the texts are read twice.

Defined cases: a null text stays null and counts as no lines; an empty text stays empty; a null site is a site of its own;
rows with the same id are treated alike; a null id is the smallest.  Documents are never dropped: one whose lines all go
has the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenline.llm.common import forget, written

MIN_SITES, MIN_WORDS = 3, 1
#: log2 of the sketch's registers, and its relative standard error.
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def _key(line: Column) -> Column:
    """96 bits of the line, or null for a line under the least number of words."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _keys(text: Column, min_words: int) -> Column:
    """The key of each line in order, null for a line under ``min_words`` words."""
    normed = F.transform(F.split(text, "\n"), _norm)
    return F.transform(
        normed,
        lambda x: F.when((x != "") & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= min_words - 1), _key(x)),
    )


def line_keys(df: DataFrame, id_col: str, text: str, site: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, of, site, pos, h, g): the keys of each document's lines; ``of`` tells texts that share an id apart."""
    ident, place = F.coalesce(F.col(id_col), F.lit(-(2**63))), F.coalesce(F.col(site), F.lit("\0"))
    # made before the lines are dealt out, so that no line carries its text
    named = df.select(ident.alias("id"), F.xxhash64(text).alias("of"), place.alias("site"), F.col(text).alias("t"))
    keyed = named.select("id", "of", "site", F.posexplode(_keys(F.col("t"), min_words)).alias("pos", "k"))
    return keyed.where("k is not null").select("id", "of", "site", "pos", "k.h", "k.g")


def spread_lines(keys: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, g, keeper): keys of the lines on at least ``min_sites`` sites, and the smallest id that has each."""
    sketched = keys.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("keeper"), F.hll_sketch_agg("site", LG_K).alias("s"))
    band = 4 * ERROR * min_sites + 1
    # a line that stands fewer times can't be on more sites
    estimate = sketched.where(F.col("n") >= min_sites).select("h", "g", "keeper", F.hll_sketch_estimate("s").alias("est"))
    estimate = written(estimate.where(F.col("est") >= min_sites - band), "estimates")
    near = estimate.where(F.col("est") <= min_sites + band)
    exact = keys.select("h", "g", "site").join(near.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g")
    exact = exact.agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    spread = estimate.where(F.col("est") > min_sites + band).select("h", "g", "keeper")
    spread = written(spread.union(near.join(exact, ["h", "g"]).select("h", "g", "keeper")), "spread")
    forget(keys.sparkSession, estimate)
    return spread


def remove_spread_lines(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS
) -> DataFrame:
    """``df`` with ``text`` without its spread lines, and with n_lines and n_removed (both bigint)."""
    lines_of = written(line_keys(df, id_col, text, site, min_words), "lines")
    spread = spread_lines(lines_of, min_sites)
    ident = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    held = lines_of.select(F.col("id").alias("_id"), F.col("of").alias("_of"), "pos", "h", "g").join(spread, ["h", "g"]).where("_id <> keeper")
    # a line that stands twice in rows of one id and text has each place once
    gone = written(held.groupBy("_id", "_of").agg(F.collect_set("pos").alias("_gone")), "gone")
    forget(df.sparkSession, lines_of, spread)
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    out = df.select(*kept, ident.alias("_id"), F.xxhash64(text).alias("_of")).join(gone, ["_id", "_of"], "left")
    lines = F.split(F.col(text), "\n")
    # by place, through a hash set, so the work is in proportion to the lines; the array of one binds the split lines
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
    kept_lines = F.get(F.transform(F.array(lines), lambda x: F.transform(places(x), lambda p: F.get(x, p))), 0)
    out = out.withColumn("_stays", F.when(F.col("_gone").isNull(), lines).otherwise(kept_lines))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join("_stays", "\n"))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return out.select(
        *(new.alias(c) if c == text else F.col(c) for c in kept),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(n - F.size("_stays")).cast("long").alias("n_removed"),
    )


def oracle_sql(min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> str:
    """The same with exact distinct counts, in DuckDB."""
    return f"""
    WITH lines AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos
      FROM documents
    ), normed AS (
      SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM lines
    ), spread AS (
      SELECT norm, min(doc_id) AS keeper FROM normed
      WHERE norm <> '' AND length(norm) - length(replace(norm, ' ', '')) >= {min_words - 1}
      GROUP BY norm HAVING count(DISTINCT source) >= {min_sites}
    )
    SELECT n.doc_id AS doc_id,
           coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE s.norm IS NULL OR s.keeper = n.doc_id), '') AS text,
           count(*) AS n_lines,
           count(*) FILTER (WHERE s.norm IS NOT NULL AND s.keeper <> n.doc_id) AS n_removed
    FROM normed n LEFT JOIN spread s ON n.norm = s.norm
    GROUP BY n.doc_id
    """
