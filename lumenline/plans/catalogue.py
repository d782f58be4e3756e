"""Every query over the driver's tables, with its DuckDB equivalent where SQL can say it.

All queries read whole tables.  Computed doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenline.functions import text as T
from lumenline.functions import vectors as V
from lumenline.operators import gallery, integrity, retrieval, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- SQL building blocks -----------------------------------------------------------------------------------------


def _sql_lcs(q: str, text: str, kind: str = "BIGINT") -> str:
    full = (1 << len(q)) - 1
    case = " ".join(f"WHEN '{c}' THEN {sum(1 << i for i, x in enumerate(q) if x == c)}" for c in dict.fromkeys(q))
    masks = f"list_transform(string_split({text}, ''), lambda c: (CASE c {case} ELSE 0 END)::{kind})"
    return f"({len(q)} - bit_count(list_reduce(list_prepend({full}::{kind}, {masks}), lambda v, m: ((v + (v & m)) | (v & (~m))) & {full}::{kind})))"


def _sql_lcs_columns(a: str, b: str) -> str:
    """Share of the characters of ``a`` that are a subsequence of ``b``."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i::INT, 1) = c THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT"
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    left = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v & (~m))) & {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE (length({a}) - bit_count({left}))::DOUBLE / length({a}) END)"


def _sql_norm(x: str) -> str:
    return f"regexp_replace({x}, '[^一-鿿0-9A-Za-z]', '', 'g')"


def _sql_edit(a: str, b: str) -> str:
    x, y = _sql_norm(a), _sql_norm(b)
    return f"(CASE WHEN least(length({x}), length({y})) = 0 THEN 0.0 ELSE 1 - levenshtein({x}, {y})::DOUBLE / least(length({x}), length({y})) END)"


# --- retrieval ---------------------------------------------------------------------------------------------------

NEEDLE = "tion"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", "source", F.col("n_chars").alias("s"), "text")


def _hits(where: str, order: str, tail: str) -> str:
    low = "lower(text)"
    return f"""
    WITH scored AS (
      SELECT d.doc_id, d.source, coalesce(l.quality, 0) AS d,
             CASE WHEN length(text) = 0 THEN 0.0 ELSE {_sql_lcs(NEEDLE, low)} * 100.0 / {len(NEEDLE)} END AS ratio,
             contains({low}, '{NEEDLE}')::INT AS exact_match
      FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality = 1 GROUP BY doc_id) l ON d.doc_id = l.doc_id
      WHERE {where}
    )
    SELECT doc_id, source, round(ratio, 6) AS match_ratio, exact_match FROM scored WHERE ratio >= 50
    ORDER BY {order}ratio DESC, exact_match DESC, doc_id {tail}
    """


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", F.round("match_ratio", 6).alias("match_ratio"), "exact_match")


@query(_hits("n_chars >= 200", "", "LIMIT 20"))
def fuzzy_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.search(_lines(spark, d), NEEDLE, text="text", order=("doc_id",), min_similarity=200, page=0))


@query(_hits("n_chars >= 200", "", "LIMIT 20 OFFSET 20"))
def fuzzy_search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.search(_lines(spark, d), NEEDLE, text="text", order=("doc_id",), min_similarity=200, page=1))


@query(_hits("true", "d DESC, ", "LIMIT 20"))
def fuzzy_search_boosted(spark: SparkSession, d: str) -> DataFrame:
    lines = integrity.mark(_lines(spark, d), read(spark, d, "labels").where("quality = 1"), "doc_id")
    return _shown(retrieval.search(lines, NEEDLE, text="text", order=("doc_id",), flag="d", flag_first=True, page=0))


#: Over 62 characters, so its bits are in two numbers here and in one of 128 bits in SQL; without spaces it is one word.
LONG_NEEDLE = "thereforetheinternationaltransformationofinformationandcommunicationsystems"


@query(f"""
    WITH s AS (SELECT conv_id, turn, text, CASE WHEN text = '' THEN 0.0 ELSE {_sql_lcs(LONG_NEEDLE, "lower(text)", "HUGEINT")} * 100.0 / {len(LONG_NEEDLE)} END AS ratio FROM conversations)
    SELECT conv_id, turn, round(ratio, 6) AS match_ratio, contains(lower(text), '{LONG_NEEDLE}')::INT AS exact_match FROM s WHERE ratio >= 60
""")
def fuzzy_search_long(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("s", F.lit(1.0))
    found = retrieval.search(turns, LONG_NEEDLE, text="text", order=("conv_id", "turn"), min_ratio=60)
    return found.select("conv_id", "turn", F.round("match_ratio", 6).alias("match_ratio"), "exact_match")


@query("""
    WITH a AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
    b AS (SELECT *, instr(t, 'tion') AS p FROM a),
    c AS (SELECT *, CASE WHEN p > 0 THEN left(t, p - 1) || repeat(chr(1), 4) || substr(t, p + 4) ELSE t END AS u FROM b)
    SELECT conv_id, turn, round(((p > 0)::INT * 4 + (instr(u, 'on') > 0)::INT * 2) * 100.0 / 6, 6) AS match_ratio,
           (contains(t, 'tion') AND contains(t, 'on'))::INT AS exact_match
    FROM c WHERE ((p > 0)::INT * 4 + (instr(u, 'on') > 0)::INT * 2) * 100.0 / 6 >= 50
""")
def multiword_search(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("s", F.lit(1.0))
    found = retrieval.search(turns, "tion on", text="text", order=("conv_id", "turn"))
    return found.select("conv_id", "turn", F.round("match_ratio", 6).alias("match_ratio"), "exact_match")


@query("""
    SELECT b.item_id, count(d.doc_id) AS hits FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id
""")
def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.substring_hits(read(spark, d, "documents"), "text", read(spark, d, "benchmark"), "text", "item_id")


@query("""
    SELECT count(DISTINCT d.source) AS groups, count(*) AS rows, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS flagged
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
""")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.archive_stats(integrity.mark(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").where("quality = 1"), "doc_id"), "source", "d")


# --- keys --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS d FROM documents")
def flag_marking(spark: SparkSession, d: str) -> DataFrame:
    return integrity.mark(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").where("quality = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return integrity.missing_keys(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    return integrity.missing_keys(read(spark, d, "labels"), read(spark, d, "documents").where("lang = 'en'"), ["doc_id"])


@query("""
    SELECT o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def key_without_target(spark: SparkSession, d: str) -> DataFrame:
    lookup = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    targets = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return integrity.key_without_target(read(spark, d, "orders"), lookup, ["o_orderkey"], "l_suppkey", targets)


@query("""
    SELECT count(*) AS total, count(l.doc_id) AS hit, count(*) - count(l.doc_id) AS miss, round(count(l.doc_id) * 100.0 / count(*), 4) AS pct
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    return integrity.coverage(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"])


@query("""
    SELECT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids
    FROM events GROUP BY user_id, event_type, CAST(ts AS DATE) HAVING count(*) > 1
""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    found = integrity.duplicate_groups(ev, ["user_id", "event_type", "day"], "ts", "event_id")
    return found.select("user_id", "event_type", "day", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@query("""
    SELECT o_orderpriority, count(*) AS n, max(datediff('day', DATE '1990-01-01', l_shipdate::DATE)) AS largest,
           min(datediff('day', l_shipdate::DATE, o_orderdate::DATE)) AS margin, count(*) FILTER (WHERE l_shipdate::DATE > o_orderdate::DATE) AS n_over
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority
""")
def over_limit_per_group(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    return integrity.over_limit(j, "o_orderpriority", day("l_shipdate"), day("o_orderdate"))


@query("""
    SELECT d.doc_id, coalesce(l.quality, b.n) AS value,
           CASE WHEN l.quality IS NOT NULL THEN 'first' WHEN b.n IS NOT NULL THEN 'second' ELSE 'missing' END AS origin
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT item_id, length(text)::INT AS n FROM benchmark) b ON d.doc_id = b.item_id
""")
def coalesce_lookup(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "labels").select("doc_id", F.col("quality").alias("value"))
    second = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("value"))
    return integrity.coalesce_lookup(read(spark, d, "documents").select("doc_id"), first, second, "doc_id", "value")


@query("""
    WITH e AS (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
    offs AS (SELECT unnest([0, 1, -1, 2, -2, 3, -3]) AS off, unnest([0, 1, 2, 3, 4, 5, 6]) AS p),
    r AS (SELECT user_id, hour, max(event_id) AS found FROM e WHERE event_type = 'purchase' GROUP BY user_id, hour),
    m AS (SELECT l.event_id, o.off, o.p, r.found FROM e l, offs o, r WHERE l.event_type = 'view' AND r.user_id = l.user_id AND r.hour = l.hour + o.off)
    SELECT event_id, arg_min(off, p) AS off, arg_min(found, p) AS found FROM m GROUP BY event_id
""")
def nearest_offset_join(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600).cast("long"))
    right = ev.where("event_type = 'purchase'").select("user_id", "hour", F.col("event_id").alias("found"))
    return integrity.nearest_offset(ev.where("event_type = 'view'"), right, "user_id", "hour", "event_id", "found")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    return integrity.pending(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey").subtract(read(spark, d, "lineitem").select("l_orderkey"))


@query("""
    WITH m AS (SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey))::VARCHAR AS k FROM supplier WHERE s_acctbal > 2000 AND s_nationkey % 3 <> 0 GROUP BY s_nationkey),
    n AS (SELECT n_name, n_nationkey, coalesce(k, CASE WHEN n_nationkey BETWEEN 1 AND 20 THEN (396255 + n_nationkey)::VARCHAR END) AS key
          FROM nation LEFT JOIN m ON n_nationkey = s_nationkey)
    SELECT n_name, key, 'https://example.org/play/' || key || '?t=' || n_nationkey AS link FROM n
""")
def deep_link(spark: SparkSession, d: str) -> DataFrame:
    mapping = read(spark, d, "supplier").where("s_acctbal > 2000 AND s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("key"), "s_acctbal")
    out = integrity.reverse_lookup(read(spark, d, "nation"), mapping, "n_nationkey", "key", "s_acctbal", "n_nationkey", 396255, 20)
    return out.select("n_name", "key", F.concat(F.lit("https://example.org/play/"), "key", F.lit("?t="), F.col("n_nationkey").cast("string")).alias("link"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    key = [F.col("o_custkey").alias("ep"), F.col("o_orderkey").alias("ts")]
    fixes = o.select(*key, F.col("o_orderpriority").alias("old"), F.col("o_orderstatus").alias("new"), F.when(F.col("o_totalprice") > 200000, "manual").otherwise("auto").alias("src"))
    current = o.where("o_orderpriority <> '5-LOW'").select(*key, F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("text"))
    dropped = o.where("o_totalprice < 50000").select(*key)
    retimed = o.select(F.col("o_custkey").alias("ep"), F.col("o_orderkey").alias("old_ts"), (F.col("o_orderkey") + 1).alias("new_ts"), F.lit(1).alias("rank"))
    reverted = fixes.where("new = 'F'").select("ep", "ts", "old", "new")
    return integrity.reconcile(fixes, current, dropped, retimed, reverted)


@query("""
    WITH f AS (SELECT o_custkey AS ep, o_orderkey AS ts, o_orderpriority AS old, o_orderstatus AS new,
                      CASE WHEN o_totalprice > 200000 THEN 'manual' ELSE 'auto' END AS src, o_totalprice FROM orders),
    c AS (SELECT o_custkey AS ep, o_orderkey AS ts, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS text
          FROM orders WHERE o_orderpriority <> '5-LOW'),
    j AS (SELECT f.*, coalesce(a.text, b.text) AS now FROM f LEFT JOIN c a ON a.ep = f.ep AND a.ts = f.ts LEFT JOIN c b ON b.ep = f.ep AND b.ts = f.ts + 1),
    s AS (SELECT src, CASE WHEN o_totalprice < 50000 THEN 'removed' WHEN now = new THEN 'applied' WHEN new = 'F' AND now = old THEN 'reverted' ELSE 'problem' END AS status FROM j)
    SELECT src, status, count(*) AS n FROM s GROUP BY src, status
""")
def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).groupBy("src", "status").agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT o_custkey AS ep, o_orderpriority AS new, 'auto' AS src, 0 AS round, o_orderkey AS ts FROM orders WHERE o_totalprice <= 200000
               UNION ALL SELECT o_custkey, o_orderpriority, 'manual', 1, o_orderkey FROM orders WHERE o_totalprice > 200000
               UNION ALL SELECT o_custkey, o_orderstatus, 'audit', 2, o_orderkey FROM orders WHERE o_totalprice < 30000)
    SELECT ep, arg_max(ts, (round, ts)) AS ts, arg_max(new, (round, ts)) AS new, arg_max(src, (round, ts)) AS src, max(round) AS round, count(*) AS entries FROM r GROUP BY ep
""")
def ledger_rounds(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("ep"), F.col("o_orderkey").alias("ts"), F.col("o_orderpriority").alias("new"), "o_orderstatus", "o_totalprice")
    rounds = [("auto", o.where("o_totalprice <= 200000")), ("manual", o.where("o_totalprice > 200000")), ("audit", o.where("o_totalprice < 30000").withColumn("new", F.col("o_orderstatus")))]
    return integrity.last_round(integrity.ledger(rounds, ["ep", "ts", "new"]), ["ep"], ["ts", "new"])


@query("""
    SELECT 'o_orderpriority' AS dimension, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
""")
def counts_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.counts_by(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey % 50 AS ep FROM lineitem),
    x AS (SELECT ep, (l_orderkey * 10 + l_linenumber) AS row, greatest(0, least(2999, round_even((l_quantity * 20 + o) * 2.5, 0)::BIGINT)) AS fno
          FROM l, (SELECT unnest([-1.0, 0.0, 1.0]) AS o))
    SELECT ep, fno, count(*) AS n, min(row) AS first FROM x GROUP BY ep, fno
""")
def wanted_frames(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("ep"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), (F.col("l_quantity") * 20).alias("sec"))
    videos = li.select("ep").distinct().withColumns({"fps": F.lit(2.5), "frames": F.lit(3000)})
    found = integrity.wanted_frames(li, videos, "ep", "row", "sec", (-1, 0, 1))
    return found.select("ep", "fno", F.size("wanted").cast("long").alias("n"), F.array_min(F.transform("wanted", lambda w: w["row"])).alias("first"))


# --- alignment ---------------------------------------------------------------------------------------------------

_PAIRS = f"""
    SELECT u.conv_id, u.turn AS l_turn, a.turn AS r_turn, {_sql_edit('u.text', 'a.text')} AS similarity
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant' AND abs(u.turn - a.turn) <= 2
    WHERE {_sql_edit('u.text', 'a.text')} > 0
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    left = c.where("role = 'user'").select("conv_id", F.col("turn").alias("l_turn"), T.norm_text(F.col("text")).alias("l_text"))
    right = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("r_turn"), T.norm_text(F.col("text")).alias("r_text"))
    return sequences.windowed_pairs(left, right, "conv_id", "turn", 2, T.normed_similarity(F.col("l_text"), F.col("r_text"), 0.0))


@query(f"SELECT conv_id, l_turn, r_turn, round(similarity, 6) AS similarity FROM ({_PAIRS})")
def windowed_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "l_turn", "r_turn", F.round("similarity", 6).alias("similarity"))


@query(f"""
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY similarity DESC, l_turn, r_turn) AS k FROM ({_PAIRS})),
    g AS (
      SELECT conv_id, k, l_turn, r_turn, similarity, true AS free, [l_turn] AS ls, [r_turn] AS rs FROM p WHERE k = 1
      UNION ALL
      SELECT p.conv_id, p.k, p.l_turn, p.r_turn, p.similarity, NOT list_contains(ls, p.l_turn) AND NOT list_contains(rs, p.r_turn),
             CASE WHEN NOT list_contains(ls, p.l_turn) AND NOT list_contains(rs, p.r_turn) THEN list_append(ls, p.l_turn) ELSE ls END,
             CASE WHEN NOT list_contains(ls, p.l_turn) AND NOT list_contains(rs, p.r_turn) THEN list_append(rs, p.r_turn) ELSE rs END
      FROM g JOIN p ON p.conv_id = g.conv_id AND p.k = g.k + 1
    )
    SELECT conv_id, l_turn, r_turn, round(similarity, 6) AS similarity FROM g WHERE free
""")
def greedy_alignment(spark: SparkSession, d: str) -> DataFrame:
    return sequences.greedy_matching(_pairs(spark, d), "conv_id", "l_turn", "r_turn", "similarity").withColumn("similarity", F.round("similarity", 6))


@query(f"""
    SELECT count(*) FILTER (WHERE similarity >= 0.95) AS high, count(*) FILTER (WHERE similarity >= 0.6 AND similarity < 0.95) AS middle,
           count(*) FILTER (WHERE similarity < 0.6) AS low FROM ({_PAIRS})
""")
def similarity_buckets(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.buckets(_pairs(spark, d), "similarity")


@query(f"""
    SELECT CASE WHEN similarity < 0.55 THEN 'unmatched' WHEN similarity >= 0.95 THEN 'confirmed' ELSE 'review' END AS verdict, count(*) AS n
    FROM ({_PAIRS}) GROUP BY 1
""")
def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = sequences.verdict(F.col("similarity"), F.lit("diff"), F.lit(1), F.lit(0.0))
    return _pairs(spark, d).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""
    WITH v AS (SELECT conv_id, CASE WHEN similarity < 0.55 THEN 'unmatched' WHEN similarity >= 0.95 THEN 'confirmed' ELSE 'review' END AS verdict FROM ({_PAIRS}))
    SELECT conv_id, verdict, grouping(conv_id, verdict)::INT AS level, count(*) AS n FROM v GROUP BY GROUPING SETS ((conv_id, verdict), (verdict), ())
""")
def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = sequences.verdict(F.col("similarity"), F.lit("diff"), F.lit(1), F.lit(0.0))
    return retrieval.histograms(_pairs(spark, d), "conv_id", v, "verdict")


@query(f"""
    WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    s AS (SELECT conv_id, turn, text, CASE WHEN before IS NOT NULL AND before <> '' AND text <> '' AND {_sql_edit('before', 'text')} >= 0.1 THEN 0 ELSE 1 END AS start FROM l),
    i AS (SELECT *, sum(start) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
    SELECT conv_id, min(turn) AS t0, max(turn) AS t1, round_even((min(turn) + max(turn)) / 2.0, 2)::DOUBLE AS mid, count(*) AS n_points, count(*) FILTER (WHERE text <> '') AS n_read
    FROM i GROUP BY conv_id, island
""")
def similarity_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sessions(read(spark, d, "conversations"), "conv_id", "turn", "text", partial(T.edit_similarity, least=0.1), 0.1).drop("island")


@query(f"""
    WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ts FROM conversations),
    l AS (SELECT *, lag(ts) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM p),
    i AS (SELECT conv_id, turn, ts, sum(CASE WHEN len(ts) > 0 AND len(was) > 0
            AND list_max(flatten(list_transform(ts, lambda a: list_transform(was, lambda b: {_sql_edit("a", "b")})))) >= 0.4 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM l),
    s AS (SELECT conv_id, island, min(turn) AS t0, max(turn) AS t1, count(*) AS n_points, flatten(list(ts ORDER BY turn)) AS names FROM i GROUP BY conv_id, island),
    c AS (SELECT *, list_reduce(list_transform(names, lambda t: {{'reps': [t], 'ns': [1]}}), lambda s, x:
      CASE WHEN len(list_filter(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.4)) = 0
           THEN {{'reps': list_append(s.reps, x.reps[1]), 'ns': list_append(s.ns, 1)}}
           ELSE {{'reps': s.reps, 'ns': list_transform(s.ns, lambda n, i: n + (i = list_position(list_transform(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.4), true))::INT)}} END) AS s
      FROM s WHERE len(names) > 0)
    SELECT conv_id, t0, t1, round_even((t0 + t1) / 2.0, 2)::DOUBLE AS mid, n_points, len(names) AS n_read, s.reps[list_position(s.ns, list_max(s.ns))] AS text, list_max(s.ns) AS support FROM c
""")
def reading_sessions(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: x != "")
    points = read(spark, d, "conversations").select("conv_id", "turn", pieces.alias("ts"))
    return sequences.text_sessions(points, "conv_id", "turn", "ts", partial(T.normed_similarity, least=0.4), 0.4, prepare=T.norm_text).drop("island", "alts")


# --- sequences ---------------------------------------------------------------------------------------------------


@query("""
    SELECT event_id, user_id, event_type FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type
""")
def drop_consecutive_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sequences.drop_consecutive(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
    WITH e AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events),
    l AS (SELECT *, lag(event_type) OVER w AS pt, lag(day) OVER w AS pd FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id)),
    i AS (SELECT *, sum(CASE WHEN pt = event_type AND day - pd <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day, event_id) AS island FROM l)
    SELECT user_id, any_value(event_type) AS event_type, min(day) AS first, max(day) AS last, count(*) AS n,
           first(day ORDER BY value DESC, day, event_id) AS best_at, max(value) AS best_score FROM i GROUP BY user_id, island
""")
def run_merge_argmax(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("day", F.floor(F.unix_timestamp("ts") / 86400).cast("long"))
    return sequences.merge_runs(ev, "user_id", "day", "event_type", "value", "event_id").drop("island")


@query("""
    WITH RECURSIVE e AS (
      SELECT user_id, event_id, event_type, value, row_number() OVER w AS n, lag(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    ), c AS (SELECT user_id, event_id, n FROM e WHERE (b IS NULL OR abs(value - b) > 20) AND event_type <> 'error'),
    f AS (
      SELECT user_id, min(n) AS n FROM c GROUP BY user_id
      UNION ALL
      SELECT user_id, n FROM (SELECT f.user_id AS user_id, min(c.n) AS n FROM f JOIN c ON c.user_id = f.user_id AND c.n >= f.n + 3 GROUP BY f.user_id, f.n)
    )
    SELECT c.user_id, c.event_id FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n
""")
def debounced_trigger(spark: SparkSession, d: str) -> DataFrame:
    return sequences.debounced(read(spark, d, "events"), "user_id", "event_id", "value", F.col("event_type") != "error", 20.0, 3)


@query("""
    WITH l AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
    SELECT vec_id, round(CASE WHEN b IS NULL THEN 1.0 ELSE list_sum(list_transform(list_zip(e, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(e) END, 5) AS diff FROM l
""")
def signature_diff(spark: SparkSession, d: str) -> DataFrame:
    df = sequences.before(read(spark, d, "embeddings"), "label", ["vec_id"], "embedding", "b")
    return df.select("vec_id", F.round(F.when(F.col("b").isNull(), 1.0).otherwise(V.mean_difference(F.col("embedding"), F.col("b"))), 5).alias("diff"))


@query("""
    WITH s AS (SELECT vec_id, label, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
    l AS (SELECT *, lag(bits) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM s)
    SELECT vec_id, CASE WHEN b IS NOT NULL THEN round(len(list_intersect(bits, b))::DOUBLE / len(list_distinct(list_concat(bits, b))), 6) END AS iou FROM l
    WHERE b IS NULL OR len(list_intersect(bits, b))::DOUBLE / len(list_distinct(list_concat(bits, b))) < 0.4
""")
def iou_dedup(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "embeddings").select("vec_id", "label", V.sign_bits(F.col("embedding")).alias("bits"))
    df = sequences.before(df, "label", ["vec_id"], "bits", "b")
    df = df.withColumn("v", F.when(F.col("b").isNotNull(), V.iou(F.col("bits"), F.col("b"))))
    return df.where("v is null or v < 0.4").select("vec_id", F.round("v", 6).alias("iou"))


@query("""
    SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (WHERE l_quantity > 25) AS l_partkey,
           CASE WHEN count(*) FILTER (WHERE l_quantity > 25) = 0 THEN 'none' ELSE 'ok' END AS reason
    FROM lineitem GROUP BY l_orderkey
""")
def first_offset_pass(spark: SparkSession, d: str) -> DataFrame:
    return sequences.first_passing(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") > 25, "l_partkey")


@query("""
    SELECT s.event_id, max(h.event_id) AS last_hit FROM events s JOIN events h ON s.user_id = h.user_id AND s.event_type = 'signup' AND h.event_type = 'click'
      AND abs(CAST(floor(epoch(s.ts) / 3600) AS BIGINT) - CAST(floor(epoch(h.ts) / 3600) AS BIGINT)) <= 12 GROUP BY s.event_id
""")
def last_hit_in_window(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600).cast("long"))
    left = ev.where("event_type = 'signup'").select("user_id", "event_id", F.col("hour").alias("l_hour"))
    right = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("hit"), F.col("hour").alias("r_hour"))
    return sequences.windowed_pairs(left, right, "user_id", "hour", 12, F.lit(1.0)).groupBy("event_id").agg(F.max("hit").alias("last_hit"))


@query("""
    SELECT event_id, user_id FROM (SELECT *, coalesce(max((value > 90)::INT) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM events) WHERE h = 0
""")
def early_exit_window(spark: SparkSession, d: str) -> DataFrame:
    return sequences.until_first(read(spark, d, "events"), "user_id", "event_id", F.col("value") > 90).select("event_id", "user_id")


@query("""
    WITH h AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
    l AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) <= 8 THEN 0 ELSE 1 END AS s FROM h),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY hour) AS island FROM l)
    SELECT user_id, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i GROUP BY user_id, island
""")
def hour_runs(spark: SparkSession, d: str) -> DataFrame:
    hours = read(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour")).distinct()
    runs = sequences.islands(hours, "user_id", ["hour"], lambda last: F.col("hour") - last > 8, {"hour": F.col("hour")})
    return runs.groupBy("user_id", "island").agg(F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n")).drop("island")


@query("SELECT user_id, max(event_id) AS latest, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def latest_progress(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("latest"), F.count_distinct("event_type").alias("n_types"))


@query("""
    SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY event_type
""")
def reason_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").select("event_type")
    counts = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    total = ev.agg(F.count("*").alias("t"))
    return counts.join(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("pct"))


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 100")
def corpus_order_slice(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(100).limit(50)


@query("""
    WITH r AS (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS k
               FROM lineitem WHERE l_quantity >= 18 AND l_discount >= 0.02)
    SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) AS parts FROM r WHERE k <= 3 GROUP BY l_orderkey
""")
def top_segments(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("k", -F.col("l_extendedprice"))
    keep = (F.col("l_quantity") >= 18) & (F.col("l_discount") >= 0.02)
    found = retrieval.top_segments(li, "l_orderkey", keep, ["k", "l_partkey", "l_suppkey", "l_linenumber"], ["l_partkey"])
    return found.select("l_orderkey", F.array_join(F.transform("top", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


# --- scalars -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_sql_norm('text')}) AS normed FROM documents")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("normed"))


@query(r"SELECT conv_id, turn, regexp_replace(trim(text, ' '), '[\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2000}-\x{206F}.,!?;:\s]+$', '') AS cleaned FROM conversations")
def clean_trailing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.clean_trailing(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, round((length(text) - length(regexp_replace(text, '[ぁ-ヿ]', '', 'g')))::DOUBLE / length(text), 6) AS kana FROM documents")
def kana_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(T.kana_ratio(F.col("text")), 6).alias("kana"))


#: A table of phrases that overlap: the longest that begins at a place is replaced.
PHRASES = {"t": "T", "ti": "1", "tion": "2", "tions": "3", "on": "4", "ns": "5", "e": "E", "en": "6", "ent": ""}


@query(f"""
    WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s){"|".join(sorted(PHRASES, key=len, reverse=True))}|.') AS parts FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_transform(parts, lambda p: CASE p {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHRASES.items())} ELSE p END), '')) AS text_md5 FROM c
""")
def phrase_replacement(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.to_simplified(F.col("text"), PHRASES)).alias("text_md5"))


#: Letters of the tables as characters at the ends of the ranges of kana and of Chinese characters, and beside them.
KANA, CHINESE = ("aeiot", "ぁヿアーぷ"), ("aeiot ", "一鿿龥ぁㄅ　")


@query(f"""
    SELECT doc_id, round((length(t) - length(regexp_replace(t, '[ぁ-ヿ]', '', 'g')))::DOUBLE / length(t), 6) AS kana FROM (SELECT doc_id, translate(text, '{KANA[0]}', '{KANA[1]}') AS t FROM documents)
""")
def kana_share(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.round(T.kana_ratio(F.translate("text", *KANA)), 6).alias("kana"))


@query(f"SELECT doc_id, md5({_sql_norm('t')}) AS normed, length({_sql_norm('t')})::INT AS n FROM (SELECT doc_id, translate(text, '{CHINESE[0]}', '{CHINESE[1]}') AS t FROM documents)")
def norm_chinese_text(spark: SparkSession, d: str) -> DataFrame:
    normed = T.norm_text(F.translate("text", *CHINESE))
    return read(spark, d, "documents").select("doc_id", F.md5(normed).alias("normed"), F.length(normed).alias("n"))


@query("""
    SELECT event_id, printf('%dm%02ds', event_id // 60, event_id % 60) AS ts, event_id::INT AS seconds FROM events
""")
def parse_and_format_ts(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").select("event_id", T.format_ts(F.col("event_id")).alias("ts"))
    return ev.select("event_id", "ts", T.parse_ts(F.col("ts"), whole=True).alias("seconds"))


@query(f"SELECT p_partkey, round({_sql_edit('p_name', 'p_type')}, 6) AS similarity FROM part")
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(T.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("""
    WITH s AS (SELECT p_partkey, p_name, list_reduce(list_prepend('', string_split(p_name, '')), lambda a, c: CASE WHEN contains('eioualr', c) THEN a || c ELSE a END) AS q FROM part)
    SELECT p_partkey, true AS inside, (q = p_name) AS outside FROM s
""")
def subsequence_test(spark: SparkSession, d: str) -> DataFrame:
    q = F.regexp_replace("p_name", "[^eioualr]", "")
    return read(spark, d, "part").select("p_partkey", T.is_subsequence(q, F.col("p_name")).alias("inside"), T.is_subsequence(F.col("p_name"), q).alias("outside"))


@query(f"""
    WITH s AS (SELECT p_partkey, {_sql_norm('p_name')} AS x, {_sql_norm("regexp_replace(p_name, '[aeiou]', '', 'g')")} AS y FROM part)
    SELECT p_partkey, CASE WHEN x = '' OR y = '' THEN '' WHEN 1 - levenshtein(x, y)::DOUBLE / least(length(x), length(y)) >= 0.95 THEN 'same'
           ELSE 'del' END AS relation FROM s
""")
def diff_relation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.diff_relation(F.col("p_name"), F.regexp_replace("p_name", "[aeiou]", "")).alias("relation"))


@query(f"""
    WITH p AS (SELECT p_partkey, regexp_replace(p_name, '[\\s·]', '', 'g') AS e, regexp_replace(p_type, '[\\s·]', '', 'g') AS r, regexp_replace(p_brand, '[\\s·]', '', 'g') AS s FROM part)
    SELECT p_partkey, contains(r, e) OR (length(r) >= 2 AND contains(e, r)) OR {_sql_lcs_columns('e', 'r')} >= 0.5
                   OR contains(s, e) OR (length(s) >= 2 AND contains(e, s)) OR {_sql_lcs_columns('e', 's')} >= 0.5 AS matches FROM p
""")
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.containment_match(F.array("p_type", "p_brand"), F.col("p_name")).alias("matches"))


@query()
def edit_kind(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.edit_kind("p_name", "p_type").alias("e")).select("p_partkey", "e.*")


@query(f"SELECT p_partkey, round({_sql_lcs_columns('a', 'b')}, 6) AS ratio FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)")
def column_lcs_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(T.lcs_columns(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("""
    WITH RECURSIVE p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE a.text <> ''),
    w AS (
      SELECT item_id, x, y, 0 AS k, j, 0 AS v FROM (SELECT *, unnest(range(1, length(x) + 1)) AS j FROM p)
      UNION ALL
      SELECT item_id, x, y, k + 1, j, max(c) OVER (PARTITION BY item_id ORDER BY j) FROM (
        SELECT *, greatest(v, lag(v, 1, 0) OVER (PARTITION BY item_id ORDER BY j) + (substr(x, j::INT, 1) = substr(y, k + 1, 1))::INT) AS c FROM w WHERE k < length(y))
    )
    SELECT item_id, round(max(v) FILTER (WHERE k = length(y))::DOUBLE / any_value(length(x)), 6) AS ratio FROM w GROUP BY item_id
""")
def long_text_lcs_ratio(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    pairs = items.where("text <> ''").join(after, "item_id")
    return pairs.select("item_id", F.round(T.lcs_columns(F.col("text"), F.col("after")), 6).alias("ratio"))


@query(f"""
    WITH t AS (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY p_brand),
    c AS (SELECT p_brand, list_reduce(list_transform(names, lambda t: {{'reps': [t], 'ns': [1]}}), lambda s, x:
      CASE WHEN len(list_filter(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.4)) = 0
           THEN {{'reps': list_append(s.reps, x.reps[1]), 'ns': list_append(s.ns, 1)}}
           ELSE {{'reps': s.reps, 'ns': list_transform(s.ns, lambda n, i: n + (i = list_position(list_transform(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.4), true))::INT)}} END) AS s FROM t)
    SELECT p_brand, len(s.reps)::INT AS clusters, s.reps[list_position(s.ns, list_max(s.ns))] AS rep, list_max(s.ns) AS n FROM c
""")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    found = names.select("p_brand", sequences.leader_clusters(F.col("names"), T.edit_similarity, 0.4).alias("c"))
    return found.select("p_brand", F.size("c").alias("clusters"), F.get("c", 0)["rep"].alias("rep"), F.get("c", 0)["n"].alias("n"))


@query(f"""
    WITH t AS (SELECT p_brand, list(p_name || ' ' || p_type ORDER BY p_partkey) AS names, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY p_brand),
    c AS (SELECT p_brand, list_reduce(list_transform(names, lambda t, i: {{'reps': [t], 'ids': [ids[i]], 'ns': [1]}}), lambda s, x:
      CASE WHEN len(list_filter(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.8)) = 0
           THEN {{'reps': list_append(s.reps, x.reps[1]), 'ids': list_append(s.ids, x.ids[1]), 'ns': list_append(s.ns, 1)}}
           ELSE {{'reps': s.reps, 'ids': s.ids, 'ns': list_transform(s.ns, lambda n, i: n + (i = list_position(list_transform(s.reps, lambda r: {_sql_edit('r', 'x.reps[1]')} >= 0.8), true))::INT)}} END) AS s FROM t)
    SELECT p_brand, unnest(s.ids) AS leader, unnest(s.reps) AS rep, unnest(s.ns)::BIGINT AS n FROM c
""")
def text_clusters(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").withColumn("said", F.concat_ws(" ", "p_name", "p_type"))
    return sequences.cluster_rows(parts, "p_brand", "p_partkey", "said", 0.8).drop("score")


@query("""
    SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::BIGINT AS number, left(c_name, 4) AS prefix, c_mktsegment || '|' || c_name AS key
    FROM customer WHERE trim(c_name) <> '' AND c_acctbal >= 0
""")
def text_pipeline_filters(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where((F.trim("c_name") != "") & (F.col("c_acctbal") >= 0))
    number = F.regexp_extract("c_name", "([0-9]+)", 1).cast("long")
    return c.select("c_custkey", number.alias("number"), F.substring("c_name", 1, 4).alias("prefix"), F.concat_ws("|", "c_mktsegment", "c_name").alias("key"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice, 0)::DOUBLE AS price, least(40.0, greatest(5.0, l_quantity)) AS quantity FROM lineitem
""")
def rounding_clamp(spark: SparkSession, d: str) -> DataFrame:
    clamped = F.least(F.lit(40.0), F.greatest(F.lit(5.0), F.col("l_quantity")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround("l_extendedprice", 0).alias("price"), clamped.alias("quantity"))


@query("SELECT page_id, md5(regexp_replace(html, '<!--(.|\\n)*?-->', '', 'g')) AS html_md5 FROM pages")
def html_comment_strip(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(T.strip_comments(F.col("html"))).alias("html_md5"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_property_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
    WITH t AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS piece FROM conversations)
    SELECT conv_id, turn, count(*) FILTER (WHERE trim(piece, ' ') <> '') AS n, max(length(trim(piece, ' '))) AS longest FROM t GROUP BY conv_id, turn
""")
def flatten_readings(spark: SparkSession, d: str) -> DataFrame:
    pieces = F.transform(F.split("text", r"\."), lambda x: F.trim(x))
    c = read(spark, d, "conversations").select("conv_id", "turn", pieces.alias("p"))
    return c.select("conv_id", "turn", F.size(F.filter("p", lambda x: x != "")).cast("long").alias("n"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


@query(f"""
    WITH f AS (SELECT conv_id, arg_min(text, turn) AS expected FROM conversations GROUP BY conv_id),
    s AS (SELECT c.conv_id, c.turn, {_sql_edit('f.expected', 'c.text')} AS similarity FROM conversations c JOIN f ON c.conv_id = f.conv_id
          WHERE c.turn > (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id))
    SELECT conv_id, round(max(similarity), 6) AS similarity, first(turn ORDER BY similarity DESC, turn) AS turn FROM s GROUP BY conv_id
""")
def best_reading(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("expected"), F.min("turn").alias("t0"))
    later = c.join(first, "conv_id").where(F.col("turn") > F.col("t0"))
    # the best of a key's readings without holding them: the most alike, then the first
    best = F.min(F.struct((-T.edit_similarity(F.col("expected"), F.col("text"))).alias("s"), "turn"))
    found = later.groupBy("conv_id").agg(best.alias("b"))
    return found.select("conv_id", F.round(-F.col("b.s"), 6).alias("similarity"), F.col("b.turn").alias("turn"))


# --- vectors -----------------------------------------------------------------------------------------------------

_GALLERY = "SELECT * FROM embeddings WHERE vec_id % 20 = 0"


@query(f"""
    SELECT p.vec_id, round(max(list_cosine_similarity(p.embedding::DOUBLE[], g.embedding::DOUBLE[])), 5) AS best FROM embeddings p, ({_GALLERY}) g GROUP BY p.vec_id
""")
def max_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return gallery.most_alike(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding").select("vec_id", F.round("best", 5).alias("best"))


#: Rows of a cell of the gallery of known labels: small enough that there are several.
CELL = 128


@query("""
    WITH c AS (SELECT p.vec_id, g.vec_id AS best_id, list_cosine_similarity(p.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS c
               FROM embeddings p JOIN embeddings g ON p.label >= 6 AND g.label < 6)
    SELECT vec_id, round(max(c), 5) AS best, arg_max(best_id, c) AS best_id FROM c GROUP BY vec_id
""")
def nearest_known(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return gallery.most_alike(e.where("label >= 6"), e.where("label < 6"), "vec_id", "embedding", CELL).withColumn("best", F.round("best", 5))


@query(f"""
    WITH b AS (SELECT p.vec_id, p.label, max(list_cosine_similarity(p.embedding::DOUBLE[], g.embedding::DOUBLE[])) AS best
               FROM embeddings p, ({_GALLERY}) g WHERE p.vec_id <> g.vec_id GROUP BY p.vec_id, p.label)
    SELECT label, count(*) FILTER (WHERE best >= 0.25) AS passed, count(*) AS n FROM embeddings JOIN b USING (vec_id, label) WHERE vec_id % 20 <> 0 GROUP BY label
""")
def cosine_gate(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    probes = e.join(e.where("vec_id % 20 = 0").select("vec_id"), "vec_id", "left_anti")
    best = gallery.most_alike(probes, e.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return probes.select("vec_id", "label").join(best, "vec_id").groupBy("label").agg(F.count_if(F.col("best") >= 0.25).alias("passed"), F.count("*").alias("n"))
