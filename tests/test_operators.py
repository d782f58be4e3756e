"""Operators on small fixtures, sources and sinks on files, streams against their batch forms."""

import gzip
import json
import random

from pyspark.sql import functions as F

from lumenline.functions import text as T
from lumenline.operators import integrity, retrieval, sequences
from lumenline.sources import files
from lumenline.streaming import stateful


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_search_orders_and_limits(spark):
    df = spark.createDataFrame([(0, "red ring", 0.9, 0), (1, "a ring", 0.1, 1), (2, "RING", None, 0), (3, "rung", 0.9, 0), (4, "zzz", 1.0, 1)], "ord long, x string, s double, d int")
    assert [r.ord for r in retrieval.search(df, "ring").collect()] == [0, 1, 2, 3]
    assert [r.ord for r in retrieval.search(df, "ring", min_similarity=0.5).collect()] == [0, 3]  # a null similarity is under any limit above 0
    assert [r.ord for r in retrieval.search(df, "ring", flag="d", flag_first=True).collect()][0] == 1
    assert [r.ord for r in retrieval.search(df, "ring", min_ratio=0, page=1, page_size=2).collect()] == [2, 3]
    assert retrieval.search(df, "  ").count() == 0 and retrieval.search(df, "%20").count() == 0
    assert [r.ord for r in retrieval.search(df, "red%20ring").collect()][0] == 0
    assert [r.ord for r in retrieval.search(df, "ring", flag="d", flag_only=True, min_ratio=0).collect()] == [1, 4]


def test_limits_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, "ring", 0.5), (1, "rixx", nan), (2, "rixx", None), (3, "rxxx", 0.5), (4, "ring", inf)], "ord long, x string, s double")
    found = lambda **limits: [r.ord for r in retrieval.search(df, "ring", **limits).collect()]
    assert found() == found(min_ratio=nan) == found(min_similarity=inf, min_ratio=-inf) == [0, 4, 2]
    assert found(min_ratio=0, min_similarity=-5) == [0, 4, 2, 3] and found(min_ratio=0.0, min_similarity=0.5) == [0, 4, 3]


def test_nearest_offset_prefers_order(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 50), (3, "a", 0), (4, "a", 99)], "row int, ep string, sec int")
    right = spark.createDataFrame([("a", 9, "m1"), ("a", 11, "p1"), ("a", 47, "m3"), ("a", 1, "x"), ("a", 1, "y"), ("a", 95, "far")], "ep string, sec int, f string")
    got = rows(integrity.nearest_offset(left, right, "ep", "sec", "row", "f"), "row")
    assert got == [(1, 1, "p1"), (2, -3, "m3"), (3, 1, "y")]


def test_runs_and_duplicates(spark):
    df = spark.createDataFrame([("v", s, "t", x, i) for i, (s, x) in enumerate([(5, 0.3), (6, 0.9), (7, 0.9), (9, 0.4)])], "k string, sec int, text string, sim double, id int")
    got = rows(sequences.merge_runs(df, "k", "sec", "text", "sim", "id").select("first", "last", "n", "best_at"), "first")
    assert got == [(5, 7, 3, 6), (9, 9, 1, 9)]
    df = spark.createDataFrame([("v", 1, "a"), ("v", 2, "a"), ("v", 3, None), ("v", 4, None), ("v", 5, "a")], "k string, o int, t string")
    assert [r[1] for r in rows(sequences.drop_consecutive(df, "k", ["o"], "t"), "o")] == [1, 3, 5]


def test_debounced_matches_plain(spark):
    values = [(1, 0.0), (2, 50.0), (3, 52.0), (4, 0.0), (5, 90.0), (6, 10.0), (7, 10.0), (8, 99.0)]
    df = spark.createDataFrame([("u", o, v, True) for o, v in values], "u string, o long, v double, on boolean")
    got = [r[1] for r in rows(sequences.debounced(df, "u", "o", "v", F.col("on"), 20.0, 3), "o")]
    want, prev, last = [], None, -(10**9)
    for n, (o, v) in enumerate(values):
        if (prev is None or abs(v - prev) > 20) and n - last >= 3:
            want.append(o)
            last = n
        prev = v
    assert got == want


def test_clusters_and_matching(spark):
    df = spark.createDataFrame([(["abcde", "abcdx", "zzzzz", "abcde"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(sequences.leader_clusters(F.col("t"), T.edit_similarity, 0.8)).collect()]
    assert [(c.rep, c.n) for c in got[0]] == [("abcde", 3), ("zzzzz", 1)] and got[1] == []
    pairs = spark.createDataFrame([("e", 1, 1, 0.9), ("e", 1, 2, 0.9), ("e", 2, 1, 0.9), ("e", 2, 2, 0.1), ("f", 1, 1, 0.5)], "k string, i int, j int, s double")
    assert [r[:3] for r in rows(sequences.greedy_matching(pairs, "k", "i", "j", "s"), "k", "i")] == [("e", 1, 1), ("e", 2, 2), ("f", 1, 1)]
    v = spark.sql("select * from values (0.95D,'x'),(0.54D,'add'),(0.7D,'add'),(0.7D,'del'),(null,'x') as t(s,k)")
    got = [r[0] for r in v.select(sequences.verdict(F.col("s"), F.col("k"), F.lit(2), F.lit(0.1))).collect()]
    assert got == ["confirmed", "unmatched", "apply_add", "review", "unmatched"]


def test_ledger(spark):
    key = "ep string, ts string"
    fixes = spark.createDataFrame([("e", t, "o", "n", "s") for t in "abcde"], f"{key}, old string, new string, src string")
    current = spark.createDataFrame([("e", "a", "n"), ("e", "b2", "n"), ("e", "c", "o"), ("e", "d", "x"), ("e", "e3", "n")], f"{key}, text string")
    dropped = spark.createDataFrame([("e", "d")], key)
    moved = spark.createDataFrame([("e", "b", "b2", 1), ("e", "e", "e2", 1), ("e", "e2", "e3", 1)], "ep string, old_ts string, new_ts string, rank int")
    reverted = spark.createDataFrame([("e", "c", "o", "n")], f"{key}, old string, new string")
    got = {r.ts: r.status for r in integrity.reconcile(fixes, current, dropped, moved, reverted).collect()}
    assert got == {"a": "applied", "b": "applied", "c": "reverted", "d": "removed", "e": "problem"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v int")
    assert rows(integrity.coverage(none, none, ["k"])) == [(0, 0, 0, None)]
    assert integrity.duplicate_groups(none, ["k"], "v", "v").count() == 0
    assert sequences.drop_consecutive(none, "k", ["v"], "v").count() == 0


def test_sources(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    lines = [{"timestamp": "0m05s", "similarity": 0.5, "text": "x"}, {"timestamp": "10m00s", "similarity": 0.6, "text": " "}]
    (corpus / "[P01] one.json").write_text(json.dumps(lines))
    (corpus / "other.json").write_text("[]")
    got = rows(files.scan_corpus(spark, str(corpus)), "pos")
    assert got == [("[P01] one", 0, "0m05s", 0.5, "x"), ("[P01] one", 1, "10m00s", 0.6, " ")]
    (tmp_path / "map.js").write_text('window.X = {"a|1m00s": "f};.jpg", "b": "g"};\n')
    assert dict(rows(files.scan_literal(spark, str(tmp_path / "map.js")))) == {"a|1m00s": "f};.jpg", "b": "g"}
    (tmp_path / "db").write_bytes(gzip.compress(json.dumps([{"f": "x", "t": "0m01s", "s": 0.5, "x": "t", "d": 1}]).encode()))
    assert rows(files.scan_gzip_json(spark, str(tmp_path / "db"))) == [("x", "0m01s", 0.5, "t", 1)]
    names = spark.createDataFrame([("P01_0m05s.jpg",), ("P01_0m05s+1s.jpg",), ("x.jpg",)], "name string")
    assert len(rows(files.frame_names(names))) == 2
    assert files.listing(spark, str(corpus), "*.json").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", "10m00s", "b"), ("t1", "2m00s", "a")], "title string, timestamp string, text string")
    files.write_by_title(df, str(tmp_path / "out"))
    assert [r.text for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a", "b"]
    files.export_literal(df, "timestamp", "text", "X", str(tmp_path / "lit"))
    assert dict(rows(files.scan_literal(spark, str(tmp_path / "lit" / "*.txt")))) == {"10m00s": "b", "2m00s": "a"}
    files.export_rows(df, str(tmp_path / "rows"), ["text"])
    assert [json.loads(r[0])["text"] for r in spark.read.text(str(tmp_path / "rows")).collect()] == ["a", "b"]


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate([1.0, 1.0, 60.0, 60.0, 1.0, 1.0, 80.0])], "k string, o long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, o long, v double").parquet(str(tmp_path / "in"))
    for name, made, want in (
        ("repeats", stateful.drop_repeats(stream, "k", "o", "v"), sequences.drop_consecutive(df, "k", ["o"], "v").select("o")),
        ("fires", stateful.debounced(stream, "k", "o", "v", 20.0, 2), sequences.debounced(df, "k", "o", "v", F.lit(True), 20.0, 2).select("o")),
    ):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.o for r in spark.table(name).collect()) == sorted(r.o for r in want.collect())


def run(made, folder, name):
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_streams_in_the_order_of_time(spark, tmp_path):
    dice = random.Random(4)
    rows = [(dice.choice("uuuv"), i, 1_700_000_000 + i, float(dice.choice([1, 1, 60, 80])), dice.random() < 0.7) for i in range(120)]
    # within 20 seconds of disorder; what comes last closes the keys
    shuffled = sorted(rows, key=lambda r: r[1] + dice.uniform(0, 15))
    parts = [shuffled[i : i + 15] for i in range(0, 120, 15)] + [[(k, 1000, 1_700_001_000, 1.0, True) for k in "uv"], [("u", -1, 1_700_000_050, 99.0, True), ("u", 1001, 1_700_002_000, 1.0, True)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, "k string, o long, s long, v double, act boolean").selectExpr("k", "o", "timestamp_seconds(s) as t", "v", "act")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    df = spark.createDataFrame(rows, "k string, o long, s long, v double, act boolean")
    source = spark.readStream.schema("k string, o long, t timestamp, v double, act boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream = source.withWatermark("t", "20 seconds")
    for name, made, want in (
        ("repeats_by_time", stateful.drop_repeats(stream, "k", "o", "v", "t"), sequences.drop_consecutive(df, "k", ["o"], "v").select("k", "o")),
        ("fires_by_time", stateful.debounced(stream, "k", "o", "v", 20.0, 3, F.col("act"), "t"), sequences.debounced(df, "k", "o", "v", F.col("act"), 20.0, 3)),
    ):
        query = run(made, tmp_path, name)
        got = sorted((r.k, r.o) for r in spark.table(name).collect() if r.o < 1000)
        assert got == sorted((r.k, r.o) for r in want.collect())
        assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 1  # the late row


def test_streamed_trigger_has_the_gate(spark, tmp_path):
    df = spark.createDataFrame([("u", i, float(v), i != 2) for i, v in enumerate([0, 50, 0, 50, 0])], "k string, o long, v double, act boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(stateful.debounced(stream, "k", "o", "v", 20.0, 1, F.col("act")), tmp_path, "gate")
    assert sorted(r.o for r in spark.table("gate").collect()) == [0, 1, 3, 4]


def test_drain_reads_once(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stateful.drain(spark, str(tmp_path / "in"), "id long", str(tmp_path / "cp"), lambda df, _: seen.append(df.count()))
    assert sum(seen) == 3


def test_search_folds_once_and_pushes_the_filter(spark, tmp_path):
    spark.createDataFrame([(i, "a ring" * i, i) for i in range(9)], "ord long, x string, s long").write.parquet(str(tmp_path / "t"))
    found = retrieval.search(spark.read.parquet(str(tmp_path / "t")), "ring", min_similarity=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 1 and "GreaterThanOrEqual(s,3)" in plan
    assert [r.ord for r in found.collect()] == [3, 4, 5, 6, 7, 8]


def test_substring_hits(spark):
    lines = spark.createDataFrame([("abcab",), ("xbc",), (None,), ("",), ("abcab",)], "t string")
    phrases = spark.createDataFrame([(1, "ab"), (2, "bc"), (3, ""), (4, None), (5, "zz"), (6, "ab")], "id int, p string")
    want = [(1, 2), (2, 3), (3, 4), (4, 0), (5, 0), (6, 2)]
    assert rows(retrieval.substring_hits(lines, "t", phrases, "p", "id"), "id") == want
    retrieval.PHRASE_CHARS, before = 2, retrieval.PHRASE_CHARS
    assert rows(retrieval.substring_hits(lines, "t", phrases, "p", "id"), "id") == want
    retrieval.PHRASE_CHARS = before
    assert retrieval.substring_hits(lines, "t", phrases.where("false"), "p", "id").count() == 0
    assert retrieval.substring_hits(lines.where("false"), "t", phrases, "p", "id").agg(F.sum("hits")).first()[0] == 0


def test_vectors_without_rows(spark, tmp_path):
    from lumenline.plans import catalogue

    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalogue.max_cosine(spark, str(tmp_path)).count() == 0 and catalogue.cosine_gate(spark, str(tmp_path)).count() == 0


def test_pairs_without_similarity_are_none(spark):
    left = spark.createDataFrame([("e", 1, "abc"), ("e", 2, "xyz")], "k string, l_at int, a string")
    right = spark.createDataFrame([("e", 2, "abd"), ("e", 9, "abc")], "k string, r_at int, b string")
    found = sequences.windowed_pairs(left, right, "k", "at", 2, T.edit_similarity(F.col("a"), F.col("b")))
    assert [(r.l_at, r.r_at) for r in found.collect()] == [(1, 2)]


def test_reverse_lookup_takes_the_first_entry(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 30)], "v string, n int")
    mapping = spark.createDataFrame([("a", "k9", 1), ("a", "k1", 2)], "v string, k string, place int")
    got = {r.v: r.k for r in integrity.reverse_lookup(df, mapping, "v", "k", "place", "n", 100, 20).collect()}
    assert got == {"a": "k9", "b": "102", "c": None}


def test_missing_limit_is_zero(spark):
    df = spark.createDataFrame([("e", 5, None), ("e", 5, 9)], "k string, v int, m int")
    assert rows(integrity.over_limit(df, "k", F.col("v"), F.col("m"))) == [("e", 2, 5, -5, 1)]


def test_wanted_frames_and_files(spark):
    entries = spark.createDataFrame([("e", 1, 0), ("e", 2, 1), ("e", 3, 99), ("e", 4, None)], "ep string, row int, sec int")
    videos = spark.createDataFrame([("e", 2.0, 20)], "ep string, fps double, frames int")
    got = {r.fno: [tuple(w) for w in r.wanted] for r in integrity.wanted_frames(entries, videos, "ep", "row", "sec", (0, 1)).collect()}
    assert got == {0: [(1, 0)], 2: [(1, 1), (2, 0)], 4: [(2, 1)], 19: [(3, 0), (3, 1)]}
    names = spark.createDataFrame([("[P01] b.mp4",), ("[P01] a.MP4",), ("[P02] x.txt",)], "name string")
    keys = spark.createDataFrame([("P01",), ("P02",)], "ep string")
    assert rows(integrity.resolve_files(keys, "ep", names), "ep") == [("P01", "[P01] a.MP4"), ("P02", None)]


def test_first_passing_reasons(spark):
    df = spark.createDataFrame([(1, 0, False, True), (1, 1, True, True), (2, 0, False, True), (3, 0, False, False)], "r int, p int, ok boolean, m boolean")
    got = sequences.first_passing(df, "r", "p", F.col("ok"), "p", F.col("m"), ("no_subtitle", "no_face"))
    assert rows(got, "r") == [(1, 1, "ok"), (2, None, "no_face"), (3, None, "no_subtitle")]


def test_majority_compares_each_leader_once(spark):
    df = spark.createDataFrame([(["abcde!", "zz", "abcdx", "zz?", "zz"],)], "x array<string>")
    clusters = sequences.leader_clusters(F.col("x"), T.normed_similarity, 0.8, prepare=T.norm_text)
    got = df.withColumn("c", sequences.majority_text(clusters)).select("c.*")
    assert [tuple(r) for r in got.collect()] == [("zz", 3, [("abcde!", 2)])]
    assert [tuple(r) for r in df.select(clusters.alias("c")).first().c] == [("zz", 3, 0.0), ("abcde!", 2, 0.0)]
    for made in (got, df.select(sequences.majority_text(sequences.leader_clusters(F.col("x"), T.edit_similarity, 0.8)).alias("c")).select("c.*")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("levenshtein") == 1


def test_text_sessions_and_majority(spark):
    points = [("v", 1.0, ["abcde", "abcdf"]), ("v", 2.0, ["zzzzz", "abcde"]), ("v", 3.0, []), ("v", 4.0, ["qrstu"]), ("v", 5.5, ["qrstu", "other"])]
    df = spark.createDataFrame(points, "k string, t double, x array<string>")
    got = rows(sequences.text_sessions(df, "k", "t", "x", T.edit_similarity, 0.8).drop("k", "island"), "t0")
    assert [tuple(r)[:5] for r in got] == [(1.0, 2.0, 1.5, 2, 4), (4.0, 5.5, 4.75, 2, 3)]
    assert [(r[5], r[6], [tuple(a) for a in r[7]]) for r in got] == [("abcde", 3, [("zzzzz", 1)]), ("qrstu", 2, [("other", 1)])]
    scored = df.limit(1).select(sequences.leader_clusters(F.array(*map(F.lit, ["abcde", "abcdx", "zz"])), T.edit_similarity, 0.8, F.array(F.lit(0.5), F.lit(1.0), F.lit(0.25))).alias("c"))
    assert [tuple(c) for c in scored.first().c] == [("abcde", 2, 0.75), ("zz", 1, 0.25)]
