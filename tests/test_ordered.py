"""Ordered operators with one key over many blocks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumenline.functions import text as T
from lumenline.operators import ordered, sequences


def made(seed, n=400):
    dice = random.Random(seed)
    keys = ["hot"] * 8 + ["a", "b", None]
    return [(dice.choice(keys), i, float(dice.choice([0, 10, 30, 55, 90])), dice.random() < 0.7, dice.choice(["x", "x", "y", None, ""])) for i in range(n)]


SCHEMA = "k string, o long, v double, act boolean, t string"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def in_tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_blocks_know_what_came_before(spark, blocks):
    rows = made(blocks)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    dealt = ordered.dealt(df, "k", ["o"], {"was": F.col("t"), "v2": F.col("v") * 2}, blocks)
    got = {r["o"]: r for r in ordered.running(dealt, "k", F.col("v"), "total").collect()}
    if blocks == 16:  # the hot key is dealt over most blocks
        assert dealt.where("k = 'hot'").select("_block").distinct().count() > 8 and dealt.where("_spans").select("k").distinct().count() >= 1
    for own in by_key(rows).values():
        total, last = 0.0, (None, None)
        for n, r in enumerate(own, 1):
            total += r[2]
            assert (got[r[1]]["_at"], got[r[1]]["was"], got[r[1]]["v2"], got[r[1]]["total"]) == (n, *last, total)
            last = (r[4], r[2] * 2)


@pytest.mark.parametrize(("blocks", "gap"), [(1, 3), (7, 1), (7, 3), (40, 25), (40, 0), (5, 1000)])
def test_debounce_of_a_key_in_many_blocks(spark, blocks, gap):
    rows = made(gap, 500)
    got = sequences.debounced(spark.createDataFrame(rows, SCHEMA).repartition(4), "k", "o", "v", F.col("act"), 20.0, gap, blocks)
    want = []
    for own in by_key(rows).values():
        before, last = None, -(10**9)
        for n, r in enumerate(own):
            if (before is None or abs(r[2] - before) > 20) and r[3] and n - last >= gap:
                want.append((r[0], r[1]))
                last = n
            before = r[2]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "collect_list(o" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("blocks", [1, 9])
def test_runs_of_a_key_in_many_blocks(spark, blocks):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sequences.drop_consecutive(df, "k", ["o"], "t", blocks)
    assert kept.columns == df.columns
    want = [r[1] for own in by_key(rows).values() for n, r in enumerate(own) if n == 0 or own[n - 1][4] != r[4]]
    assert sorted(r["o"] for r in kept.collect()) == sorted(want)
    runs, sessions = [], []
    for key, own in by_key(rows).items():
        for n, r in enumerate(own):
            b = own[n - 1] if n else None
            if b and b[4] == r[4] and r[4] is not None and r[1] - b[1] <= 2:
                runs[-1][1].append(r)
            else:
                runs.append((key, [r]))
            if b and b[4] and r[4] and b[4] == r[4]:
                sessions[-1][1].append(r)
            else:
                sessions.append((key, [r]))
    got = sequences.merge_runs(df, "k", "o", "t", "v", "o", 2, blocks)
    best = lambda g: min(g, key=lambda r: (-r[2], r[1]))
    assert sorted(map(tuple, got.drop("island").collect()), key=repr) == sorted(((k, g[0][4], g[0][1], g[-1][1], len(g), best(g)[1], best(g)[2]) for k, g in runs), key=repr)
    got = sequences.sessions(df, "k", "o", "t", lambda a, b: (a == b).cast("double"), 0.8, blocks).select("k", "t0", "t1", "n_points")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, g[0][1], g[-1][1], len(g)) for k, g in sessions), key=repr)
    texts = df.select("k", "o", F.when(F.col("t") != "", F.array("t", F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("ts"))
    found = [sorted(map(repr, sequences.text_sessions(texts, "k", "o", "ts", T.edit_similarity, 0.8, b).drop("island").collect())) for b in (1, blocks)]
    assert found[0] == found[1] and found[0]


def test_until_first(spark):
    rows = made(7)
    got = sequences.until_first(spark.createDataFrame(rows, SCHEMA), "k", "o", F.col("v") == 90)
    want = []
    for own in by_key(rows).values():
        for r in own:
            want.append(r[1])
            if r[2] == 90:
                break
    assert sorted(r["o"] for r in got.collect()) == sorted(want) and got.columns == ["k", "o", "v", "act", "t"]


def greedy(pairs):
    used, out = set(), []
    for k, i, j, s in sorted(pairs, key=lambda p: (p[3] is None, -(p[3] or 0), p[1], p[2])):
        if (k, 0, i) not in used and (k, 1, j) not in used:
            used |= {(k, 0, i), (k, 1, j)}
            out.append((k, i, j, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [10**6, 300, 40])
@pytest.mark.parametrize("ties", [True, False])
def test_greedy_matching_in_blocks(spark, rows, ties):
    dice = random.Random(rows)
    near = [("hot", i, j, 1.0 if ties else dice.choice([0.5, 0.6, dice.random()])) for i in range(200) for j in range(i - 3, i + 4) if dice.random() < 0.8]
    odd = [(None, 1, 2, 0.3), (None, 1, 3, 0.9), ("a", 1, 1, None), ("a", 1, 2, 0.1), ("a", 2, 1, 0.1), ("a", 2, 2, 0.1)]
    wide = [("wide", i, i % 3, dice.random()) for i in range(100)]
    pairs = near + odd + wide
    found = sequences.greedy_matching(spark.createDataFrame(pairs, "k string, i long, j long, s double").repartition(3), "k", "i", "j", "s", rows)
    assert sorted(map(tuple, found.collect()), key=repr) == greedy(pairs)
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_nothing_to_order(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sequences.drop_consecutive(df, "k", ["o"], "t").count() == 0
    assert sequences.debounced(df, "k", "o", "v", F.col("act"), 1.0, 2).count() == 0
    assert sequences.greedy_matching(df.selectExpr("k", "o as i", "o as j", "v as s"), "k", "i", "j", "s").count() == 0


def folded(rows, least):
    """Clusters by the plain fold: (key, leader, rep, n)."""
    import re

    def alike(a, b):
        a, b = (re.sub(r"[^一-鿿0-9A-Za-z]", "", x or "") for x in (a, b))
        if not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return 1 - row[-1] / min(len(a), len(b))

    out = {}
    for k, o, t in sorted(rows, key=lambda r: r[1]):
        for c in out.setdefault(k, []):
            if alike(c[1], t) >= least - 1e-12:
                c[2] += 1
                break
        else:
            out[k].append([o, t, 1])
    return sorted(((k, o, t, n) for k, cs in out.items() for o, t, n in cs), key=repr)


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_clusters_of_rows_equal_the_fold(spark, least):
    dice = random.Random(11)
    base = ["".join(dice.choice("abcdefgh") for _ in range(dice.choice([1, 2, 3, 5, 10, 20]))) for _ in range(25)]
    rows = []
    for o in range(260):
        t = list(dice.choice(base))
        for _ in range(dice.choice([0, 0, 1, 2])):
            t[dice.randrange(len(t))] = dice.choice(["", "a", "x", "xy"])
        rows.append((dice.choice(["hot", "hot", "k", None]), o, dice.choice(["".join(t)] * 9 + ["", None, "?!"])))
    df = spark.createDataFrame([(*r, float(r[1])) for r in rows], "k string, o long, t string, s double").repartition(3)
    got = sequences.cluster_rows(df, "k", "o", "t", least, "s")
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == folded(rows, least)


def test_clusters_of_a_large_group(spark):
    dice = random.Random(12)
    base = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(400)]
    rows = [("hot", o, base[o % 400][: dice.randrange(22, 25)], 1.0) for o in range(10_000)]
    found = sequences.cluster_rows(spark.createDataFrame(rows, "k string, o long, t string, s double"), "k", "o", "t", 0.8, "s").collect()
    assert sorted(r["leader"] for r in found) == list(range(400)) and {r["n"] for r in found} == {25} and {r["score"] for r in found} == {1.0}
    assert sequences.cluster_rows(spark.createDataFrame([], "k string, o long, t string"), "k", "o", "t").count() == 0
