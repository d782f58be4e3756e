"""The gallery operator against all pairs, and how many cells its probes visit."""

import numpy as np
import pytest

from lumenline.operators import gallery


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def made(seed, centres, n, spread, dims=16):
    dice = np.random.default_rng(seed)
    middle = dice.normal(size=(centres, dims))
    x = (middle[dice.integers(0, centres, n)] + spread * dice.normal(size=(n, dims))).astype(np.float32)
    x[3], x[5] = 0, x[4]  # no length; a tie
    return x


def frame(spark, x, first=0):
    rows = [(first + i, v.tolist(), "x") for i, v in enumerate(x)] + [(first + len(x), None, "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, best string").repartition(4)


def plain(probes, known, first):
    cosine = unit(probes.astype(np.float64)) @ unit(known.astype(np.float64)).T
    return {i: (pytest.approx(c.max(), abs=1e-12), set(np.flatnonzero(c >= c.max() - 1e-12) + first)) for i, c in enumerate(cosine)}


@pytest.mark.parametrize(("spread", "block", "per_task"), [(0.05, 40, 10**6), (1.0, 40, 30), (0.05, 1000, 10**6), (0.2, 7, 5)])
def test_equals_all_pairs(spark, spread, block, per_task):
    probes, known = made(1, 12, 200, spread), made(1, 12, 500, spread)
    got = gallery.most_alike(frame(spark, probes), frame(spark, known, 1000), "vec_id", "embedding", block, per_task)
    assert got.columns == ["vec_id", "best", "best_id"]
    found = {r["vec_id"]: (r["best"], r["best_id"]) for r in got.collect()}
    want = plain(probes, known, 1000)
    assert set(found) == set(want)
    for i, (best, ids) in want.items():
        assert found[i][0] == best and found[i][1] in ids


def test_probes_visit_few_cells_of_clustered_vectors(spark):
    probes, known = made(2, 40, 300, 0.02), made(2, 40, 2000, 0.02)
    named = lambda df: df.select(df["vec_id"].alias("id"), df["embedding"].alias("v")).where("v is not null")
    own, sent = gallery.visits(named(frame(spark, probes)), named(frame(spark, known)), 50, 2000)
    chunks = own.select("cell", "chunk").distinct().count()
    assert 40 <= chunks and sent.count() < 0.2 * 300 * chunks  # of all probes and chunks
    assert own.groupBy("cell", "chunk").count().agg({"count": "max"}).first()[0] < 200


def test_probes_are_sent_once_a_group_not_once_a_cell(spark, monkeypatch):
    probes, known = made(4, 200, 300, 1.0), made(4, 200, 2000, 1.0)  # nothing to prune
    named = lambda df: df.select(df["vec_id"].alias("id"), df["embedding"].alias("v")).where("v is not null")
    own, listed, sizes = gallery._placed(named(frame(spark, probes)), named(frame(spark, known)), 10, 2000, 4)
    sent = listed.selectExpr("sum(size(groups)) g", "sum(size(cells)) c").first()
    assert sent.g <= 4 * 300 < 20 * 300 < sent.c and sum(sizes) == 2000
    assert {r["group"] for r in own.collect()} == {0, 1, 2, 3} and own.groupBy("group").count().agg({"count": "max"}).first()[0] < 700
    monkeypatch.setattr(gallery, "HELD", 150)  # cells in several groups, and several cells in a group
    known[:700] = known[0]  # a cell of equal vectors lies in several groups
    want = plain(probes, known, 1000)
    for block in (10, 400):
        got = {r["vec_id"]: (r["best"], r["best_id"]) for r in gallery.most_alike(frame(spark, probes), frame(spark, known, 1000), "vec_id", "embedding", block, 100).collect()}
        assert set(got) == set(want) and all(got[i][0] == best and got[i][1] in ids for i, (best, ids) in want.items())


def test_without_gallery(spark):
    some = frame(spark, made(3, 2, 10, 1.0))
    assert gallery.most_alike(some, some.limit(0), "vec_id", "embedding").count() == 0
    assert gallery.most_alike(some.limit(0), some, "vec_id", "embedding", 2).count() == 0
