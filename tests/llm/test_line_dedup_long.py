"""Documents of very many lines, and rows that share an id."""

import time

from lumenline.llm import line_dedup


def test_many_lost_lines_take_linear_time(spark):
    n = 100_000
    shared = [f"line {i} of many" for i in range(n)]
    rows = [(d, "\n".join([f"own {d}", *shared, "", f"end {d}", shared[0]]), f"s{d}") for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    began = time.time()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_spread_lines(df).collect()}
    assert time.time() - began < 60
    assert got[0] == (rows[0][1], n + 4, 0)
    assert got[1] == ("own 1\n\nend 1", n + 4, n + 1) and got[2] == ("own 2\n\nend 2", n + 4, n + 1)


def test_rows_of_one_id(spark):
    rows = [(1, "spread line\na", "s1"), (2, "b\nspread  line", "s2"), (2, "spread line\nc\nspread line", "s3"), (2, "b\nspread  line", "s4"), (None, None, None), (3, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_spread_lines(df).collect() if r.doc_id)
    assert got == [(1, "spread line\na", 2, 0), (2, "b", 2, 1), (2, "b", 2, 1), (2, "c", 3, 2), (3, "", 1, 0)]
