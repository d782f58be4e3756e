"""Scalar functions against plain Python versions and golden values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenline.functions import images
from lumenline.functions import text as T
from lumenline.functions import vectors as V


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def claimed(words, text):
    text, free = text.lower(), [True] * len(text)
    got = 0
    for w in words:
        for i in range(len(text) - len(w) + 1):
            if text[i : i + len(w)] == w and all(free[i : i + len(w)]):
                free[i : i + len(w)] = [False] * len(w)
                got += len(w)
                break
    return got * 100.0 / sum(map(len, words))


def column(spark, rows, expr, names):
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.select(expr).collect()]


def test_lcs_ratio_golden(spark):
    for q, t, want in [("abc", "xaybzc", 100), ("ABC", "cab", 66.667), ("red ring", "blue anvil", 37.5), ("", "abc", 0), ("abc", "", 0), ("水晶", "水球晶体", 100)]:
        assert column(spark, [(t,)], T.lcs_ratio(q, F.col("t")), "t string")[0] == pytest.approx(want, abs=1e-3)


def test_lcs_random(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé水😀 ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for q in ("abca", "é水😀ab", "a" * 62):
        got = column(spark, [(t,) for t in texts], T.lcs_length(q, F.col("t")), "t string")
        assert got == [lcs(q, t) for t in texts]
    pairs = list(zip(texts, texts[1:], strict=False))
    got = column(spark, pairs, T.lcs_columns(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([lcs(a, b) / len(a) if a and b else 0.0 for a, b in pairs])


def test_lcs_of_any_length(spark):
    rng = random.Random(6)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(made(n, "abcdé日😀"), made(m, "abcdxé日😀")) for n in (0, 1, 61, 62, 63, 124, 125, 200) for m in (0, 1, 62, 63, 300)]
    pairs += [("a" * 200, "a" * 130), ("a" * 63, "b" * 63), (made(5000, "abcdefgh"), made(2000, "abcdefgh"))]
    got = column(spark, pairs, T.lcs_columns(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([lcs(a, b) / len(a) if a and b else 0.0 for a, b in pairs])
    for n in (62, 63, 200, 5000):
        q = made(n, "abcdé")
        texts = [b for _, b in pairs[:40]] + [q, q[:100] + "zz" + q[100:]]
        assert column(spark, [(t,) for t in texts], T.lcs_ratio(q, F.col("t")), "t string") == pytest.approx([lcs(q, t) * 100 / n for t in texts])


def test_longest_phrase_first(spark):
    rng = random.Random(9)
    tables = [{"ab": "1", "abc": "22", "b": "", "bcd": "x", "c": "c"}, {"頭髮": "头发", "髮": "发", "頭": "头", "發": "发", "理髮": "理发"}, {"a": "b", "b": "a"}, {}, {"": "x", "a.": "(", "\\": "s"}]
    texts = ["", None, "abcdabcabbcd", "理髮頭髮發頭", "a.b\\a"] + ["".join(rng.choice("abcd.頭髮理") for _ in range(40)) for _ in range(60)]
    for table in tables:

        def plain(t, table=table):
            out, i = "", 0
            while i < len(t):
                k = max((k for k in table if k and t.startswith(k, i)), key=len, default=None)
                out, i = out + (t[i] if k is None else table[k]), i + (1 if k is None else len(k))
            return out

        got = column(spark, [(t,) for t in texts], T.to_simplified(F.col("t"), table), "t string")
        assert got == [None if t is None else plain(t) for t in texts]


def test_multiword(spark):
    rng = random.Random(4)
    texts = ["aba", "abba", "a", "bar foo", *("".join(rng.choice("aBb o") for _ in range(rng.randint(0, 14))) for _ in range(150))]
    for words in (["ab", "ba"], ["a", "a"], ["foo", "bar"], ["foo", "baz"]):
        got = column(spark, [(t,) for t in texts], T.multiword_ratio(words, F.col("t")), "t string")
        assert got == pytest.approx([claimed(words, t) for t in texts])


def test_query_words():
    assert T.query_words("nation") is None and T.query_words("a\tb") is None
    assert T.query_words("A  b%20c") == ["a", "b", "c"] and T.query_words("%20") == []


def test_edit_similarity_and_relations(spark):
    rows = [("abc", "abc!"), ("ab", "wxyz"), ("", "a"), ("A", "a"), ("blue ring", "blue bolt"), ("在年前的今天", "在15年前的今天")]
    got = column(spark, rows, T.edit_similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([1.0, -1.0, 0.0, 0.0, 0.5, 0.6667], abs=1e-4)
    words = ["", "a", "abcd", "abce", "xbcd", "abcdefgh", "abxdefgh", "hgfedcba", "同文字数", "同文字数多い"]
    rows = [(a, b) for a in words for b in words]
    full = column(spark, rows, T.edit_similarity(F.col("a"), F.col("b")), "a string, b string")
    for least in (0.0, 0.3, 0.75, 1.0):
        got = column(spark, rows, T.edit_similarity(F.col("a"), F.col("b"), least), "a string, b string")
        assert got == [s if s >= least else None for s in full]
    rows = [("abc", "abc"), ("ace", "abcde"), ("abcde", "ace"), ("abc", "xyz"), ("", "a")]
    assert column(spark, rows, T.diff_relation(F.col("a"), F.col("b")), "a string, b string") == ["same", "add", "del", "diff", ""]
    assert column(spark, [("ac", "abc"), ("ca", "abc"), ("", "x"), ("aa", "a")], T.is_subsequence(F.col("a"), F.col("b")), "a string, b string") == [True, False, True, False]


def test_edit_kind(spark):
    rows = [("好烫店", "好烫"), ("abc", "abd"), ("abcd", "xbcde"), ("a b", "ab"), ("ab", "abc")]
    df = spark.createDataFrame(rows, "a string, b string").select(T.edit_kind("a", "b").alias("e")).select("e.kind")
    assert [r[0] for r in df.collect()] == ["del", "replace", "mixed", "same", "add"]


def test_kana_clean_and_time(spark):
    assert column(spark, [("ウルトラ",), ("爱染ア",), ("アー!",), ("abc",), ("",)], T.kana_ratio(F.col("t")), "t string") == pytest.approx([1, 1 / 3, 2 / 3, 0, 0])
    assert column(spark, [(" abc。！ ",), ("a.b",), ("...",)], T.clean_trailing(F.col("t")), "t string") == ["abc", "a.b", ""]
    assert column(spark, [("2m05s",), ("2m05s_fix",), ("x",), (None,)], T.parse_ts(F.col("t")), "t string") == [125, 125, None, None]
    assert column(spark, [("2m05s",), ("2m05s_fix",)], T.parse_ts(F.col("t"), whole=True), "t string") == [125, None]
    assert column(spark, [(125,), (0,), (-1,)], T.format_ts(F.col("t")), "t int") == ["2m05s", "0m00s", "-1m59s"]
    assert column(spark, [("[P07] x name.json",)], T.display_title(F.col("t")), "t string") == ["P07 x name"]
    assert column(spark, [("a<!-- x\n -->b<!--[if IE]-->",)], T.strip_comments(F.col("t")), "t string") == ["ab<!--[if IE]-->"]


def test_containment(spark):
    rows = [(["xx a b c yy"], "abc"), (["ab"], "abcd"), (["a"], "zzzz"), (["axbx"], "abcd"), ([], "a")]
    assert column(spark, rows, T.containment_match(F.col("r"), F.col("e")), "r array<string>, e string") == [True, True, False, True, False]


def test_vectors(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    got = column(spark, rows, V.cosine(F.col("a"), F.col("b")), "a array<float>, b array<float>")
    assert got[2] is None and [got[0], got[1], got[3]] == pytest.approx([1, 0, -1])
    faces = spark.sql("select array(struct(0.5D as sim, 0.0001D as area), struct(0.1D as sim, 0.9D as area)) as f")
    assert faces.select(V.passing(F.col("f"), 0.4, 0.0005)).first()[0] is False
    assert faces.select(V.largest(F.col("f"))[0]["area"]).first()[0] == 0.9


def test_images():
    image = np.zeros((60, 80, 3), np.uint8)
    image[20:40, 10:50] = 255
    assert images.white_mask(image).sum() == 800
    mask = images.edge_white(image)
    assert mask[20, 10] and not mask[30, 30]
    assert images.row_runs(np.array([0, 5, 5, 0, 0, 5, 0, 0, 0, 0, 5]), 0.5, 3) == [(1, 6), (10, 11)]
    assert images.tight_columns(images.white_mask(image), 2) == (8, 52)
    assert images.band_signature(image, 6, 8).sum() > 0
    assert images.crop_box(image, (0, 0, 5, 5)).shape[:2] == (15, 15)
