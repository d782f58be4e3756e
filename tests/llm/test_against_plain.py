"""Operators and stages against plain versions, on small tables made here."""

import itertools
import math
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenline.llm import common, decontamination, fingerprints, html_extraction, license_scan, line_dedup, quality, simhash, token_counts
from lumenline.llm.bpe import version_digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- SimHash ------------------------------------------------------------------------------------------------------


def test_op5_cuts_a_place_that_most_fingerprints_share(spark):
    rng = random.Random(7)
    first = 0xABCD << 48
    base = [first | rng.getrandbits(48) for _ in range(40)]
    near = {b ^ (sum(1 << rng.randrange(48) for _ in range(rng.randint(0, 3))) & (2**48 - 1)) for b in base for _ in range(30)}
    prints = np.array(sorted(near | {first | rng.getrandbits(48) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}), np.uint64)
    df = spark.createDataFrame([(int(p), i) for i, p in enumerate(prints.view(np.int64))], "fp long, node long")
    labels = np.arange(len(prints))
    while True:
        new = np.array([labels[np.bitwise_count(prints ^ p) <= 3].min() for p in prints])
        if (new == labels).all():
            break
        labels = new
    for held in (10**9, 100):
        got = {r.node: r.component for r in simhash.components(simhash.links(df, held)).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == labels.tolist()


# --- spot signatures ----------------------------------------------------------------------------------------------


def test_op1_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELL", 7)
    monkeypatch.setattr(fingerprints, "HOT", 20)
    rng = random.Random(21)
    made = lambda n: [rng.choice(["the", "of", *("".join(rng.choice("bcdfgk") for _ in range(4)) for _ in range(2))]) for _ in range(n)]
    texts = [None, "", "", "the of", "word"]
    for family in range(6):
        base = made(60 + 40 * family)
        for k in range(30):
            other = list(base)
            for _ in range(rng.randint(0, 12)):
                other[rng.randrange(len(other))] = rng.choice(["the", f"new{k}"])
            texts.append("same start " + " ".join(other[: len(other) - rng.choice([0, 0, 4])]))
    texts += texts[5:25]
    rows = [(None if i == 40 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string")
    pairs, members = fingerprints.near_duplicates(df, "id", "t")
    signed = fingerprints.with_signatures(df.fillna("", "t"), "t", "s").collect()
    rep: dict[tuple, int] = {}
    for r in signed:
        if r.id is not None:
            rep[tuple(r.s)] = min(r.id, rep.get(tuple(r.s), r.id))
    found = {}
    for (s, a), (t, b) in itertools.combinations(((k, v) for k, v in rep.items() if k), 2):
        common = len({*s} & {*t})
        if common / (len(s) + len(t) - common) >= 0.8:
            found[min(a, b), max(a, b)] = common / (len(s) + len(t) - common)
    got = pairs.collect()
    assert len(got) == len(found) > 100
    assert {(r.rep_a, r.rep_b): r.similarity for r in got} == found
    assert sorted((str(r.id), str(r.rep)) for r in members.collect()) == sorted((str(r.id), str(rep.get(tuple(r.s)))) for r in signed)


# --- benchmark ----------------------------------------------------------------------------------------------------


def test_op6_asks_only_items_of_the_windows_length():
    rng = random.Random(3)
    items = [(i, words(rng, 10 + i % 40, 5000)) for i in range(400)]
    looked_for = decontamination.Benchmark(items)
    for i, t in items[:100]:
        found = looked_for.scan(f"{words(rng, 100, 5000)} {t} {words(rng, 100, 5000)}")
        assert [x[0] for x in found] == [i]
    windows = looked_for.asked / 10  # ten items have each length
    assert looked_for.similar >= 100 and looked_for.found < 0.2 * windows * len(items)


def test_leaks_stage_takes_rows_one_by_one(spark, tmp_path):
    rng = random.Random(2)
    item = words(rng, 30)
    spark.createDataFrame([(0, item), (1, "yes"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{words(rng, 9)} {item}", "a"), (None, "clean yes", "a"), (7, item, "a"), (7, "also clean", "b"), (8, None, None), (9, "", "a")]
    got = corpus_pipeline.leaks_stage(spark, documents(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, _ in (rows[1], rows[3], rows[4], rows[5]))


def test_copies_stage_takes_rows_one_by_one(spark):
    rng = random.Random(4)
    one, two = words(rng, 80), words(rng, 80)
    rows = [(None, one, "a"), (None, words(rng, 80), "a"), (3, one + " end", "a"), (5, two, "a"), (5, words(rng, 80), "a"), (2, two, "b"), (2, two, "b"), (9, "", "a"), (8, None, "a")]
    got = corpus_pipeline.copies_stage(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, _ in (rows[1], rows[2], rows[4], rows[5], rows[8]))


def test_lines_stage(spark):
    rows = [(1, "Menu\nown one", "a"), (2, "Menu\nown two", "b"), (3, " Menu \n\nown three", "c"), (4, "only two sites", "a"), (5, "only two sites", "b"), (6, None, None), (7, "", "a")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, documents(spark, rows), "").collect()}
    want = {1: "Menu\nown one", 2: "own two", 3: "\nown three", 4: "only two sites", 5: "only two sites", 7: ""}
    assert got.pop(6)[0] is None and got == {i: (t, len(t)) for i, t in want.items()}


def test_op3_sketches_agree_with_exact_counts_at_every_size(spark):
    rows = [(d, s, n, 0) for n in (1, 2, 3, 4, 5, 40, 900) for d, s in ((i, f"s{i % n}") for i in range(1000))]
    keys = spark.createDataFrame(rows, "id long, site string, h long, g int")
    for least in (3, 5, 300):
        got = {r.h for r in line_dedup.spread_lines(keys, least).collect()}
        assert got == {n for n in (1, 2, 3, 4, 5, 40, 900) if n >= least}


# --- token counts -------------------------------------------------------------------------------------------------


def test_op7_hot_digests(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "the same text" if i % 3 else f"text {i}", "a") for i in range(3000)] + [(None, None, "a"), (None, "", "a")]
    token_counts.HOT, before = 50, token_counts.HOT
    try:
        made = token_counts.count_tokens(documents(spark, rows).select("doc_id", "text"), "text", path, str(tmp_path / "cache"))
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in made.collect())
    finally:
        token_counts.HOT = before
    count = token_counts.counter(path)
    want = Counter((i, len((t or "").encode()), count([t or ""])[0]) for i, t, _ in rows)
    assert got == want
    assert {r.version for r in spark.read.parquet(str(tmp_path / "cache")).select("version").distinct().collect()} == {version_digest(path)}


# --- quality ------------------------------------------------------------------------------------------------------


def plain_kneser_ney(train, text):
    """Perplexity under an interpolated modified Kneser-Ney trigram model, from the definition."""
    pad = lambda t: ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
    c3 = Counter(g for t in train for g in zip(pad(t), pad(t)[1:], pad(t)[2:], strict=False))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def discounts(counts):
        n = [max(1, sum(x == k for x in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    def smoothed(counts, w, d, lower):
        total = sum(counts.values())
        if not total:
            return lower
        left = sum(d[min(n, 3) - 1] for n in counts.values()) / total
        return (counts[w] - d[min(counts[w], 3) - 1] if counts[w] else 0) / total + left * lower

    by1, by2 = defaultdict(Counter), defaultdict(Counter)
    for (b, c), n in c2.items():
        by1[b][c] = n
    for (a, b, c), n in c3.items():
        by2[a, b][c] = n
    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)
    seq = pad(text)
    total = 0.0
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        p = smoothed(c1, c, d1, 1 / (len(c1) + 1))
        p = smoothed(by1[b], c, d2, p)
        p = smoothed(by2[a, b], c, d3, p)
        total += math.log(p)
    return math.exp(-total / (len(seq) - 2))


def test_op8_equals_plain_kneser_ney(spark):
    rng = random.Random(9)
    train = [" ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(1, 40))) for _ in range(120)] + [None, ""]
    terms = quality.Terms(*quality.model_terms(spark.createDataFrame([(t,) for t in train], "text string")))
    texts = [*train[:10], "w1 w2 w3", "unseen words w1 here", "", None, "W1 w2  w1\nw0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.perplexity(df, terms).collect():
        assert r.perplexity == pytest.approx(plain_kneser_ney(train, texts[r.doc_id]), rel=1e-4)


def test_quality_stage_keeps_rows_with_null_or_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, words(rng, 40, 50), "a") for i in range(60)]
    rows += [(None, words(rng, 40, 50), "a"), (3, words(rng, 40, 50), "a"), (None, " ".join(f"junk{rng.random()}" for _ in range(40)), "a")]
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.quality_stage(spark, documents(spark, rows), str(tmp_path)).collect()
    texts = {r.text for r in got}
    assert rows[-1][1] not in texts and sum(t in texts for _, t, _ in rows) >= 58


# --- shared folder ------------------------------------------------------------------------------------------------


def test_scratch_deletes_what_was_written(spark):
    df = spark.range(5)
    with common.scratch(spark) as made:
        lost = common.written(df, "lost")
        kept = common.written(df.withColumn("p", F.col("id") % 2), "kept", by="p")
        made.pop()
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT"):
        spark.read.parquet(lost.inputFiles()[0])
    common.forget(spark, kept)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session())


# --- licenses -----------------------------------------------------------------------------------------------------


def plain_licenses(text):
    """The licenses that a template confirms, by whole alignments of all templates."""
    import difflib

    said = license_scan.words_of(text)
    found = set()
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            want = license_scan.words_of(t)
            ops = [o for o in difflib.SequenceMatcher(None, want, said, autojunk=False).get_opcodes()]
            while ops and ops[0][0] == "insert":
                ops = ops[1:]
            while ops and ops[-1][0] == "insert":
                ops = ops[:-1]
            lost = [w for o, a, b, _, _ in ops if o in ("delete", "replace") for w in want[a:b]]
            more = sum(b - a for o, _, _, a, b in ops if o in ("insert", "replace"))
            if len(lost) <= 0.1 * len(want) and more <= len(want) and not any(c.isdigit() for w in lost for c in w):
                found.add(name)
    return found


def altered_bodies():
    """(license, text): every template, plain and with words changed and added, wrapped."""
    rng = random.Random(12)
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            said = t.split()
            for share in (0, 0.02, 0.05):
                made = list(said)
                for _ in range(int(share * len(made))):
                    at = rng.randrange(1, len(made) - 1)
                    if rng.random() < 0.5:
                        made[at] = "changed"
                    else:
                        made.insert(at, "added")
                yield name, "Copyright 2020 Someone\n\n" + textwrap.fill(" ".join(made), 72) + "\n\nint main;"


def test_op10_altered_bodies_are_those_they_were_made_from(spark):
    texts = list(altered_bodies())
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(df).collect()}
    some = {i: plain_licenses(t) for i, (_, t) in enumerate(texts)}
    assert set(got) == {i for i, names in some.items() if names}  # as many as by confirming all templates
    assert all(got[i] in some[i] for i in got)
    assert got == {i: name for i, (name, _) in enumerate(texts) if i in got}
    assert set(got.values()) == set(license_scan.TEMPLATES) and len(got) > 0.9 * len(texts)


def test_op10_ranking_decides(monkeypatch):
    found = lambda text: [n[2] for region in license_scan.candidate_regions(text) for n in license_scan.notices(text, region)]
    texts = [(name, text) for name, text in altered_bodies() if plain_licenses(text)]
    assert [found(text) for _, text in texts] == [[name] for name, _ in texts]
    monkeypatch.setattr(license_scan.Templates, "rank", lambda self, block, among: [(0.0, k) for k in sorted(among)])
    assert any(found(text) != [name] for name, text in texts)


def test_op10_templates_of_the_caller(spark):
    own = {"House-1.0": ("This work may be copied under the house license of the authors, who give no warranty of any kind for it.",)}
    df = spark.createDataFrame([(1, "x\nThis work may be copied under the house\nlicense of the authors, who give no warranty of any kind for it. y"), (2, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.start_line, r.n_lines) for r in license_scan.scan(df, templates=own).collect()] == [(1, "House-1.0", 1, 2)]
    assert license_scan.scan(df, templates={}, unconfirmed=True).count() == 0


def test_op10_odd_rows(spark):
    text = "Released under the MIT License."
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (5, None, 4), (6, "", 5), (7, "license " * 20_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = license_scan.scan(df).collect()
    assert sorted((str(r.doc_id), r.license, r.n_missing) for r in got) == [("4", "MIT", 0), ("4", "MIT", 0), ("None", "MIT", 0)]


# --- pages --------------------------------------------------------------------------------------------------------


def test_op9_blocks_of_odd_markup():
    blocks = lambda html: [b.text for b in html_extraction.leaf_blocks(html)]
    assert blocks("<p>a</p><svg/><p>b</p>") == ["a", "b"] and blocks("<p>a<svg width='1' />b</p>") == ["ab"]
    assert blocks("<p>a<svg><text>drop</text></svg>b</p>") == ["ab"]
    assert blocks("<p>let <math><mi>x</mi></math> be</p>") == ["let x be"]
    assert blocks("<p title=\"it's>one</p><p>two</p>") == ["one", "two"]
    assert blocks('<p title="a > b">one</p>') == ["one"]
    assert blocks("<script>if (a < b) x('</p>')</script><p>one &lt;two&gt; &#8364;</p>") == ["one <two> €"]
    assert blocks("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]


def page(title, paragraphs, extra=""):
    """A page unlike those the field is trained on: no article element, own class names."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p {{ x }}</style></head><body><div class="wrap">
    <ul class="nav"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>
    <div class="post"><h1>{title}</h1>{body}</div>{extra}
    <div id="footer"><p>Copyright 2020 Example. All rights reserved.</p></div></div><script>var a;</script></body></html>"""


def test_op9_pages_of_another_make(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "river", "was", "slow", "and", "we", "walked", "along", "its", "bank", "until", "evening"]) for _ in range(n)).capitalize() + "."
    comments = '<div class="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thanks!</p></div></div>'
    made = []
    for i in range(40):
        paragraphs = [prose(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        made.append((i, "u", page(f"Walk {i}", paragraphs, comments if i % 2 else ""), paragraphs))
    df = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extraction.extract(df).collect()}
    wanted = sum(p in got[i] for i, _, _, ps in made for p in ps)
    others = sum(x in got[i] for i, *_ in made for x in ("Home", "News", "Contact", "Nice post, thanks!", "Copyright 2020 Example. All rights reserved."))
    assert wanted >= 0.95 * sum(len(ps) for *_, ps in made) and others <= 0.05 * 5 * len(made)


def test_window_fingerprints_with_repeats():
    """Sums over overlapping windows are the fingerprints of the windows on their own, whatever repeats in them."""
    rng = random.Random(5)
    for _ in range(40):
        words = [rng.choice("abc") if rng.random() < 0.7 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 90))]
        words += ["so"] * rng.choice((0, 0, 30)) + words[:20]
        length = rng.randrange(1, len(words) + 1)
        starts = sorted({rng.randrange(len(words) - length + 1) for _ in range(25)})
        got = list(decontamination.Benchmark._prints(words, length, starts))
        assert got == [(s, decontamination.simhash(decontamination.shingles(words[s : s + length]))) for s in starts]


def test_radius_finds_similar_windows_of_any_weights():
    """Windows of similarity 0.8 lie within the radius, also where one shingle has a tenth of the weight."""
    rng = random.Random(6)
    for reps in (0, 8, 16, 40):
        for n in range(40):
            common = [f"w{rng.randrange(10**6)}" for _ in range(9 * reps + 50)]
            changed = 1 + len(common) // 55
            item = common + ["so"] * reps
            text = [f"z{n}" if i % 55 == 25 and i // 55 < changed and not reps else w for i, w in enumerate(common)] + ["no"] * reps
            looked_for = decontamination.Benchmark([(1, " ".join(item))])
            similarity = decontamination.weighted_similarity(Counter(decontamination.shingles(item)), Counter(decontamination.shingles(text)))
            assert similarity >= 0.8
            assert [r[0] for r in looked_for.scan(" ".join(text))] == [1]
