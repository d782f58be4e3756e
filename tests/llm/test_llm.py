"""Corpus operators against plain versions of themselves, the libraries they stand for, and odd tables."""

import hashlib
import random
import textwrap
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenline.llm import bpe, decontamination, fingerprints, html_extraction, language_model, license_scan, line_dedup, quality, queries, simhash, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "in", *("".join(rng.choice("abcdeiorst") for _ in range(rng.randint(3, 8))) for _ in range(4))]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and very long texts, repeated rows and columns of clashing names."""
    rng = random.Random(5)
    item = prose(rng, 30)
    copy = prose(rng, 80)
    shared = "this line stands on very many sites " + prose(rng, 4)
    texts = [None, "", "x", LONG, copy, copy, copy + " end", item, f"{prose(rng, 20)} {item} {prose(rng, 9)}", *(f"{shared}\n{prose(rng, 60)}" for _ in range(12))]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, None if i % 9 == 8 else rng.choice(["en", "de"]), None if i == 3 else f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[4])
    extra = {c: F.lit(1) for c in ("ids", "decoded", "n_tokens", "perplexity", "accepted", "fp", "h", "g", "n_removed", "keeper", "node", "component_id", "row")}
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).withColumns(extra).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "two words"), (4, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(9, 80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(0, "u", None), (1, "u", ""), (2, "u", "<article><h1>A &amp; b</h1><p>One<br>two <b>three</b>.<p>Four\n five.</article><footer>&copy; x</footer>"), (3, "u", "no tags"), (4, "u", "<p <div")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    turns = [(0, 0, "user", "Hi."), (0, 1, "assistant", None), (1, None, None, "x"), (None, 3, "user", "long. " * 30_000), (None, 4, "assistant", "Yes."), (2, 0, "", "")]
    clashing = {c: F.lit(1) for c in ("c", "taken", "cost", "audit", "copy", "dropped", "pick")}
    spark.createDataFrame([*turns, turns[0]], "conv_id long, turn long, role string, text string").withColumns(clashing).write.parquet(f"{d}/conversations.parquet")
    vectors = [(0, [1.0, -0.5]), (100, None), (200, [float("nan"), 1.0]), (300, []), (7, [0.5, None]), (8, [0.5, 0.25]), (None, [2.0, 1.0]), (8, [0.5, 0.25]), (9, [float("inf"), 0.0])]
    clashing = {c: F.lit(1) for c in ("id", "v", "row", "cls", "q", "rank", "score")}
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns(clashing).write.parquet(f"{d}/embeddings.parquet")
    return d, rows


def test_every_query_survives_odd_tables(spark, tables):
    d, rows = tables
    for name, f in queries.QUERIES.items():
        n = f(spark, d).count()
        # conversations with a row, and for the vectors 0 and 300 the four others that take part
        own = {"op11_conversation_repair": 4, "op12_exact_topk": 8}
        if name not in ("op6_decontamination", "op9_html_extraction", "op10_license_scan"):
            assert n == own.get(name, len(rows)), name


def test_empty_tables(spark, tables, tmp_path):
    d, _ = tables
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_op1(spark, tables):
    d, rows = tables
    got = {r.doc_id: r for r in queries.QUERIES["op1_document_fingerprints"](spark, d).collect()}
    order = sorted({r[0]: r[1] or "" for r in rows}.items(), reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(order):
        if i in (4, 5):  # id 4 stands twice
            continue
        n = len(t) // 3
        edited = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_op1_near_duplicates(spark):
    rng = random.Random(1)
    base = prose(rng, 300)
    df = spark.createDataFrame([(1, base), (2, base + " tail"), (3, base), (4, prose(rng, 300)), (5, "")], "id long, t string")
    pairs, members = fingerprints.near_duplicates(df, "id", "t")
    assert [(r.rep_a, r.rep_b) for r in pairs.collect()] == [(1, 2)]
    assert dict((r.id, r.rep) for r in members.collect()) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_op2_equals_library(tables):
    _, rows = tables
    lib, mine = Tokenizer.from_file(WORD_BPE), bpe.Tokenizer(WORD_BPE)
    odd = ["it's I'LL", "a\x1cb \x85x", "İΣΑΣ é ﬁ ½ x²9", "<|endoftext|>ab<|startoftext|>", "日本語 😀👩‍👩‍👧", "a" * 3000, "q" * 65, "́a ́", "한글", "\n\t "]
    texts = [r[1] or "" for r in rows] + odd
    rng = random.Random(2)
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x4E00, 0x4E20)])) for _ in range(40)) for _ in range(300)]
    for t, ids in zip(texts, mine.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert mine.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_op3_equals_plain(spark, tables):
    d, rows = tables
    sites, keeper = {}, {}
    norm = lambda x: " ".join(x.split())
    for i, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if norm(line):
                sites.setdefault(norm(line), set()).add(s)
                keeper[norm(line)] = min(i, keeper.get(norm(line), i))
    spread = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert spread
    got = {r.doc_id: r.text for r in queries.QUERIES["op3_line_dedup"](spark, d).collect()}
    for i, t, *_ in rows:
        want = t if t is None else "\n".join(x for x in t.split("\n") if norm(x) not in spread or keeper[norm(x)] == i)
        assert got[i] == want


def test_op4_counts_and_gain(spark, tables):
    d, rows = tables
    got = queries.QUERIES["op4_lm_scoring"](spark, d).collect()
    c = Counter()
    for i, t, *_ in rows:
        if crc32(str(i).encode()) % 5 != 1:
            c.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        words = [*texts[r.doc_id].encode().lower().split(), b" "]
        assert r.train_tokens == n and r.n_tokens == len(words) and r.n_known == sum(c[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0


def test_op4_learns_and_does_not_depend_on_the_layout(spark):
    rng = random.Random(8)
    after = {f"w{i}": rng.sample(range(400), 3) for i in range(400)}

    def text(n):
        out = [f"w{rng.randrange(400)}"]
        for _ in range(n):
            out.append(f"w{rng.choice(after[out[-1]])}")
        return " ".join(out)

    rows = [(i, text(rng.choice((5, 40, 200, 3000 if i % 50 == 0 else 100)))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    one = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    many = {r.doc_id: r for r in language_model.score_documents(docs.orderBy(F.desc("doc_id")).repartition(5)).collect()}
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.3
    assert all(one[i].score == pytest.approx(many[i].score, rel=1e-4) and one[i].base_score == pytest.approx(many[i].base_score) for i in one)


def test_op4_splits_and_buckets_like_bytes():
    texts = [None, "", "  a\x0bB\x1cc\x85 d\xa0e  ", "É x. long-words-here é", "\n"]
    batch = pa.record_batch({"id": pa.array(range(5)), "text": pa.array(texts)})
    for size in (1, 1 << 20):
        language_model.SPLIT, before = size, language_model.SPLIT
        found = [w.as_py() for _, words, _ in language_model.split_texts(batch) for w in words]
        counts = [n for _, _, k in language_model.split_texts(batch) for n in k.tolist()]
        language_model.SPLIT = before
        want = [(t or "").encode().lower().split() for t in texts]
        assert counts == [len(w) for w in want] and [w.encode() for w in found] == [x for w in want for x in w]
    words = pa.array(["skip", *found]).slice(1)
    for w, b in zip(found, language_model.buckets_of(words).tolist(), strict=True):
        raw = w.encode()
        stop = raw[-1] < 128 and not (48 <= raw[-1] < 58 or 97 <= raw[-1] < 123)
        assert b == 4 * stop + 2 * (not raw.isascii()) + (len(raw) > 8)


def test_op4_level_keeps_the_most_frequent(spark):
    words = spark.createDataFrame([(f"w{i}", 1000 // i, 0) for i in range(1, 900)], "token string, c long, a long")
    want = words.orderBy(words.c.desc(), "token").limit(40).collect()
    level = language_model.frequent_level(words, 40)
    kept = words.where(language_model._level() >= level)
    assert 40 <= kept.count() < 60
    assert kept.orderBy(words.c.desc(), "token").limit(40).collect() == want
    assert language_model.frequent_level(words, 5000) == 0


def test_op4_symbols_travel_as_bytes(spark):
    docs = spark.createDataFrame([(1, " The cat\tsat "), (2, None), (3, "the rare"), (4, " \n ")], "id long, text string")
    counts = {r.token: (r.c, r.a) for r in language_model.count_tokens(docs).collect()}
    trained = [i for i in (1, 2, 3, 4) if not language_model.is_held_out(i)]
    assert counts[" "] == (len(trained), 4) and counts["the"] == (len({1, 3} & set(trained)), 2) and len(counts) == 5
    table = language_model.Table([("the", 2, 2, 0), ("cat", 1, 1, 0), ("sat", 1, 1, 0)], 8, 5, {0: (1, 1)})
    made = language_model.encoded_documents(docs, spark.sparkContext.broadcast(table))
    assert dict(made.dtypes)["symbols"] == "binary"
    got = {r.id: (np.frombuffer(r.symbols, language_model.SYMBOL).tolist(), r.rare) for r in made.collect()}
    the, cat, sat = table.symbol.tolist()
    assert got[1] == ([the, cat, sat, 0], []) and got[2] == got[4] == ([0], []) and got[3] == ([the, int(table.bucket_symbol[0]), 0], ["rare"])


def test_op4_gradient():
    rng = np.random.default_rng(0)
    net = language_model.Network(100, logits=np.log(rng.dirichlet(np.ones(100))))
    x, y = rng.integers(0, 100, (4, 3)), rng.integers(0, 100, (4, 3))
    start = np.zeros((4, 3), bool)
    start[0] = start[2, 1] = True
    valid, h = np.ones((4, 3), bool), np.zeros((3, language_model.HIDDEN), np.float32)

    def loss():
        hs, _ = net.states(x, start, h)
        return -net.log_probs(hs.reshape(-1, language_model.HIDDEN), y.ravel())[0].mean()

    before = net.flat.copy()
    net.learn(x, y, start, valid, h)
    grad = net.grad.copy()
    norm = np.linalg.norm(grad)
    for name in ("embed", "wx", "wh", "b", "wc", "wo"):
        net.flat[:] = before
        net.grad[:] = grad
        g = net.g[name].ravel()
        k = int(np.abs(g).argmax())
        w = net.w[name].reshape(-1)
        at, eps = float(w[k]), 1e-2
        w[k] = at + eps
        up = loss()
        w[k] = at - eps
        down = loss()
        assert (up - down) / (2 * eps) == pytest.approx(g[k], rel=0.08, abs=2e-4), (name, norm)
    for r in range(3):
        total = [net.log_probs(np.ones((1, language_model.HIDDEN), np.float32) * r, np.array([s]))[0][0] for s in range(100)]
        assert np.exp(total).sum() == pytest.approx(1, abs=1e-3)


def plain_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5_equals_brute_force(spark, tables):
    d, rows = tables
    prints = {r[0]: plain_fingerprint(r[1], 3) for r in rows}
    lab = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and lab[a] != lab[b]:
                    lab[a] = lab[b] = min(lab[a], lab[b])
                    changed = True
    for r in queries.QUERIES["op5_simhash_components"](spark, d).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == lab[r.doc_id]


def test_op5_trie_join_on_dense_groups():
    rng = random.Random(7)
    base = [rng.getrandbits(48) for _ in range(30)]
    near = {b ^ sum(1 << rng.randrange(48) for _ in range(rng.randint(0, 3))) & (2**48 - 1) for b in base for _ in range(40)}
    prints = np.array(sorted(near | {rng.getrandbits(48) for _ in range(300)}), np.uint64)
    labels = simhash.trie_links(np.zeros(len(prints), int), prints)
    lab = np.arange(len(prints))
    while True:
        new = lab.copy()
        for i in range(len(prints)):
            at = np.bitwise_count(prints ^ prints[i]) <= 3
            new[i] = lab[at].min()
        if (new == lab).all():
            break
        lab = new
    assert (labels == lab).all()


def test_op5_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61) if i in got and i) and got[101] == 100


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(-1, None, "x"), (-2, "", "x"), (-3, "  \n", "x"), (-4, "one two", "x"), (-5, "one two", "x"), (-6, "one three", "x")]
    for base in range(60):
        words = rng.choices(vocab, k=rng.choice((12, 60, 300, 2000)))
        for _ in range(rng.choice((1, 3, 8))):
            made = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                made[rng.randrange(len(made))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1009 + base * 2000, " ".join(made), "x"))
    rows += [rows[-1], (None, rows[-1][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.similar_documents(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    sets = {r[0]: set(simhash.shingle_hashes(r[1] or "", 5).tolist()) for r in rows if r[0] is not None}
    name = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    told = {r.doc_id: r.component_id for r in got}
    assert told[None] == told[rows[-2][0]]
    found = sum(told[a] == told[b] for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.97 * len(pairs)
    near = [(a, b) for a in sets for b in sets if a < b and told[a] == told[b]]
    assert sum(name[a] != name[b] for a, b in near) <= 0.02 * len(near)
    assert told[-1] == told[-2] == told[-3] == -3 and told[-4] == told[-5] == -5 and told[-6] == -6


def test_similar_documents_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.similar_documents(df, "doc_id", "text").count() == 0


def test_op6_multi_index_finds_all_within_the_radius():
    rng = random.Random(1)
    prints = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    index = decontamination.MultiIndex(prints)
    for _ in range(50):
        f = int(prints[rng.randrange(500)]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 24)))
        want = [(i, int(p ^ f).bit_count()) for i, p in enumerate(prints.tolist()) if int(p ^ f).bit_count() <= decontamination.RADIUS]
        assert index.within(f) == want


def test_op6_equals_brute_force(spark, tables):
    d, rows = tables
    items = {r.item_id: decontamination.words_of(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = set()
    for i, t, *_ in rows:
        w = decontamination.words_of(t) if t != LONG else []
        for k, x in items.items():
            target = Counter(decontamination.shingles(x))
            for s in range(max(1, len(w) - len(x) + 1)) if x and w else ():
                if decontamination.weighted_similarity(Counter(decontamination.shingles(w[s : s + len(x)])), target) >= 0.8:
                    want.add((i, k))
    got = queries.QUERIES["op6_decontamination"](spark, d)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    small = decontamination.find_leaks(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{d}/benchmark.parquet"), 64)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want


def test_op7_cache_is_used(spark, tables, tmp_path):
    d, rows = tables
    cache = str(tmp_path / "cache")
    lib = Tokenizer.from_file(BYTE_BPE)
    for _ in range(2):
        got = queries.op7_token_counts(spark, d, cache=cache).collect()
        for r in got:
            t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 512)
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})


def test_op7_sentencepiece():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.counter(path)(["a b c", ""]) == [len(lib.encode("a b c")), 0]


def test_op8_is_a_distribution(spark):
    docs = spark.createDataFrame([("a b a b c",), ("a c b",), ("b b a",), (None,)], "text string")
    terms = quality.Terms(*quality.model_terms(docs))
    shards = [x.value for x in terms.shards]
    one = lambda kind, *w: quality._join(quality.ngram_key(kind, *(np.array([quality._hash(x)]) for x in w)), terms.shards, np.nan)[0]
    assert sum(len(k) for k, _ in shards) > 5
    for a, m in (("a", "b"), ("b", "a"), (quality.START, "a"), ("x", "y")):
        total = 0.0
        for c in ("a", "b", "c", quality.END, "unseen"):
            parts = [one("context1", m), one("pair", m, c), one("context2", a, m), one("triple", a, m, c)]
            word = one("word", c)
            total += np.exp((terms.unknown if np.isnan(word) else word) + np.nansum(parts))
        assert total == pytest.approx(1, abs=1e-5)


def test_op8_without_labels_accepts_all(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    assert quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet").where("false")).where("accepted").count() == len(rows)


def test_op9(spark, tables):
    d, _ = tables
    got = {r.page_id: r.text for r in queries.QUERIES["op9_html_extraction"](spark, d).collect()}
    assert got[0] == "" and got[1] == "" and got[2] == "A & b\nOne two three.\nFour five."
    field = html_extraction.trained()
    pages = html_extraction.labelled_pages(150, 1234)
    right = sum(x == y for blocks, labels in pages for x, y in zip(field.decode(blocks), labels, strict=True))
    assert right / sum(len(labels) for _, labels in pages) > 0.98


def test_op10(spark):
    rows = [(1, "Hello.\nLicensed under the Apache License, Version 2.0."), (2, "Licensed under the Apache License, Version 3.0."), (3, "released under  the MIT licence terms"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: (r.license, r.n_missing) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Apache-2.0", 0), 6: ("GPL-3.0", 0)}
    assert license_scan.rank("Released under the MIT License.")[0][1] == "MIT"


def test_pipeline_stages(spark, tables, tmp_path):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*corpus_pipeline.DOCUMENT_COLUMNS)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == list(corpus_pipeline.DOCUMENT_COLUMNS), name
        made.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    kept = {r.doc_id for r in docs.collect()}
    assert kept and not kept & {7, 8} and not {4, 5} <= kept


@pytest.mark.parametrize("n", [30, 200, 1000])
def test_similar_documents_finds_all_variants_of_a_base(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocab, k=300)
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):  # about 0.82 to the base, about 0.67 to each other
        made = list(base)
        for at in rng.sample(range(4, 296, 6), 6):
            made[at] = f"v{i}x{at}"
        rows.append((i, " ".join(made)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    alike = [i for i in range(1, n + 1) if len(sets[0] & sets[i]) >= 0.8 * len(sets[0] | sets[i])]
    assert len(alike) == n and sum(len(sets[1] & x) >= 0.8 * len(sets[1] | x) for x in sets[2:]) < n / 20
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sum(r.component_id != 0 for r in got) <= 0.001 * n


def test_similar_documents_verifies_links_of_few_bits(spark):
    rng = random.Random(3)
    sets = [np.sort(rng.sample(range(10**9), 40)) for _ in range(700)]
    sets += [np.r_[s[:39], 10**9 + i] for i, s in enumerate(sets[:300])]
    rows = [(i, 0, s.tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, part long, shingles array<long>")
    forest = spark.createDataFrame([(0, i) for i in range(1, 1000)], "a long, b long")
    got = {(r.node, r.component) for r in simhash.similar_parts(df, forest).collect() if r.node != r.component}
    assert got == {(700 + i, i) for i in range(300)}


def licenses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(license_scan.scan(df).collect(), key=lambda r: (r.doc_id, r.start_line)):
        out[r.doc_id].append((r.license, r.start_line, r.n_lines))
    return list(out.values())


def test_op10_wrapped_notices(spark):
    rng = random.Random(4)
    texts, want = [], []
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for width in (20, 70, 78, 80):
                for prefix in ("", "# ", " * ", "// "):
                    lines = textwrap.wrap(t, width, break_long_words=False)
                    texts.append("\n".join([prose(rng, 12), "", *(prefix + x for x in lines), "", prose(rng, 12)]))
                    want.append([(name, 2, len(lines))])
    assert licenses(spark, texts) == want


def test_op10_notice_in_a_long_line(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, n)} Released under the MIT License. {prose(rng, n)}" for n in (15, 60, 300, 3000)]
    texts.append(f"{prose(rng, 400)} it was is {prose(rng, 400)}\nReleased under the MIT License.")
    assert [[x[0] for x in found] for found in licenses(spark, texts)] == [["MIT"]] * 5


def test_op10_adjacent_notices(spark):
    short = [(name, t) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    texts = ["Released under the MIT License.\nLicensed under CC BY 4.0.", "\n".join(t for _, t in short), " ".join(t for _, t in short * 3)]
    got = licenses(spark, texts)
    assert got[0] == [("MIT", 0, 1), ("CC-BY-4.0", 1, 1)]
    assert [(n, i) for n, i, _ in got[1]] == [(n, i) for i, (n, _) in enumerate(short)]
    assert Counter(n for n, _, _ in got[2]) == Counter(n for n, _ in short * 3)


def test_op8_thresholds_from_all_trusted(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(5, 60)), "rare" if i % 20 == 0 else rng.choice(["en", "de"])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, trusted=80).collect()
    order = labels.select("doc_id", F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)).alias("p")).orderBy("h").limit(80)
    trained = {r.doc_id for r in order.collect() if r.p != 0}
    for lang in ("en", "de", "rare"):
        values = [r.perplexity for r in got if r.lang == lang and r.doc_id < 1000 and r.doc_id not in trained]
        said = {r.threshold for r in got if r.lang == lang}
        assert len(said) == 1 and said.pop() == pytest.approx(float(np.quantile(values, quality.QUANTILE)))
