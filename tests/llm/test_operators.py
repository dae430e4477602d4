"""Small fixtures against plain Python: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelgrove.llm import common, html_mincut, langid, license_join, line_dedup, minhash, nn_descent, packing, substring_index, toxicity, wu_manber

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_words int, rep int, kept int, score string, n int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = " ".join(words(rng, 70, 10**6))
    line = "A line, that many documents hold: with some more words in it"
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, "a b c d e"), (6, "\x1cÉcole K İ naïve \x00 ok")]
    base = words(rng, 300, 10**6)
    for i in range(7, 25):  # near copies, some on either side of the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    out += [(i, " ".join(base)) for i in range(25, 30)]
    for i in range(30, 60):
        own = " ".join(words(rng, rng.randrange(0, 200)))
        out.append((i, "\n".join([own, line if i % 2 else line.upper() + "  ", passage if i % 5 == 0 else own[:30], "MIT  License, and Apache-License"[: i % 40]])))
    out.append((60, " ".join(words(rng, 30_000)) + " " + passage))
    out.append((61, "x" * 200_000))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None, 1, "n", 7, 8, 9, "s", 1) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


# ---------------------------------------------------------------- 1


def test_minhash(docs, rows, empty):
    for share in (80, 85):
        got = minhash.near_duplicates(docs, share=share)
        assert found(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(rows, share)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, x in brute.near_duplicates(rows, 80).items() if x[2]}


def test_minhash_repeats_and_null_ids(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_large_groups_in_blocks(spark, monkeypatch):
    """Groups larger than a block lose no link and stay whole."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 150, 10**6)
    data = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        data.append((i, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), share=85)
    assert found(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(data)


def test_bit_estimate():
    signer = minhash.Signer(25, 5, 2)
    rng = np.random.default_rng(1)
    same, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = (signer.packed(signer.minima(np.concatenate([same, z]))[None]) for z in (a, b))
    assert abs(float(signer.similarity(x[0], y[0])) - 0.8) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(900, x) for x in range(500, 560)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = brute.components({x for e in links for x in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    assert got == want


# ---------------------------------------------------------------- 2

PAGE = """<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><header class=top><p>Site name</p></header><nav><a href=/>Home</a> <a href=/b>News</a></nav>
<div id="cookie-notice">We use cookies. Please accept.</div><div class="sidebar"><p>Read also: ten more stories from our editors.</p></div>
<main><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> and&nbsp;a <a href=x>link</a>. It goes on for a while.<p>Second paragraph follows; it is not closed.
<ul><li>Point one of the list.</li><li>Point two.</li></ul><form><label>Name</label><input></form></main>
<section class="comments"><p>Great article, thanks! I have read it all.</p></section><!-- <p>gone</p> --><footer>&copy; all rights reserved</footer></body>"""


def test_html(spark):
    want = "Title & more First paragraph, with bold and a link. It goes on for a while. Second paragraph follows; it is not closed. Point one of the list. Point two."
    data = [(1, "u", PAGE, "z"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<nav>only <a>menu</a></nav>", ""), (1, "u", PAGE, "z")]
    got = html_mincut.extract(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, want), (1, want), (2, ""), (3, ""), (4, "")]
    for cut in range(0, len(PAGE), 7):  # markup cut off anywhere
        html_mincut.main_text(PAGE[:cut])
    assert len(html_mincut.main_text("<article>" + "<p>Some words here, a sentence.</p>" * 20000)) > 500_000


def test_minimum_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randrange(1, 8)
        e = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda s: sum(max(x, 0) if not a else max(-x, 0) for a, x in zip(s, e)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(2**n))
        assert abs(cost(html_mincut.minimum_cut(e, edges)) - best) < 1e-9


# ---------------------------------------------------------------- 3


def test_licenses(docs, rows, empty, spark):
    got = license_join.scan(docs)
    assert found(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.licenses(rows)
    assert license_join.scan(empty).count() == 0
    text = "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and some documentation files"
    row = license_join.scan(spark.createDataFrame([(1, text), (2, "mit licenses"), (3, "cc\x7fBY cc by K by")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in row] == ["mit", "", "cc-by"]
    assert 0.8 <= row[0].score < 1 and row[2].n_base == 2 and row[2].score == 1


def test_license_join_is_exact(docs, rows):
    """The filters lose no (line, template) pair that reaches the share."""
    import re

    want = set()
    for i, text in rows:
        for line in (text or "").split("\n"):
            have = set(brute.PLAIN.findall(line.translate(brute.LOWER)))
            for t, label in license_join.TEMPLATES.items():
                own = set(re.findall(r"\S+", t))
                if 100 * len(own & have) >= 60 * len(own):
                    want.add((i, label))
    got = license_join.template_matches(docs, id_col="doc_id", text_col="text", share=60).collect()
    assert {(r.doc_id, r.label) for r in got} == want


# ---------------------------------------------------------------- 4


def test_contamination(spark, docs, rows, empty):
    texts = dict(rows)
    w = brute.PLAIN.findall(texts[7].lower())
    items = [(1, " ".join(w[20:45])), (2, " ".join(w[40:52]).upper()), (3, "one-two"), (10, "one, TWO"), (4, None), (5, "..."), (6, texts[35]), (None, "a b c"), (1, "b c"), (1, " ".join(w[20:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, [x for x in items if x[0] is not None])
    for limit in (500_000, 20):  # one pass, and several
        got = wu_manber.contamination(docs, bench, patterns_per_pass=limit)
        got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), wu_manber.items_digest().alias("sha"), (F.col("n_hit") > 0).alias("c"))
        assert found(got, *got.columns) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert wu_manber.contamination(docs, none).where("n_hit > 0").count() == 0
    assert wu_manber.contamination(empty, bench).count() == 0
    clean = wu_manber.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r[0] for r in clean.select("doc_id").collect()} == {i for i, x in want.items() if not x[4]}


# ---------------------------------------------------------------- 5


def test_toxicity(spark, empty):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        sentences = [" ".join(words(rng, 8, 60)) + "." for _ in range(6)]
        if toxic:
            sentences[rng.randrange(6)] = " ".join([*words(rng, 4, 60), rng.choice(["vileness", "vilest", "grr"]), *words(rng, 3, 60)]) + "!"
        data.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    frame, truth = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, truth, rows=F.col("doc_id") % 3 != 2)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert sum((got[i].score >= 0.3) == bool(t) for i, t in labels) >= 590
    texts = dict(data)
    for i, t in labels:  # the offending sentence is the one with the word
        if t and got[i].sentences:
            x = max(got[i].sentences, key=lambda s: s.score)
            assert any(w in texts[i].encode()[x.start : x.end].decode() for w in ("vile", "grr"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "vilest"), (4, "x " * 50_000)], "doc_id long, text string")
    odd_scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert odd_scores[1] == odd_scores[2] == 0 and odd_scores[None] > 0.3
    assert toxicity.score(empty, model).count() == 0
    clean = toxicity.keep_clean(frame, model)
    assert clean.columns == frame.columns and clean.count() == sum(r.score < 0.3 for r in got.values())
    untaught = toxicity.train(empty, truth.where("false"))
    assert toxicity.score(frame, untaught).where("score >= 0.3").count() == 0


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("bits", [20, 10])  # 10: the filters are full of false suspects
def test_lines(docs, rows, empty, bits):
    got = line_dedup.dedup_lines(docs, log_bits=max(bits, 16) if bits > 10 else 16)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    assert found(got, *got.columns) == brute.line_dedup(rows)
    assert line_dedup.dedup_lines(empty, log_bits=16).count() == 0


def test_lines_repeated_rows(spark):
    line = "l" * 50
    data = [(1, line)] * 6 + [(None, line), (2, line)]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), log_bits=16).collect()
    assert all(r.n_dropped == 0 for r in got) and len(got) == 8


# ---------------------------------------------------------------- 7


def test_language(spark, empty):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["tion", "eau", "ille"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    data = [(i, text(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    frame = spark.createDataFrame([*data, (900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (903, text("aa", 20_000), None)], "doc_id long, text string, lang string")
    learned = langid.train(frame, rows=F.col("id") % 5 != 0)
    assert sorted(learned) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.classify(frame, learned).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in data) >= 178
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.classify(empty, learned).count() == 0
    assert {r.lang_pred for r in langid.classify(frame, {}).collect()} == {"und"}


# ---------------------------------------------------------------- 8


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        rows.append((i, rng.standard_normal(16).tolist(), i % 3))
    for g in range(8):
        centre = rng.standard_normal(16)
        for k in range(12):
            rows.append((300 + g * 12 + k, (centre + rng.standard_normal(16) * (0.03 * k)).tolist(), g % 3))
    same = rng.standard_normal(16).tolist()
    rows += [(500 + k, same, 1) for k in range(40)] + [(600, [0.0] * 16, 1), (601, None, 1), (602, same, None), (603, [float("nan")] * 16, 1), (604, same[:8], 1), (605, [*same[:15], None], 1), (606, [], 1), (607, [2 * x for x in same], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = found(nn_descent.near_embeddings(frame), "vec_id", "n_links", "component_id", "kept")
    assert got == brute.embeddings(rows)
    assert nn_descent.near_embeddings(frame.where("false")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    for name in ("START_BLOCK", "EXACT_BLOCK", "NODE_BLOCK"):
        monkeypatch.setattr(nn_descent, name, 16)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * 0.22).tolist(), 1) for i in range(200)] + [(i, rng.standard_normal(32).tolist(), 1) for i in range(200, 300)]
    got = found(nn_descent.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links", "component_id", "kept")
    want = brute.embeddings(rows)
    assert sum(min(got[i][0], x[0]) for i, x in want.items()) >= 0.99 * sum(x[0] for x in want.values())
    assert all(got[i][0] <= x[0] for i, x in want.items())


def test_embedding_pairs_far_apart_in_the_blocks(spark, monkeypatch):
    """Isolated pairs in a label that is large against a block: fresh directions, or all rows, find them."""
    monkeypatch.setattr(nn_descent, "START_BLOCK", 4)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((500, 64))
    twin = base + rng.standard_normal((500, 64)) * 0.36
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, twin]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.embeddings(rows)
    assert sum(x[0] for x in want.values()) > 500
    got = found(nn_descent.near_embeddings(frame, directions=1), "vec_id", "n_links", "component_id", "kept")
    assert sum(got[i][0] for i in want) >= 0.99 * sum(x[0] for x in want.values())
    got = found(nn_descent.near_embeddings(frame, directions=1, rounds=0, extra_rounds=0), "vec_id", "n_links", "component_id", "kept")
    assert got == want


def test_embedding_links_between_dense_groups(spark):
    """Two groups whose members' lists are full of their own group: links across hold them together."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = q[0], 0.951 * q[0] + np.sqrt(1 - 0.951**2) * q[1]
    rows = [(i, (centres[i % 2] + rng.standard_normal(64) * 0.1 / 8).tolist(), 1) for i in range(100)]
    got = found(nn_descent.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id", "n_links", "component_id", "kept")
    assert got == brute.embeddings(rows)
    assert {x[1] for x in got.values()} == {0}
    assert min(x[0] for x in got.values()) > 49  # more than the own group's


# ---------------------------------------------------------------- 9


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    extra = [(70, "<|endoftext|> <|ENDOFTEXT|> Don't H̱A İs é É  x\x1cy, ... a.b, 12,5. Ünï"), (71, "a," * 5000)]
    every = [*rows, *extra]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in every}
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in packing.pack(frame, TOKENIZER).collect():
        ids = np.array(want[r.doc_id], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for i, own in pieces.items():
        assert [a for a, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]]))[:-1] and sum(n for _, n in own) == len(want[i])
    assert pieces.keys() == want.keys()
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]]))[:-1] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= total / 2048 * 1.02 + 2
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_cuts_and_pool_bound():
    for capacity in (16, 2048):
        cuts = packing._cuts(capacity)
        assert all(sum(c) == r for r, c in enumerate(cuts))
        sizes = {x for c in cuts for x in c}
        assert all(capacity // (capacity // x) == x for x in sizes)
        assert sum(capacity // x - 1 for x in sizes) < 5 * capacity


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substrings(docs, rows, empty, batches):
    got = substring_index.dedup_substrings(docs, batches=batches)
    assert set(got.columns) == {*docs.columns, "n_removed"}
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    assert found(got, *got.columns) == brute.substrings(rows)
    assert substring_index.dedup_substrings(empty, batches=batches).count() == 0
