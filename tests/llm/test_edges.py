"""Odd tables for all ten operators and the pipeline's stages, and the registered queries against their SQL twins."""

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelgrove.llm import html_mincut, langid, license_join, line_dedup, minhash, nn_descent, packing, queries, substring_index, toxicity, wu_manber

SF = "/root/testdata/sf0.001"
NAMES = "_gone _drop _doc _p _r _n _b _o spans items text_key key rep sig g i j m c h l n part block sentences score kept component_id own first last N_LINES n_Dropped N_words n_Removed sequence_id".split()
MODEL = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -6.0)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated ids, one with an empty text, and columns named like the operators' own."""
    long = " ".join(f"word{i}" for i in range(80))
    line = "\nthis is a line of more than forty code points in all"
    rows = [(None, long), (1, long), (1, long), (1, ""), (2, long + line), (3, None), (3, long), (4, ""), (5, "İ. x"), (6, " \n\t"), (7, "MIT License" + line), *[(10 + i, f"own{i}" + line) for i in range(5)]]
    schema = "doc_id long, text string, lang string, html string, " + ", ".join(f"`{x}` int" for x in NAMES)
    return spark.createDataFrame([(i, t, "en", t, *([1] * len(NAMES))) for i, t in rows], schema)


def benchmark(spark):
    return spark.createDataFrame([(1, "word1 word2 word3"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "drop_near": lambda s, d: minhash.drop_near_duplicates(d),
    "html": lambda s, d: html_mincut.extract(d.drop("text")),
    "license": lambda s, d: license_join.scan(d),
    "license windows": lambda s, d: license_join.scan_windows(d),
    "contamination": lambda s, d: wu_manber.contamination(d, benchmark(s)),
    "decontaminate": lambda s, d: wu_manber.decontaminate(d, benchmark(s)),
    "toxicity": lambda s, d: toxicity.score(d, MODEL),
    "keep_clean": lambda s, d: toxicity.keep_clean(d, MODEL),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "lines alone": lambda s, d: line_dedup.dedup_lines(d, counts=False),
    "language": lambda s, d: langid.classify(d, langid.train(d)),
    "packing": lambda s, d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "substrings": lambda s, d: substring_index.dedup_substrings(d),
    "embeddings": lambda s, d: nn_descent.near_embeddings(d.select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("embedding"), *NAMES)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, tmp_path, name):
    out = OPERATORS[name](spark, odd)
    out.write.parquet(str(tmp_path / "out"))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == odd.count() if name not in ("drop_near", "decontaminate", "packing") else n > 0
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, tmp_path, name, stage):
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, SF)
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
        back = spark.read.parquet(str(tmp_path / "out"))
        if name != "packing":
            assert back.columns == docs.columns
            assert back.where("doc_id is null").count() == docs.where("doc_id is null").count()
        assert (back.count() > 0) == (docs is odd)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLES[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_empty_text_in_a_group_of_near_copies(spark):
    long = " ".join(f"word{i}" for i in range(100))
    rows = [(1, long), (1, ""), (2, long + " more"), (2, None), (3, ""), (4, long + " x y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(1, 1), (2, 1), (4, 1)}


def test_positional_filter_drops_what_the_prefix_filter_admits(spark):
    """A block that holds a template's rare tokens but not enough after them is no candidate, and the labels stay right."""
    template = list(license_join.TEMPLATES)[4]
    rows = [(1, template), (2, template.rsplit(" ", 1)[0]), (3, "mit"), (4, "the the under released"), (5, "nothing")]
    got = {r.doc_id: r.labels for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "", 5: ""}


def test_wrapped_notices(spark):
    """Stretches of the whole text find what no single line holds, and nothing that is spread over more words than that."""
    words = list(license_join.TEMPLATES)[5].split()
    wrapped = "intro\n" + "\n".join(" ".join(words[k : k + 4]).upper() + "," for k in range(0, len(words), 4)) + "\nend"
    spread = " filler filler ".join(words)
    rows = [(1, wrapped), (2, spread), (3, ("x " * 30_000) + wrapped), (4, " ".join(words[:12])), (5, " ".join(words[:-2])), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_join.scan_windows(docs).collect()} == {1: "mit", 2: "", 3: "mit", 4: "", 5: "mit", 6: ""}
    # the scan takes lines and stretches: the second text is one line that holds all words
    assert {r.doc_id: r.labels for r in license_join.scan(docs).collect()} == {1: "mit", 2: "mit", 3: "mit", 4: "", 5: "mit", 6: ""}
    assert {r.doc_id: r.score for r in license_join.scan(docs).collect()}[3] == 1.0


def test_branching_pattern_takes_the_same_words():
    import re

    words = ["a", "and", "any", "an", "license", "licensed", "4", "mit"]
    whole = re.compile(license_join._any_of(words))
    assert all(whole.fullmatch(w) for w in words)
    assert not any(whole.fullmatch(w) for w in ("", "al", "andy", "license4", "licenses", "mi", "44"))


def test_windows_against_brute_force(spark):
    """Every stretch of 125 % of a template's words, counted one by one."""
    rng = np.random.default_rng(3)
    vocabulary = sorted({w for t in license_join.TEMPLATES for w in t.split()})
    rows = []
    for i in range(60):
        t = list(license_join.TEMPLATES)[i % len(license_join.TEMPLATES)].split()
        own = [w for w in t if rng.random() < 0.9]
        at = rng.integers(0, 40)
        text = list(rng.choice(vocabulary, 40))
        rows.append((i, " ".join(text[:at] + own + text[at:])))
    want = {}
    for i, text in rows:
        w = text.split()
        labels, best = set(), 0.0
        for t, label in license_join.TEMPLATES.items():
            own, size = set(t.split()), -(-125 * len(t.split()) // 100)
            n = max(len(own & set(w[k : k + size])) for k in range(len(w)))
            if 100 * n >= 80 * len(own):
                labels.add(label)
                best = max(best, n / len(own))
        want[i] = (",".join(sorted(labels)), best)
    got = license_join.scan_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.containment) for r in got} == want and any(x for x, _ in want.values())


def test_patterns_per_pass_bounds_words_and_long_items(spark, monkeypatch):
    sizes = []
    made = wu_manber.patterns_of
    monkeypatch.setattr(wu_manber, "patterns_of", lambda items, window: (lambda out: (sizes.append(sum(map(len, out.values()))), out)[1])(made(items, window)))
    text = ",".join(str(i) for i in range(3000))
    docs = spark.createDataFrame([(1, "x " + text.replace(",", " ")), (2, "1 2 3 4 5 6 7 8 9 10"), (3, "1 2 3"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, "x 0 1"), (9, ",,,")], "item_id long, text string")
    one = wu_manber.contamination(docs, items, patterns_per_pass=10**6).orderBy("doc_id").collect()
    assert sizes == [2992]
    sizes.clear()
    many = wu_manber.contamination(docs, items, patterns_per_pass=500).orderBy("doc_id").collect()
    assert len(sizes) == 6 and max(sizes) <= 500
    key = lambda rows: [(r.doc_id, r.n_words, r.n_hit, list(r.spans), sorted(r["items"])) for r in rows]
    assert key(one) == key(many)
    assert key(one)[0][1:] == (3001, 3001, [0, 3001], [7, 8])


def test_toxicity_does_not_depend_on_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (2, 7))
    assert (a.code == b.code).all() and (a.weight == b.weight).all() and a.bias == b.bias


def test_too_many_languages_is_an_error(spark):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(langid.train(docs, max_languages=5)) == 5
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=4)


def test_code_points_above_ffff(spark):
    """Emoji before, between and behind phrases, in lines and passages: word positions and windows count code points as one."""
    face, many = "\U0001f600", "\U0001f600 " * 5
    texts = [
        f"{many}mit license here", f"{face * 5} {many}the mit license, {face} and cc by {face}{face}", f"apache{face}license", f"mit license {many}gnu general public license",
        f"{face}mit license", f"mit license{face}", f"x {face} cc-by", many, f"a{face}b c d e f g",
    ]
    line = f"{face} a line of more than forty code points {face * 3} in all"
    passage = " ".join(f"w{i}{face}" for i in range(60))
    texts += [f"own {i} {face}\n{line}\n{passage} {i}" for i in range(6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_join.scan(docs).collect()}
    assert got == brute.licenses(rows)
    items = [(1, f"{face} a line of"), (2, f"cc by {face}{face}")]
    found = wu_manber.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in found.collect()} == {i: x[:3] for i, x in brute.contamination(rows, items).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, share=85).collect()} == brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in line_dedup.dedup_lines(docs).collect()} == brute.line_dedup(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substring_index.dedup_substrings(docs).collect()} == brute.substrings(rows)


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ ① 42 _"), (3, "२"), (4, "the word ½"), (5, "中"), (6, "ª"), (7, "!?")]
    got = langid.classify(spark.createDataFrame(rows, "doc_id long, text string"), {"en": b"the word and some more", "fr": b"le mot et encore"})
    assert {r.doc_id for r in got.collect() if r.lang_pred == "und"} == {1, 2, 3, 7}
