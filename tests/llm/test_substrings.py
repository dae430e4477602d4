"""The fingerprint index: calls with new texts alone, compaction, reopening, plans and odd rows, against plain Python."""

import io
import random
from contextlib import redirect_stdout

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.llm import substring_index
from pixelgrove.llm.common import SPACED, Words


def words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed, n):
    """Documents that share passages of lengths around the window, whole copies, periodic texts and hot passages."""
    rng = random.Random(seed)
    passages = [words(rng, k) for k in (49, 50, 51, 60, 84, 120, 200)]
    hot = words(rng, 70)
    made = []
    for i in range(n):
        out = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 48))
            out += p[a : a + rng.randrange(45, 90)] + words(rng, rng.randrange(40))
        if i % 3 == 0:
            out += hot + words(rng, rng.randrange(60))
        if i % 11 == 0:
            out += ["la", "li"] * rng.randrange(20, 60)
        made.append((i, " ".join(out)))
        if i % 13 == 0:
            made[-1] = (i, made[rng.randrange(len(made))][1])
    return made


def result(df):
    got = df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).collect()
    return {r[0]: tuple(r[1:]) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    rows = corpus(seed, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(substring_index.dedup_substrings(frame, batches=1 + seed)) == brute.substrings(rows)


def test_later_calls_get_new_texts_alone(spark, tmp_path):
    rows = corpus(7, 160)
    want = brute.substrings(rows)
    folder = str(tmp_path / "index")
    index = substring_index.FingerprintIndex(spark, folder, max_runs=1)
    got = {}
    for k, (low, high) in enumerate(((0, 50), (50, 90), (90, 130), (130, 160))):
        frame = spark.createDataFrame(rows[low:high], "doc_id long, text string")
        if k == 2:  # another session
            index = substring_index.FingerprintIndex(spark, folder, max_runs=1)
        got |= result(substring_index.dedup_substrings(frame, batches=1, index=index))
        assert len(index.runs) <= 1
    assert got == want


def test_an_identical_text_in_a_second_call(spark, tmp_path):
    text = " ".join(words(random.Random(3), 120))
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"))
    one = substring_index.dedup_substrings(spark.createDataFrame([(1, text)], "doc_id long, text string"), index=index, batches=1)
    two = substring_index.dedup_substrings(spark.createDataFrame([(2, text)], "doc_id long, text string"), index=index, batches=1)
    assert one.first().n_removed == 0 and two.first().n_removed == 120


def test_history_is_not_shuffled(spark, tmp_path):
    """The join of the runs is a merge join of bucketed scans, and so is their compaction."""
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), max_runs=9)
    for part in (corpus(1, 40), corpus(2, 40)):
        substring_index.dedup_substrings(spark.createDataFrame(part, "doc_id long, text string"), batches=1, index=index)
    a, b = (spark.table(x) for x in index.runs)
    out = io.StringIO()
    with redirect_stdout(out):
        a.join(b.groupBy("fp", "r").count(), ["fp", "r"], "left").hint("merge").explain()
        index.read().groupBy("fp", "r").agg(F.min("doc_id")).explain()
    assert "Exchange" not in out.getvalue().replace("BroadcastExchange", "")


def test_nulls_repeats_and_names(spark):
    text = " ".join(words(random.Random(5), 80))
    rows = [(None, text, 1, 2), (3, text, 1, 2), (3, text, 1, 2), (4, text, 1, 2), (5, None, 1, 2), (6, "", 1, 2), (7, "short", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int, N_words int")
    out = substring_index.dedup_substrings(frame)
    got = sorted(((r.doc_id, r.n_removed, r.spans) for r in out.collect()), key=str)
    assert got == sorted([(None, 0, 1), (3, 0, 1), (3, 0, 1), (4, 80, 1), (5, 0, 1), (6, 0, 1), (7, 0, None)], key=str)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**9, 50))
    chosen = set()
    for _ in range(20):
        before, after = (" ".join(f"q{x}" for x in rng.integers(0, 10**9, rng.integers(0, 90))) for _ in range(2))
        text = f"{before} {passage} {after}".encode()
        w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), SPACED)
        least, inside = substring_index.anchors(w, 50)
        at = len(before.split())
        assert inside[at]
        chosen.add(int(least[at]))
    assert len(chosen) == 1
