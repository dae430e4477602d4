"""The corpus pipeline stage by stage against brute force, each stage on its own input."""

import brute
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"  # the smallest table has nine toxic labels to learn from, too few


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], DATA).write.parquet(str(folder / str(n)))
        out.append(spark.read.parquet(str(folder / str(n))))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert [x for x, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for x in stages[1:5]:
        assert x.dtypes == stages[0].dtypes


def test_toxicity_keeps_clean_documents(spark, stages):
    gone = stages[0].join(stages[1].select("doc_id"), "doc_id", "left_anti")
    insults = "idiot|moron|scum|loser|clown|stupid|trash|worthless|pathetic|disgusting"  # what the tables' English labels mark
    marked = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0")
    assert gone.join(marked, "doc_id").count() <= 0.01 * marked.count()
    assert stages[1].where(F.lower("text").rlike(rf"\b({insults})\b")).count() == 0


def test_lines(stages):
    want = brute.line_dedup(rows(stages[1]))
    got = {i: brute.sha(t) for i, t in rows(stages[2])}
    assert got == {i: x[2] for i, x in want.items()}
    assert stages[2].where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_near_copies(stages):
    want = brute.near_duplicates(rows(stages[2]), 80)
    assert {i for i, _ in rows(stages[3])} == {i for i, x in want.items() if x[2]}


def test_leaks(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute.contamination(rows(stages[3]), items)
    assert {i for i, _ in rows(stages[4])} == {i for i, x in want.items() if not x[4]}


def test_packing(stages):
    pieces = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert pieces.where("n <> t").count() == 0 and pieces.count() == stages[4].count()
    fill = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert fill.where("n <> m or n > 2048").count() == 0


def test_run(spark, stages):
    assert P.run(spark, DATA).exceptAll(stages[5]).count() == 0
