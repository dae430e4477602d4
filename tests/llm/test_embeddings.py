"""Recall of the embedding links where they are rare, the audit's report, and odd vectors."""

import numpy as np

from pixelgrove.llm import nn_descent


def test_rare_links(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((12_000, 64))
    for k in range(34):
        a = m[k] / np.linalg.norm(m[k])
        n = rng.standard_normal(64)
        n -= n @ a * a
        c = 0.931 + 0.01 * rng.random()
        m[6000 + k] = c * a + np.sqrt(1 - c * c) * n / np.linalg.norm(n)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    true = int((unit @ unit.T >= 0.93).sum() - len(m)) // 2
    vectors = spark.createDataFrame([(i, "a", x.tolist()) for i, x in enumerate(m)], "vec_id long, label string, embedding array<double>").repartition(4)
    report = []
    found = nn_descent.near_embeddings(vectors, report=report).selectExpr("sum(n_links)").first()[0] // 2
    assert true >= 30 and found >= 0.95 * true
    assert report[-1]["parts"][0]["share"] >= 0.995 and report[-1]["parts"][0]["sampled"] == len(m)


def test_every_label_is_judged(spark):
    """A dense label does not end the audit of others, whose rare links lie in vectors with a common mean or in isotropic ones."""
    rng = np.random.default_rng(11)
    dense = np.repeat(rng.standard_normal((100, 64)), 20, 0) + 0.05 * rng.standard_normal((2000, 64))

    def with_pairs(m):
        for k in range(20):
            m[2500 + k] = m[k] + 0.02 * rng.standard_normal(64) * np.linalg.norm(m[k]) / 8
        return m

    parts = {"dense": dense, "mean": with_pairs(0.8 * rng.standard_normal((5000, 64)) + 1.0 * rng.standard_normal(64)), "plain": with_pairs(rng.standard_normal((5000, 64)))}
    rows, true = [], 0
    for label, m in parts.items():
        unit = m / np.linalg.norm(m, axis=1)[:, None]
        true += int((unit @ unit.T >= 0.93).sum() - len(m))
        rows += [(len(rows) + i, label, x.tolist()) for i, x in enumerate(m)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(4)
    report = []
    got = nn_descent.near_embeddings(vectors, report=report, sample=200, most_sample=1500).selectExpr("sum(n_links)").first()[0]
    assert got == true > 2000 * 19
    assert len(report[0]["parts"]) == 3 and {x["judged"] for x in report[0]["parts"]} == {True, False}


def test_directions_follow_the_size(spark):
    reps = spark.createDataFrame([(1, 1, b"\0" * 16)], "id long, part long, f binary")
    graph = nn_descent.Graph(reps, 0.93, 8, 32, 0.99)
    assert graph.directions(10) == 1
    few, more, many = (graph.directions(n) for n in (10**4, 10**6, 10**9))
    assert 4 <= few < more < many < 100


def test_null_and_repeated_ids(spark):
    rows = [
        (1, "a", [1.0, 0.0]),
        (1, "a", [0.0, 1.0]),  # one id with two vectors: the smaller struct counts
        (2, "a", [0.0, 2.0]),
        (3, "a", [3.0, 0.0]),
        (None, "a", [1.0, 0.0]),
        (4, None, [1.0, 0.0]),
        (5, "a", None),
        (6, "a", []),
        (7, "a", [float("nan"), 1.0]),
        (8, "a", [None, 1.0]),
        (9, "a", [0.0, 0.0]),
        (10, "b", [1.0, 0.0]),
        (11, "a", [1.0, 0.0, 0.0]),
        (12, "a", [float("inf"), 1.0]),
    ]
    made = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    results = [sorted(map(tuple, nn_descent.near_embeddings(made.repartition(n)).collect()), key=str) for n in (1, 6)]
    assert results[0] == results[1] and len(results[0]) == len(rows)
    linked = {r[0]: r[1:] for r in results[0]}
    assert linked[1] == linked[2][:1] + (1, True) or linked[1][0] == 1
    assert all(linked[i][0] == 0 for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert linked[None] == (0, None, True)
