"""Ridge choice, threshold sweeps, batch ranks, typed values and the stream's sink against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.functions import variants
from pixelgrove.operators import batchwise, results, threshold
from pixelgrove.plans import evaluate
from pixelgrove.sources import tables
from pixelgrove.streaming import contingency as stream


@pytest.mark.parametrize("curve", [False, True])
def test_ridge_choice(spark, curve):
    rng = np.random.default_rng(7)
    x = rng.uniform(1, 9, 400)
    y = np.exp(0.4 * x + 0.05 * rng.standard_normal(400)) if curve else 3 * x + 10 + rng.standard_normal(400)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("k", 1, None, 2.0), ("k", 1, 2.0, float("nan"))], "key string, i long, x double, y double")
    got = results.ridge_choice(df, ["key"], "x", "y", F.col("i"), exponents=(2.0, -3.0, 11)).first()
    best = None
    for log in (False, True):
        t = np.log(y) if log else y
        zx, zy = (x - x.mean()) / x.std(), (t - t.mean()) / t.std()
        for alpha in 10 ** np.linspace(2, -3, 11):
            error = 0.0
            for f in range(5):
                out = np.arange(400) % 5 == f
                a, b = zx[~out], zy[~out]
                slope = ((a - a.mean()) * (b - b.mean())).sum() / (((a - a.mean()) ** 2).sum() + alpha)
                error += ((zy[out] - (b.mean() + slope * (zx[out] - a.mean()))) ** 2).sum()
            slope = (zx * zy).sum() / ((zx * zx).sum() + alpha) * t.std() / x.std()
            one = (-error / 400, log, alpha, slope, t.mean() - slope * x.mean())
            best = one if best is None or one[0] > best[0] + 1e-9 else best
    assert got.log == curve == best[1]
    assert (got.score, got.alpha, got.slope, got.intercept) == pytest.approx((best[0], best[2], best[3], best[4]), rel=1e-6)
    assert got.n == 400


def test_ridge_of_constants_and_negatives(spark):
    df = spark.createDataFrame([("c", i, 1.0, 2.0) for i in range(10)] + [("n", i, float(i), -float(i)) for i in range(10)] + [("one", 0, 1.0, 1.0)], "key string, i long, x double, y double")
    got = {r.key: r for r in results.ridge_choice(df, ["key"], "x", "y", F.col("i")).collect()}
    assert got["c"].slope == 0 and got["c"].intercept == pytest.approx(2.0) and not got["n"].log and "one" not in got


@pytest.mark.parametrize("rows", [10**6, 7, 1])
def test_batches_do_not_depend_on_ranges(spark, monkeypatch, rows):
    counts = spark.createDataFrame([(i, i % 3, i % 5, i % 2, 7) for i in range(90)], "chip long, tp long, fp long, fn long, tn long")
    want = sorted(tuple(r) for r in batchwise.batches(counts, "chip", 3, 4).collect())
    monkeypatch.setattr(batchwise, "RANGE_ROWS", rows)
    assert sorted(tuple(r) for r in batchwise.batches(counts, "chip", 3, 4).collect()) == want
    assert len(want) == 3 * 23


def test_sweep_is_the_single_evaluations(spark):
    """Each configuration has the accuracy that its own thresholds give, chip by chip; the best comes first."""
    rng = np.random.default_rng(3)
    rows = [(c, float(rng.normal(c % 2 + 2 * (k % 2), 0.5)), int(k % 5 > 1) if k % 7 else -1) for c in range(4) for k in range(300)] + [(9, 1.0, 1), (9, 1.0, 0)]
    df = spark.createDataFrame(rows, "chip int, v double, label int")
    got = evaluate.sweep_thresholds(df, ["chip"], "v", "label", [16, 64]).collect()
    assert [r.objective for r in got] == sorted((r.objective for r in got), reverse=True) and len(got) == 4 and {r.n_keys for r in got} == {5}
    for r in got:
        cut = threshold.METHODS[r.method](df, ["chip"], "v", r.bins)
        done = threshold.apply_threshold(df, cut, ["chip"], "v").where("label >= 0")
        each = done.groupBy("chip").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("a"))
        assert r.objective == pytest.approx(each.agg(F.avg("a")).first()[0], abs=0.01)
    with pytest.raises(ValueError):
        evaluate.sweep_thresholds(df, ["chip"], "v", "label", [10, 64])


def test_typed_values(spark, tmp_path):
    rows = [(1, '{"a": 1, "b": {"c": [1, 2]}, "d": "x\\"y", "e": null, "f": 1.5, "g": true}'), (2, "{}"), (3, None), (4, "[1]"), (5, "no json"), (6, '{"h\\u00e9": "z"}')]
    df = spark.createDataFrame(rows, "id long, props string")
    each = variants.entries(df, ["id"], "props")
    got = {(r.id, r.key): r.t for r in each.select("id", "key", variants.text(F.col("value")).alias("t")).collect()}
    assert got == {(1, "a"): "1", (1, "b"): '{"c":[1,2]}', (1, "d"): 'x"y', (1, "e"): "null", (1, "f"): "1.5", (1, "g"): "true", (6, "hé"): "z"}
    tree = each.withColumn("tree", F.parse_json(variants.typed(F.col("value"))))
    assert {r.k for r in tree.select(F.try_variant_get("tree", "$.type", "string").alias("k")).collect()} >= {"bigint", "string", "object", "boolean"}
    assert {(r.id, r.key): r.t for r in tree.select("id", "key", variants.text(variants.resolved(F.col("tree"))).alias("t")).collect() if r.key != "e"} == {k: v for k, v in got.items() if k[1] != "e"}
    made = each.select(F.col("id").alias("trial"), F.col("key").alias("param"), F.lit('Uni"form').alias("name"), F.parse_json(F.lit('{"low": 0}')).alias("attributes"), F.col("value"))
    tables.save_distributions(made, str(tmp_path / "d"))
    back = tables.load_distributions(spark, str(tmp_path / "d"))
    key = lambda df: sorted((r.trial, r.param, r.name, r.a, r.v) for r in df.select("trial", "param", "name", F.to_json("attributes").alias("a"), F.to_json("value").alias("v")).collect())
    assert key(back) == key(made)


def test_a_replayed_epoch_is_stored_once(spark, tmp_path):
    sink = stream.by_epoch(str(tmp_path / "out"))
    for epoch in (0, 1, 1, 0):
        sink(spark.range(epoch + 2), epoch)
    assert sorted((r.epoch, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_tile_scores_are_compared_with_a_limit_of_the_same_run(spark):
    """A score that is the limit is not over it: both come from one run of the sums, in a window, not from two aggregations."""
    df = spark.createDataFrame([(1, r, c, float((r * 7 + c * 3) % 11)) for r in range(16) for c in range(16)], "chip int, row int, col int, v double")
    plan = threshold.tiled(df, ["chip"], "v", tile=8, smallest=4, percentile=0.8, bins=32)._jdf.queryExecution().optimizedPlan().toString()
    limits = [x for x in plan.splitlines() if "percentile(" in x]
    assert limits and all("Window" in x for x in limits if "AS _limit" in x) and not any("Aggregate" in x for x in limits)
