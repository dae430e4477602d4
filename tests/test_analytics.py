"""Worked examples, properties and edge cases of the analytics operators."""

import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pixelgrove.functions import scalars
from pixelgrove.functions import spectral as S
from pixelgrove.operators import batchwise, classify, cluster_metrics, columns, distribution, estimators, lineage, metrics, params, results, spatial, threshold
from pixelgrove.operators import contingency as C
from pixelgrove.plans import grid, spaces
from pixelgrove.plans.evaluate import evaluate
from pixelgrove.sources import chips, tables
from pixelgrove.streaming import contingency as stream


def one(df):
    return df.collect()[0]


# ---------------------------------------------------------------- expressions


def test_zero_sums_and_hsv(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 3.0, 2.0), (2.0, 2.0, 1.0), (1.0, 0.5, 1.0)], "a double, b double, c double").coalesce(1)
    got = df.select(S.normalised_difference("a", "b").alias("x"), *[v.alias(k) for k, v in S.hsv("a", "b", "c").items()]).collect()
    assert [round(r.x, 6) for r in got] == [1.0, -0.5, 0.0, round(0.5 / 1.5, 6)]
    assert got[0][1:] == (0.0, 0.0, 0.0)
    assert abs(got[1].hue - (120 + 60 * 0.5) / 360) < 1e-12 and abs(got[2].hue - 60 / 360) < 1e-12  # red wins a tie with green
    assert abs(got[3].hue - 300 / 360) < 1e-12


def test_stored_water_index_means(spark):
    """The compat form reproduces a stored mean from the stored band means only with bands swapped."""
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "g double, n double, s1 double, s2 double")
    row = one(df.select(S.awei("g", "n", "s1", "s2").alias("a"), S.awei("g", "n", "s1", "s2", compat=True).alias("b")))
    assert row.a == 4 * (1 - 3) - (0.5 + 13.75) and row.b == 4 * (1 - 2) - (0.75 + 13.75)


def test_radar_and_masks(spark):
    df = spark.createDataFrame([(float("nan"), -1), (float("inf"), 0), (float("-inf"), 1), (None, 1), (-20.0, 0)], "v double, label int").coalesce(1)
    assert [round(r[0], 6) for r in df.select(S.radar_clean("v")).collect()] == [round(50 / 51, 6), 1.0, 0.0, round(50 / 51, 6), round(30 / 51, 6)]
    spread = columns.spread_mask(df, "label", -1, ["v", "label"]).collect()
    assert spread[0].v == -1 and spread[4].v == -20
    assert one(columns.valid_mask(df, "label")).mask is False


def test_bits(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (1, 0, 1)], "a int, b int, c int").coalesce(1)
    assert [tuple(r) for r in df.select(S.bits_and(["a", "b", "c"]), S.bits_or(["a", "b", "c"])).collect()] == [(0, 1), (1, 1), (0, 1)]


def test_scalars(spark):
    df = spark.createDataFrame([("a_b_12",), ("plain",), ("x/Bolivia_103757_S2Hand.tif",)], "s string").coalesce(1)
    seeds = df.select(*[v.alias(k) for k, v in scalars.name_and_seed(F.col("s")).items()]).collect()
    assert [tuple(r) for r in seeds][:2] == [("a_b", 12), ("plain", None)]
    assert tuple(df.select(*scalars.region_and_id(F.col("s")).values()).collect()[2]) == ("Bolivia", 103757)
    values = spark.createDataFrame([(x,) for x in ("12", "1.5", "1e3", "nan", "None", "TRUE", " text ")], "s string").coalesce(1)
    got = values.select(scalars.typed_value(F.col("s")).alias("v")).select("v.*").collect()
    assert [r.kind for r in got] == ["int", "float", "float", "float", "null", "bool", "string"]
    assert got[0].int_value == 12 and got[2].float_value == 1000 and math.isnan(got[3].float_value) and got[5].bool_value and got[6].string_value == "text"
    maps = spark.sql("select map('a', 1, 'b', 2) o, map('a', 1) i, map('a', 2) j, map('z', 1) k")
    assert tuple(one(maps.select(*[scalars.contains_map(F.col("o"), F.col(c)) for c in "ijk"]))) == (True, False, False)
    kinds = spark.createDataFrame([(2,), (6,), (14,)], "k int").coalesce(1)
    assert [r[0] for r in kinds.select(scalars.kind_name(F.col("k"))).collect()] == ["label", "label_s1", "label_s1_s2"]


# ---------------------------------------------------------------- contingencies and metrics


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c % 3), int(c), int(x), int(y)) for c in range(12) for x, y in zip(rng.integers(-1, 2, 40), rng.integers(0, 2, 40))]
    rows += [(0, 100, -1, 1)] * 5 + [(1, 101, 0, 0)] * 5
    return spark.createDataFrame(rows, "region int, chip int, label int, pred int")


def test_levels_add_up(pixels):
    levels = C.by_level(pixels).collect()
    total = next(r for r in levels if r.level == "total")
    for level in ("chip", "region"):
        assert sum(r.n11 for r in levels if r.level == level) == total.n11
        assert sum(r.invalid for r in levels if r.level == level) == total.invalid
    assert len([r for r in levels if r.level == "chip"]) == 14


def test_all_cloud_chips_have_no_metrics(pixels):
    counts = C.binary_counts(pixels, ["chip"])
    got = {r.chip: r for r in metrics.scores(C.with_valid(counts), ["chip"]).collect()}
    assert 100 not in got and got[101].accuracy == 1 and got[101].iou1_1 == 1 and got[101].iou0_1 == 0 and got[101].f1_1 == 1
    assert {r.chip for r in C.normalised(C.contingency(pixels, ["chip"]), ["chip"]).select("chip").distinct().collect()} == set(range(12)) | {101}
    assert one(metrics.objective(counts, metrics.accuracy())).n_keys == 13


def test_merge_is_sum(pixels):
    parts = [C.contingency(pixels.where(F.col("chip") % 2 == k)) for k in (0, 1)]
    assert {tuple(r) for r in C.merge(parts).collect()} == {tuple(r) for r in C.contingency(pixels).collect()}


CLUSTERINGS = {"U1": [(0, 0, 20), (1, 2, 1), (1, 0, 1), (2, 2, 3), (2, 1, 1)], "U2": [(0, 0, 18), (0, 1, 2), (1, 1, 2), (2, 2, 4)]}


def _entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts if c)


@pytest.mark.parametrize("name", CLUSTERINGS)
def test_cluster_scores_against_point_pairs(spark, name):
    """26 points; all scores recomputed from the definition, point pair by point pair."""
    cells = CLUSTERINGS[name]
    table = spark.createDataFrame([("k", *c) for c in cells], "key string, label int, pred int, n long")
    points = [(a, b) for a, b, n in cells for _ in range(n)]
    pairs = {(x, y): 0 for x in (0, 1) for y in (0, 1)}
    for i, p in enumerate(points):
        for j, q in enumerate(points):
            if i != j:
                pairs[int(p[0] == q[0]), int(p[1] == q[1])] += 1
    for keys in ((), ("key",)):
        row = one(cluster_metrics.pair_confusion(table, keys))
        assert (row.p00, row.p01, row.p10, row.p11) == (pairs[0, 0], pairs[0, 1], pairs[1, 0], pairs[1, 1])
        scores = one(cluster_metrics.pair_scores(cluster_metrics.pair_confusion(table, keys), keys))
        assert abs(scores.rand - (pairs[0, 0] + pairs[1, 1]) / sum(pairs.values())) < 1e-12
        info = one(cluster_metrics.information_scores(table, keys))
        hl, hp, both = (_entropy([sum(n for *k, n in cells if f(k) == v) for v in {f(k) for *k, _ in cells}]) for f in (lambda k: k[0], lambda k: k[1], tuple))
        assert abs(info.mutual_information - (hl + hp - both)) < 1e-12 and abs(info.h_label - hl) < 1e-12
        b3 = one(cluster_metrics.bcubed(table, keys))
        size = lambda i, v: sum(n for *k, n in cells if k[i] == v)
        assert abs(b3.bcubed_precision - sum(n * n / size(1, b) for a, b, n in cells) / len(points)) < 1e-12


def test_expected_mutual_information(spark):
    """Against the mean over random relabellings."""
    cells = CLUSTERINGS["U2"]
    table = spark.createDataFrame(cells, "label int, pred int, n long")
    labels = np.array([a for a, b, n in cells for _ in range(n)])
    preds = np.array([b for a, b, n in cells for _ in range(n)])
    rng = np.random.default_rng(0)
    seen = []
    for _ in range(4000):
        p = rng.permutation(preds)
        m = np.zeros((3, 3))
        np.add.at(m, (labels, p), 1)
        q = m / m.sum()
        e = q.sum(1)[:, None] * q.sum(0)
        seen.append((q[q > 0] * np.log(q[q > 0] / e[q > 0])).sum())
    got = one(cluster_metrics.adjusted_mutual_information(table))
    assert abs(got.expected_mi - np.mean(seen)) < 0.006 and 0 < got.adjusted_mi < 1


def test_assignment_is_best(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    for shape in ((3, 3), (2, 4), (4, 3)):
        m = rng.integers(0, 50, shape)
        pairs = cluster_metrics._assign(m.sum() - m.astype(float))
        a, b = shape
        best = max(sum(m[i, p[i]] for i in range(a)) for p in permutations(range(b), a)) if a <= b else max(sum(m[p[j], j] for j in range(b)) for p in permutations(range(a), b))
        assert sum(m[i, j] for i, j in pairs) == best and len(pairs) == min(shape)
    table = spark.createDataFrame([("a", 0, 5, 10), ("a", 1, 5, 9), ("a", 1, 6, 1), ("a", 0, 7, 1)], "key string, label int, pred int, n long")
    got = {(r.label, r.pred): r.n for r in cluster_metrics.assignment(table, ["key"]).collect()}
    assert got == {(0, 0): 10, (1, 0): 9, (1, 1): 1, (0, -1): 1}


def test_max_agreement_ties(spark):
    table = spark.createDataFrame([(0, 7, 5), (1, 7, 5), (1, 8, 2)], "label int, pred int, n long")
    assert {(r.label, r.pred, r.n) for r in cluster_metrics.max_agreement(table).collect()} == {(0, 0, 5), (1, 0, 5), (1, 1, 2)}


def test_batches(spark):
    counts = spark.createDataFrame([(i, 0, 0, 0, 5) for i in range(6)], "chip int, tp long, fp long, fn long, tn long")
    got = {r.metric: r for r in batchwise.batch_metrics(counts, "chip", 10, 4).collect()}
    assert got["iou"].mean_mean == 1 and got["f1"].mean_std == 0 and got["accuracy"].mean_min == 1
    every = batchwise.batches(counts.withColumn("tp", F.col("chip").cast("long")), "chip", 5, 4)
    assert {r.s for r in every.groupBy("iter").agg(F.sum("tp").alias("s")).collect()} == {15} and every.count() == 10


# ---------------------------------------------------------------- parameters


def test_only_the_train_split_fits(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "a double, b double")
    stored = params.ensure(df, spark.createDataFrame([], params.SCHEMA), ["a", "b"], "standard", "train", "lee")
    assert params.parameters(stored, ["a", "b"], "standard", "lee") == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert params.ensure(df, stored, ["a"], "standard", "test", "lee") is stored
    with pytest.raises(LookupError):
        params.ensure(df, stored, ["a"], "standard", "test", "median")
    ranges = params.parameters(params.fit_range(df, ["a"]), ["a"], "range")
    assert ranges == {"a": (1.0, 2.0)}
    done = params.apply(df.where("not isnan(a)"), {"a": (2.0, 1.0)}, "standard").agg(F.avg("a"), F.stddev_pop("a"))
    assert tuple(one(done)) == (0.0, 1.0)


# ---------------------------------------------------------------- space


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(4)
    a = rng.random((9, 11))
    rows = [(1, r, c, float(a[r, c])) for r in range(9) for c in range(11)] + [(2, r, c, 3.0) for r in range(8) for c in range(8)]
    return a, spark.createDataFrame(rows, "chip int, row int, col int, v double")


def _array(df, shape, chip=1, value="v"):
    out = np.zeros(shape)
    for r in df.where(F.col("chip") == chip).collect():
        out[r.row, r.col] = r[value]
    return out


def test_filters_against_numpy(image):
    a, df = image
    pad = np.pad(a, 3, mode="reflect")
    windows = np.lib.stride_tricks.sliding_window_view(pad, (7, 7))
    assert np.allclose(_array(spatial.boxcar(df, ["chip"], ["v"]), a.shape), windows.mean((2, 3)))
    assert np.allclose(_array(spatial.median(df, ["chip"], "v"), a.shape), np.median(windows, (2, 3)))
    near = np.lib.stride_tricks.sliding_window_view(np.pad(a, 3, mode="symmetric"), (7, 7))
    m, s, s2 = near.mean((2, 3)), (near**2).mean((2, 3)), (near**4).mean((2, 3))
    vary = np.maximum(s2 - s * s, 1e-10)
    k = np.maximum((vary - s * s / 4.4) / (1 + 1 / 4.4), 0) / vary
    assert np.allclose(_array(spatial.lee(df, ["chip"], ["v"]), a.shape), m + (a - m) * k)
    for name in ("mean", "lee_sigma"):  # a constant stays
        assert np.allclose(_array(spatial.speckle_filter(name, df, ["chip"], ["v"]), (8, 8), 2), 3.0)
    with pytest.raises(ValueError):
        spatial.speckle_filter("refined_lee", df, ["chip"], ["v"])


def test_improved_sigma_keeps_point_targets(spark):
    rows = [(1, r, c, 10.0 if 6 <= r <= 8 and 6 <= c <= 8 else 1.0) for r in range(20) for c in range(20)]
    got = _array(spatial.improved_sigma(spark.createDataFrame(rows, "chip int, row int, col int, v double"), ["chip"], ["v"], percentile=0.9), (20, 20))
    assert np.allclose(got[6:9, 6:9], 10.0) and np.allclose(got[0:3], 0) and got[14, 14] == pytest.approx(1.0)


def test_tiles_and_windows(image):
    a, df = image
    tiles = spatial.tile_split(df, ["chip"], 4, 5, ["v"])
    assert tiles.where("chip = 1").count() == 3 * 3 * 20
    back = spatial.tile_join(spatial.tile_split(df, ["chip"], 4, 5, ["v"], pad=None), ["chip"], 4, 5, ["v"])
    assert np.allclose(_array(back, a.shape), a)
    z = df.withColumn("z", (F.col("v") > 0.5).cast("int"))
    got = spatial.sliding_windows(z, ["chip"], "z", 3, dilation=2, padding=1, stride=2)
    b = np.pad((a > 0.5).astype(int), 1)
    h, w = 1 + (9 + 2 - 4 - 1) // 2, 1 + (11 + 2 - 4 - 1) // 2
    want = np.array([[int(b[2 * r : 2 * r + 5 : 2, 2 * c : 2 * c + 5 : 2].sum() >= 5) for c in range(w)] for r in range(h)])
    assert np.array_equal(_array(got, (h, w), value="z"), want)
    centre = spatial.sliding_windows(z, ["chip"], "v", 3, padding=1, stride=2, aggregation="center")
    assert np.allclose(_array(centre, (5, 6)), a[::2, ::2])
    crop = spatial.random_crop(df, ["chip"], 4, 3)
    assert crop.where("chip = 1").count() == 12
    flipped = {np.allclose(_array(spatial.random_flip(df, ["chip"], p=p), a.shape), x) for p, x in ((0.0, a[:, ::-1]), (1.1, a))}
    assert flipped == {True}


@pytest.mark.parametrize("kernel, dilation, padding, stride", [(3, 1, 1, 2), (5, 2, 3, 1), (2, 1, 0, 3), (3, 4, 1, 1)])
def test_windows_on_small_tiles(spark, monkeypatch, kernel, dilation, padding, stride):
    """Tiles whose pixels overlap, batches that hold parts of a tile, counting in slices: as counted pixel by pixel, ties to the smallest."""
    monkeypatch.setattr(spatial.tiles, "SIDE", 4)
    monkeypatch.setattr(spatial, "_PAIRS", 60)
    a = np.random.default_rng(3).integers(-2, 3, (17, 23)).astype(float)
    df = spark.createDataFrame([("x", r, c, float(a[r, c])) for r, c in np.ndindex(a.shape)], "chip string, row int, col long, v double").repartition(3)
    b = np.pad(a, padding)
    h, w = ((n - dilation * (kernel - 1) - 1) // stride + 1 for n in b.shape)

    def most(r, c):
        seen = b[r * stride :, c * stride :][: dilation * (kernel - 1) + 1 : dilation, : dilation * (kernel - 1) + 1 : dilation]
        value, n = np.unique(seen, return_counts=True)
        return value[n.argmax()]

    made = spatial.sliding_windows(df, ["chip"], "v", kernel, dilation, padding, stride)
    got = {(r.row, r.col): r.v for r in made.collect()}
    assert got == {(r, c): most(r, c) for r in range(h) for c in range(w)}
    assert "Join" not in made._jdf.queryExecution().toString()  # a join would sort all pixels of a task


def test_zones_and_boxes(spark):
    values, labels = [[0.5, 1.5, 0.0, -0.5], [-1.0, 1.0, 10.0, 100.0]], [[0, 1, 0, 1], [1, 0, 1, 0]]
    rows = [(1, r, c, values[r][c], labels[r][c]) for r in range(2) for c in range(4)]
    df = spark.createDataFrame(rows, "chip int, row int, col int, v double, z int")
    got = {r.z: r for r in spatial.zonal_stats(df, ["chip"], "z", ["v"]).collect()}
    for z in (0, 1):
        x = np.array(values)[np.array(labels) == z]
        assert got[z]["v-mean"] == pytest.approx(x.mean()) and got[z]["v-var"] == pytest.approx(x.var()) and got[z]["v-std"] == pytest.approx(x.std())
    boxes = spatial.boxes(df.where("v > 5"), ["chip"], "z").drop("z").groupBy("chip").agg(*[f(c).alias(c) for c, f in (("row_min", F.min), ("row_max", F.max), ("col_min", F.min), ("col_max", F.max))])
    assert {(r.row, r.col, r.v) for r in spatial.crop_to_box(df, boxes, ["chip"]).collect()} == {(0, 0, 10.0), (0, 1, 100.0)}


def test_thresholds_separate_two_modes(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random((32, 32)) < 0.4, rng.normal(-15, 0.7, (32, 32)), rng.normal(-5, 0.7, (32, 32)))
    rows = [(1, r, c, float(v[r, c])) for r in range(32) for c in range(32)] + [(2, r, c, 1.0) for r in range(16) for c in range(16)] + [(1, 40, 0, float("nan"))]
    df = spark.createDataFrame(rows, "chip int, row int, col int, v double")
    for name, f in threshold.METHODS.items():
        t = {r.chip: r.threshold for r in f(df, ["chip"], "v", 64).collect()}
        assert -14 < t[1] < -6, name
        assert t[2] is not None
        assert one(threshold.apply_threshold(df.where("chip = 1"), f(df, ["chip"], "v", 64), ["chip"], "v").agg(F.sum("pred")))[0] == int((v < -10).sum())
    tiled = {r.chip: r.threshold for r in threshold.tiled(df, ["chip"], "v", tile=16, smallest=8, percentile=0.5).collect()}
    assert -14 < tiled[1] < -6 and 2 in tiled


# ---------------------------------------------------------------- classifiers


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = i % 2
        x = rng.normal(y * 3, 1 + y * 0.5, 2)
        rows.append((i, float(x[0]), float(x[1]), y, "train" if i % 4 else "valid", i % 7, [float(x[0]), float(x[1])]))
    return spark.createDataFrame(rows, "id long, a double, b double, y int, split string, chip int, x array<double>")


@pytest.mark.parametrize("fit", [classify.gaussian_naive_bayes, classify.linear_discriminant, classify.quadratic_discriminant])
def test_moment_classifiers(blobs, fit):
    model = fit(blobs.where("split = 'train'"), ["a", "b"], "y")
    got = model.predict(blobs).agg(F.avg((F.col("y") == F.col("prediction")).cast("int"))).first()[0]
    assert got > 0.93
    p = one(model.probabilities(blobs).select((F.col("p_0") + F.col("p_1")).alias("s")))
    assert p.s == pytest.approx(1)


def test_nearest_neighbours(spark, blobs):
    rows = [(1, 0, [0.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 2.0]), (4, 0, [5.0, 5.0])]
    train = spark.createDataFrame(rows, "id long, y int, x array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "id long, x array<double>")
    for metric, want in (("euclidean", [0, 1, 2]), ("manhattan", [0, 1, 2]), ("chebyshev", [0, 1, 2])):
        assert [r.distance for r in classify.nearest(train, q, 3, metric).orderBy("distance").collect()] == want
    near = classify.nearest(train, q, 3)
    assert one(classify.vote(near)).prediction == 1 and one(classify.vote(near, weights="distance")).prediction == 0  # an exact match votes alone
    approx = classify.vote(classify.nearest_lsh(blobs.where("split = 'train'"), blobs.where("split = 'valid'"), 5, bucket=4.0))
    both = approx.join(classify.vote(classify.nearest(blobs.where("split = 'train'"), blobs.where("split = 'valid'"), 5)).withColumnRenamed("prediction", "exact"), "query")
    assert both.agg(F.avg((F.col("prediction") == F.col("exact")).cast("int"))).first()[0] > 0.9


def test_estimators_and_evaluation(spark, blobs, tmp_path):
    df = blobs.withColumnRenamed("y", "label")
    masked = df.withColumn("label", F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("label")))
    model = estimators.fit(masked, estimators.make("rf", trees=5, leaves=8), ["a", "b"], balanced=True)
    estimators.save(model, str(tmp_path / "m"))
    scored = estimators.predict(estimators.load(str(tmp_path / "m")), df, probabilities=True)
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.9
    estimators.score_splits(df, model, str(tmp_path / "scored"), ["id"])
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 400
    result = one(evaluate(df, {"a": F.col("a"), "b": F.col("b")}, estimators.make("sgd", loss="log"), ["chip"]))
    assert result.objective > 0.85 and result.n_keys == 7  # the two classes overlap
    with pytest.raises(KeyError):
        estimators.make("unknown")


@pytest.mark.parametrize("name, params", [("rf", {"trees": 3, "leaves": 4}), ("sgd", {"loss": "hinge"}), ("sgd", {"loss": "log"}), ("gbt", {"trees": 2, "leaves": 4})])
def test_models_go_to_tasks_after_an_observation(spark, blobs, name, params):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    df = blobs.withColumnRenamed("y", "label")
    scored = estimators.predict(estimators.fit(df, estimators.make(name, **params), ["a", "b"], balanced=True), df)
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.8

@pytest.mark.parametrize("name, params", [("rf", {"trees": 3, "leaves": 4}), ("sgd", {"loss": "hinge"}), ("sgd", {"loss": "log"})])
def test_fit_leaves_no_stored_model(spark, blobs, name, params):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before, df = set(folder.glob("model-*")), blobs.withColumnRenamed("y", "label")
    model = estimators.fit(df, estimators.make(name, **params), ["a", "b"])
    assert set(folder.glob("model-*")) == before
    assert estimators.predict(model, df).where("prediction is null").count() == 0



# ---------------------------------------------------------------- results, lineage, grids


def test_averaging_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("a", 1, 2.0), ("b", 1, 5.0)], "c string, seed int, value double")
    got = {r.c: r for r in results.seed_averages(df, ["c"]).collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["mean_std"] is None and got["b"]["std"] is None


def test_run_matching_and_configs(spark):
    trials = spark.createDataFrame([(1, 1, {"lr": "1"}), (1, 2, {"lr": "1", "d": "2"}), (1, 3, {"x": "0"})], "ex int, trial long, config map<string,string>")
    runs = spark.createDataFrame([(1, 7, {"lr": "1", "d": "3"}, "COMPLETED", 7), (1, 9, {"lr": "1", "d": "2"}, "COMPLETED", 9)], "ex int, run long, config map<string,string>, status string, folder int")
    assert {(r.trial, r.run) for r in results.match_runs(trials, runs, "ex").collect()} == {(1, 7), (2, 9)}
    assert one(results.matching_run(runs, {"lr": "1", "d": "2"})).folder == 9
    assert one(results.matching_run(runs, {"lr": "1", "z": "4"}, ["d"], ["z"])).folder == 7
    assert results.mismatches(trials.select("trial"), runs.select(F.col("run").alias("trial")), ["trial"]).count() == 5


def test_lineage(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "predecessor long, successor long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    paths = sorted(tuple(r) for r in lineage.search(edges, ids(0, 4), ids(3, 4)).collect())
    assert paths == [(0, 3, 2), (0, 3, 2), (4, 4, 0)]
    assert len(lineage.search(edges, ids(0), ids(3, 4), end_at_match=False).collect()) == 4
    assert lineage.search(edges, ids(0), ids(4), stop=ids(3)).count() == 0
    assert {r.target for r in lineage.last_evaluation(edges, ids(4), ids(1, 2)).collect()} == {1, 2}
    flags = {r.node: (r.root, r.final) for r in lineage.root_and_final(ids(0, 1, 4, 9).withColumnRenamed("id", "node"), edges).collect()}
    assert flags == {0: (True, False), 1: (False, False), 4: (False, True), 9: (False, False)}
    have = spark.createDataFrame([(3, "a", 1), (4, "b", None)], "id long, name string, seed long")
    want = spark.createDataFrame([("b", None), ("c", 2), ("c", 2)], "name string, seed long")
    assert {tuple(r) for r in lineage.get_or_create(have, want).collect()} == {(3, "a", 1), (4, "b", None), (5, "c", 2)}


def test_conditional_grid(spark):
    """Two conditional branches of 25 values each for 2 x 2 settings: 100 rows."""
    table = grid.grid(spark, {"kind": ["a", "b"], "x": [0, 1], "a_only": list(range(25)), "b_only": list(range(25))}, {"a_only": F.col("kind") == "a", "b_only": F.col("kind") == "b"})
    assert table.count() == 100
    done = table.where("kind = 'a'").withColumn("state", F.lit("COMPLETE"))
    assert grid.pending(table, done).count() == 50
    out = []
    assert grid.sweep(table, done, lambda c: 1.0, out.append) == 50 and len(out) == 50


def test_feature_spaces(spark):
    every = spaces.all_spaces()
    assert len(every) == 23 and sum(k.startswith("SAR_") for k in every) == 11
    flags = spark.createDataFrame([("SAR",), ("SAR_RGB",), ("RGB",)], "s string").coalesce(1).select(*columns.feature_space_flags(F.col("s")).values()).collect()
    assert [tuple(r) for r in flags] == [(True, False), (True, True), (False, False)]
    with pytest.raises(ValueError):
        spaces.by_filter(["nope"])


def test_columns_and_catalog(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, c string")
    assert columns.drop_empty_columns(df).columns == ["a", "c"]
    assert columns.keep(df, ["c", "a"]).columns == ["c", "a"]
    with pytest.raises(ValueError):
        columns.keep(df, ["zz"])
    assert columns.in_sequence(df, [lambda x: x.where("a > 1"), lambda x: None], may_end=True) is None
    cat = columns.Catalog().add("radar", df, 4, "train").add("truth", df.select("a"), 2, "train")
    assert cat.find(kind=4) == "radar" and cat.find(channels=["b"], channel_mode="and_not") == "truth"
    with pytest.raises(LookupError):
        cat.find(split="train")
    with pytest.raises(ValueError):
        cat.merge(columns.Catalog().add("radar", df, 8, "train"))
    nested = spark.sql("select named_struct('x', 1, 'y', named_struct('z', 2)) as a, 3 as b")
    assert columns.flatten(nested).columns == ["a_x", "a_y_z", "b"]


def test_ridge_prefers_the_logarithm(spark):
    df = spark.createDataFrame([(float(x), math.exp(0.3 * x)) for x in range(40)], "x double, y double")
    assert results.ridge_fit(df, "x", "y", ridge=0.01)["log"] is True


# ---------------------------------------------------------------- sources and streams


def test_store_and_chips(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "db"))
    assert store.create_if_absent("Experiment").count() == 0
    store.append("Experiment", spark.createDataFrame([(1, "a", None)], tables.SCHEMAS["Experiment"]))
    assert store["Experiment"].count() == 1
    with pytest.raises(PermissionError):
        tables.Store(spark, str(tmp_path / "db"), read_only=True).save("Experiment", store["Experiment"])
    folder = tmp_path / "chips"
    folder.mkdir()
    for i in range(3):
        np.save(folder / f"Bolivia_{i}_S1Hand.npy", np.full((2, 4, 5), i, float))
    (folder / "list.csv").write_text("Bolivia_1_S1Hand.npy, Bolivia_1_LabelHand.npy\n")

    def decode(content):
        import io

        return np.load(io.BytesIO(content))

    px = chips.pixels(spark, str(folder), decode, chips.RADAR, "*.npy")
    assert px.count() == 60 and one(px.where("chip_id = 2").agg(F.avg("VH")))[0] == 2
    scan = chips.files(spark, str(folder), "*.npy")
    assert [r.chip_id for r in chips.in_manifest(scan, chips.manifest(spark, str(folder / "list.csv"))).collect()] == [1]
    chips.pack(px, str(tmp_path / "packed"), "S1", "weak")
    assert chips.read_split(spark, [str(tmp_path / "no"), str(tmp_path / "packed")], "S1", "weak").count() == 60
    assert chips.read_split(spark, str(tmp_path / "packed"), "S1", "weak-bolivia").count() == 0
    for i, status in enumerate(("COMPLETED", "FAILED")):
        run = tmp_path / "runs" / str(i)
        run.mkdir(parents=True)
        (run / "config.json").write_text('{"a": 1}')
        (run / "pipeline.json").write_text("[]")
        (run / "run.json").write_text(f'{{"status": "{status}"}}')
    assert [r.folder for r in tables.runs(spark, str(tmp_path / "runs")).collect()] == ["0"]
    (tmp_path / "d.json").write_text('{"3": {"lr": {"name": "float", "attributes": {"low": "0"}, "value": "0.1"}}}')
    assert tuple(one(tables.distributions(spark, str(tmp_path / "d.json")).select("trial", "param", "value"))) == (3, "lr", "0.1")


def test_stream_equals_batch(spark, tmp_path, pixels):
    source = str(tmp_path / "in")
    for k in range(3):
        pixels.where(F.col("chip") % 3 == k).write.mode("append").parquet(source)
    seen = []
    df = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.run(stream.running_contingency(df, ["region"]), lambda b, e: seen.append(b.collect()), str(tmp_path / "state"), "complete").awaitTermination()
    assert {tuple(r) for r in seen[-1]} == {tuple(r) for r in C.contingency(pixels, ["region"]).collect()}


def test_distribution(pixels):
    flags = {r.chip: r.chip_type for r in distribution.chip_flags(pixels, ["region", "chip"]).collect()}
    assert flags[100] == "no data" and flags[101] == "dry"
    shares = distribution.chip_type_share(distribution.chip_flags(pixels, ["region", "chip"])).collect()
    assert sum(r.n for r in shares) == 14


def test_bundle(pixels):
    from pyspark.sql import functions as F

    from pixelgrove.operators import bundles

    table = C.contingency(pixels, ["region"])
    got = {(r.region, r.metric, r.class_name): r.value for r in bundles.bundle(table, ["region"], clustering=True).collect()}
    counts = {r.region: r for r in metrics.scores(C.binary_counts(pixels, ["region"]), ["region"]).collect()}
    for region, r in counts.items():
        assert got[region, "accuracy.no_clouds", None] == pytest.approx(r.accuracy)
        assert got[region, "iou.no_clouds", 1] == pytest.approx(r.iou1_1)
    assert {m for _, m, _ in got} >= {"rand.no_clouds", "v_measure.no_clouds", "f1.max_agree.no_clouds", "bcubed_f.no_clouds"}
    assert bundles.too_many_predictions(table, ["region"], 2) and not bundles.too_many_predictions(table, ["region"], 3)
    assert bundles.bundle(table.where(F.lit(False)), ["region"]).count() == 0


# ---------------------------------------------------------------- whole inputs


@pytest.mark.parametrize("kind,pad", [("mirror", "reflect"), ("reflect", "symmetric")])
@pytest.mark.parametrize("shape", [(1, 5), (2, 9), (3, 4)])
def test_borders_of_small_chips(spark, kind, pad, shape):
    a = np.arange(shape[0] * shape[1], dtype=float).reshape(shape) ** 2
    df = spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(a)], "chip int, row int, col int, v double")
    got = {(r.row, r.col): r.v for r in spatial.window_mean(df, ["chip"], ["v"], 7, kind).collect()}
    want = np.lib.stride_tricks.sliding_window_view(np.pad(a, 3, pad), (7, 7)).mean((2, 3))
    assert len(got) == a.size
    assert all(abs(got[i] - v) < 1e-9 for i, v in np.ndenumerate(want))


def test_queries_over_whole_tables(spark, tmp_path):
    from pixelgrove.plans import registry

    lines = [(o, n, 10 * o + n) for o in range(1, 5) for n in (1, 2, 3)]
    t = spark.createDataFrame([(o, n, s, 0.5, 0.25, 10.0, 100.0) for o, n, s in lines], "l_orderkey long, l_linenumber int, l_suppkey long, l_discount double, l_tax double, l_quantity double, l_extendedprice double")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    every = registry.queries()
    got = {tuple(r) for r in every["sequence_edges_all"](spark, str(tmp_path)).select("predecessor", "successor").collect()}
    assert got == {(10 * o + n, 10 * o + n + 1) for o in range(1, 5) for n in (1, 2)}
    got = {tuple(r) for r in every["mask_combination_all"](spark, str(tmp_path)).select("pix", "line", "b1").collect()}
    assert got == {(o, n, -1.0 if n == 2 else 0.5) for o, n, _ in lines}


def test_nearest_over_many_blocks(spark, monkeypatch):
    """More training rows than one block holds, and than the former limit, ties included."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (51_000, 3)).astype(float)
    t = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, x array<double>, y int")
    monkeypatch.setattr(classify, "TRAIN_BLOCK", 8000)
    got = {}
    for r in classify.nearest(t, t.where("id % 5100 = 0"), 7).collect():
        got.setdefault(r.query, []).append((r.distance, r.id))
    for q in range(0, 51_000, 5100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert sorted(got[q]) == [(d[i], i) for i in np.lexsort((np.arange(len(d)), d))[:7]]
    assert len(got) == 10


def _sigma_by_loops(a, looks, low, high, noise, percentile):
    """The improved sigma filter of an array (bands, rows, cols) of amplitudes, pixel by pixel."""
    power = a**2
    span = power.sum(0)
    limit = np.percentile(power[0], 100 * percentile)
    out, (h, w) = np.zeros_like(a), span.shape
    kept = np.zeros((h, w), bool)
    gain = lambda m, v, s: max((max(v, 1e-10) - m * m * s) / (1 + s), 0) / max(v, 1e-10)
    for r in range(3, h - 3):
        for c in range(3, w - 3):
            near = span[r - 1 : r + 2, c - 1 : c + 2] > limit
            if near.sum() >= 6:
                kept[r - 1 : r + 2, c - 1 : c + 2] |= near
    for r in range(3, h - 3):
        for c in range(3, w - 3):
            x = span[r - 1 : r + 2, c - 1 : c + 2]
            tilde = x.mean() + gain(x.mean(), x.var(), 1 / looks) * (span[r, c] - x.mean())
            y = span[r - 3 : r + 4, c - 3 : c + 4]
            pick = (y > low * tilde) & (y < high * tilde)
            if pick.any():
                k = gain(y[pick].mean(), y[pick].var(), noise)
                m = power[:, r - 3 : r + 4, c - 3 : c + 4][:, pick].mean(1)
                out[:, r, c] = m + k * (power[:, r, c] - m)
    out[:, kept] = power[:, kept]
    return np.sqrt(np.maximum(out, 0))


def test_improved_sigma_against_loops(spark):
    a = np.random.default_rng(3).gamma(4.4, 1 / 4.4, (2, 12, 13)) ** 0.5
    a[:, 4:7, 5:8] *= 5
    rows = [(1, r, c, float(a[0, r, c]), float(a[1, r, c])) for r in range(12) for c in range(13)]
    df = spark.createDataFrame(rows, "chip int, row int, col int, v double, w double")
    low, high, noise = spatial.sigma_range(4.4, 0.9)
    assert (round(low, 3), round(high, 3), round(noise, 4)) == (0.398, 2.024, 0.1444)
    got = spatial.improved_sigma(df, ["chip"], ["v", "w"], percentile=0.9)
    want = _sigma_by_loops(a, 4.4, low, high, noise, 0.9)
    for i, band in enumerate("vw"):
        assert np.allclose(_array(got, (12, 13), value=band), want[i])


def test_adjusted_mutual_information_of_large_tables(spark):
    """As many points as a hand-labelled set; and the short range of cells gives what the whole one gives."""
    from math import exp, lgamma, log

    def expected(a, b):
        n, lf, out = sum(a), (lambda x: lgamma(x + 1)), 0.0
        for x in a:
            for y in b:
                for c in range(max(1, x + y - n), min(x, y) + 1):
                    w = exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(c) - lf(x - c) - lf(y - c) - lf(n - x - y + c))
                    out += c / n * log(n * c / (x * y)) * w
        return out

    table = spark.createDataFrame([(0, 0, 300), (0, 1, 200), (1, 0, 100), (1, 1, 900)], "label int, pred int, n long")
    got = cluster_metrics.expected_mutual_information(table).first().expected_mi
    assert got == pytest.approx(expected([500, 1000], [400, 1100]), rel=1e-9)
    large = spark.createDataFrame([(0, 0, 60_000_000), (0, 1, 10_000_000), (1, 0, 7_000_000), (1, 1, 40_000_000)], "label int, pred int, n long")
    row = cluster_metrics.adjusted_mutual_information(large).first()
    assert 0 < row.adjusted_mi < 1 and row.expected_mi == pytest.approx(1 / (2 * 117e6), rel=0.01)


def test_a_cycle_ends_the_search_with_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "predecessor long, successor long")
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    with pytest.raises(ValueError):
        lineage.search(edges, one(1), one(9), max_levels=4)


def test_module_settings():
    assert lineage.per_module(["a", "b"], None, "x") == [None, None]
    assert lineage.per_module(["a", "b"], [1], "x") == [1, 1]
    with pytest.raises(ValueError):
        lineage.per_module(["a", "b"], [1, 2, 3], "x")


@pytest.mark.parametrize("side", [1, 2, 3])
def test_boxcar_on_chips_smaller_than_the_window(spark, side):
    a = np.arange(side * side, dtype=float).reshape(side, side)
    df = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(side) for c in range(side)], "chip int, row int, col int, v double")
    wide = np.pad(a, 3, mode="reflect") if side > 1 else np.full((7, 7), a[0, 0])
    want = np.array([[wide[r : r + 7, c : c + 7].mean() for c in range(side)] for r in range(side)])
    assert np.allclose(_array(spatial.boxcar(df, ["chip"], ["v"], 7), a.shape), want)
