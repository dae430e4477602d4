"""What jobs leave behind: filtered spaces, split lists, parameter files, predictions."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pixelgrove.operators import bundles, params
from pixelgrove.plans import spaces
from pixelgrove.sources import chips


def _pixels(spark, size=9):
    rng = np.random.default_rng(3)
    rows = [(s, c, r, k, *map(float, rng.random(2))) for s, c in (("train", 1), ("valid", 1), ("valid", 2), ("test", 3)) for r in range(size) for k in range(size)]
    return spark.createDataFrame(rows, "split string, chip int, row int, col int, VV double, VH double")


def test_filtered_spaces(spark):
    df = _pixels(spark)
    got = spaces.filtered(df, [None, "mean"], ["chip"], names=["SAR"])
    assert set(got) == {None, "mean"} and set(got["mean"]) == {"SAR"}
    train, valid = got[None]["SAR"]
    assert train.columns == ["chip", "row", "col", "VV", "VH"]
    assert (train.count(), valid.count()) == (81, 162)
    # the same chip number in two splits: each is filtered on its own
    means = {s: x.where("chip = 1 and row = 4 and col = 4").first() for s, x in zip(("train", "valid"), got["mean"]["SAR"])}
    for s, row in means.items():
        near = [r["VV"] for r in df.where(f"split = '{s}' and chip = 1 and row between 1 and 7 and col between 1 and 7").collect()]
        assert row["VV"] == pytest.approx(np.mean(near))
    with pytest.raises(ValueError):
        spaces.filtered(df, ["nope"], ["chip"])
    with pytest.raises(ValueError):
        spaces.filtered(df, [None], ["chip"], names=["SAR", "nope"])


def test_parameter_file(spark, tmp_path):
    path = str(tmp_path / "channels")
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (float("nan"), None)], "a double, b double")
    assert params.load(spark, path).count() == 0
    with pytest.raises(LookupError):
        params.ensure_file(df, path, ["a"], "standard", "valid")
    first = params.ensure_file(df, path, ["a", "b"], "standard", "train")
    assert params.parameters(first, ["a", "b"], "standard") == {"a": (2.0, 1.0), "b": (4.0, 1.0)}
    files = sorted(os.listdir(path))
    again = params.ensure_file(df.where("a > 1"), path, ["b", "a"], "standard", "valid")
    assert sorted(os.listdir(path)) == files and params.parameters(again, ["a"], "standard") == {"a": (2.0, 1.0)}
    more = params.ensure_file(df, path, ["a"], "range", "train", "lee")  # ranges know no filter
    assert params.parameters(more, ["a"], "range") == {"a": (1.0, 2.0)} and more.count() == 3
    assert params.ensure_file(df, path, ["a"], "range", "valid", "median").count() == 3


def test_split_lists(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    lines = spark.createDataFrame([("train", "X_1_S1Hand.tif ", " X_1_LabelHand.tif"), ("test", "Y_2_S1Hand.tif", None)], "list string, data_file string, label_file string")
    chips.write_lists(lines, source)
    chips.rewrite_lists(spark, source, target)
    got = sorted(map(tuple, chips.read_lists(spark, target).collect()))
    assert got == [("test_dem", "Y_2_dem.tif", None), ("test_s2", "Y_2_S2Hand.tif", None), ("train_dem", "X_1_dem.tif", "X_1_LabelHand.tif"), ("train_s2", "X_1_S2Hand.tif", "X_1_LabelHand.tif")]
    assert [r["data_file"] for r in chips.read_lists(spark, target, "train_s2").collect()] == ["X_1_S2Hand.tif"]
    with pytest.raises(AnalysisException):
        chips.rewrite_lists(spark, source, target)


def test_predictions_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("R", 1, 0)], "region string, chip int, pred int")
    chips.save_predictions(df, str(tmp_path / "p"))
    with pytest.raises(AnalysisException):
        chips.save_predictions(df, str(tmp_path / "p"))


def test_bundles_under_a_limit(spark):
    table = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 1, 2), ("b", 0, 0, 1), ("b", 1, 0, 1)], "region string, label int, pred int, n long")
    # 2 and 1 different predictions: 1.5 on average
    assert bundles.bundle_unless_many(table, ["region"], 1.5).count() == 0
    kept, plain = (f(table, ["region"], *more) for f, more in ((bundles.bundle_unless_many, [1.6]), (bundles.bundle, [])))
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


def test_packed_sets_merge_without_broadcast(spark):
    data = spark.createDataFrame([("a", 1, 0, k, float(k)) for k in range(5)], "region string, chip_id long, row int, col int, v double")
    labels = data.where("col < 3").select("region", "chip_id", "row", "col", (F.col("col") % 2).alias("label"))
    plan = chips.data_with_labels(data, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert chips.data_with_labels(data, labels).count() == 3 and chips.with_elevation(data, labels.withColumnRenamed("label", "dem")).count() == 5
