"""Chip and run folders: exact round trips, pruning by split and region, formats by suffix, and damaged folders."""

import os

import numpy as np
import pytest

from pixelgrove.sources import folders


@pytest.fixture(scope="module")
def chips(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = [(s, r, c, y, x, float(rng.standard_normal()), float(y * x)) for c, (s, r) in enumerate([("train", "Ghana"), ("train", "Sri-Lanka"), ("valid", "Ghana"), ("test", "Spain")]) for y in range(3 + c) for x in range(4)]
    df = spark.createDataFrame(rows, "split string, region string, chip_id long, row int, col int, a double, b double").repartition(4)
    base = str(tmp_path_factory.mktemp("chips"))
    files = [folders.save_chips(df, base, ["a", "b"], "S1Hand").collect(), folders.save_chips(df.where("region = 'Ghana'"), base, ["b", "a"], "S2Hand", channels_last=True).collect()]
    return base, rows, files


def back(df, *columns):
    return sorted(tuple(r) for r in df.select("split", "region", "chip_id", "row", "col", *columns).collect())


def test_round_trip(spark, chips):
    base, rows, files = chips
    assert back(folders.chips(spark, base, ["a", "b"], layer="S1Hand"), "a", "b") == sorted(rows)
    assert {r.file for r in files[0]} == {"Ghana_0_S1Hand.npy", "Sri-Lanka_1_S1Hand.npy", "Ghana_2_S1Hand.npy", "Spain_3_S1Hand.npy"}
    swapped = folders.chips(spark, base, ["b", "a"], layer="S2Hand")
    assert back(swapped, "a", "b") == sorted(r for r in rows if r[1] == "Ghana")


def test_pruning(spark, chips):
    base, rows, _ = chips
    some = folders.chips(spark, base, ["a", "b"], splits=["train", "bolivia"], regions=["ghana"], layer="S1Hand")
    assert back(some, "a", "b") == sorted(r for r in rows if r[:2] == ("train", "Ghana")) and some.rdd.getNumPartitions() == 1
    assert folders.chips(spark, base, ["a", "b"], splits=["train"], layer="S1Hand", partition_bytes=1).rdd.getNumPartitions() == 2
    assert back(folders.chips(spark, base, ["a", "b"], exclude="S2"), "a", "b") == sorted(rows)
    assert folders.chips(spark, base, ["a", "b"], regions=["Nowhere"]).count() == 0


def test_wrong_use(spark, chips):
    base = chips[0]
    with pytest.raises(Exception, match="unknown split"):
        folders.chips(spark, base, ["a", "b"], splits=["tets"]).count()
    with pytest.raises(Exception, match="bands"):
        folders.chips(spark, base, ["a"], layer="S1Hand").count()


def test_a_decoder_of_the_user(spark, chips):
    base, rows, _ = chips
    twice = folders.chips(spark, base, ["a", "b"], layer="S1Hand", decode=lambda data: 2 * folders.from_npy(data))
    assert back(twice, "b") == sorted((*r[:5], 2 * r[6]) for r in rows)


def test_runs(spark, tmp_path):
    rows = [("r1", '{"x": 1}', "{}", "COMPLETED"), ("r2", '{"x": 2}', "{}", "FAILED"), ("r3", '{"x": 3}', None, "COMPLETED"), ("r4", '{"x": "é"}', "{}", "COMPLETED"), ("r5", None, None, None)]
    df = spark.createDataFrame(rows, "folder string, config string, pipeline string, status string")
    for _ in range(2):  # writing again replaces
        assert folders.save_runs(df, str(tmp_path)).count() == 5
    assert sorted(os.listdir(tmp_path)) == ["r1", "r2", "r3", "r4", "r5"] and os.listdir(tmp_path / "r5") == []
    assert sorted(tuple(r) for r in folders.runs(spark, str(tmp_path)).collect()) == [rows[0], rows[3]]
    assert folders.runs(spark, str(tmp_path), status=None).count() == 3
    assert folders.runs(spark, str(tmp_path / "none")).count() == 0
