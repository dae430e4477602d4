"""Tiles with a halo: results do not depend on the tile size, borders fold as numpy pads, and several bands share a pass."""

import numpy as np
import pytest

from pixelgrove.operators import spatial, tiles

SHAPES = [(1, 1), (1, 9), (5, 2), (20, 23), (17, 8)]


@pytest.fixture(scope="module")
def chips(spark):
    rng = np.random.default_rng(4)
    arrays = {k: np.abs(rng.gamma(2, 1, (2, *s))) for k, s in enumerate(SHAPES)}
    rows = [(None if k == 3 else k, r, c, float(a[0, r, c]), float(a[1, r, c]), "extra") for k, a in arrays.items() for r in range(a.shape[1]) for c in range(a.shape[2])]
    return arrays, spark.createDataFrame(rows, "chip int, row int, col int, v double, w double, _top string").repartition(5)


def grids(df, bands=("v", "w")):
    rows = df.collect()
    out = {k: np.full((2, *s), np.inf) for k, s in enumerate(SHAPES)}
    for r in rows:
        out[3 if r.chip is None else r.chip][:, r.row, r.col] = [r[b] for b in bands]
    return out


FILTERS = {
    "boxcar": lambda d: spatial.boxcar(d, ["chip"], ["v", "w"], 7),
    "median": lambda d: spatial.median(d, ["chip"], ["v", "w"], 5),
    "lee": lambda d: spatial.lee(d, ["chip"], ["v", "w"], 7),
    "sigma": lambda d: spatial.improved_sigma(d, ["chip"], ["v", "w"], percentile=0.7),
}


@pytest.mark.parametrize("name", FILTERS)
def test_any_tile_size(chips, monkeypatch, name):
    _, df = chips
    want = grids(FILTERS[name](df))
    assert all(np.isfinite(a).all() for a in want.values())
    for side in (1, 5, 8):
        monkeypatch.setattr(tiles, "SIDE", side)
        got = grids(FILTERS[name](df))
        assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)


def test_against_padded_arrays(chips):
    arrays, df = chips
    mean, middle = grids(FILTERS["boxcar"](df)), grids(FILTERS["median"](df))
    for k, a in arrays.items():
        for b in range(2):
            near = np.lib.stride_tricks.sliding_window_view(np.pad(a[b], 3, mode="reflect" if min(a[b].shape) > 1 else "symmetric"), (7, 7))
            if min(a[b].shape) > 1:
                assert np.allclose(mean[k][b], near.mean((2, 3)))
                near = np.lib.stride_tricks.sliding_window_view(np.pad(a[b], 2, mode="reflect"), (5, 5))
                assert np.allclose(middle[k][b], np.median(near, (2, 3)))


@pytest.mark.parametrize("kind, mode", [("mirror", "reflect"), ("reflect", "symmetric")])
@pytest.mark.parametrize("length", [2, 3, 5, 12])
def test_folding(kind, mode, length):
    want = np.pad(np.arange(length), 7, mode=mode)
    assert (tiles.fold(np.arange(-7, length + 7), length, kind) == want).all()
    assert (tiles.fold(np.arange(-7, 8), 1, kind) == 0).all()


def test_missing_pixels_and_values(spark):
    """A pixel that a chip lacks has no row; null and NaN are the largest in a median and 0 in a mean."""
    rows = [(1, 0, 0, 1.0), (1, 0, 1, None), (1, 0, 2, float("nan")), (1, 2, 2, 5.0)]
    df = spark.createDataFrame(rows, "chip int, row int, col int, v double")
    got = {(r.row, r.col): r.v for r in spatial.boxcar(df, ["chip"], ["v"], 3).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (2, 2)} and got[0, 0] == pytest.approx(1 / 9) and got[2, 2] == pytest.approx(5 / 9)
    line = spark.createDataFrame([(1, 0, c, v) for c, v in enumerate([1.0, 2.0, None, 4.0, 8.0])], "chip int, row int, col int, v double")
    assert [r.v for r in spatial.median(line, ["chip"], "v", 3).orderBy("col").collect()][:2] == [2.0, 2.0]
    assert spatial.boxcar(line, ["chip"], ["v"], 3).where("col = 4").first().v == pytest.approx((4 + 8 + 4) / 3)
    assert spatial.lee(df.limit(0), ["chip"], ["v"]).count() == 0
