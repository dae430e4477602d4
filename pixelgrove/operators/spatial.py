"""Neighbourhood operators over pixel tables (keys, row, col, value columns).

Filters work on tiles with a halo, as arrays (module tiles); flags and shifts are window frames along rows and
columns, so no task holds more than a tile or a strip.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache, reduce
from math import lgamma
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    return df.join(per, list(keys))


def _line_frame(keys: Sequence[str], line: str, along: str, k: int):
    return Window.partitionBy(*keys, line).orderBy(along).rowsBetween(-k, k)


def _clean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Missing and NaN values as 0."""
    return df.select(*keys, "row", "col", *[F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(v) for v in values])


def window_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], win: int = 7, kind: str = "mirror") -> DataFrame:
    """Mean of the win x win neighbourhood of each value."""

    def means(tile: tiles.Tile) -> dict[str, np.ndarray]:
        return {v: tiles.box_mean(tile, tile.bands[v]) for v in values}

    return tiles.apply(df, keys, values, dict.fromkeys(values, "double"), win // 2, kind, means)


def boxcar(df: DataFrame, keys: Sequence[str], values: Sequence[str], win: int = 7) -> DataFrame:
    """Boxcar mean with mirrored borders; NaN counts as 0."""
    return window_mean(_clean(df, keys, values), keys, values, win, "mirror")


def median(df: DataFrame, keys: Sequence[str], values: str | Sequence[str], win: int = 7) -> DataFrame:
    """Median of the win x win neighbourhood (win odd) of one or several bands, mirrored borders; missing and NaN values are the largest."""
    values = [values] if isinstance(values, str) else list(values)

    def middle(tile: tiles.Tile) -> dict[str, np.ndarray]:
        near = {v: np.lib.stride_tricks.sliding_window_view(tile.bands[v], (win, win)).reshape(*tile.shape, win * win) for v in values}
        return {v: np.partition(x, win * win // 2, axis=-1)[..., win * win // 2] for v, x in near.items()}

    return tiles.apply(df, keys, values, dict.fromkeys(values, "double"), win // 2, "mirror", middle)


def lee(df: DataFrame, keys: Sequence[str], values: Sequence[str], win: int = 7, looks: float = 4.4) -> DataFrame:
    """Lee speckle filter: |x| (NaN: 0), one gain for all bands from the span's local moments, borders reflected."""

    def filtered(tile: tiles.Tile) -> dict[str, np.ndarray]:
        size = {v: np.abs(tile.bands[v]) for v in values}
        span = sum(x * x for x in size.values())
        mean = tiles.box_mean(tile, span)
        gain = _gain(mean, tiles.box_mean(tile, span * span) - mean * mean, 1.0 / looks)
        out = {}
        for v, x in size.items():
            own = tiles.box_mean(tile, x)
            out[v] = own + (tile.shifted(x, 0, 0) - own) * gain
        return out

    return tiles.apply(_clean(df, keys, values), keys, values, dict.fromkeys(values, "double"), win // 2, "reflect", filtered)


@lru_cache(32)
def sigma_range(looks: float, sigma: float) -> tuple[float, float, float]:
    """(low, high, variance) of the sigma range: the stretch of a speckle of mean 1 (gamma of shape looks) that holds
    the share sigma of it and has mean 1; variance: around 1, inside the stretch."""
    grid = np.linspace(0, 1 + 60 / np.sqrt(looks), 400_001)
    density = np.exp(looks * np.log(looks) - lgamma(looks) + (looks - 1) * np.log(np.maximum(grid, 1e-300)) - looks * grid)
    total = lambda y: np.append(0, np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(grid)))
    mass, mean, square = (total(density * w) for w in (1.0, grid, (grid - 1) ** 2))
    low, high = 0.0, float(np.interp(1 - sigma, mass, grid))
    for _ in range(60):  # the mean rises with the lower limit
        a = (low + high) / 2
        b = float(np.interp(np.interp(a, grid, mass) + sigma, mass, grid))
        if np.interp(b, grid, mean) - np.interp(a, grid, mean) < sigma:
            low = a
        else:
            high = a
    return a, b, float(np.interp(b, grid, square) - np.interp(a, grid, square)) / sigma


def point_targets(df: DataFrame, keys: Sequence[str], values: Sequence[str], percentile: float = 0.98) -> DataFrame:
    """Adds bright (span over the percentile of the first band's intensity) and kept (bright, with an interior pixel
    of at least six bright ones around it in its 3 x 3)."""
    sized = _sizes(df, keys)
    x = sized.withColumn("_span", sum((F.col(v) * F.col(v) for v in values), F.lit(0.0)))
    limit = x.groupBy(*keys).agg(F.percentile(F.col(values[0]) * F.col(values[0]), percentile).alias("_limit"))
    x = x.join(limit, list(keys)).withColumn("bright", (F.col("_span") > F.col("_limit")).cast("int"))
    for line, along in (("row", "col"), ("col", "row")):
        x = x.withColumn("_count", F.sum("bright" if along == "col" else "_count").over(_line_frame(keys, line, along, 1)))
    inside = (F.col("row") >= 3) & (F.col("col") >= 3) & (F.col("row") < F.col("_rows") - 3) & (F.col("col") < F.col("_cols") - 3)
    x = x.withColumn("_target", (inside & (F.col("_count") >= 6)).cast("int"))
    for line, along in (("row", "col"), ("col", "row")):
        x = x.withColumn("_near", F.max("_target" if along == "col" else "_near").over(_line_frame(keys, line, along, 1)))
    x = x.withColumn("kept", (F.col("bright") == 1) & (F.col("_near") == 1)).withColumn("inside", inside)
    return x.drop("_count", "_target", "_near", "_limit", "_rows", "_cols")


def _gain(mean: np.ndarray, var: np.ndarray, noise: float) -> np.ndarray:
    """Share of the local deviation that is kept; noise: variance of the speckle."""
    var = np.maximum(var, 1e-10)
    return np.maximum((var - mean * mean * noise) / (1 + noise), 0.0) / var


def improved_sigma(df: DataFrame, keys: Sequence[str], values: Sequence[str], looks: float = 4.4, sigma: float = 0.9, percentile: float = 0.98, bounds: tuple[float, float, float] | None = None) -> DataFrame:
    """Improved sigma filter of intensities.

    Point targets stay; elsewhere a 3 x 3 estimate of the span picks the pixels of the 7 x 7 neighbourhood inside
    the sigma range, from which each band is estimated.  Pixels within three of the edge are 0 unless they
    are point targets.  All bands share the gain of the span.  bounds: (low, high, variance) of the range instead of the one
    that follows from looks and sigma.
    """
    low, high, inner = bounds or sigma_range(looks, sigma)
    clean = _clean(df, keys, values)
    limit = clean.groupBy(*[F.col(k).alias(f"_p_{i}") for i, k in enumerate(keys)]).agg(F.percentile(F.col(values[0]) * F.col(values[0]), percentile).alias("_limit"))
    clean = clean.join(limit, [F.col(k).eqNullSafe(F.col(f"_p_{i}")) for i, k in enumerate(keys)])

    def filtered(tile: tiles.Tile) -> dict[str, np.ndarray]:
        square = {v: tile.bands[v] ** 2 for v in values}
        span = sum(square.values())
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        # brightness, then targets with six bright cells around, then what lies next to a target: one ring of the halo each
        grow = lambda a, f: f([np.roll(a, (x, y), (0, 1)) for x, y in near])
        bright = tile.there & (span > np.where(np.isnan(tile.bands["_limit"]), np.inf, tile.bands["_limit"]))
        r, c = (n - tile.halo + np.arange(m) for n, m in zip((tile.top, tile.left), tile.there.shape))
        deep = ((r >= 3) & (r < tile.rows - 3))[:, None] & (c >= 3) & (c < tile.cols - 3)
        target = deep & tile.there & (grow(bright.astype(int), sum) >= 6)
        kept = tile.shifted(bright & (grow(target.astype(int), sum) > 0), 0, 0)
        inside = tile.border(3)

        def moments(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n, s, q = (np.zeros(tile.shape) for _ in range(3))
            for mask, x in cells:
                n += mask
                s += np.where(mask, x, 0.0)
                q += np.where(mask, x * x, 0.0)
            mean = s / np.maximum(n, 1)
            return n, mean, q / np.maximum(n, 1) - mean * mean

        own = tile.shifted(span, 0, 0)
        _, mean, var = moments((tile.shifted(tile.there, a, b), tile.shifted(span, a, b)) for a, b in near)
        guess = mean + _gain(mean, var, 1 / looks) * (own - mean)
        wide = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
        picks = []
        for a, b in wide:
            x = tile.shifted(span, a, b)
            picks.append(tile.shifted(tile.there, a, b) & (x > low * guess) & (x < high * guess))
        n, mean, var = moments((p, tile.shifted(span, a, b)) for p, (a, b) in zip(picks, wide))
        gain = _gain(mean, var, inner)
        out = {}
        for v, x in square.items():
            _, mean, _ = moments((p, tile.shifted(x, a, b)) for p, (a, b) in zip(picks, wide))
            own = tile.shifted(x, 0, 0)
            estimate = np.where(n == 0, 0.0, mean + gain * (own - mean))
            out[v] = np.sqrt(np.maximum(np.where(kept, own, np.where(inside, estimate, 0.0)), 0.0))
        return out

    return tiles.apply(clean, keys, [*values, "_limit"], dict.fromkeys(values, "double"), 3, None, filtered)


# Alias -> filter.
FILTER_ALIASES = {"median": "median", "boxcar": "boxcar", "mean": "boxcar", "lee": "lee", "lee_sigma": "lee", "lee_improved": "improved", "lee_sigma_improved": "improved", "improved_lee": "improved", "improved_lee_sigma": "improved"}


def speckle_filter(name: str, df: DataFrame, keys: Sequence[str], values: Sequence[str], **how) -> DataFrame:
    kind = FILTER_ALIASES.get(name.casefold().strip())
    if kind is None:
        raise ValueError(f"unknown or unsupported filter: {name}")
    return {"median": median, "boxcar": boxcar, "lee": lee, "improved": improved_sigma}[kind](df, keys, values, **how)


# ---------------------------------------------------------------- windows, tiles, zones


def _pieces(keys: Sequence[str], value: str, reach: int, padding: int, stride: int, side: int):
    """Pixels of a batch as lists, one row for each tile of output cells that sees some of them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            low, many = [], []
            for c in ("row", "col"):
                x = table.column(c).to_numpy().astype(np.int64) + padding
                low.append(np.maximum(-((reach - x) // stride), 0) // side)
                many.append(np.maximum(x // stride // side - low[-1] + 1, 0))
            n = many[0] * many[1]
            at = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            table = table.take(pa.array(at))
            top, left = (low[0][at] + nth // many[1][at]) * side, (low[1][at] + nth % many[1][at]) * side
            named = dict(zip([*(f"k{i}" for i in range(len(keys))), "top", "left", "row", "col", "v"], [*(table.column(k) for k in keys), top, left, table.column("row"), table.column("col"), table.column(value)]))
            on = list(named)[:-3]
            lists = pa.table(named).group_by(on, use_threads=False).aggregate([(c, "list") for c in ("row", "col", "v")])
            size = pa.nulls(lists.num_rows, pa.int32())
            whole = [lists.column(c).cast(pa.int32()) for c in ("top", "left")] + [size, size] + [lists.column(f"{c}_list").cast(pa.list_(pa.int32())) for c in ("row", "col")]
            yield from pa.table([*(lists.column(c) for c in on[:-2]), *whole, lists.column("v_list")], names=[*keys, *_PIECE]).to_batches()

    return run


_PIECE = ["_top", "_left", "_rows", "_cols", "_row", "_col", "_v"]
#: Pairs of a cell and a pixel that are counted at once.
_PAIRS = 2_000_000


def _majorities(keys: Sequence[str], value: str, kernel: int, dilation: int, padding: int, stride: int, side: int):
    """The output cells of a tile from its pieces; the row with the chip's size says where the grid ends."""
    reach = dilation * (kernel - 1)

    def run(table: pa.Table) -> pa.Table:
        top, left = (table.column(c)[0].as_py() for c in ("_top", "_left"))
        # without a size the tile lies beyond the grid
        bottom, right = (min(start + side, ((pc.max(table.column(c)).as_py() or 0) + 2 * padding - reach - 1) // stride + 1) for c, start in (("_rows", top), ("_cols", left)))
        width = max(right - left, 0)
        row, col = (pc.list_flatten(table.column(c)).to_numpy().astype(np.int64) for c in ("_row", "_col"))
        given = pc.list_flatten(table.column("_v")).combine_chunks()
        given = pa.concat_arrays([given, pa.array([0], given.type)])  # the last one is the padding
        if pa.types.is_floating(given.type):
            given = pc.add(given, pa.scalar(0, given.type))  # no negative zeros
        # classes in the order of ties: ascending, NaN, null
        there = given.is_valid().to_numpy(zero_copy_only=False)
        _, first, rank = np.unique(given.drop_null().to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        code = np.full(len(given), len(first))
        code[there] = rank
        places = np.append(np.flatnonzero(there)[first], np.flatnonzero(~there)[:1])
        zero, m = code[-1], len(places)
        order = np.argsort(row, kind="stable")
        row, col, code = row[order], col[order], code[:-1][order]
        once = np.zeros(len(row), bool)  # of pixels at one place, the first
        if len(row):
            once[np.unique((row - row.min()) * (np.ptp(col) + 1) + col - col.min(), return_index=True)[1]] = True
        made = [np.zeros((0, 3), np.int64)]
        step = max(1, _PAIRS // max(1, width * kernel * kernel))
        for a in range(top, bottom if width else top, step):
            b = min(a + step, bottom)
            lo, hi = np.searchsorted(row, [a * stride - padding, (b - 1) * stride - padding + reach + 1])
            cells, seen, places_seen = (b - a) * width, [np.zeros(0, np.int64)], np.zeros((b - a) * width, np.int64)
            for t in range(kernel):
                r, rest = np.divmod(row[lo:hi] + padding - t * dilation, stride)
                on = lo + np.flatnonzero((rest == 0) & (r >= a) & (r < b))
                for u in range(kernel):
                    c, rest = np.divmod(col[on] + padding - u * dilation, stride)
                    ok = (rest == 0) & (c >= left) & (c < right)
                    kept = on[ok]
                    cell = (r[kept - lo] - a) * width + c[ok] - left
                    seen.append(cell * m + code[kept])
                    places_seen += np.bincount(cell[once[kept]], minlength=cells)
            pairs, n = np.unique(np.concatenate(seen), return_counts=True)
            if padding:
                lacking = kernel * kernel - places_seen
                cell = np.flatnonzero(lacking > 0)
                pairs, same = np.unique(np.concatenate([pairs, cell * m + zero]), return_inverse=True)
                n = np.bincount(same, np.concatenate([n, lacking[cell]]), len(pairs)).astype(np.int64)
            cell, kind = np.divmod(pairs, m)
            best = np.lexsort((kind, -n, cell))
            best = best[np.diff(cell[best], prepend=-1) > 0]
            made.append(np.stack([a + cell[best] // max(width, 1), left + cell[best] % max(width, 1), kind[best]], 1))
        made = np.concatenate(made)
        key = pa.array(np.zeros(len(made), np.int64))
        out = [*(table.column(k).take(key) for k in keys), *(pa.array(made[:, i].astype(np.int32)) for i in (0, 1)), given.take(pa.array(places[made[:, 2]]))]
        return pa.table(out, names=[*keys, "row", "col", value])

    return run


def sliding_windows(df: DataFrame, keys: Sequence[str], value: str, kernel: int, dilation: int = 1, padding: int = 0, stride: int = 1, aggregation: str = "majority") -> DataFrame:
    """Output grid of a dilated, strided, zero-padded kernel: majority (smallest on ties) or the centre's value.

    With padding, zeros stand for every place without a pixel; without it, a cell that sees no pixel is left out.  For the majority the output
    cells are cut into tiles; pixels go to the tiles that see them as lists, so a task holds the windows of one tile.
    """
    reach = dilation * (kernel - 1)

    if aggregation == "center":
        size = _sizes(df.select(*keys, "row", "col", value), keys)
        mid = dilation * (kernel // 2)
        pos = lambda c: F.col(c) + padding - mid
        last = lambda s: F.floor((F.col(s) + 2 * padding - reach - 1) / F.lit(stride)) * stride
        ok = [(pos(c) >= 0) & (pos(c) % stride == 0) & (pos(c) <= last(s)) for c, s in (("row", "_rows"), ("col", "_cols"))]
        return size.where(ok[0] & ok[1]).select(*keys, F.floor(pos("row") / F.lit(stride)).cast("int").alias("row"), F.floor(pos("col") / F.lit(stride)).cast("int").alias("col"), value)
    side = max(tiles.SIDE // stride, 1)
    kinds = dict(df.dtypes)
    named = lambda *columns: ", ".join(f"`{c}` {k}" for c, k in columns)
    own = [(k, kinds[k]) for k in keys]
    known = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    pixels = known.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(*keys, "row", "col", value)
    types = ["int"] * 4 + ["array<int>"] * 2 + [f"array<{kinds[value]}>"]
    pieces = pixels.mapInArrow(_pieces(keys, value, reach, padding, stride, side), named(*own, *zip(_PIECE, types)))
    # one row with the chip's size for every tile of its grid
    size = known.groupBy(*keys).agg((F.max("row") + 1).cast("int").alias("_rows"), (F.max("col") + 1).cast("int").alias("_cols"))
    end = lambda c: F.floor((F.col(c) + 2 * padding - reach - 1) / F.lit(stride)).cast("int")
    grid = size.where((end("_rows") >= 0) & (end("_cols") >= 0))
    for start, c in (("_top", "_rows"), ("_left", "_cols")):
        grid = grid.withColumn(start, F.explode(F.sequence(F.lit(0), end(c), F.lit(side))))
    grid = grid.select(*keys, *_PIECE[:4], *[F.array().cast(t).alias(c) for c, t in zip(_PIECE[4:], types[4:])])
    return pieces.unionByName(grid).groupBy(*keys, "_top", "_left").applyInArrow(_majorities(keys, value, kernel, dilation, padding, stride, side), named(*own, ("row", "int"), ("col", "int"), (value, kinds[value])))


def shift(df: DataFrame, keys: Sequence[str], value: str, n: int, fill: float, axis: str = "col", name: str = "shifted") -> DataFrame:
    """The value n places before (n > 0) or after along an axis; fill beyond the edge."""
    line = "row" if axis == "col" else "col"
    w = Window.partitionBy(*keys, line).orderBy(axis)
    moved = F.lag(value, n, fill).over(w) if n >= 0 else F.lead(value, -n, fill).over(w)
    return df.withColumn(name, moved)


def tile_split(df: DataFrame, keys: Sequence[str], height: int, width: int, values: Sequence[str], pad: float | None = 0.0) -> DataFrame:
    """(keys, tile_row, tile_col, row, col, values): coordinates inside tiles; ragged tiles are filled up with pad (None: not)."""
    at = lambda c, n: F.floor(F.col(c) / F.lit(n)).cast("int")
    out = df.select(*keys, at("row", height).alias("tile_row"), at("col", width).alias("tile_col"), (F.col("row") % height).cast("int").alias("row"), (F.col("col") % width).cast("int").alias("col"), *values)
    if pad is None:
        return out
    tiles = out.select(*keys, "tile_row", "tile_col").distinct()
    grid = tiles.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    on = [*keys, "tile_row", "tile_col", "row", "col"]
    return grid.join(out, on, "left").select(*on, *[F.coalesce(F.col(v), F.lit(pad)).alias(v) for v in values])


def tile_join(tiles: DataFrame, keys: Sequence[str], height: int, width: int, values: Sequence[str]) -> DataFrame:
    """Chip coordinates from tile coordinates; the inverse of tile_split up to padding."""
    return tiles.select(*keys, (F.col("tile_row") * height + F.col("row")).alias("row"), (F.col("tile_col") * width + F.col("col")).alias("col"), *values)


def _chance(seed: int, keys: Sequence[str], salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1_000_000)) / F.lit(1_000_000.0)


def random_flip(df: DataFrame, keys: Sequence[str], axis: str = "col", p: float = 0.5, seed: int = 0) -> DataFrame:
    """Mirrors chips along an axis where a per-chip draw is at least p (p is the chance to stay)."""
    size = df.groupBy(*keys).agg((F.max(axis) + 1).alias("_n"))
    flip = _chance(seed, keys, "flip" + axis) >= p
    return df.join(size, list(keys)).withColumn(axis, F.when(flip, F.col("_n") - 1 - F.col(axis)).otherwise(F.col(axis))).drop("_n")


def random_crop(df: DataFrame, keys: Sequence[str], height: int, width: int, seed: int = 0) -> DataFrame:
    """A height x width window per chip, the same for all columns; coordinates start at 0 again."""
    x = _sizes(df, keys)
    off = lambda size, want, salt: F.floor(_chance(seed, keys, salt) * F.greatest(F.col(size) - want + 1, F.lit(1)))
    x = x.withColumn("_r", off("_rows", height, "row")).withColumn("_c", off("_cols", width, "col"))
    x = x.withColumn("row", (F.col("row") - F.col("_r")).cast("int")).withColumn("col", (F.col("col") - F.col("_c")).cast("int"))
    return x.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)).drop("_r", "_c", "_rows", "_cols")


def zonal_stats(df: DataFrame, keys: Sequence[str], zone: str, bands: Sequence[str], stats: Sequence[str] = ("mean", "var", "std"), extra: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Per zone: <band>-<stat> of mean, var, std (population, NaN skipped) or majority (smallest on ties); extra adds own aggregates."""
    make = {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "majority": lambda x: F.mode(x, True), **(extra or {})}
    cols = []
    for b in bands:
        x = F.col(f"`{b}`").cast("double")
        x = F.when(~F.isnan(x), x)
        cols += [make[s](x if s != "majority" else F.col(f"`{b}`")).alias(f"{b}-{s}") for s in stats]
    return df.groupBy(*keys, zone).agg(*cols)


def zone_lookup(pixels: DataFrame, zones: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every pixel with the values of its zone."""
    return pixels.join(zones, list(on), "left")


def boxes(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Bounding box of every label of every chip (limits included)."""
    return df.groupBy(*keys, label).agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


def box_union(a: str, b: str) -> dict[str, Column]:
    lo = lambda c: F.least(F.col(f"{a}{c}_min"), F.col(f"{b}{c}_min"))
    hi = lambda c: F.greatest(F.col(f"{a}{c}_max"), F.col(f"{b}{c}_max"))
    return {"row_min": lo("row"), "row_max": hi("row"), "col_min": lo("col"), "col_max": hi("col")}


def box_intersection(a: str, b: str) -> dict[str, Column]:
    """Empty intersections have max < min."""
    lo = lambda c: F.greatest(F.col(f"{a}{c}_min"), F.col(f"{b}{c}_min"))
    hi = lambda c: F.least(F.col(f"{a}{c}_max"), F.col(f"{b}{c}_max"))
    return {"row_min": lo("row"), "row_max": hi("row"), "col_min": lo("col"), "col_max": hi("col")}


def crop_to_box(df: DataFrame, box: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels inside their chip's box, with coordinates from the box's corner."""
    x = df.join(box, list(keys)).where(F.col("row").between(F.col("row_min"), F.col("row_max")) & F.col("col").between(F.col("col_min"), F.col("col_max")))
    return x.withColumns({"row": F.col("row") - F.col("row_min"), "col": F.col("col") - F.col("col_min")}).drop("row_min", "row_max", "col_min", "col_max")
