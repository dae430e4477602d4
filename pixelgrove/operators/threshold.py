"""Histogram thresholds per image (keys) and band: Otsu, minimum error, and their tiled variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, bin, h, low, width): density histogram over each key's own range, empty bins included.

    A constant key gets the range value - 0.5 to value + 0.5.
    """
    x = F.col(value).cast("double")
    clean = df.select(*keys, F.when(~F.isnan(x), x).alias("x")).where("x is not null")
    span = clean.groupBy(*keys).agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.count(F.lit(1)).alias("_n"))
    same = F.col("_a") == F.col("_b")
    span = span.select(*keys, "_n", F.when(same, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("low"), F.when(same, F.lit(1.0)).otherwise(F.col("_b") - F.col("_a")).alias("span"))
    place = F.least(F.floor((F.col("x") - F.col("low")) / F.col("span") * bins), F.lit(bins - 1)).cast("int")
    counts = clean.join(span, list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.col("span") / bins
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.coalesce("c", F.lit(0)) / (F.col("_n") * width)).alias("h"), "low", width.alias("width"))


def _sums(hist: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """Running and total count, first and second moments of the histogram; x: the bins' positions."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("x", x)
    parts = {"c": F.col("h"), "m": F.col("h") * F.col("x"), "s": F.col("h") * F.col("x") * F.col("x")}
    whole = Window.partitionBy(*keys)
    return h.withColumns({**{k: F.sum(v).over(up) for k, v in parts.items()}, **{f"{k}_all": F.sum(v).over(whole) for k, v in parts.items()}})


def _cut() -> Column:
    """A bin and its upper edge."""
    return F.struct(F.col("bin").alias("cut"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("threshold"))


def otsu_bin(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cut, threshold): the bin with the largest between-class variance (the first on ties) of each histogram, and its upper edge."""
    t = _sums(hist, keys, F.col("bin") + F.lit(0.5))
    w0, w1 = F.col("c"), F.col("c_all") - F.col("c")
    gap = F.col("m") / F.nullif(w0, F.lit(0.0)) - (F.col("m_all") - F.col("m")) / F.nullif(w1, F.lit(0.0))
    t = t.withColumn("score", F.round(w0 * w1 * gap * gap / (F.col("c_all") * F.col("c_all")), 12))
    return t.groupBy(*keys).agg(F.max_by(_cut(), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("bin"))).alias("_c")).select(*keys, "_c.*")


def minimum_error_bin(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cut, threshold) after Kittler and Illingworth: two normal classes with least overlap; positions rescaled to
    [0, 1], 1e-9 guards the logarithms.  Without any finite cost the middle bin is taken."""
    last = F.max("bin").over(Window.partitionBy(*keys))
    t = _sums(hist.withColumns({"h": F.col("h") * F.col("width"), "_last": last}), keys, F.col("bin") / F.col("_last").cast("double"))
    eps = 1e-9
    p, q = F.col("c"), F.col("c_all") - F.col("c")
    mu = lambda m, w: m / F.nullif(w, F.lit(0.0))
    var = lambda s, m, w: s / F.nullif(w, F.lit(0.0)) - mu(m, w) * mu(m, w)
    sd0 = F.sqrt(F.greatest(var(F.col("s"), F.col("m"), p), F.lit(0.0)) + eps)
    sd1 = F.sqrt(F.greatest(var(F.col("s_all") - F.col("s"), F.col("m_all") - F.col("m"), q), F.lit(0.0)) + eps)
    cost = 1 + 2 * (p * F.log(sd0) + q * F.log(sd1)) - 2 * (p * F.log(p + eps) + q * F.log(q + eps))
    t = t.withColumn("cost", F.when((p > eps) & (q > eps), F.round(cost, 12)))
    best = F.min_by(_cut(), F.when(F.col("cost").isNotNull(), F.struct("cost", "bin")))
    middle = F.max(F.when(F.col("bin") == F.floor((F.col("_last") + 1) / 2), _cut()))
    return t.groupBy(*keys).agg(F.coalesce(best, middle).alias("_c")).select(*keys, "_c.*")


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold) of otsu_bin."""
    return otsu_bin(histogram(df, keys, value, bins), keys).drop("cut")


def minimum_error(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold) of minimum_error_bin."""
    return minimum_error_bin(histogram(df, keys, value, bins), keys).drop("cut")


METHODS = {"otsu": otsu, "minimum_error": minimum_error}
CUTS = {"otsu": otsu_bin, "minimum_error": minimum_error_bin}


def apply_threshold(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str, name: str = "pred") -> DataFrame:
    """1 below the key's threshold, else 0."""
    return df.join(thresholds, list(keys)).withColumn(name, (F.col(value) < F.col("threshold")).cast("int")).drop("threshold")


def combine_bands(first: str, second: str | None = None, how: str = "and") -> Column:
    """One band's decision, or two bands' AND / OR."""
    if second is None:
        return F.col(first)
    return F.col(first).bitwiseAND(F.col(second)) if how == "and" else F.col(first).bitwiseOR(F.col(second))


def tiled(df: DataFrame, keys: Sequence[str], value: str, method: str = "otsu", tile: int = 256, smallest: int = 16, percentile: float = 0.95, top: int = 5, spread: float = 5.0, merged: bool = False, bins: int = 256) -> DataFrame:
    """(keys, threshold) from the most varied tiles.

    Tiles of side tile, tile / 2 ... down to smallest are scored in one pass.  A tile with over 10 % missing
    pixels is skipped; its score is the deviation of its four quadrant means.  At the largest side that has any,
    tiles over the percentile of scores (at the first side also with a mean up to the chip's mean) are
    taken; without any, the tiles on the diagonal.  The best top tiles by score give
    thresholds, which are averaged; if their deviation is over spread, or merged is set, the tiles'
    pixels give one threshold instead.
    """
    sides = []
    side = tile
    while side >= smallest:
        sides.append(side)
        side //= 2
    x = F.col(value).cast("double")
    px = df.select(*keys, "row", "col", F.when(~F.isnan(x), x).alias("x"))
    whole = px.groupBy(*keys).agg(F.avg("x").alias("_mean"))
    px = px.withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides])))
    at = lambda c: F.floor(F.col(c) / F.col("side")).cast("int")
    half = lambda c: (F.col(c) % F.col("side") >= F.col("side") / 2).cast("int")
    px = px.withColumns({"tr": at("row"), "tc": at("col"), "quarter": half("row") * 2 + half("col")})
    on = [*keys, "side", "tr", "tc"]
    quarters = px.groupBy(*on, "quarter").agg(F.avg("x").alias("m"), F.sum("x").alias("s"), F.count("x").alias("n"), F.count(F.lit(1)).alias("all"))
    # rounded, and compared inside windows: a second run of the same sums may differ in the last digit, which a score that is the limit must not
    tiles = quarters.groupBy(*on).agg(F.round(F.stddev_pop("m"), 12).alias("score"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("n").alias("n"), F.sum("all").alias("all"))
    tiles = tiles.where(F.col("n") >= 0.9 * F.col("all")).join(whole, list(keys))
    tiles = tiles.withColumn("_limit", F.percentile("score", percentile).over(Window.partitionBy(*keys, "side")))
    good = (F.col("score") > F.col("_limit")) & ((F.col("side") != tile) | (F.col("mean") <= F.col("_mean")))
    tiles = tiles.withColumn("_good", good)
    tiles = tiles.withColumn("_side", F.max(F.when(F.col("_good"), F.col("side"))).over(Window.partitionBy(*keys)))
    pick = F.when(F.col("_side").isNotNull(), F.col("_good") & (F.col("side") == F.col("_side"))).otherwise((F.col("side") == tile) & (F.col("tr") == F.col("tc")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "tr", "tc"))
    tiles = tiles.where(pick).withColumn("_rank", rank).where(F.col("_rank") <= top).select(*on)
    pixels = px.join(tiles, on).where("x is not null")
    each = METHODS[method](pixels, on, "x", bins).groupBy(*keys).agg(F.avg("threshold").alias("_one"), F.stddev_pop("threshold").alias("_sd"))
    together = METHODS[method](pixels, keys, "x", bins).withColumnRenamed("threshold", "_all")
    return each.join(together, list(keys)).select(*keys, F.when(F.lit(merged) | (F.col("_sd") > spread), F.col("_all")).otherwise(F.col("_one")).alias("threshold"))
