"""Train and evaluate one configuration: features, mask, fit, predict, contingency, objective."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import contingency as C
from ..operators import estimators, metrics, params, spatial, threshold
from .spaces import build


def evaluate(
    df: DataFrame,
    space: Mapping[str, Column],
    estimator,
    keys: Sequence[str],
    *,
    split: str = "split",
    label: str = "label",
    train: str = "train",
    test: str = "valid",
    speckle: tuple[str, Sequence[str]] | None = None,
    standardise: bool = True,
    balanced: bool = False,
) -> DataFrame:
    """(objective, n_keys): mean accuracy over the chips (keys) of the test split.

    speckle: (filter, radar bands), applied to the pixel table (row, col) first.
    """
    if speckle:
        name, radar = speckle
        clean = spatial.speckle_filter(name, df, [split, *keys], list(radar))
        df = df.drop(*radar).join(clean, [split, *keys, "row", "col"])
    features = list(space)
    rows = build(df, space, [split, *keys, label])
    if standardise:
        fitted = params.fit_standard(rows.where(F.col(split) == train), features)
        rows = params.apply(rows, params.parameters(fitted, features, "standard"), "standard")
    model = estimators.fit(rows.where(F.col(split) == train), estimator, features, label, balanced=balanced)
    scored = estimators.predict(model, rows.where(F.col(split) == test))
    counts = C.binary_counts(scored, list(keys), label, "prediction")
    return metrics.objective(counts, metrics.accuracy())


def sweep_thresholds(df: DataFrame, keys: Sequence[str], value: str, label: str, bins: Sequence[int], methods: Sequence[str] = ("otsu", "minimum_error")) -> DataFrame:
    """(method, bins, objective, n_keys) of every configuration of a threshold classifier, the best first.

    A pixel is positive below its chip's threshold; the objective is the mean accuracy over the chips, labels below 0 left out.  All
    configurations are evaluated in one job over one histogram per chip and label: bins must divide the largest of them, whose histogram
    gives all coarser ones, and the counts on either side of a threshold follow from the same histogram, so pixels are read once.
    """
    finest = max(bins)
    if any(finest % b for b in bins):
        raise ValueError(f"every number of bins must divide {finest}")
    if unknown := set(methods) - set(threshold.CUTS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    x = F.col(value).cast("double")
    cells = df.select(*keys, x.alias("_x"), F.col(label).alias("_l")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    span = cells.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    same = F.col("_a") == F.col("_b")
    span = span.select(*keys, F.when(same, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("low"), F.when(same, F.lit(1.0)).otherwise(F.col("_b") - F.col("_a")).alias("span"))
    place = F.least(F.floor((F.col("_x") - F.col("low")) / F.col("span") * finest), F.lit(finest - 1)).cast("int")
    of = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    fine = cells.join(span, list(keys)).groupBy(*keys, "low", "span", place.alias("_fine")).agg(F.count(F.lit(1)).alias("c"), of(F.col("_l") == 1).alias("pos"), of(F.col("_l") == 0).alias("neg"))
    # every number of bins as a further key: a coarse bin is a run of fine ones
    coarse = fine.withColumn("bins", F.explode(F.array(*[F.lit(b) for b in bins])))
    coarse = coarse.withColumn("bin", F.floor(F.col("_fine") * F.col("bins") / F.lit(finest)).cast("int"))
    wide = [*keys, "bins"]
    coarse = coarse.groupBy(*wide, "low", "span", "bin").agg(*[F.sum(c).alias(c) for c in ("c", "pos", "neg")])
    grid = coarse.groupBy(*wide, "low", "span").agg(F.sum("c").alias("_n")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    hist = grid.join(coarse.select(*wide, "bin", "c", "pos", "neg"), [*wide, "bin"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("c", "pos", "neg")})
    width = F.col("span") / F.col("bins")
    hist = hist.select(*wide, "bin", "low", width.alias("width"), (F.col("c") / (F.col("_n") * width)).alias("h"), "pos", "neg")
    counts = hist.select(*wide, "bin", "pos", "neg")
    found = None
    for name in methods:
        cut = threshold.CUTS[name](hist, wide).select(*wide, "cut").withColumn("method", F.lit(name))
        found = cut if found is None else found.unionByName(cut)
    below = F.col("bin") <= F.col("cut")
    right = F.sum(F.when(below, F.col("pos")).otherwise(F.col("neg")))
    each = counts.join(found, wide).groupBy("method", *wide).agg((right / F.nullif(F.sum(F.col("pos") + F.col("neg")), F.lit(0))).alias("accuracy"))
    out = each.groupBy("method", "bins").agg(F.avg("accuracy").alias("objective"), F.count("accuracy").alias("n_keys"))
    return out.orderBy(F.desc_nulls_last("objective"), "method", "bins")
