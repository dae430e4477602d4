"""Contingency tables (label x prediction counts) as long rows, and their levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred", check: Column | None = None) -> DataFrame:
    """(keys, label, pred, n): one partial aggregation and one shuffle of counts."""
    if check is not None:
        df = df.where(check)
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def densify(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds zero rows: within a key every present label meets every present prediction.

    Both sides are distinct classes of one key, so rows grow with classes, not with data.
    """
    labels, preds = table.select(*keys, "label").distinct(), table.select(*keys, "pred").distinct()
    cells = labels.join(preds, list(keys)) if keys else labels.join(F.broadcast(preds), F.lit(True))
    on = [*keys, "label", "pred"]
    return cells.join(table, on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))


def merge(tables: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Sum of contingencies with possibly different classes."""
    out = tables[0].select(*keys, "label", "pred", "n")
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, "label", "pred", "n"))
    return out.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))


def normalised(table: DataFrame, keys: Sequence[str] = (), exclude_clouds: bool = True) -> DataFrame:
    """Classes 0 and 1 (and label -1 if clouds are kept), zero cells added; keys without a valid pixel are gone."""
    labels = [0, 1] if exclude_clouds else [-1, 0, 1]
    cell = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("pred") == b), F.col("n"))), F.lit(0)).alias("n"))
    valid = F.sum(F.when(F.col("label") != -1, F.col("n")).otherwise(0))
    wide = table.groupBy(*keys).agg(F.array(*[cell(a, b) for a in labels for b in (0, 1)]).alias("cells"), valid.alias("_valid")).where("_valid > 0")
    return wide.select(*keys, F.inline("cells"))


def binary_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred", n: str | None = None) -> DataFrame:
    """One row per key: n00 n01 n10 n11 (label, prediction) and invalid; straight from pixels or from counts (n)."""
    weight = F.col(n) if n else F.lit(1)
    return df.groupBy(*keys).agg(*_cells(label, pred, weight))


def _cells(label: str, pred: str, weight: Column) -> list[Column]:
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col(label) == a) & (F.col(pred) == b), weight)), F.lit(0)).alias(f"n{a}{b}")
    return [*[cell(a, b) for a in (0, 1) for b in (0, 1)], F.coalesce(F.sum(F.when(F.col(label) == -1, weight)), F.lit(0)).alias("invalid")]


def by_level(df: DataFrame, region: str = "region", chip: str = "chip", label: str = "label", pred: str = "pred") -> DataFrame:
    """binary_counts per chip, per region and in total, in one pass over grouping sets.

    level tells the grouping; the keys that a level sums over are null.
    """
    first = binary_counts(df, [region, chip], label, pred)  # pixels shrink to chips before the expansion
    sums = [F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11", "invalid")]
    grouped = first.groupingSets([[F.col(region), F.col(chip)], [F.col(region)], []], F.col(region), F.col(chip)).agg(F.grouping_id().alias("_g"), *sums)
    return grouped.withColumn("level", F.when(F.col("_g") == 0, "chip").when(F.col("_g") == 1, "region").otherwise("total")).drop("_g")


def with_valid(counts: DataFrame) -> DataFrame:
    """Only keys with a valid pixel yield metrics."""
    return counts.where(F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") > 0)
