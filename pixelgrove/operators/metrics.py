"""Classification quality over binary counts, one expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(float(empty))).otherwise(a / F.nullif(b, F.lit(0)))


def cells(cls: int) -> tuple[Column, Column, Column, Column]:
    """tp, fp, fn, tn of a class of binary_counts (labels first)."""
    o = 1 - cls
    return F.col(f"n{cls}{cls}"), F.col(f"n{o}{cls}"), F.col(f"n{cls}{o}"), F.col(f"n{o}{o}")


def precision(cls: int, zero: float = 1) -> Column:
    tp, fp, _, _ = cells(cls)
    return _share(tp, tp + fp, zero)


def recall(cls: int, zero: float = 1) -> Column:
    tp, _, fn, _ = cells(cls)
    return _share(tp, tp + fn, zero)


def f_score(cls: int, beta: float = 1.0, zero: float = 0) -> Column:
    """0 (or zero) if precision or recall is 0."""
    p, r = precision(cls), recall(cls)
    return F.when((p == 0) | (r == 0), F.lit(float(zero))).otherwise((1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)))


def iou(cls: int, zero: float = 1) -> Column:
    tp, fp, fn, _ = cells(cls)
    return _share(tp, tp + fp + fn, zero)


def accuracy() -> Column:
    good = F.col("n00") + F.col("n11")
    return good / F.nullif(good + F.col("n01") + F.col("n10"), F.lit(0))


def scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Wide table of accuracy and, per class, precision, recall, F1 and both IoU variants."""
    out = [accuracy().alias("accuracy")]
    for c in (0, 1):
        out += [precision(c).alias(f"precision_{c}"), recall(c).alias(f"recall_{c}"), f_score(c).alias(f"f1_{c}"), iou(c, 1).alias(f"iou1_{c}"), iou(c, 0).alias(f"iou0_{c}")]
    return counts.select(*keys, *out)


def long_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, class_name, value): one row per metric and class; class_name is null for overall metrics."""
    names = [c for c in wide.columns if c not in keys]
    rows = wide.unpivot(keys, names, "name", "value")
    cls = F.regexp_extract("name", r"_(\d+)$", 1)
    return rows.select(*keys, F.regexp_replace("name", r"_\d+$", "").alias("metric"), F.when(cls != "", cls.cast("int")).alias("class_name"), "value")


def objective(counts: DataFrame, value: Column) -> DataFrame:
    """Mean of a metric over keys with a valid pixel (keys without are in neither numerator nor denominator)."""
    valid = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") > 0
    return counts.where(valid).agg(F.avg(value).alias("objective"), F.count(F.lit(1)).alias("n_keys"))
