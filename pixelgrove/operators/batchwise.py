"""Metrics of random batches of chips.

Chips are shuffled n_iter times by a hash of (seed, iteration, chip), cut into batches, and each
batch's summed counts give its metrics.  Rows are chips x iterations: the work is asked for.  Chips are ranked
within ranges of the hash (its first hexadecimal digits), and the counts of the ranges before are added, so no task
holds more than some RANGE_ROWS chips of an iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Chips of an iteration that one window partition holds, about.
RANGE_ROWS = 4000


def remap(table: DataFrame, keys: Sequence[str], label_of_interest: int = 1, preds_of_interest: Sequence[int] = (1,), exclude: Sequence[int] = (-1,)) -> DataFrame:
    """Binary counts per key: the class of interest against the rest, several predictions may count as positive."""
    t = table.where(~F.col("label").isin(*exclude)) if exclude else table
    pos, hit = F.col("label") == label_of_interest, F.col("pred").isin(*preds_of_interest)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return t.groupBy(*keys).agg(part(pos & hit).alias("tp"), part(~pos & hit).alias("fp"), part(pos & ~hit).alias("fn"), part(~pos & ~hit).alias("tn"))


def batch_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Edge rules: no pixels: accuracy null.  Without true positives: neither fp nor fn: all 1; no fn:
    recall 1, precision 0; no fp: recall 0, precision 1; else 0.  F1 of two zeros is 1."""
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    none = tp == 0
    iou = F.when(none, F.when((fp == 0) & (fn == 0), 1.0).otherwise(0.0)).otherwise(ratio(tp, tp + fp + fn))
    precision = F.when(none, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(ratio(tp, tp + fp))
    recall = F.when(none, F.when(fn == 0, 1.0).otherwise(0.0)).otherwise(ratio(tp, tp + fn))
    f1 = F.when((precision == 0) & (recall == 0), 1.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return {"iou": iou, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": f1}


def batches(counts: DataFrame, chip: str, n_iter: int, size: int, seed: int = 42) -> DataFrame:
    """(iter, batch, tp, fp, fn, tn) of every batch; the last one of an iteration may be smaller."""
    rows = counts.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    order = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("iter").cast("string"), F.col(chip).cast("string")).cast("binary"))
    rows = rows.withColumn("_o", order)
    digits, chips = 0, counts.count()
    while chips > RANGE_ROWS << 4 * digits:
        digits += 1
    rows = rows.withColumn("_range", F.substring("_o", 1, digits))
    rank = F.row_number().over(Window.partitionBy("iter", "_range").orderBy("_o", F.col(chip))).cast("long")
    if digits:
        before = F.sum("_n").over(Window.partitionBy("iter").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        ahead = rows.groupBy("iter", "_range").agg(F.count(F.lit(1)).alias("_n")).select("iter", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
        rows = rows.withColumn("_r", rank).join(ahead, ["iter", "_range"])
        rank = F.col("_r") + F.col("_before")
    rows = rows.withColumn("batch", F.floor((rank - 1) / F.lit(size)))
    return rows.groupBy("iter", "batch").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def batch_metrics(counts: DataFrame, chip: str, n_iter: int, size: int, seed: int = 42) -> DataFrame:
    """Per metric: mean and deviation over batches, then mean, deviation, minimum and maximum over iterations."""
    each = batches(counts, chip, n_iter, size, seed)
    values = batch_scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    each = each.select("iter", *[v.alias(k) for k, v in values.items()]).unpivot("iter", list(values), "metric", "value")
    per = each.groupBy("iter", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    over = [f(c).alias(f"{c}_{n}") for c in ("mean", "std") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return per.groupBy("metric").agg(*over).withColumn("batch_size", F.lit(size))
