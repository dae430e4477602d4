"""Standard sets of metrics over one contingency, as long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster_metrics as K
from .results import union_all


def too_many_predictions(table: DataFrame, keys: Sequence[str], limit: float) -> bool:
    """Whether keys hold limit or more different predictions on average; per-key metrics are then left out."""
    per = table.where("n > 0").groupBy(*keys).agg(F.count_distinct("pred").alias("k"))
    mean = per.agg(F.avg("k")).first()[0]
    return mean is not None and mean >= limit


def bundle(table: DataFrame, keys: Sequence[str], exclude_clouds: bool = True, clustering: bool = False, match: str = "max_agree") -> DataFrame:
    """(keys, metric, class_name, value) of a contingency (keys, label, pred, n).

    Class metrics are of the predictions as they are, or, if predictions are clusters, of clusters mapped to classes
    (match: max_agree or assignment) with that suffix.  clustering adds pair, information and set metrics.
    """
    keys = list(keys)
    t = table.where("label <> -1") if exclude_clouds else table
    suffix = ".no_clouds" if exclude_clouds else ""
    plain = K.multiclass_scores(t, keys)
    parts = [_class_rows(plain, keys, suffix)]
    if clustering:
        mapped = (K.max_agreement if match == "max_agree" else K.assignment)(t, keys)
        parts.append(_class_rows(K.multiclass_scores(mapped, keys), keys, f".{match}{suffix}"))
        wide = [K.pair_scores(K.pair_confusion(t, keys), keys), K.information_scores(t, keys), K.cluster_f(t, keys), K.bcubed(t, keys), K.balanced_pairs(t, keys)]
        parts += [_rows(w, keys, suffix) for w in wide]
    return union_all(parts)


def bundle_unless_many(table: DataFrame, keys: Sequence[str], limit: float, **how) -> DataFrame:
    """The rows of bundle, or none of them if keys hold limit or more different predictions on average."""
    out = bundle(table, keys, **how)
    return out.where(F.lit(False)) if too_many_predictions(table, keys, limit) else out


def _rows(wide: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    typed = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    long = typed.unpivot(keys, names, "metric", "value")
    return long.select(*keys, F.concat("metric", F.lit(suffix)).alias("metric"), F.lit(None).cast("int").alias("class_name"), "value")


def _class_rows(scores: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    names = ["precision", "recall", "f1", "iou"]
    long = scores.select(*keys, F.col("class_name").cast("int").alias("class_name"), *names).unpivot([*keys, "class_name"], names, "metric", "value")
    long = long.select(*keys, F.concat("metric", F.lit(suffix)).alias("metric"), "class_name", "value")
    overall = scores.groupBy(*keys).agg(F.max("accuracy").alias("value")).select(*keys, F.lit("accuracy" + suffix).alias("metric"), F.lit(None).cast("int").alias("class_name"), "value")
    return long.unionByName(overall)
