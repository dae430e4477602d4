"""Fitted channel parameters: ranges and standardisation, kept as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import EPS, range_clip, standardised

SCHEMA = "channel string, filter string, kind string, offset double, scale double"


def _fit(df: DataFrame, channels: Sequence[str], kind: str, filter_name: str | None) -> DataFrame:
    cols = []
    for i, c in enumerate(channels):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)  # NaN is no value
        if kind == "range":
            low, scale = F.min(x), F.max(x) - F.min(x)
        else:
            low, scale = F.avg(x), F.stddev_pop(x)
        cols.append(F.struct(F.lit(c).alias("channel"), low.alias("offset"), F.when(F.abs(scale) < EPS, 1.0).otherwise(scale).alias("scale")).alias(f"c{i}"))
    rows = df.agg(F.array(*cols).alias("p")).select(F.inline("p"))  # one pass over all channels
    return rows.select("channel", F.lit(filter_name).cast("string").alias("filter"), F.lit(kind).alias("kind"), "offset", "scale")


def fit_range(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Minimum and width of each channel; a width under EPS becomes 1."""
    return _fit(df, channels, "range", None)


def fit_standard(df: DataFrame, channels: Sequence[str], filter_name: str | None = None) -> DataFrame:
    """Mean and population deviation of each channel, without NaN; a deviation under EPS becomes 1."""
    return _fit(df, channels, "standard", filter_name)


def update(stored: DataFrame, fitted: DataFrame) -> DataFrame:
    """stored plus the fitted rows whose (channel, filter, kind) it lacks."""
    same = (F.col("s.channel") == F.col("f.channel")) & F.col("s.filter").eqNullSafe(F.col("f.filter")) & (F.col("s.kind") == F.col("f.kind"))
    return stored.unionByName(fitted.alias("f").join(stored.alias("s"), same, "left_anti"))


def parameters(stored: DataFrame, channels: Sequence[str], kind: str, filter_name: str | None = None) -> dict[str, tuple[float, float]]:
    """(offset, scale) by channel, as literals for expressions; missing ones are an error."""
    rows = stored.where((F.col("kind") == kind) & F.col("filter").eqNullSafe(F.lit(filter_name)) & F.col("channel").isin(*channels)).collect()
    found = {r["channel"]: (r["offset"], r["scale"]) for r in rows}
    missing = [c for c in channels if c not in found]
    if missing:
        raise LookupError(f"no {kind} parameters for {missing}")
    return found


def _missing(stored: DataFrame, channels: Sequence[str], kind: str, split: str, filter_name: str | None) -> list[str]:
    """The channels that the table lacks; only the train split may ask for them."""
    have = {r["channel"] for r in stored.where((F.col("kind") == kind) & F.col("filter").eqNullSafe(F.lit(filter_name))).select("channel").collect()}
    missing = [c for c in channels if c not in have]
    if missing and split != "train":
        raise LookupError(f"the {split} split may not fit {missing}")
    return missing


def ensure(df: DataFrame, stored: DataFrame, channels: Sequence[str], kind: str, split: str, filter_name: str | None = None) -> DataFrame:
    """The stored table, with missing channels fitted on df; only the train split may fit."""
    missing = _missing(stored, channels, kind, split, filter_name)
    if not missing:
        return stored
    return update(stored, _fit(df, missing, kind, None if kind == "range" else filter_name))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table that a side file (a folder of JSON lines) holds; an empty one where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def ensure_file(df: DataFrame, path: str, channels: Sequence[str], kind: str, split: str, filter_name: str | None = None) -> DataFrame:
    """The table of the side file at path; channels that it lacks are fitted on df, by the train split only, and their rows added to the file.

    The file is not touched where nothing is missing.  A failed write leaves no rows behind, so the call can be repeated.
    """
    spark = df.sparkSession
    filter_name = None if kind == "range" else filter_name  # ranges are those of the unfiltered channels
    missing = _missing(load(spark, path), channels, kind, split, filter_name)
    if missing:
        _fit(df, missing, kind, filter_name).coalesce(1).write.mode("append").json(path)
    return load(spark, path)


def apply(df: DataFrame, params: dict[str, tuple[float, float]], kind: str) -> DataFrame:
    """Range clip or standardise the channels in place, as one projection."""
    make = range_clip if kind == "range" else standardised
    return df.withColumns({c: make(c, *p) for c, p in params.items()})
