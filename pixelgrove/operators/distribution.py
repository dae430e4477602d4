"""Reports on labels: counts, shares and chip types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, region: str = "region", label: str = "label") -> DataFrame:
    """Pixels by (region, class) and, with a null region, by class."""
    first = df.groupBy(F.col(region).alias("region"), F.col(label).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    return first.unionByName(first.groupBy("class_name").agg(F.sum("n").alias("n")).withColumn("region", F.lit(None).cast(df.schema[region].dataType)))


def region_share(df: DataFrame, region: str = "region") -> DataFrame:
    """Share of all pixels per region, most frequent first, then by region descending."""
    per = df.groupBy(F.col(region).alias("region")).agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("_t"))
    return per.join(F.broadcast(whole), F.lit(True)).select("region", "n", (F.col("n") / F.col("_t")).alias("share")).orderBy(F.desc("n"), F.desc("region"))


def class_share(df: DataFrame, region: str = "region", label: str = "label") -> DataFrame:
    """Share of each class within its region."""
    per = df.groupBy(F.col(region).alias("region"), F.col(label).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("region")))


def chip_flags(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per chip: only dry, only no data, no water; and the type by name."""
    x = F.col(label)
    g = df.groupBy(*keys).agg(F.every(x == 0).alias("dry_only"), F.every(x == -1).alias("no_data_only"), F.every(x != 1).alias("no_flood"))
    kind = F.when(F.col("no_data_only"), "no data").when(F.col("dry_only"), "dry").when(F.col("no_flood"), "dry and no data").otherwise("flood")
    return g.withColumn("chip_type", kind)


def chip_type_share(flags: DataFrame, region: str = "region") -> DataFrame:
    """Chips by (region, type): share within the region and overall share of the type."""
    per = flags.groupBy(F.col(region).alias("region"), "chip_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = per.groupBy("chip_type").agg(F.sum("n").alias("_k"))
    whole = per.agg(F.sum("n").alias("_t"))
    out = per.withColumn("share_in_region", F.col("n") / F.sum("n").over(Window.partitionBy("region")))
    out = out.join(F.broadcast(kinds), "chip_type").join(F.broadcast(whole), F.lit(True))  # one row per type, one in all
    return out.select("region", "chip_type", "n", "share_in_region", (F.col("_k") / F.col("_t")).alias("share_overall"))
