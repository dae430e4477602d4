"""Bridge views: the analytics roles (raster, bands, scored pixels, metrics ...) over general tables.

Each view exists twice: as a DataFrame plan and as the SQL text that gives the same rows elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, chip, row, col, v): vectors as chips of 16 rows; the last chip may be ragged."""
    t = table(spark, sf_dir, "embeddings")
    chip = F.floor(F.col("vec_id") / 16).cast("int")
    return t.select((chip % 5).alias("region"), chip.alias("chip"), (F.col("vec_id") % 16).cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pix, line, b1 ... b6): spectral bands, with zero-sum pixels."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("pix"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("b1"), F.col("l_tax").alias("b2"), (F.col("l_quantity") / 50).alias("b3"), (F.col("l_extendedprice") / 100000).alias("b4"), (F.col("l_discount") + F.col("l_tax")).alias("b5"), (F.col("l_linenumber") / 7).alias("b6"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, chip, label, pred)."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    t = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    return t.select(F.col("n_regionkey").alias("region"), F.col("l_suppkey").alias("chip"), label.alias("label"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("pred"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, pred): classes against the position of the largest of four dimensions."""
    t = table(spark, sf_dir, "embeddings")
    first = F.slice("embedding", 1, 4)
    return t.select("label", (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("pred"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, f1 ... f4): training rows."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i + 1}") for i in range(4)])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predecessor, successor): a binary tree rooted at 0."""
    t = table(spark, sf_dir, "part").where("p_partkey >= 1")
    return t.select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("predecessor"), F.col("p_partkey").alias("successor"))


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config, seed, data_id, class, value)."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_returnflag").alias("config"), F.col("l_linenumber").alias("seed"), F.col("l_orderkey").alias("data_id"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("class"), F.col("l_discount").alias("value"))


#: The same views as SQL common table expressions.
SQL = {
    "raster": "raster AS (SELECT ((vec_id // 16) % 5)::INT AS region, (vec_id // 16)::INT AS chip, (vec_id % 16)::INT AS row, (generate_subscripts(embedding, 1) - 1)::INT AS col, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "bands": "bands AS (SELECT l_orderkey AS pix, l_linenumber AS line, l_discount AS b1, l_tax AS b2, l_quantity / 50 AS b3, l_extendedprice / 100000 AS b4, l_discount + l_tax AS b5, l_linenumber / 7 AS b6 FROM lineitem)",
    "scored": "scored AS (SELECT n_regionkey AS region, l_suppkey AS chip, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS label, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS pred FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)",
    "clusters": "clusters AS (SELECT label, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::INT AS pred FROM embeddings)",
    "feat": "feat AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label % 2 AS y, embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2, embedding[3]::DOUBLE AS f3, embedding[4]::DOUBLE AS f4 FROM embeddings)",
    "edges": "edges AS (SELECT p_partkey // 2 AS predecessor, p_partkey AS successor FROM part WHERE p_partkey >= 1)",
    "metric_long": "metric_long AS (SELECT l_returnflag AS config, l_linenumber AS seed, l_orderkey AS data_id, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS class, l_discount AS value FROM lineitem)",
}


def sql(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names)
