"""The relational store of runs and metrics: typed tables in a folder, run archives, trial tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns and types.
SCHEMAS = {
    "Experiment": "id bigint, name string, seed bigint",
    "Trial": "ex_id bigint, trial_num bigint, start_time timestamp, end_time timestamp",
    "Artifact": "id bigint, trial_num bigint, ex_id bigint, f_name string",
    "Pipeline": "id bigint, trial_num bigint, ex_id bigint, type string, root boolean, final boolean",
    "is_successor": "predecessor bigint, successor bigint",
    "computed_by": "module bigint, pipeline bigint",
}


class Store:
    """Named tables below a folder, as Parquet; a read-only store refuses writes."""

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False) -> None:
        self.spark, self.folder, self.read_only = spark, folder.rstrip("/"), read_only

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def __contains__(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def from_csv(self, name: str) -> DataFrame:
        """A table that other tools left as <name>.csv, types inferred."""
        return self.spark.read.csv(f"{self.path(name)}.csv", header=True, inferSchema=True)

    def save(self, name: str, df: DataFrame) -> None:
        self._writable()
        df.write.mode("overwrite").parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        self._writable()
        df.write.mode("append").parquet(self.path(name))

    def create_if_absent(self, name: str, schema: str | None = None) -> DataFrame:
        if name not in self:
            self.save(name, self.spark.createDataFrame([], schema or SCHEMAS[name]))
        return self[name]

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(folder, config, pipeline, status): complete run folders below root, from their three JSON files."""

    def part(name: str, column) -> DataFrame:
        t = spark.read.option("wholetext", True).text(f"{root}/*/{name}.json", pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("p"))
        return t.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("folder"), column.alias(name if name != "run" else "status"))

    config, pipeline = part("config", F.col("value")), part("pipeline", F.col("value"))
    status = part("run", F.get_json_object("value", "$.status"))
    return config.join(pipeline, "folder").join(status, "folder").where("status = 'COMPLETED'")


def trials(raw: DataFrame) -> DataFrame:
    """Complete trials with both times: blanks in times become T, values_* and state columns go."""
    time = lambda c: F.to_timestamp(F.regexp_replace(F.trim(c), " ", "T"))
    t = raw.where("state = 'COMPLETE'").withColumns({"datetime_start": time("datetime_start"), "datetime_complete": time("datetime_complete")})
    t = t.where("datetime_start is not null and datetime_complete is not null")
    return t.drop("state", *[c for c in raw.columns if c.startswith("values_")]).withColumnsRenamed({"datetime_start": "start_time", "datetime_complete": "end_time", "number": "trial_num"})


def distributions(spark: SparkSession, path: str) -> DataFrame:
    """(trial, param, name, attributes, value) of a JSON map trial -> param -> description."""
    shape = "map<string, map<string, struct<name: string, attributes: map<string, string>, value: string>>>"
    t = spark.read.option("wholetext", True).text(path).select(F.from_json("value", shape).alias("m"))
    t = t.select(F.explode("m").alias("trial", "p")).select(F.col("trial").cast("bigint"), F.explode("p").alias("param", "d"))
    return t.select("trial", "param", "d.name", "d.attributes", "d.value")


def save_distributions(df: DataFrame, path: str) -> None:
    """Writes rows (trial, param, name, attributes: VARIANT, value: VARIANT) as JSON lines {trial, distributions}: one trial a line, so a set of
    any size is read in parts."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    one = F.concat(quoted("param"), F.lit(':{"name":'), quoted("name"), F.lit(',"attributes":'), F.coalesce(F.to_json("attributes"), F.lit("null")), F.lit(',"value":'), F.coalesce(F.to_json("value"), F.lit("null")), F.lit("}"))
    lines = df.groupBy("trial").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("all"))
    lines.select(F.concat(F.lit('{"trial":'), F.col("trial").cast("string"), F.lit(',"distributions":{'), F.col("all"), F.lit("}}")).alias("value")).write.mode("errorifexists").text(path)


def load_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(trial, param, name, attributes: VARIANT, value: VARIANT) of what save_distributions wrote; parameters need not be known."""
    t = spark.read.text(path).select(F.parse_json("value").alias("v"))
    t = t.select(F.variant_get("v", "$.trial", "bigint").alias("trial"), F.variant_get("v", "$.distributions", "variant").alias("d"))
    each = t.lateralJoin(spark.tvf.variant_explode(F.col("d").outer()))
    part = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    return each.select("trial", F.col("key").alias("param"), part("name", "string").alias("name"), part("attributes", "variant").alias("attributes"), part("value", "variant").alias("value"))


def save_best(ranked: DataFrame, folder: str, buckets: Sequence[str] = ("sar_opt", "sar", "opt")) -> None:
    """One CSV folder per bucket of a ranked result."""
    for b in buckets:
        ranked.where(F.col("bucket") == b).drop("bucket").write.mode("overwrite").csv(f"{folder}/{b}", header=True)
