"""Scans of chip folders, split manifests and packed sets; the matching sinks.

A chip file becomes pixel rows through a decoder that the user supplies (a function of the file's
bytes); decoding runs where Spark has put the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_name, region_and_id

# Band names, splits, and kinds of data.
RADAR = ("VV", "VH")
OPTICAL = ("Coastal", "Blue", "Green", "Red", "RedEdge-1", "RedEdge-2", "RedEdge-3", "NIR", "Narrow NIR", "Water Vapor", "Cirrus", "SWIR-1", "SWIR-2")
SPLITS = ("train", "valid", "test", "bolivia")
WEAK_SPLITS = ("weak", "weak-bolivia")
KINDS = ("S1", "S2", "label", "S1OtsuLabel", "S2IndexLabel")

Decoder = Callable[[bytes], "np.ndarray"]


def files(spark: SparkSession, folder: str, glob: str = "*.tif", exclude: str | None = None) -> DataFrame:
    """(path, file, region, chip_id) of a folder's files, without content; exclude: a substring of names to leave out."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return with_keys(out, exclude)


def with_keys(paths: DataFrame, exclude: str | None = None) -> DataFrame:
    file = base_name(F.col("path"))
    parts = region_and_id(file)
    out = paths.select("path", file.alias("file"), parts["region"].alias("region"), parts["chip_id"].alias("chip_id"))
    return out.where(~F.col("file").contains(exclude)) if exclude else out


def manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(data_file, label_file) of a split list without header."""
    t = spark.read.schema("data_file string, label_file string").csv(path, sep=",")
    return t.select(F.trim("data_file").alias("data_file"), F.trim("label_file").alias("label_file"))


def in_manifest(scan: DataFrame, wanted: DataFrame, column: str = "data_file") -> DataFrame:
    return scan.join(wanted.select(F.col(column).alias("file")), "file", "left_semi")


def rewrite_manifest(lines: DataFrame, what: str, by: str) -> DataFrame:
    """A manifest of another sensor: the layer name in the data files replaced."""
    return lines.withColumn("data_file", F.regexp_replace("data_file", what, by))


# Suffix of a split list of another sensor -> the layer name in its files.
LAYERS = {"s2": "S2Hand", "dem": "dem"}


def write_lists(lines: DataFrame, folder: str) -> None:
    """Writes split lists (list, data_file, label_file) as CSV without header, one folder list=<name> each; an existing folder is an error."""
    lines.select("list", "data_file", "label_file").write.mode("errorifexists").partitionBy("list").csv(folder)


def read_lists(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(list, data_file, label_file) of all split lists of a folder, or of one of them."""
    t = spark.read.schema("data_file string, label_file string, list string").csv(folder)
    t = t.where(F.col("list") == name) if name is not None else t
    return t.select("list", F.trim("data_file").alias("data_file"), F.trim("label_file").alias("label_file"))


def rewrite_lists(spark: SparkSession, source: str, target: str, layers: Mapping[str, str] = LAYERS, what: str = "S1Hand") -> None:
    """Writes, for every list of source and every layer, the list <name>_<suffix> to target: its data files are those of the layer.

    All lists are read once and written in one job, the elevation lists with all their lines.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("suffix"), F.lit(v).alias("layer")) for k, v in layers.items()]))
    t = read_lists(spark, source).withColumn("_l", each)
    write_lists(t.select(F.concat_ws("_", "list", "_l.suffix").alias("list"), F.replace(F.col("data_file"), F.lit(what), F.col("_l.layer")).alias("data_file"), "label_file"), target)


def pixels(spark: SparkSession, folder: str, decode: Decoder, bands: Sequence[str], glob: str = "*.tif", channels_last: bool = False, exclude: str | None = None) -> DataFrame:
    """(region, chip_id, row, col, bands ...) of all files; decode gives (bands, rows, cols), or channels last."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    keyed = with_keys(scan.select("path"), exclude).join(scan, "path") if exclude else with_keys_and_content(scan)
    names = list(bands)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for region, chip, content in zip(part["region"], part["chip_id"], part["content"]):
                image = np.asarray(decode(bytes(content)))
                image = np.moveaxis(image, -1, 0) if channels_last else image
                _, h, w = image.shape
                yield pd.DataFrame({"region": region, "chip_id": chip, "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), **{b: image[i].reshape(-1).astype(float) for i, b in enumerate(names)}})

    fields = ", ".join(f"`{b}` double" for b in names)
    return keyed.select("region", "chip_id", "content").mapInPandas(run, f"region string, chip_id long, row int, col int, {fields}")


def with_keys_and_content(scan: DataFrame) -> DataFrame:
    parts = region_and_id(base_name(F.col("path")))
    return scan.select("path", parts["region"].alias("region"), parts["chip_id"].alias("chip_id"), "content")


def labels_only(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Labels as small integers, without the chips that hold NaN."""
    x = F.col(label).cast("double")
    bad = df.where(F.isnan(x)).select(*keys).distinct()
    return df.join(bad, list(keys), "left_anti").withColumn(label, x.cast("tinyint"))


def data_with_labels(data: DataFrame, labels: DataFrame, keys: Sequence[str] = ("region", "chip_id", "row", "col")) -> DataFrame:
    """1:1 merge by key; use results.mismatches to check a set beforehand.

    Always a merge join: packed files are so much smaller than their rows that Spark would broadcast a side of any length.
    """
    return data.join(labels.hint("merge"), list(keys))


def with_elevation(data: DataFrame, elevation: DataFrame, keys: Sequence[str] = ("region", "chip_id", "row", "col")) -> DataFrame:
    return data.join(elevation.hint("merge"), list(keys), "left")


def resolve(base: str, kind: str, split: str) -> str:
    """The partition folder of a kind and split; unknown names are an error."""
    kind_, split_ = kind.strip(), split.strip().casefold()
    if split_ not in SPLITS + WEAK_SPLITS:
        raise ValueError(f"unknown split {split}")
    if kind_ not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    return f"{base.rstrip('/')}/kind={kind_}/split={'weak' if split_.startswith('weak') else split_}"


def read_split(spark: SparkSession, base: str | Sequence[str], kind: str, split: str) -> DataFrame:
    """A packed set; of several base folders the first that has it; weak-bolivia leaves that region out."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    for b in [base] if isinstance(base, str) else base:
        path = resolve(b, kind, split)
        p = fs(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.parquet(path)
            return df.where(F.lower("region") != "bolivia") if split.strip().casefold() == "weak-bolivia" else df
    raise FileNotFoundError(f"{kind}/{split} in none of {base}")


def pack(df: DataFrame, base: str, kind: str, split: str) -> None:
    """Writes a packed set, one folder per region; an existing one is an error."""
    df.write.mode("errorifexists").partitionBy("region").parquet(resolve(base, kind, split))


def save_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("region").parquet(path)
