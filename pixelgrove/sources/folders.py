"""Python data sources over folders of chip files and of runs, and the matching writers.

A reader lists a folder once, leaves out the splits and regions that are not asked for, and deals the files to partitions
by size; tasks open them with pyarrow's file systems (local, HDFS, S3, GCS).  Pixels become rows where the file is read.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .chips import SPLITS, WEAK_SPLITS

#: Bytes of files that a reader's partition takes, about.
PARTITION_BYTES = 64 << 20
_NAME = re.compile(r"(?P<region>[^/]+)_(?P<chip>\d+)_(?P<layer>[^/]+?)(?P<suffix>\.[^/]*)$")
#: Suffix of chips whose channels come last.
CHANNELS_LAST = ".hwc.npy"

Decoder = Callable[[bytes], "np.ndarray"]


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


@dataclass
class Files(InputPartition):
    """Paths, each with what its name or folder says."""

    items: list[tuple]


def _dealt(items: list[tuple[int, tuple]], most: int = PARTITION_BYTES) -> list[Files]:
    """Partitions of about most bytes of (size, item)."""
    out: list[Files] = []
    held: list[tuple] = []
    size = 0
    for n, item in items:
        held.append(item)
        size += n
        if size >= most:
            out.append(Files(held))
            held, size = [], 0
    return [*out, Files(held)] if held or not out else out


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _ChipReader(DataSourceReader):
    def __init__(self, options: dict, bands: Sequence[str], decode: Decoder) -> None:
        self.folder, self.layer = options["path"].rstrip("/"), options.get("layer")
        self.splits = [x for x in options.get("splits", "").split(",") if x]
        self.regions = {x.casefold() for x in options.get("regions", "").split(",") if x}
        self.exclude, self.suffix = options.get("exclude"), options.get("suffix", ".npy")
        self.bands, self.decode, self.bytes = list(bands), decode, int(options.get("partition_bytes", PARTITION_BYTES))
        for s in self.splits:
            if s.casefold() not in SPLITS + WEAK_SPLITS:
                raise ValueError(f"unknown split {s}")

    def partitions(self) -> list[Files]:
        system, base = _file_system(self.folder)
        found = []
        tops = [f"{base}/{s}" for s in self.splits] or [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory]
        for top in tops:
            for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                m = _NAME.search(info.path)
                if info.type != fs.FileType.File or m is None or not info.path.endswith(self.suffix) or self.exclude and self.exclude in info.base_name:
                    continue
                if self.layer and m["layer"] != self.layer or self.regions and m["region"].casefold() not in self.regions:
                    continue
                found.append((info.size or 0, (info.path, top.rsplit("/", 1)[1], m["region"], int(m["chip"]), m["suffix"])))
        return _dealt(sorted(found, key=lambda x: x[1]), self.bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.folder)
        for path, split, region, chip, suffix in partition.items:
            with system.open_input_stream(path, compression=None) as file:
                image = np.asarray(self.decode(file.read()))
            if suffix == CHANNELS_LAST:
                image = np.moveaxis(image, -1, 0)
            if image.shape[0] != len(self.bands):
                raise ValueError(f"{path} has {image.shape[0]} bands, not {len(self.bands)}")
            _, h, w = image.shape
            n = h * w
            same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(n, np.int64)))
            columns = [same(split, pa.string()), same(path.rsplit("/", 1)[1], pa.string()), same(region, pa.string()), same(chip, pa.int64())]
            columns += [pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h))]
            columns += [pa.array(image[i].reshape(-1).astype(float)) for i in range(len(self.bands))]
            yield pa.RecordBatch.from_arrays(columns, ["split", "file", "region", "chip_id", "row", "col", *self.bands])


def chips(spark: SparkSession, folder: str, bands: Sequence[str], *, splits: Sequence[str] = (), regions: Sequence[str] = (), layer: str | None = None, exclude: str | None = None, suffix: str = ".npy", partition_bytes: int = PARTITION_BYTES, decode: Decoder = from_npy) -> DataFrame:
    """(split, file, region, chip_id, row, col, bands) of the files <folder>/<split>/REGION_ID_LAYER.<suffix>.

    Only the wanted splits (all: none given) are listed, and only the wanted regions' files are read; exclude leaves out names that
    hold it.  decode makes an array (bands, rows, cols) of a file's bytes; those with the suffix CHANNELS_LAST have their channels last.
    """
    fields = "split string, file string, region string, chip_id long, row int, col int, " + ", ".join(f"`{b}` double" for b in bands)

    class Chips(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pixel_chips"

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return _ChipReader(dict(self.options), bands, decode)

    spark.dataSource.register(Chips)
    wanted = {"path": folder, "splits": ",".join(splits), "regions": ",".join(regions), "layer": layer, "exclude": exclude, "suffix": suffix, "partition_bytes": str(partition_bytes)}
    reader = spark.read.format("pixel_chips")
    for k, v in wanted.items():
        reader = reader.option(k, v) if v else reader
    return reader.load()


class _RunReader(DataSourceReader):
    """Run folders with all three files."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")

    def partitions(self) -> list[Files]:
        system, base = _file_system(self.root)
        found = [x.path for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
        return _dealt([(1 << 16, (p,)) for p in sorted(found)])

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.root)
        for (path,) in partition.items:
            parts = []
            for name in ("config", "pipeline", "run"):
                info = system.get_file_info(f"{path}/{name}.json")
                if info.type != fs.FileType.File:
                    break
                with system.open_input_stream(info.path, compression=None) as file:
                    parts.append(file.read().decode())
            else:
                yield path.rsplit("/", 1)[1], parts[0], parts[1], json.loads(parts[2]).get("status")


class Runs(DataSource):
    """(folder, config, pipeline, status) of the run folders below a path."""

    @classmethod
    def name(cls) -> str:
        return "pixel_runs"

    def schema(self) -> str:
        return "folder string, config string, pipeline string, status string"

    def reader(self, schema) -> DataSourceReader:
        return _RunReader(dict(self.options))


def runs(spark: SparkSession, root: str, status: str | None = "COMPLETED") -> DataFrame:
    """Run folders below root that hold config, pipeline and run files; status: only those that ended so."""
    spark.dataSource.register(Runs)
    found = spark.read.format("pixel_runs").option("path", root).load()
    return found if status is None else found.where(found["status"] == status)


# ---------------------------------------------------------------- writers


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A whole file or none: written under another name, then moved."""
    top, name = path.rsplit("/", 1)
    system.create_dir(top, recursive=True)
    part = f"{top}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as file:
        file.write(data)
    system.move(part, path)


def save_chips(df: DataFrame, folder: str, bands: Sequence[str], layer: str, channels_last: bool = False) -> DataFrame:
    """Writes <folder>/<split>/REGION_ID_LAYER.npy for every chip of (split, region, chip_id, row, col, bands) and lists (split, file).

    Run the list (write or collect it) to write the files; a repeated task replaces its files by equal ones.
    """
    suffix = CHANNELS_LAST if channels_last else ".npy"

    def run(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        image = np.full((len(bands), int(row.max()) + 1, int(col.max()) + 1), np.nan)
        for i, b in enumerate(bands):
            image[i, row, col] = table.column(b).to_numpy()
        split, region, chip = (table.column(c)[0].as_py() for c in ("split", "region", "chip_id"))
        out, name = io.BytesIO(), f"{region}_{chip}_{layer}{suffix}"
        np.save(out, np.moveaxis(image, 0, -1) if channels_last else image)
        system, base = _file_system(folder)
        _put(system, f"{base}/{split}/{name}", out.getvalue())
        return pa.table({"split": [split], "file": [name]})

    rows = df.select("split", "region", "chip_id", "row", "col", *[df[b].cast("double").alias(b) for b in bands])
    return rows.groupBy("split", "region", "chip_id").applyInArrow(run, "split string, file string")


def save_runs(df: DataFrame, root: str) -> DataFrame:
    """Writes <root>/<folder>/{config, pipeline, run}.json for every row of (folder, config, pipeline, status), texts that are null not at all, and lists the
    folders; run the list to write them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                files = {"config": row["config"], "pipeline": row["pipeline"], "run": None if row["status"] is None else json.dumps({"status": row["status"]})}
                system.create_dir(f"{base}/{row['folder']}", recursive=True)
                for name, text in files.items():
                    if text is not None:
                        _put(system, f"{base}/{row['folder']}/{name}.json", text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("folder")], ["folder"])

    return df.select("folder", "config", "pipeline", "status").mapInArrow(run, "folder string")
