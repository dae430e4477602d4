"""Shared pieces of the training-data operators: scratch tables, size-checked joins,
vectorised word hashing over Arrow batches, and connected components.

Word hashing works on the UTF-8 bytes of whole Arrow string columns: a word's hash is a
polynomial over random 64-bit byte codes, taken from one prefix sum per block of documents, so
no Python code runs per word.  Everything is modulo 2**64 (numpy's wrap-around).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side made of ids or short rows is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes of text that one vectorised block covers; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18
#: Rows of a batch whose text is copied at once.
SLICE = 1000

U = np.uint64


def _give_back_memory() -> None:
    """Python workers live long and handle large buffers: let freed ones return to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_give_back_memory()
_INV_MAX = (1 << 64) - 1


# ---------------------------------------------------------------- scratch tables and joins


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset a temporary one with a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out


def forget(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows, else as it is (the join then shuffles)."""
    n = small.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small


def own_name(stem: str) -> str:
    """A column name that no table of a user has."""
    return f"{stem}_{uuid.uuid4().hex}"


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the one column of ids, which may hold no null."""
    name = own_name("gone")
    return docs.join(sized(ids.toDF(name)), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


# ---------------------------------------------------------------- hashing of words


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser, as a new array."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


class _Poly:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up, self.down


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, _INV_MAX, 256, dtype=U, endpoint=True)


_BYTES, _GRAMS, _GRAMS2 = _Poly(0x9E3779B97F4A7C15), _Poly(0xD6E8FEB86659FD93), _Poly(0xA0761D6478BD642F)


def _letters(of: Callable[[int], bool]) -> np.ndarray:
    return np.array([of(b) for b in range(256)])


#: Word bytes of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
SPACED = _letters(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
PLAIN = _letters(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of mask; first (one longer) marks where a document starts, which ends a run."""
    n = len(mask)
    fresh, done = mask.copy(), mask.copy()
    fresh[1:] &= ~mask[:-1] | first[1:n]
    done[:-1] &= ~mask[1:] | first[1:n]
    return np.flatnonzero(fresh), np.flatnonzero(done) + 1


class Span:
    """Hashes of stretches of bytes, by one prefix sum."""

    __slots__ = ("_total",)

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        self._total = np.zeros(n + 1, U)
        np.cumsum(_codes()[buf] * _BYTES.upto(n + 1)[0][:n], out=self._total[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start up to end."""
        return mix((self._total[end] - self._total[start]) * _BYTES.upto(len(self._total))[1][start])


class Words(Span):
    """Words of a run of documents: byte starts and ends in buf, hashes, and first[d] .. first[d + 1] of document d."""

    __slots__ = ("buf", "bounds", "start", "end", "hash", "first")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> None:
        """buf: bytes; bounds: the documents' limits in buf (n + 1)."""
        super().__init__(buf)
        self.buf, self.bounds = buf, bounds
        at = np.zeros(len(buf) + 1, bool)
        at[bounds] = True
        self.start, self.end = runs(kind[buf], at)
        self.first = np.searchsorted(self.start, bounds)
        self.hash = self.between(self.start, self.end)

    def grams(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on; what runs past a document's end is of no use."""
        return grams(self.hash, k, second)


def grams(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    up, down = (_GRAMS2 if second else _GRAMS).upto(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k))


def stretches(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start up to end."""
    up, down = _GRAMS2.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the limits of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_bytes(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of blocks of about size bytes."""
    rows, at = len(bounds) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to
        at = to


def blocks(column: pa.Array, kind: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for blocks of about BLOCK_BYTES of the column."""
    for k in range(0, len(column), SLICE):
        buf, bounds = column_bytes(column.slice(k, SLICE))
        for at, to in in_bytes(bounds, BLOCK_BYTES):
            part = buf[bounds[at] : bounds[to]]
            yield k + at, k + to, Words(_LOWER[part] if lower else part, bounds[at : to + 1] - bounds[at], kind)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a contiguous 2-d array as one binary value."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize if rows.size else 0
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 50_000) -> Iterator[pa.Table]:
    """Joins batches sorted by keys into tables that never cut a group, of some at_least rows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Limits of runs of equal rows of sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def in_blocks(df: DataFrame, key: str, count: str, member: str, size: int) -> DataFrame:
    """df with i, j: the pairs of blocks of its group to which a row goes, (0, 0) in groups of up to size rows."""
    n = F.ceil(F.col(count) / F.lit(size)).cast("int")
    block = F.pmod(F.xxhash64(member, key), n).cast("int")
    df = df.withColumn("_n", n).withColumn("_b", block)
    other = F.explode(F.when(F.col("_n") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1)))
    df = df.withColumn("_o", other)
    return df.withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_n", "_b", "_o")


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps: every step is a group-by with partial
    aggregation and a join that adaptive execution can split, so a node with a third of all
    edges is no task of its own.  Rounds grow with the logarithm of the longest path.
    """
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialise(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seal = None
    while True:
        both = now.union(now.select("b", "a"))
        # a table of its own: a join with the aggregate itself would keep all edges of a hub in one task
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.union(down).distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        forget(low)
        now = after
        if seal is not None and tuple(mark) == seal:
            break
        seal = tuple(mark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
