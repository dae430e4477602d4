"""Merkle manifest of a dataset, with nested-interval labels.

Rows are leaves; per group (a language) they are ordered by id, and every two neighbours become a node until one is
left, the group's subroot; the subroots, ordered by group, become the root in the same way.  A node carries the interval
``[lo, hi)`` of the leaf ranks that it covers, so the tree needs no pointers:

* a node's ancestors are the nodes whose intervals contain its own; they are attached by joins inside buckets: a band of
  ``BAND`` levels and a stretch of ``2 ** BAND`` nodes of the band's lowest level,
* what a node's interval leaves of its parent's is its sibling's interval.

A bucket holds at most ``2 ** BAND`` nodes and their ancestors of the band, whatever the group's size, so one group may hold most of
the rows.  Rows are shuffled as digests, texts never: once to rank them by range, once to hash a band, once to attach it; there
are log2(rows) / BAND bands, each 2 ** BAND times smaller than the one below.  Ranks come from range partitions and their counts,
not from a window over a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed_binary, grouped, materialise, sized

#: Levels of a band.
BAND = 8
#: A step of a path: a code and the sibling's digest.  Codes: where the sibling is, that there is none, that the node is a root.
RIGHT, LEFT, ALONE, ROOT = range(4)
_STEP = 33
_NODES = "tree long, n long, level int, lo long, hi long, digest binary"
_PATHS = "tree long, at long, path binary, subroot binary"
#: Rows of a bucket, in this order: the path above it, nodes, the band's lowest nodes.
_ABOVE, _NODE, _BASE = range(3)


def leaf_digest(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 (hex) of the columns in a row, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""

    def field(name: str) -> Column:
        text = (changed or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with tree (a number per group, ascending with it, null first), n (the group's rows) and rank (from 0, by order).

    Rows are sorted by range and numbered within partitions; a group's rows in a partition are consecutive, so the counts of
    (partition, group), as many as there are partitions and groups, give the ranks.
    """
    line = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    line = materialise(line.withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    parts = line.groupBy(F.col(group).alias("its"), part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("its")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.select("its", "part", F.min("first").over(own).alias("tree"), F.sum("rows").over(own).alias("n"), (before - F.col("first")).alias("shift")), "parts")
    out = line.join(sized(parts), F.col(group).eqNullSafe(F.col("its")) & (part == F.col("part")))
    return out.select(*rows.columns, "tree", "n", (F.col("place") + F.col("shift")).alias("rank"))


# ---------------------------------------------------------------- nodes


def _hash_band(band: int) -> Callable:
    levels, shift = BAND, BAND * band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["tree", "bucket"]):
            tree, n, lo = (table.column(k).to_numpy() for k in ("tree", "n", "lo"))
            digest = [x.hex() for x in table.column("digest").to_pylist()]
            bounds = np.flatnonzero(np.diff(tree, prepend=~tree[0]) | np.diff(lo >> (shift + levels), prepend=-1))
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(tree)]):
                own, t, size, start, level = digest[a:b], int(tree[a]), int(n[a]), int(lo[a]), shift
                while level < shift + levels and -(-size >> level) > 1:
                    level += 1
                    own = [hashlib.sha256("".join(own[k : k + 2]).encode()).hexdigest() for k in range(0, len(own), 2)]
                    at = [start + (k << level) for k in range(len(own))]
                    values = ([t] * len(own), [size] * len(own), [level] * len(own), at, [min(x + (1 << level), size) for x in at], [bytes.fromhex(x) for x in own])
                    for column, more in zip(out, values):
                        column += more
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["tree", "n", "level", "lo", "hi", "digest"])

    return run


def _bucket(rows: DataFrame, band: int) -> DataFrame:
    return rows.withColumn("bucket", F.shiftright("lo", BAND * (band + 1)))


def bands(leaves: DataFrame) -> list[DataFrame]:
    """Nodes above the leaves (tree, n, lo, digest): per band (tree, n, level, lo, hi, digest)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    base = leaves.select("tree", "n", "lo", "digest")
    while not out or most > 1 << BAND * len(out):
        band = len(out)
        dealt = _bucket(base, band).repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "lo")
        out.append(materialise(dealt.mapInArrow(_hash_band(band), _NODES), "nodes"))
        base = _lowest(out, band + 1).select("tree", "n", "lo", "digest")
    return out


def _lowest(nodes: list[DataFrame], band: int) -> DataFrame:
    """The nodes on which a band stands: the last level of the band below, but no roots."""
    return nodes[band - 1].where((F.col("level") == BAND * band) & (F.col("hi") - F.col("lo") < F.col("n")))


def _tops(leaves: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(tree, n, digest) of the root of every tree."""
    whole = [x.where("lo = 0 and hi = n").select("tree", "n", "digest") for x in nodes]
    return reduce(DataFrame.unionByName, whole, leaves.where("n = 1").select("tree", "n", "digest"))


# ---------------------------------------------------------------- ancestors and siblings


def _rows_of(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """32-byte digests as the rows of a matrix."""
    if not len(at):
        return np.zeros((0, 32), np.uint8)
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), 32)


def _attach_band(band: int, finish: Callable) -> Callable:
    """Steps from every lowest node of a bucket up to the band's end, by containment and interval difference, then finish."""
    levels, shift = BAND, BAND * band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["tree", "bucket"]):
            tree, bucket, kind, level, lo, hi = (table.column(k).to_numpy() for k in ("tree", "bucket", "kind", "level", "lo", "hi"))
            new = np.ones(len(tree), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (bucket[1:] != bucket[:-1])
            group = np.cumsum(new) - 1
            # one number line for all buckets: a bucket takes one place for each lowest node
            place = (group << levels) + ((lo >> shift) & ((1 << levels) - 1))
            paths, upper = np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
            for now in range(shift + levels, shift - 1, -1):
                at = np.flatnonzero((kind == _BASE) if now == shift else (kind == _NODE) & (level == now))
                up = np.searchsorted(place[upper], place[at], "right") - 1
                held = np.zeros(len(at), bool)
                if len(upper):
                    parent = upper[np.maximum(up, 0)]
                    held = (up >= 0) & (group[parent] == group[at]) & (lo[parent] <= lo[at]) & (hi[at] <= hi[parent])
                    left, right = held & (lo[parent] < lo[at]), held & (hi[at] < hi[parent])
                    other = np.searchsorted(place[at], np.where(left, place[parent], place[at] + (1 << (now - shift))))
                else:
                    left = right = held
                    other = np.zeros(len(at), np.int64)
                step = np.zeros((len(at), _STEP), np.uint8)
                step[:, 0] = np.where(left, LEFT, np.where(right, RIGHT, np.where(held, ALONE, ROOT)))
                pair = np.flatnonzero(left | right)
                if not (lo[at[other[pair]]] == np.where(left[pair], lo[parent[pair]] if len(pair) else 0, hi[at[pair]])).all():
                    raise ValueError("a node's sibling is missing")
                step[pair, 1:] = _rows_of(table.column("digest"), at[other[pair]])
                if now == shift + levels:
                    paths = np.zeros((len(at), 0), np.uint8)  # the band's last level: its steps are the next band's
                else:
                    rest = np.zeros((len(at), paths.shape[1]), np.uint8)
                    rest[:, ::_STEP] = ROOT
                    rest[held] = paths[up[held]]
                    paths = np.concatenate([step, rest], 1)
                upper = at
            above = np.flatnonzero(kind == _ABOVE)
            if not (group[above] == np.arange(group[-1] + 1)).all():
                raise ValueError("a bucket has no path above it, or several")
            yield finish(table, upper, paths, above[group[upper]])

    return run


def _inner(table: pa.Table, at: np.ndarray, paths: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
    rest = table.column("path").take(pa.array(above)).to_pylist()
    full = [p.tobytes() + r for p, r in zip(paths, rest)]
    take = lambda k, i: table.column(k).take(pa.array(i)).combine_chunks()
    return pa.RecordBatch.from_arrays([take("tree", at), take("lo", at), pa.array(full, pa.binary()), take("subroot", above)], ["tree", "at", "path", "subroot"])


def fold(path: str, leaf: str) -> tuple[str, str]:
    """The root that a leaf leads to along a path (hex), and the SHA-256 of the path's siblings in a row."""
    now, siblings = leaf, []
    for k in range(0, len(path), 2 * _STEP):
        code = int(path[k : k + 2], 16)
        if code == ROOT:
            continue
        sibling = path[k + 2 : k + 2 * _STEP] if code != ALONE else ""
        now = hashlib.sha256((sibling + now if code == LEFT else now + sibling).encode()).hexdigest()
        siblings.append(sibling)
    return now, hashlib.sha256("".join(siblings).encode()).hexdigest()


def _outer(table: pa.Table, at: np.ndarray, paths: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
    """Each leaf's proof, and the root that its claimed digest leads to."""
    rest = [x.hex() for x in table.column("path").take(pa.array(above)).to_pylist()]
    leaf = [x.hex() for x in table.column("digest").take(pa.array(at)).to_pylist()]
    claim = [x.hex() for x in table.column("path").take(pa.array(at)).to_pylist()]
    made = [fold(p.tobytes().hex() + r, c) for p, r, c in zip(paths, rest, claim)]
    subroot = [x.hex() for x in table.column("subroot").take(pa.array(above)).to_pylist()]
    ids = table.column("id").take(pa.array(at)).combine_chunks()
    names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]
    return pa.RecordBatch.from_arrays([ids, pa.array(leaf, pa.string()), pa.array(subroot, pa.string()), pa.array([p for _, p in made], pa.string()), pa.array([r for r, _ in made], pa.string())], names)


def _attach(base: DataFrame, nodes: list[DataFrame], roots: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish's rows for every leaf of base (tree, n, lo, digest, path, id), with the path from the leaf over its
    tree's root and on along that of roots (tree, n, path, subroot)."""
    kinds = {"tree": "long", "bucket": "long", "kind": "byte", "level": "int", "lo": "long", "hi": "long", "digest": "binary", "path": "binary", "subroot": "binary", "id": "long"}

    def rows(df: DataFrame, kind: int, band: int) -> DataFrame:
        df = df.withColumn("kind", F.lit(kind))
        df = df if "bucket" in df.columns else df.withColumn("bucket", F.shiftright("lo", BAND * (band + 1)))
        zero = {"level", "lo", "hi"}
        return df.select(*[(F.col(c) if c in df.columns else F.lit(0) if c in zero else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    # trees that end in a band take their root's path there, in bucket 0
    last = F.lit(len(nodes) - 1)
    for band in range(len(nodes) - 2, -1, -1):
        last = F.when(F.col("n") <= 1 << BAND * (band + 1), band).otherwise(last)
    roots = roots.withColumn("band", last).withColumn("bucket", F.lit(0))
    above: DataFrame | None = None
    for band in range(len(nodes) - 1, -1, -1):
        tops = rows(roots.where(F.col("band") == band), _ABOVE, band)
        if above is not None:  # a lowest node of the band above is the top of one bucket
            tops = tops.unionByName(rows(above.withColumn("bucket", F.shiftright("at", BAND * (band + 1))), _ABOVE, band))
        low = _lowest(nodes, band) if band else base.withColumn("hi", F.col("lo") + 1)
        dealt = tops.unionByName(rows(nodes[band], _NODE, band)).unionByName(rows(low, _BASE, band))
        dealt = dealt.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "kind", "level", "lo")
        if band:
            above = materialise(dealt.mapInArrow(_attach_band(band, _inner), _PATHS), "paths")
    return dealt.mapInArrow(_attach_band(0, finish), schema)


# ---------------------------------------------------------------- the manifest


@dataclass
class Manifest:
    """leaves: (id, group, tree, n, lo, digest, path: the claimed digest); nodes by band with their intervals, of the groups' trees and
    of the tree of subroots; root (hex, null of an empty table)."""

    leaves: DataFrame
    nodes: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None

    def verified(self) -> DataFrame:
        """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
        crown = self.subroots.select("tree", "n", F.lit(b"").alias("path"), F.lit(b"").alias("subroot")).distinct()
        roots = _attach(self.subroots.withColumn("path", F.lit(b"")), self.upper, crown, _crown_paths, "tree long, path binary, subroot binary")
        sizes = _tops(self.leaves, self.nodes).select("tree", "n")
        roots = materialise(roots.join(sizes, "tree"), "roots")
        schema = "id long, leaf string, subroot string, proof_sha256 string, folded_root string"
        out = _attach(self.leaves, self.nodes, roots, _outer, schema)
        root = F.lit(self.root).cast("string")
        return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _crown_paths(table: pa.Table, at: np.ndarray, paths: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
    """The path above every subroot; its id is the number of its group's tree."""
    rest = table.column("path").take(pa.array(above)).to_pylist()
    full = [p.tobytes() + r for p, r in zip(paths, rest)]
    digest = fixed_binary(_rows_of(table.column("digest"), at))
    return pa.RecordBatch.from_arrays([table.column("id").take(pa.array(at)).combine_chunks(), pa.array(full, pa.binary()), digest], ["tree", "path", "subroot"])


def manifest(
    docs: DataFrame,
    *,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    claimed: Column | None = None,
) -> Manifest:
    """The Merkle manifest of docs.  claimed is the digest (hex) that each row is checked with, by default its own.

    Defined cases: null values are ``-`` in a leaf, empty ones ``0:``; a null group is a group, the first; rows
    with a null id come first in their group; rows that repeat are leaves each, rows that share an id are ordered by digest; other columns
    are ignored; an empty table has no root.
    """
    leaf = leaf_digest(columns)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), F.unhex(leaf).alias("digest"), F.unhex(F.coalesce(claimed, leaf) if claimed is not None else leaf).alias("path"))
    leaves = materialise(ranked(rows, "group", ["id", "digest"]).withColumnRenamed("rank", "lo"), "leaves")
    nodes = bands(leaves)
    tops = materialise(_tops(leaves, nodes).select(F.col("tree").alias("id"), "digest", F.lit(0).alias("all")), "tops")
    subroots = materialise(ranked(tops, "all", ["id"]).withColumnRenamed("rank", "lo"), "subroots")
    upper = bands(subroots)
    root = _tops(subroots, upper).select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, nodes, subroots, upper, root[0] if root else None)
