"""MinHash near-duplicates: b-bit signatures, band candidates, exact confirmation, components.

Rows, in order of the work:

1. Each text becomes its set of distinct word shingles (64-bit hashes).  From K = bands * rows
   minima come the band keys; of every minimum only the low ``bits`` bits stay, packed into one
   short binary.
2. Documents with the same set form a class, from here on present once (smallest doc_id).
3. Buckets (equal band keys) with two classes or more are compared by bit counts of the packed
   signatures: the matching share m gives the collision-corrected similarity
   (m - 2**-bits) / (1 - 2**-bits).  A bucket gives a spanning forest of its similar pairs,
   never all of them; large buckets are dealt out as pairs of blocks.
4. The forest's components are candidate groups: every true link lies inside one.  Their
   texts are hashed again and compared exactly by full sets, again in blocks and again giving
   spanning forests, so links are found without listing pairs.
5. Components of the exact links carry the smallest doc_id.

Defined cases: null text, empty text or no words: empty set, linked with nothing, its own
component.  Fewer words than a shingle: the whole sequence is the one shingle.  doc_id is the
key: repeated rows are each returned, rows that share a doc_id share their links.  A null
doc_id is returned with a null component and kept.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    SPACED,
    Forest,
    U,
    blocks,
    components,
    fixed_binary,
    grams,
    group_bounds,
    grouped,
    in_blocks,
    lists,
    materialise,
    mix,
    signed,
    sized,
    without,
)

#: Signatures that one task compares with each other at once, and texts in the exact stage.
BUCKET_BLOCK, TEXT_BLOCK = 1024, 256


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for a, b, words in blocks(column, SPACED, lower=True):
        whole = words.grams(width)
        first = words.first
        for d in range(b - a):
            i, j = int(first[d]), int(first[d + 1])
            if j - i >= width:
                yield np.unique(whole[i : j - width + 1])
            elif j > i:
                yield grams(words.hash[i:j], j - i)
            else:
                yield np.zeros(0, U)


class Signer:
    """K minima of multiplicative 32-bit permutations."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.k, self.bands, self.rows, self.bits = bands * rows, bands, rows, bits
        self.a = draw.integers(0, 1 << 32, self.k, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, self.k, dtype=np.uint64).astype(np.uint32)[:, None]
        self.c = draw.integers(0, (1 << 64) - 1, rows, dtype=U) | U(1)
        self.lanes = 64 // bits
        self.words = math.ceil(self.k / self.lanes)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> U(32)).astype(np.uint32)
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 2048):
            x = self.a * low[None, i : i + 2048]
            x += self.b
            np.minimum(out, x.min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        x = minima.reshape(-1, self.bands, self.rows).astype(U)
        key = (mix(x + U(1)) * self.c).sum(axis=2, dtype=U)
        return mix(key + np.arange(self.bands, dtype=U) * U(0x9E3779B97F4A7C15))

    def packed(self, minima: np.ndarray) -> np.ndarray:
        n = len(minima)
        low = np.zeros((n, self.words * self.lanes), U)
        low[:, : self.k] = mix(minima.astype(U)) & U((1 << self.bits) - 1)
        return (low.reshape(n, self.words, self.lanes) << (np.arange(self.lanes, dtype=U) * U(self.bits))).sum(axis=2, dtype=U)

    def similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Collision-corrected estimate of packed signatures, by broadcasting over all but the last axis."""
        d = x ^ y
        fold = d.copy()
        for i in range(1, self.bits):
            fold |= d >> U(i)
        lane = U(sum(1 << (i * self.bits) for i in range(self.lanes)))
        differ = np.bitwise_count(fold & lane).sum(axis=-1, dtype=np.int64)
        chance = 2.0**-self.bits
        return ((1 - differ / self.k) - chance) / (1 - chance)


def signatures(docs: DataFrame, signer: Signer, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, s1, s2, sig, bands) of every row; s1, s2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, s = np.zeros(n, np.int64), np.zeros((2, n), U)
            least = np.full((n, signer.k), 0xFFFFFFFF, np.uint32)
            for i, x in enumerate(shingle_sets(batch.column(1), width)):
                size[i] = len(x)
                if len(x):
                    s[0, i], s[1, i] = mix(x + U(1)).sum(dtype=U), mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
                    least[i] = signer.minima(x)
            keys = signed(signer.band_keys(least).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(signed(s[0])), pa.array(signed(s[1])), fixed_binary(signer.packed(least)), lists(keys, np.arange(n + 1) * signer.bands, pa.int64())],
                ["doc_id", "n", "s1", "s2", "sig", "bands"],
            )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sig binary, bands array<long>")


def _bucket_edges(signer: Signer, least: float):
    """Of rows (key, i, j, side, rep, sig) sorted by (key, i, j): a spanning forest of the similar pairs of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "i", "j"]):
            key, i, j, rep = (table.column(c).to_numpy() for c in ("key", "i", "j", "rep"))
            sig = table.column("sig").combine_chunks()
            sig = np.frombuffer(sig.buffers()[2], U)[: (sig.offset + len(sig)) * signer.words].reshape(-1, signer.words)[sig.offset :]
            bounds = group_bounds(key, i, j)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            hit = two[signer.similarity(sig[two], sig[two + 1]) >= least]
            pairs = [np.stack([rep[hit], rep[hit + 1]], 1)]
            for g in np.flatnonzero(size > 2):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                forest, n = Forest(hi - lo), hi - lo
                own = sig[lo:hi]
                left = n - 1
                for x in range(n - 1):
                    near = np.flatnonzero(signer.similarity(own[x], own[x + 1 :]) >= least)
                    for y in near.tolist():
                        if forest.join(x, x + 1 + y):
                            pairs.append(np.array([[rep[lo + x], rep[lo + x + 1 + y]]]))
                            left -= 1
                    if not left:
                        break
            out = np.concatenate(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1].astype(np.int64))], ["a", "b"])

    return run


def _exact_edges(width: int, share: int):
    """Of texts (g, i, j, id, text) sorted by (g, i, j): a spanning forest of the links of each group, by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["g", "i", "j"], 512):
            g, i, j, ids = (table.column(c).to_numpy() for c in ("g", "i", "j", "id"))
            bounds = group_bounds(g, i, j)
            sets = list(shingle_sets(table.column("text").combine_chunks(), width))
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                full = [x for x in range(lo, hi) if len(sets[x])]  # a repeated id may also have an empty text
                n = len(full)
                if n < 2:
                    continue
                own, names = [sets[x] for x in full], ids[full]
                size = np.array([len(x) for x in own])
                vocabulary, local = np.unique(np.concatenate(own), return_inverse=True)
                start = np.append(0, np.cumsum(size))
                seen = np.zeros(len(vocabulary), np.int32)
                forest, left = Forest(n), n - 1
                for x in range(n - 1):
                    mine = local[start[x] : start[x + 1]]
                    seen[mine] = 1
                    both = np.add.reduceat(seen[local[start[x + 1] :]], start[x + 1 : -1] - start[x + 1])
                    seen[mine] = 0
                    union = size[x] + size[x + 1 :] - both
                    for y in np.flatnonzero(100 * both >= share * union).tolist():
                        if forest.join(x, x + 1 + y):
                            a.append(names[x])
                            b.append(names[x + 1 + y])
                            left -= 1
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    share: int = 80,
    bands: int = 25,
    rows: int = 5,
    bits: int = 2,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    share: percent of the union that two sets must share.  With the default 25 bands of 5 rows a
    pair at 85 % is missed with probability 4e-7 (at 80 %: 5e-5); the bit-count threshold lies five
    standard deviations of the estimate below the share.
    """
    signer = Signer(bands, rows, bits)
    level = share / 100
    matched = level + (1 - level) * 2.0**-bits
    least = level - 5 * math.sqrt(matched * (1 - matched) / signer.k) / (1 - 2.0**-bits)

    signs = materialise(signatures(docs, signer, width, id_col, text_col), "signatures")
    classes = signs.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(keyed.join(full, "key"), "buckets")
    members = in_blocks(members.join(classes.select("rep", "sig"), "rep"), "key", "m", "rep", BUCKET_BLOCK)
    members = members.select("key", "i", "j", "rep", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    similar = members.mapInArrow(_bucket_edges(signer, least), "a long, b long").distinct()

    groups = materialise(components(similar).withColumnsRenamed({"node": "id", "component": "g"}), "groups")
    groups = groups.join(groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.join(sized(groups), "id")
    texts = in_blocks(texts, "g", "m", "id", TEXT_BLOCK).select("g", "i", "j", "id", "text")
    texts = texts.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    links = texts.mapInArrow(_exact_edges(width, share), "a long, b long").distinct()

    linked = components(links).withColumnsRenamed({"node": "rep", "component": "c"})
    members = signs.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left").join(linked, "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return members.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; columns stay.  A doc_id that is
    kept keeps all its rows."""
    gone = near_duplicates(docs, id_col=id_col, **how).where("not kept").select("doc_id").distinct()
    return without(docs, id_col, materialise(gone, "gone"))
