"""Line deduplication with a once-seen and a twice-seen Bloom filter.

Pass 1 reads the lines and sets bits: every task keeps, per slice of the bit space, the
positions that it saw in one document and those that it saw in two or more, packed as 16-bit
offsets.  Merging a slice over the tasks gives the global twice-seen filter: a bit is set in it
if two tasks have it in their once-seen sets or one has it in its twice-seen set.  The filter
has a fixed size (``2**log_bits`` bits), so it may be broadcast; a larger corpus only raises the
share of false suspects, never the result.

Pass 2 tests the lines again; only suspected repeats (all their bits twice-seen) are shuffled,
as 128-bit hashes, to be counted exactly and to find the row that keeps the line.  Pass 3
rewrites the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SLICE, U, group_bounds, grouped, materialise, own_name, mix, sized

_SPACE = b" \t\n\x0b\x0c\r"
_SLICE_BITS = 16
_MASK = (1 << 64) - 1


def _key(line: bytes, least: int) -> bytes | None:
    """The key of a line, if it has at least so many code points."""
    key = line.strip(_SPACE)
    if len(key) < least:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key.lower()


def _keys(text: bytes, least: int) -> set[int]:
    """128-bit hashes of the distinct keys of a text."""
    return {xxhash.xxh3_128_intdigest(k) for x in text.split(b"\n") if (k := _key(x, least)) is not None}


def _places(hashes: np.ndarray, log_bits: int, k: int) -> np.ndarray:
    """k bit positions of each 64-bit hash."""
    return np.stack([mix(hashes + U(i * 0x9E37)) >> U(64 - log_bits) for i in range(1, k + 1)])


def _texts(column: pa.Array) -> Iterator[bytes]:
    for k in range(0, len(column), SLICE):
        yield from (x or b"" for x in column.slice(k, SLICE).cast(pa.binary()).to_pylist())


def twice_seen(texts: DataFrame, least: int, log_bits: int, k: int) -> np.ndarray:
    """The twice-seen filter (packed bits) of the lines of texts (column text)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            low = [x & _MASK for text in _texts(batch.column(0)) for x in _keys(text, least)]
            held.append(np.array(low, U))
        hashes, count = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
        if not len(hashes):
            return
        places = _places(hashes, log_bits, k)
        spot, which = np.unique(places.reshape(-1), return_inverse=True)
        often = np.bincount(which, weights=np.tile(count, k)) >= 2
        part = spot >> U(_SLICE_BITS)
        offset = (spot & U((1 << _SLICE_BITS) - 1)).astype("<u2")
        bounds = group_bounds(part)
        rows = zip(bounds[:-1].tolist(), bounds[1:].tolist())
        once, more = [], []
        for a, b in rows:
            once.append(offset[a:b].tobytes())
            more.append(offset[a:b][often[a:b]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["part", "once", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["part"], 2000):
            part = table.column("part").to_numpy()
            once, more = table.column("once").to_pylist(), table.column("more").to_pylist()
            ids, bits = [], []
            bounds = group_bounds(part)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                n = np.bincount(np.frombuffer(b"".join(once[a:b]), "<u2"), minlength=1 << _SLICE_BITS)
                n[np.frombuffer(b"".join(more[a:b]), "<u2")] = 2
                if (n >= 2).any():
                    ids.append(int(part[a]))
                    bits.append(zlib.compress(np.packbits(n >= 2).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits, pa.binary())], ["part", "bits"])

    parts = texts.mapInArrow(local, "part long, once binary, more binary")
    parts = parts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part long, bits binary")
    size = 1 << (_SLICE_BITS - 3)
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for row in parts.toLocalIterator():  # at most 2**log_bits bits in all, whatever the input
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def suspects(docs: DataFrame, seen, least: int, log_bits: int, k: int) -> DataFrame:
    """(doc_id, h, l): distinct keys of each document of which all bits are twice-seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in batches:
            ids, high, low = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                for x in _keys(text, least):
                    ids.append(doc)
                    high.append(x >> 64)
                    low.append(x & _MASK)
            low_, high_ = np.array(low, U), np.array(high, U)
            hit = np.ones(len(low_), bool)
            for place in _places(low_, log_bits, k):
                hit &= (bits[(place >> U(3)).astype(np.int64)] >> (U(7) - (place & U(7))).astype(np.uint8)) & 1 == 1
            doc = pa.array(ids, pa.int64()).filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([doc, pa.array(high_[hit].view(np.int64)), pa.array(low_[hit].view(np.int64))], ["doc_id", "h", "l"])

    return docs.mapInArrow(run, "doc_id long, h long, l long")


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 40,
    documents: int = 5,
    log_bits: int = 28,
    hashes: int = 2,
    counts: bool = True,
) -> DataFrame:
    """docs with the text rewritten, and, with counts, n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of at
    least ``least`` code points in at least ``documents`` documents stay only in the largest
    doc_id that holds them (with all their lines there).

    Defined cases: a null text counts as empty and becomes empty, one empty line; repeated rows
    (same doc_id) count as one document and are each rewritten; rows with a null doc_id keep all their
    lines and count for nothing; own columns n_lines and n_dropped of docs, in any case, are replaced by the counts.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seen = spark.sparkContext.broadcast(twice_seen(source.select("text"), least, log_bits, hashes))
    found = materialise(suspects(source, seen, least, log_bits, hashes), "suspects")
    seen.destroy()  # the suspects are written; no later plan reads the filter
    often = found.distinct().groupBy("h", "l").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= documents).drop("n")
    often = materialise(often, "often")
    drops = found.distinct().join(sized(often), ["h", "l"]).where("doc_id <> keep")
    drops = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h", "l")).alias("lines"), F.count(F.lit(1)).alias("n"))
    drops = materialise(drops, "drops")
    pairs = drops.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    doc, lines_ = own_name("doc"), own_name("lines")
    drops = drops.select(F.col("doc_id").alias(doc), F.col("lines").alias(lines_))

    columns = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    joined = joined.join(sized(drops, pairs, BROADCAST_ROWS), F.col(f"`{id_col}`").cast("long") == F.col(doc), "left").drop(doc)
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            lines, gone, out = [], [], []
            drop = batch.column(len(columns)).to_pylist()
            for text, own in zip(_texts(batch.column(at)), drop):
                each = text.split(b"\n")
                lines.append(len(each))
                if own:
                    away = {(x["h"] & _MASK) << 64 | (x["l"] & _MASK) for x in own}
                    each = [x for x in each if (k := _key(x, least)) is None or xxhash.xxh3_128_intdigest(k) not in away]
                gone.append(lines[-1] - len(each))
                out.append(b"\n".join(each) if gone[-1] else text)
            made = pa.array(out, pa.binary()).cast(batch.schema.field(at).type)
            more = [pa.array(lines, pa.int64()), pa.array(gone, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 : len(columns)], *more], columns + ["n_lines", "n_dropped"][: len(more)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(columns)])
    return joined.mapInArrow(run, f"{fields}, n_lines long, n_dropped long" if counts else fields)
