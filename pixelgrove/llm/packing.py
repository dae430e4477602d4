"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Cutting is free, so every document is cut into pieces whose lengths are the reciprocal-capacity
class sizes capacity // k themselves, largest first: whole sequences, then halves, thirds ...
(at most a handful of pieces per document).  A class's bins hold a fixed number of pieces,
capacity // length, so a bin is full as soon as it has its count and classes fill independently
on all workers: a piece's bin follows from its rank in the class alone.

Ranks come from salted groups: row numbers within (length, salt), shifted by prefix sums over the
salts' counts, so the largest class is spread over as many tasks as there are shuffle partitions.  The last,
incomplete bin of every class goes to one small pool that is packed by first fit; the pool has
fewer than sum(capacity // length) pieces over the class sizes, whatever the input (about
10,000 for 2048).
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SLICE, Span, U, column_bytes, in_bytes, materialise, runs

#: Token runs whose ids a worker remembers before it starts over, and slots of its table.
CACHE_RUNS, _SLOT_BITS = 800_000, 21
#: Bytes from which on a token run is remembered by a digest of its bytes.
LONG_RUN = 48

# Classes of bytes as the tokenizer's splitting pattern sees them.
SPACE, LETTER, DIGIT, OTHER, FOREIGN, WHOLE = range(6)
_CLASS = np.array(
    [FOREIGN if b >= 0x80 else SPACE if b == 0x20 or 0x09 <= b <= 0x0D else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(256)],
    np.uint8,
)
#: Second bytes, after the first, of the code points below U+0280 that are no letters or that lower-casing takes apart: U+00D7, U+00F7, U+0130.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


# The tokenizer's normalising and splitting that `_token_runs` stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]


@lru_cache(2)
def _tokenizer(path: str):
    """The tokenizer, whether its tokens are those of `_token_runs`, by id whether it ends a run, and the runs known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    form = json.loads(made.to_str())
    parts, splits, model = ((form[x] or {}) for x in ("normalizer", "pre_tokenizer", "model"))
    suffix = model.get("end_of_word_suffix")
    words = (
        bool(suffix)
        and [x["type"] for x in parts.get("normalizers", [])] == _NORMALISERS
        and [x["pattern"].get("Regex") for x in splits.get("pretokenizers", []) if x["type"] == "Split"] == [_PATTERN]
    )
    vocabulary = made.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
    return made, words, ends, _Known()


class _Known:
    """Ids of the token runs seen so far: an open hash table of keys, and each row's stretch of ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows = 0
        self.key, self.row = np.zeros(1 << _SLOT_BITS, U), np.zeros(1 << _SLOT_BITS, np.int32)
        self.ids, self.limits = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not known."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), (keys >> U(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            there = self.key[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.row[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct keys that are not known, with their ids in a row."""
        n, at = self.rows, self.limits[self.rows]
        to = at + len(ids)
        if n + len(keys) + 1 > len(self.limits):
            self.limits = np.concatenate([self.limits, np.zeros(max(len(self.limits), len(keys)), np.int64)])
        if to > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        self.ids[at:to] = ids
        self.limits[n + 1 : n + 1 + len(keys)] = at + np.cumsum(sizes)
        self.rows = n + len(keys)
        todo, slot = np.arange(len(keys)), (keys >> U(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            free = self.key[slot] == 0
            self.key[slot[free]] = keys[todo[free]]
            won = self.key[slot] == keys[todo]
            self.row[slot[won]] = n + todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << _SLOT_BITS) - 1)


def _encode(runs: list[str], whole: np.ndarray, tokenizer, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the runs in a row and their numbers.  Those that are one token before merging are encoded
    as one text: an id that ends a run tells them apart."""
    size = np.zeros(len(runs), np.int64)
    single, apart = np.flatnonzero(~whole), np.flatnonzero(whole)
    text = " ".join([runs[i] for i in single.tolist()])
    together = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    size[single] = np.diff(np.flatnonzero(ends[together]) + 1, prepend=0)
    each = [x.ids for x in tokenizer.encode_batch_fast([runs[i] for i in apart.tolist()], add_special_tokens=False)]
    size[apart] = [len(x) for x in each]
    ids = np.empty(size.sum(), "<u4")
    mine = np.repeat(whole, size)
    ids[~mine], ids[mine] = together, [x for e in each for x in e]
    return ids, size


def _token_runs(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the token runs of the documents between bounds, and which bytes lie in stretches kept whole.

    A run is what the tokenizer's pattern takes as one token before its merges: letters, one digit, other marks, or a
    contraction.  A stretch between spaces stays whole if it holds a special token or a code point
    that normalising, lower-casing or classing could treat by its neighbours; the tokenizer splits it itself.
    """
    n = len(buf)
    kind = _CLASS[buf]
    after = np.append(buf[1:], np.uint8(0))
    lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
    if len(lead):
        fine = np.ones(len(lead), bool)
        for a, b in _NO_LETTERS:
            fine &= (buf[lead] != a) | (after[lead] != b)
        kind[lead[fine]] = LETTER
        kind[lead[fine] + 1] = LETTER
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    odd = np.flatnonzero((kind == FOREIGN) | ((buf == 0x3C) & (after == 0x7C)))
    if len(odd):
        start, end = runs(kind != SPACE, first)
        of = np.unique(np.searchsorted(start, odd, "right") - 1)
        edge = np.zeros(n + 1, np.int8)
        edge[start[of]] += 1
        edge[end[of]] -= 1
        kind[np.cumsum(edge[:-1], dtype=np.int8) > 0] = WHOLE
    change = first[:-1] | (kind == DIGIT)
    change[1:] |= kind[1:] != kind[:-1]
    # a lone apostrophe before these letters is one token with them
    quote = np.flatnonzero((buf[:-1] == 0x27) & (kind[:-1] == OTHER) & change[:-1] & (kind[1:] == LETTER) & ~first[1:-1])
    if len(quote):
        third = np.minimum(quote + 2, n - 1)  # at n a document ends, so what is read there is of no use
        one, two = buf[quote + 1] | 0x20, buf[third] | 0x20
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        same = (kind[third] == LETTER) & ~first[quote + 2]
        long = same & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        change[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        rest = rest[rest < n]
        change[rest] |= kind[rest] == LETTER
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    real = kind[start] != SPACE
    return start[real], end[real], kind == WHOLE


def token_ids(buf: np.ndarray, bounds: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of buf in a row, and the documents' limits in them.  A token run is encoded once per worker and looked
    up after that; with a tokenizer that splits texts in another way a whole document is one run."""
    tokenizer, words, ends, known = _tokenizer(path)
    if not len(buf):
        return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
    if words:
        start, end, whole = _token_runs(buf, bounds)
        lower = np.where(~whole & (buf >= 0x41) & (buf <= 0x5A), buf | 0x20, buf)
        whole = whole[start]
    else:
        full = np.diff(bounds) > 0
        start, end, lower, whole = bounds[:-1][full], bounds[1:][full], buf, np.ones(full.sum(), bool)
    keys = Span(lower).between(start, end)
    for i in np.flatnonzero(end - start >= LONG_RUN).tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(lower[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    keys[keys == 0] = 1
    row = known.find(keys)
    new = np.flatnonzero(row < 0)
    if len(new):
        own, at = np.unique(keys[new], return_index=True)
        if known.rows + len(own) > CACHE_RUNS:
            known.clear()
            own, at = np.unique(keys, return_index=True)
            new = np.arange(len(keys))
        at = new[at]
        data = lower.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
        known.add(own, *_encode(texts, whole[at], tokenizer, ends))
        row = known.find(keys)
    at, size = known.limits[row], known.limits[row + 1] - known.limits[row]
    total = np.append(0, np.cumsum(size))
    ids = known.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
    return ids, total[np.searchsorted(start, bounds)]


@lru_cache(4)
def _cuts(capacity: int) -> list[list[int]]:
    """How a rest of r < capacity ids is cut, for every r."""
    out: list[list[int]] = [[]]
    for r in range(1, capacity):
        size = capacity // (capacity // (r + 1) + 1)
        out.append([size, *out[r - size]])
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, last = _cuts(capacity), np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            buf, bounds = column_bytes(batch.column(1))
            for a, b in in_bytes(bounds, 2 * BLOCK_BYTES):
                ids, limits = token_ids(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], path)
                sizes: list[int] = []
                crcs: list[int] = []
                count = []
                for at, to in zip(limits[:-1].tolist(), limits[1:].tolist()):
                    data = ids[at:to].tobytes() + last
                    n, x = to - at + 1, 0
                    own = [capacity] * (n // capacity) + cuts[n % capacity]
                    for size in own:
                        crcs.append(zlib.crc32(data[x : x + 4 * size]))
                        x += 4 * size
                    sizes += own
                    count.append(len(own))
                length, number = np.array(sizes, np.int64), np.repeat(np.arange(b - a), count)
                before = np.cumsum(length) - length
                tokens = np.diff(limits) + 1
                start = before - (limits[:-1] + np.arange(b - a))[number]
                doc = batch.column(0).slice(a, b - a).take(pa.array(number))
                columns = [doc, pa.array(start), pa.array(length), pa.array(np.array(crcs, np.int64)), pa.array(tokens[number])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room: list[int] = []
        bins, offsets = [], []
        for n in rows["length"].tolist():
            for k, left in enumerate(room):
                if left >= n:
                    break
            else:
                k = len(room)
                room.append(capacity)
            bins.append(k)
            offsets.append(capacity - room[k])
            room[k] -= n
        rows["sequence_id"], rows["offset"] = np.array(bins, np.int64) * (capacity + 1), np.array(offsets, np.int64)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined cases: a null or empty text is the end id alone; rows that repeat, or share a doc_id, are packed
    each; a null doc_id is packed as such; other columns are ignored; an empty table gives none.
    sequence_id is unique per sequence, not consecutive.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(counts, ["length", "salt"])
    fill = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).withColumn("fill", fill)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("fill")).cast("long")).withColumn("bins", F.floor(F.col("total") / F.col("fill")).cast("long"))
    ranked = materialise(ranked, "ranked")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("bin < bins").select(*out, (F.col("bin") * (capacity + 1) + F.col("length")).alias("sequence_id"), ((F.col("rank") % F.col("fill")) * F.col("length")).alias("offset"))
    pool = ranked.where("bin >= bins").select(*out, F.lit(0).alias("pool")).groupBy("pool").applyInPandas(_first_fit(capacity), full.schema)
    return full.unionByName(pool)
