"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (a shorter item is one
pattern).  Per pattern length m a scanner holds

* a shift table over blocks of two words: how far the search position may jump when it stands
  at the end of such a block (m - 1 for blocks that no pattern holds),
* buckets of patterns by the hash of their whole last-m words (the suffix at a zero shift), and
* the pattern's bytes, which confirm every occurrence directly.

Many search positions move at once: each document is cut into segments, one cursor each, and
one step moves all cursors of a batch by their table's shift.

The patterns are broadcast inside the scanner.  Their number is checked: above
``patterns_per_pass`` the benchmark is searched in several passes over slices of the patterns,
so no pass ships more than the bound.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN, U, Words, blocks, lists, materialise, mix, without

#: Words of a segment: the stretch of ends that one cursor covers.
SEGMENT = 192
_TABLE_BITS = 20
_ITEM_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _pair(h: np.ndarray) -> np.ndarray:
    """Block code of the words (t - 1, t) at t; the first has none."""
    out = np.zeros(len(h), U)
    if len(h) > 1:
        out[1:] = mix(h[:-1] * U(3) + h[1:])
    return out >> U(64 - _TABLE_BITS)


class Scanner:
    """Patterns of one length in words."""

    def __init__(self, m: int, patterns: dict[bytes, list[int]]) -> None:
        """patterns: words joined by one space -> numbers of the items."""
        self.m = m
        self.texts = sorted(patterns)
        self.items = [sorted(set(patterns[t])) for t in self.texts]
        self.shift = np.full(1 << _TABLE_BITS, max(m - 1, 1), np.int32)
        code = np.empty(len(self.texts), U)
        for n, text in enumerate(self.texts):
            buf = np.frombuffer(text, np.uint8)
            words = Words(buf, np.array([0, len(buf)]), PLAIN)
            code[n] = words.grams(m)[0]
            if m > 1:
                blocks_at = _pair(words.hash)[1:].astype(np.int64)
                np.minimum.at(self.shift, blocks_at, np.arange(m - 2, -1, -1, dtype=np.int32))
        if m == 1:
            self.shift[:] = 0
        order = np.argsort(code, kind="stable")
        self.code, self.order = code[order], order

    def search(self, words: Words) -> list[tuple[int, int]]:
        """(first word, number of the pattern) of all occurrences that lie inside one document."""
        m, total = self.m, len(words.hash)
        if total < m or not len(self.texts):
            return []
        whole = words.grams(m)
        block = _pair(words.hash)
        # cursors: ends t in [start, stop) of every document, cut into segments
        low, high = words.first[:-1] + m - 1, words.first[1:]
        count = np.maximum(0, -(-(high - low) // SEGMENT))
        doc = np.repeat(np.arange(len(low)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = low[doc] + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, high[doc])
        found: list[np.ndarray] = []
        while len(at):
            jump = self.shift[block[at].astype(np.int64)]
            zero = jump == 0
            ends = at[zero]
            if len(ends):
                code = whole[ends - m + 1]
                place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                found.append(ends[self.code[place] == code])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        out = []
        for end in np.concatenate(found).tolist() if found else []:
            s = end - m + 1
            code = whole[s]
            place = int(np.searchsorted(self.code, code))
            text = b" ".join(words.buf[a:b].tobytes() for a, b in zip(words.start[s : end + 1], words.end[s : end + 1]))
            while place < len(self.code) and self.code[place] == code:
                n = int(self.order[place])
                if self.texts[n] == text:
                    out.append((s, n))
                place += 1
        return out


def patterns_of(items: list[tuple], window: int) -> dict[int, dict[bytes, list[int]]]:
    """By length: pattern -> numbers of the items that hold it.  items: (number, utf-8 text), and the first and last + 1 of its windows if not all."""
    out: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for number, text, *part in items:
        buf = np.frombuffer(text.lower(), np.uint8)
        words = Words(buf, np.array([0, len(buf)]), PLAIN)
        each = [buf[a:b].tobytes() for a, b in zip(words.start, words.end)]
        if not each:
            continue
        m = min(window, len(each))
        for i in range(*(part or (0, len(each) - m + 1))):
            out[m][b" ".join(each[i : i + m])].append(number)
    return {m: dict(x) for m, x in out.items()}


def _scan(scanners: list[Scanner], ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[list[int]] = [[] for _ in range(n)]
            for a, b, words in blocks(batch.column(1), PLAIN, lower=True):
                n_words[a:b] = np.diff(words.first)
                hit: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
                for scanner in scanners:
                    for s, p in scanner.search(words):
                        d = int(np.searchsorted(words.first, s, "right")) - 1
                        hit[d].append((s - int(words.first[d]), scanner.m, scanner.items[p]))
                for d, places in hit.items():
                    covered = np.zeros(int(n_words[a + d]) + 1, np.int8)
                    own = set()
                    for s, m, of in places:
                        covered[s : s + m] = 1
                        own.update(of)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered])))
                    spans[a + d] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                    n_hit[a + d] = int(covered.sum())
                    items[a + d] = sorted({ids[x] for x in own})
            flat = [y for x in spans for z in x for y in z]
            span_bounds = np.append(0, np.cumsum([2 * len(x) for x in spans]))
            item_bounds = np.append(0, np.cumsum([len(x) for x in items]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words), pa.array(n_hit), lists(np.array(flat, np.int64), span_bounds, pa.int64()), lists(np.array([y for x in items for y in x], np.int64), item_bounds, pa.int64())],
                ["doc_id", "text_key", "n_words", "n_hit", "spans", "items"],
            )

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    patterns_per_pass: int = 500_000,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside an occurrence), spans (limits of the hit
    stretches, alternating), items (ids of the benchmark items that occur).

    Defined cases: a null or empty text has no words and no hits; null, empty or wordless items
    give no pattern; items may repeat (same id twice counts once); items with a null id are left
    out; an empty benchmark marks nothing; other columns are ignored; repeated rows are each
    returned.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    lines = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    passes: list[DataFrame] = []
    schema = "doc_id long, text_key long, n_words long, n_hit long, spans array<long>, items array<long>"
    held: list[tuple] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        ids = [x[0] for x in held]
        scanners = [Scanner(m, x) for m, x in sorted(patterns_of([(n, *x[1:]) for n, x in enumerate(held)], window).items())]
        passes.append(source.mapInArrow(_scan(scanners, ids), schema))
        held, size = [], 0

    # the benchmark streams through the driver slice by slice; a slice never exceeds the bound, not even within a long item
    for row in lines.toLocalIterator():
        text = row["text"].encode()
        n = len(_ITEM_WORD.findall(text))
        windows, at = (max(1, n - window + 1) if n else 0), 0
        while at < windows:
            to = min(windows, at + patterns_per_pass - size)
            held.append((row["item_id"], text, at, to))
            size, at = size + to - at, to
            if size >= patterns_per_pass:
                flush()
    if held or not passes:
        flush()
    if len(passes) == 1:
        return passes[0].drop("text_key")
    # several passes: spans are united per row; rows of one doc_id are told apart by their text's hash
    every = materialise(passes[0].withColumn("_p", F.lit(0)), "pass")
    for k, x in enumerate(passes[1:], 1):
        every = every.unionByName(materialise(x.withColumn("_p", F.lit(k)), "pass"))
    return _united(every)


def _united(every: DataFrame) -> DataFrame:
    """One row per document row of the rows of all passes: hit words are counted over the union of the spans."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "text_key", "_p").orderBy("n_words"))
    merged = (
        every.withColumn("_r", rank)
        .groupBy("doc_id", "text_key", "_r")
        .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return merged.withColumn("spans", _union("s")).select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def _union(limits: str) -> Column:
    """Alternating limits of spans, as those of disjoint ones in order."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(limits) / 2).cast("int") - 1), lambda i: F.struct(F.get(limits, (2 * i).cast("int")).alias("a"), F.get(limits, (2 * i + 1).cast("int")).alias("b")))
    none = F.array().cast("array<long>")

    def add(out: Column, x: Column) -> Column:
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), x["b"])))
        return F.when((F.size(out) > 0) & (x["a"] <= F.get(out, F.size(out) - 1)), longer).otherwise(F.concat(out, F.array(x["a"], x["b"])))

    return F.when(F.size(limits) == 0, none).otherwise(F.aggregate(F.array_sort(pairs), none, add))


def items_digest(items: str = "items"):
    """sha-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",").cast("binary"), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; columns stay."""
    marked = contamination(docs, benchmark, id_col=id_col, **how)
    gone = marked.where("n_hit > 0 and doc_id is not null").select("doc_id").distinct()
    return without(docs, id_col, materialise(gone, "contaminated"))
