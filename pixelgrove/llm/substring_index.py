"""Substring deduplication with a log-structured fingerprint index.

Every window of ``window`` words has an anchor, the least hash of its word runs of ``gram`` words, so equal windows
have equal anchors.  Consecutive windows of a document with one anchor form an entry (fp, r): the anchor and the hash of all the
words that they cover; about one word in 18 starts one.  Documents arrive in batches:

1. A batch's entries are pre-aggregated to the first document of each (fp, r).
2. This table is one immutable run of the index, bucketed and sorted by (fp, r), so the merge join with the older
   runs, bucketed alike, shuffles no history.
3. An entry that an earlier document (of history or of the batch) has too is removed whole: all its windows start there as well.
4. Inside a longer repeat nearly all entries agree; at its ends they differ.  Where an anchor has several
   different entries, one of them new, the windows of their first documents are hashed one by one (96 bits) and
   verified: a window goes if an earlier document holds it.  No other document needs this, as all its windows are in the entry's first one.
5. When there are more than ``max_runs`` runs they are compacted: merged into one, first documents only.

An index that is kept also keeps its documents' texts, for step 4, so a later call gets new texts alone.

Nothing is gathered per fingerprint.  Hashes held by very many documents (fewer than HOT_SHARE can exist) are looked up where
the rows are, the others by a plain equi-join.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SLICE, SPACED, U, Words, blocks, forget, grams, materialise, own_name, scratch_dir, signed, sized, stretches

GRAM = 16
#: Entries with more than this part of all rows count as hot, so there are at most so many.
HOT_SHARE = 10_000
_RUN = "fp BIGINT, r BIGINT, doc_id BIGINT, last BIGINT, `rows` BIGINT"
#: Stands for every document of history: smaller than any doc_id.
EARLIER = -(1 << 63)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive elements; two running passes in all."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.concatenate([x, np.full(-n % w, 0xFFFFFFFFFFFFFFFF, U)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).reshape(-1)
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the anchor, and whether the window lies inside one document."""
    gram = min(GRAM, window)
    least = _least(grams(words.hash, gram), window - gram + 1)
    end = np.repeat(words.first[1:], np.diff(words.first))[: len(least)]
    return least, np.arange(len(least)) + window <= end


def entries(texts: DataFrame, window: int) -> DataFrame:
    """(fp, r, doc_id, start, n) of texts (doc_id, text): n windows from the start-th word on have the anchor fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, words in blocks(batch.column(1), SPACED, lower=False):
                least, inside = anchors(words, window)
                first, last = inside.copy(), inside.copy()
                same = least[1:] == least[:-1]
                first[1:] &= ~(inside[:-1] & same)
                last[:-1] &= ~(inside[1:] & same)
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                doc = np.searchsorted(words.first, start, "right") - 1
                r = stretches(words.hash, start, end + window - 1) if len(start) else np.zeros(0, U)
                place = (start - words.first[doc]).astype(np.int32), (end - start).astype(np.int32)
                columns = [pa.array(signed(least[start])), pa.array(signed(r)), pa.array(ids[a + doc]), *map(pa.array, place)]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "r", "doc_id", "start", "n"])

    return texts.mapInArrow(run, "fp long, r long, doc_id long, start int, n int")


class FingerprintIndex:
    """Sorted immutable runs of (fp, r, doc_id, last, rows) in a folder that all executors share: first and last document with
    the entry, and how often it occurs.

    folder: where the index lives; without one it is a scratch index for one call, which keeps no texts.
    An index with a folder can be opened again by the same folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, max_runs: int = 4) -> None:
        self.spark, self.folder, self.kept, self.max_runs = spark, folder or scratch_dir(spark), folder is not None, max_runs
        self.runs: list[str] = []
        self.texts: list[DataFrame] = []
        self.made = 0
        if self.kept:
            self._open()

    def _open(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted((x.getPath().getName() for x in files.listStatus(path)), key=lambda x: int(x.split("-")[1])) if files.exists(path) else []
        replaced = max((int(x.split("-")[1]) for x in names if x.startswith("merged-")), default=-1)
        for name in names:
            kind, number, buckets = name.split("-")
            self.made = max(self.made, int(number) + 1)
            if not files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")):
                continue  # left by a lost call
            if kind == "texts":
                self.texts.append(self.spark.read.schema("doc_id long, text string").parquet(f"{self.folder}/{name}"))
            elif int(number) >= replaced:
                table = f"entries_{uuid.uuid4().hex}"
                self.spark.sql(f"CREATE TABLE {table} ({_RUN}) USING parquet CLUSTERED BY (fp, r) SORTED BY (fp, r) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
                self.runs.append(table)

    def read(self, runs: list[str] | None = None) -> DataFrame:
        """The rows of some runs, or all."""
        out = None
        for name in self.runs if runs is None else runs:
            rows = self.spark.table(name)
            out = rows if out is None else out.union(rows)
        return out if out is not None else self.spark.createDataFrame([], _RUN)

    def _write(self, rows: DataFrame, kind: str = "run") -> str:
        """One run, of rows that a group-by (fp, r) has dealt out: as many buckets as shuffle partitions, so each is one file."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"entries_{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists").bucketBy(buckets, "fp", "r").sortBy("fp", "r").format("parquet")
        writer.option("path", f"{self.folder}/{kind}-{self.made}-{buckets}").saveAsTable(table)
        self.made += 1
        return table

    def append(self, rows: DataFrame, texts: DataFrame) -> str:
        """A new run; its documents' texts are kept too if the index is."""
        if self.kept:
            path = f"{self.folder}/texts-{self.made}-0"
            texts.write.mode("errorifexists").parquet(path)
            texts = self.spark.read.schema("doc_id long, text string").parquet(path)
            self.made += 1
        name = self._write(rows)
        self.runs.append(name)
        self.texts.append(texts)
        return name

    def compact(self) -> None:
        """Merge all runs into one of first documents."""
        if len(self.runs) > 1:
            rows = self.read().groupBy("fp", "r").agg(F.min("doc_id").alias("doc_id"), F.max("last").alias("last"), F.sum("rows").alias("rows"))
            merged = self._write(rows, "merged")
            self._drop(self.runs)
            self.runs = [merged]

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            rows = self.spark.table(name)
            forget(rows)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Forget the tables' names; files of a scratch index go too."""
        for name in self.runs:
            if not self.kept:
                forget(self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def _windows(window: int):
    """Of (doc_id, text, fps): hash and start of every window with one of these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2).to_pylist()
            for a, b, words in blocks(batch.column(1), SPACED, lower=False):
                least, inside = anchors(words, window)
                hit = np.zeros(len(least), bool)
                for d in range(a, b):
                    lo, hi = words.first[d - a], min(words.first[d - a + 1], len(least))
                    if lo < hi:
                        hit[lo:hi] = np.isin(signed(least[lo:hi]), wanted[d])
                start = np.flatnonzero(hit & inside)
                w, v = words.grams(window), words.grams(window, True)
                doc = np.searchsorted(words.first, start, "right") - 1
                if len(start):
                    columns = [signed(w[start]), (v[start] >> U(32)).astype(np.uint32).view(np.int32), ids[a + doc], (start - words.first[doc]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["w", "v", "doc_id", "start"])

    return run


def _places(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """The windows anchored at (fp, doc_id) of rows, from texts (doc_id, text)."""
    wanted = materialise(rows.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "anchors")
    size = wanted.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0))).first()[0]
    looked = texts.join(sized(wanted, size), "doc_id").select("doc_id", "text", "fps")
    return looked.mapInArrow(_windows(window), "w long, v int, doc_id long, start int")


def _hot(keys: list) -> Callable:
    """Of rows (two hashes, doc_id, start, n): those that hot keys (two hashes, first) give an earlier document, neighbours joined."""
    one, two, first = (np.array([k[c] for k in keys], np.int64) for c in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, doc, start, n = (c.to_numpy().astype(np.int64) for c in batch.columns)
            at = np.minimum(np.searchsorted(one, x), len(one) - 1)
            hit = (one[at] == x) & (two[at] == y) & (doc > first[at])
            doc, start, end = doc[hit], start[hit], (start + n)[hit]
            if len(doc):
                new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != end[:-1]))
                last = np.append(new[1:], True)
                yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(start[new].astype(np.int32)), pa.array((end[last] - start[new]).astype(np.int32))], ["doc_id", "start", "n"])

    return run


def _matched(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n) of the rows (two hashes, doc_id, start, n) with an earlier document by the table keys (two hashes, first, rows).

    Hot keys, fewer than HOT_SHARE, are looked up where the rows are; the others, with few rows each, by a plain join.
    """
    on = keys.columns[:2]
    total = keys.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = keys.where(F.col("rows") > max(1000, total // HOT_SHARE)).orderBy(*on).collect()
    same = Counter(k[0] for k in hot)
    hot = [k for k in hot if same[k[0]] == 1]
    rows = rows.select(*on, "doc_id", "start", "n")
    cold = rows
    if hot:
        table = F.broadcast(rows.sparkSession.createDataFrame([tuple(k[:2]) for k in hot], keys.select(*on).schema))
        cold, keys = rows.join(table, on, "left_anti"), keys.join(table, on, "left_anti")
    out = cold.join(keys.select(*on, "first"), on).where("doc_id > first").select("doc_id", "start", "n")
    return out.union(rows.mapInArrow(_hot(hot), "doc_id long, start int, n int")) if hot else out


def repeats(texts: DataFrame, index: FingerprintIndex, window: int) -> DataFrame:
    """Takes the batch texts (doc_id, text) into the index; (doc_id, spans) of its windows that an earlier document
    holds: limits of their starts, alternating."""
    older = list(index.texts)
    each = materialise(entries(texts, window), "entries")
    history = index.read().groupBy("fp", "r").agg(F.count(F.lit(1)).alias("runs"))
    firsts = each.groupBy("fp", "r").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    old = index.read().select("fp", "doc_id")
    new = index.spark.table(index.append(firsts, texts))

    known = new.join(history, ["fp", "r"], "left").withColumn("first", F.when(F.col("runs").isNull(), F.col("doc_id")).otherwise(F.lit(EARLIER)))
    keys = materialise(known.where("first < last").select("fp", "r", "first", "rows"), "keys")
    whole = _matched(each, keys)

    # anchors of several different entries, one of them new
    fresh = materialise(new.join(history, ["fp", "r"], "left_anti").select("fp", "doc_id"), "fresh")
    n = fresh.count()
    near = old.join(F.broadcast(fresh.select("fp").distinct()), "fp", "left_semi") if n <= BROADCAST_ROWS else old
    seen = fresh.select("fp", F.lit(1).alias("new")).union(near.select("fp", F.lit(0)))
    doubt = seen.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("new").alias("new")).where("c > 1 and new = 1").select("fp")
    doubt = sized(materialise(doubt, "doubt"))
    places = _places(fresh.join(doubt, "fp"), texts, window)
    if older:
        before = older[0]
        for x in older[1:]:
            before = before.union(x)
        held = _places(old.join(doubt, "fp"), before, window)
        places = places.union(held.withColumn("doc_id", F.lit(EARLIER)))
    places = materialise(places, "windows")
    single = places.groupBy("w", "v").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    single = materialise(single.where("first < last").select("w", "v", "first", "rows"), "firsts")
    part = _matched(places.withColumn("n", F.lit(1)), single)

    spans = whole.union(part).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("x")).select("doc_id", "x.start", "x.n")
    out = materialise(spans.mapInArrow(_spans, "doc_id long, spans array<int>"), "repeats")
    for done in (each, keys, fresh, places, single):
        forget(done)
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of starts as disjoint ones: first, last + 1, first, last + 1 ..."""
    for batch in batches:
        at, start, n = np.asarray(batch.column(1).offsets), np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
        at = at - at[0]
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            order = np.argsort(start[lo:hi], kind="stable")
            s = start[lo:hi][order]
            e = np.maximum.accumulate((s + n[lo:hi][order]))
            cut = np.flatnonzero(s[1:] > e[:-1])
            out.append(np.stack([s[np.append(0, cut + 1)], e[np.append(cut, len(s) - 1)]], 1).reshape(-1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "spans"])


def _rest(columns: list[str], at: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            n, gone, out = [], [], []
            for text, spans in zip(texts, batch.column(len(columns)).to_pylist()):
                words = text.split()
                n.append(len(words))
                if spans:
                    kept, at_word = [], 0
                    for a, b in zip(spans[::2], spans[1::2]):  # a run of starts covers up to its last start's window
                        kept += words[at_word:a]
                        at_word = max(at_word, b - 1 + window)
                    words = kept + words[at_word:]
                gone.append(n[-1] - len(words))
                out.append(b" ".join(words))
            made = pa.array(out, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 : len(columns)], pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_words", "n_removed"])

    return run


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    batches: int = 3,
    max_runs: int = 1,
    index: FingerprintIndex | None = None,
) -> DataFrame:
    """docs with the kept words joined by one space as text, and n_words (before) and n_removed.

    Words are runs of anything but ASCII white space.  Removed is every word that is covered by a
    window whose word sequence also starts in a document with a smaller doc_id; windows are judged
    on the input.

    index: history; every document in it counts as earlier than those of docs, whatever its id, and a document that is sent
    again repeats itself.  It takes in docs, so the next call needs new documents only.  Without one a scratch index serves
    the batches (of rising doc_id) of this call, with max_runs as its bound.

    Defined cases: null texts become empty; texts shorter than the window stay; rows with a null
    doc_id are neither indexed nor changed; repeated rows of one doc_id do not count against each
    other (doc_id is the key of the text); own columns named n_words and n_removed, in any case, are replaced.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    own = index is None
    index = FingerprintIndex(spark, max_runs=max_runs) if own else index
    cuts = sorted(set(texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    limits = [None, *[int(x) for x in cuts], None]
    starts = None
    for low, high in zip(limits[:-1], limits[1:]):
        batch = texts
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found = repeats(batch, index, window)
        starts = found if starts is None else starts.unionByName(found)
        if len(index.runs) > index.max_runs and not (own and high is None):
            index.compact()
    if own:
        index.close()
    total = starts.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    doc, spans = own_name("doc"), own_name("spans")
    starts = starts.select(F.col("doc_id").alias(doc), F.col("spans").alias(spans))

    columns = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    joined = joined.join(sized(starts, total, BROADCAST_ROWS), F.col(f"`{id_col}`").cast("long") == F.col(doc), "left").drop(doc)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(columns)])
    return joined.mapInArrow(_rest(columns, columns.index(text_col), window), f"{fields}, n_words long, n_removed long")
