"""Toxicity by multiple-instance learning.

Only documents carry labels.  A sentence's probability is logistic in its words and word
beginnings; a document is toxic if any sentence is (noisy-or: 1 - prod(1 - p)).  Fitting the
document likelihood therefore teaches the sentence scores, which then locate the sentences.

Fitting takes a bounded sample of the labelled rows (``sample``, by hash order), copies once.  Spark
counts the sample's features by label and keeps the at most ``features`` most telling of those that
chance does not explain; the driver then sees only the places of these features in the sample and
fits the weights.  Scoring is one pass over all
texts, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, U, Words, blocks, materialise, mix, signed
from .minhash import shingle_sets

#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) of every word and then every beginning, and the document of every word."""
    n = len(words.buf)
    stops = np.cumsum(_STOP[words.buf])
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    sentence = stops[words.start] + doc  # rises from document to document, so none share a number
    codes, places = [words.hash], [sentence]
    if n:
        for k in BEGINNINGS:
            long = words.end - words.start > k
            s = words.start[long]
            codes.append(mix(words.between(s, s + k) + U(k)))
            places.append(sentence[long])
    return np.concatenate(codes), np.concatenate(places), doc


@dataclass
class Model:
    """Sorted feature hashes with weights, and the bias of a sentence."""

    code: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.code >> U(44)).astype(np.int64)] = True

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into codes, index into self.code) of the features that the model has."""
        maybe = np.flatnonzero(self.gate[(codes >> U(44)).astype(np.int64)])
        if not len(maybe) or not len(self.code):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.code, codes[maybe]), len(self.code) - 1)
        same = self.code[place] == codes[maybe]
        return maybe[same], place[same]


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_noisy_or(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, empty: np.ndarray, label: np.ndarray, prior: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood; weights are held near their prior, so that a few
    telling features do not explain the sample alone.

    doc: of each sentence that holds features; sentence, feature: its places; empty: each
    document's sentences without features; label: of each document.
    """
    w, b = prior.copy(), -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    n = len(label)
    for t in range(1, steps + 1):
        z = np.bincount(sentence, w[feature], minlength=len(doc)) + b if len(doc) else np.zeros(0)
        total = np.bincount(doc, _softplus(z), minlength=n) + empty * _softplus(b)
        p = np.clip(-np.expm1(-total), 1e-9, 1)
        pull = np.where(label == 1, -(1 - p) / p, 1.0) / n
        gz = pull[doc] * _sigmoid(z)
        g = np.bincount(feature, gz[sentence], minlength=len(w)) + ridge * (w - prior) / n
        g = np.append(g, gz.sum() + (pull * empty).sum() * _sigmoid(b))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two minima over the text's word shingles: near copies share them with the probability of their similarity."""
    for batch in batches:
        marks = np.zeros((2, batch.num_rows), U)
        for i, x in enumerate(shingle_sets(batch.column(2), 5)):
            marks[:, i] = (mix(x + U(1)).min(), mix(x ^ U(77)).min()) if len(x) else (0, i)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(marks[0])), pa.array(signed(marks[1]))], ["doc_id", "toxic", "text", "a", "b"])


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, words in blocks(batch.column(2), PLAIN, lower=True):
            codes, places, doc = _features(words)
            own = np.concatenate([doc, *[doc[words.end - words.start > k] for k in BEGINNINGS]]) if len(doc) else doc
            pair = np.unique(np.stack([signed(codes), own]), axis=1) if len(codes) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(toxic[a + pair[1]].astype(np.int64))], ["code", "toxic"])


def _sentence_features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in blocks(batch.column(2), PLAIN, lower=True):
                codes, places, doc = _features(words)
                at, which = model.matches(codes)
                first = np.zeros(b - a, np.int64)
                sentences = np.zeros(b - a, np.int64)
                base = places[: len(doc)]
                for d in range(b - a):
                    x = base[words.first[d] : words.first[d + 1]]
                    sentences[d] = len(np.unique(x))
                    first[d] = x[0] if len(x) else 0
                owner = np.concatenate([doc, *[doc[words.end - words.start > k] for k in BEGINNINGS]])[at] if len(doc) else at
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(b - a + 1))
                s = (places[at] - first[owner])[order] if len(at) else at
                bounds = pa.array(cut, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sentences), pa.ListArray.from_arrays(bounds, pa.array(s.astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(which[order].astype(np.int64)))],
                    ["doc_id", "toxic", "sentences", "sentence", "feature"],
                )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: Column | None = None,
    sample: int = 20_000,
    features: int = 4_000,
    at_least: int = 4,
    steps: int = 250,
    ridge: float = 1.0,
) -> Model:
    """Fit on labelled rows (``rows``: a condition on id_col that says which labels may be used)."""
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("int").alias("toxic")).where(f"`{id_col}` is not null and toxic is not null")
    if rows is not None:
        known = known.where(rows)
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    chosen = materialise(known.orderBy(F.xxhash64(id_col), id_col).limit(sample), "sample")
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), id_col)
    texts = materialise(texts.select(F.col(id_col).cast("long").alias("doc_id"), "toxic", "text"), "texts")
    # copies are one observation, else a copied toxic text would make all its words telling
    texts = texts.mapInArrow(_with_marks, "doc_id long, toxic int, text string, a long, b long")
    for mark in ("a", "b"):
        texts = texts.groupBy(mark, "toxic").agg(F.min(F.struct("doc_id", "text", "a", "b")).alias("x")).select("toxic", "x.*")
    texts = materialise(texts.select("doc_id", "toxic", "text"), "observations")
    toxic, total = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    empty = Model(np.zeros(0, U), np.zeros(0), -6.0)
    if not toxic or toxic == total:  # nothing to tell apart
        return Model(empty.code, empty.weight, 6.0 if toxic else -9.0)
    counts = texts.mapInArrow(_document_features, "code long, toxic long").groupBy("code").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialise(counts, "counts")
    rate, n, p = toxic / total, F.col("n"), F.col("p")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    # likelihood ratio of "as often in toxic documents as elsewhere", above what chance gives among so many features
    gain = 2 * (part(p, n * rate) + part(n - p, n * (1 - rate)) + part(toxic - p, (total - n) * rate) + part(total - n - toxic + p, (total - n) * (1 - rate)))
    chance = 2 * math.log(max(2, counts.count())) + 4
    told = counts.withColumn("gain", gain).where((n >= at_least) & (p > n * rate) & (F.col("gain") >= chance))
    ranked = told.orderBy(F.desc("gain"), "code").limit(features).toPandas()
    pseudo = 5  # observations at the base rate that every feature is given
    hits, seen = ranked["p"].to_numpy(float), ranked["n"].to_numpy(float)
    odds = np.log((hits + pseudo * rate) / (seen - hits + pseudo * (1 - rate))) - math.log(rate / (1 - rate))
    order = np.argsort(ranked["code"].to_numpy().view(U))
    code = ranked["code"].to_numpy().view(U)[order].copy()
    model = Model(code, np.zeros(len(code)), -6.0)
    told = texts.mapInArrow(_sentence_features(model), "doc_id long, toxic int, sentences long, sentence array<long>, feature array<long>").toPandas()
    told = told.sort_values("doc_id", kind="stable", ignore_index=True)  # sums in one order, however the rows were dealt
    label = told["toxic"].to_numpy()
    size = told["feature"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(told)), size)
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in told[c]] or [np.zeros(0, np.int64)])
    place, feature = flat("sentence"), flat("feature")
    keys, sentence = np.unique(owner * (1 << 32) + place, return_inverse=True)
    doc = (keys >> 32).astype(np.int64)
    bare = told["sentences"].to_numpy() - np.bincount(doc, minlength=len(told))
    weight, bias = fit_noisy_or(doc, sentence, feature, bare, label, np.clip(odds, -1, 4)[order], steps, ridge)
    return Model(code, weight, bias)


def text_scores(column: pa.Array, model: Model, offending: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of every text and its sentences that score offending or more."""
    out = np.zeros(len(column))
    spans: list[list[dict]] = [[] for _ in range(len(column))]
    for a, b, words in blocks(column, PLAIN, lower=True):
        if not len(words.start):
            continue
        codes, places, doc = _features(words)
        at, which = model.matches(codes)
        base = places[: len(doc)]
        edge = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
        owner, name = doc[edge], base[edge]  # one row per sentence with words; names rise
        z = np.full(len(edge), model.bias)
        if len(at):
            z += np.bincount(np.searchsorted(name, places[at]), model.weight[which], minlength=len(edge))
        part = _softplus(z)
        out[a:b] = -np.expm1(-np.bincount(owner, part, minlength=b - a))
        last = np.append(edge[1:], len(base)) - 1
        for k in np.flatnonzero(-np.expm1(-part) >= offending).tolist():
            d = int(owner[k])
            origin = int(words.bounds[d])
            spans[a + d].append({"start": int(words.start[edge[k]]) - origin, "end": int(words.end[last[k]]) - origin, "score": float(-np.expm1(-part[k]))})
    return out, spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, score and the offending sentences as (start, end, score) in bytes of the text's UTF-8.

    Defined cases: a null or empty text has no sentence and scores 0; repeated rows, null ids and clashing or
    extra columns change nothing, as every row is scored by its text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = text_scores(batch.column(1), model, offending)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(spans, _SPANS)], ["doc_id", "score", "sentences"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores threshold or more; columns stay, no join or shuffle."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, _ = text_scores(batch.column(at), model, 2.0)
            yield batch.filter(pa.array(out < threshold))

    return docs.mapInArrow(run, docs.schema)
