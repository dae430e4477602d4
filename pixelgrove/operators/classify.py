"""Classifiers fitted by aggregation: naive Bayes, linear and quadratic discriminants, nearest neighbours.

Fitting is one partial aggregation (moments per class); the driver holds d x d matrices only.
Scoring is a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


@dataclass
class Moments:
    """Per class: rows, mean vector, covariance (population)."""

    classes: list
    n: np.ndarray
    mean: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, features: Sequence[str], label: str) -> Moments:
    """One pass: counts, sums and products of the features by class, shifted by the overall means for accuracy."""
    d = len(features)
    centre = df.agg(*[F.avg(f).alias(f"c{i}") for i, f in enumerate(features)]).first()
    x = [F.col(f).cast("double") - F.lit(float(centre[i] or 0.0)) for i, f in enumerate(features)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).orderBy(label).collect()
    k = len(rows)
    n, mean, cov = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for c, r in enumerate(rows):
        n[c] = r["n"]
        m = np.array([r[f"s{i}"] for i in range(d)]) / n[c]
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = r[f"p{i}_{j}"] / n[c] - m[i] * m[j]
        mean[c] = m + np.array([float(centre[i] or 0.0) for i in range(d)])
    return Moments([r[label] for r in rows], n, mean, cov)


def _pick(classes: list, scores: list[Column]) -> Column:
    """The class of the largest score; the first on ties."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(scores[0] == best, F.lit(classes[0]))
    for c, s in zip(classes[1:], scores[1:]):
        out = out.when(s == best, F.lit(c))
    return out


@dataclass
class ScoreModel:
    """Class scores as expressions over the features."""

    classes: list
    scores: list[Column]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, _pick(self.classes, self.scores))

    def probabilities(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        top = F.greatest(*self.scores) if len(self.scores) > 1 else self.scores[0]
        e = [F.exp(s - top) for s in self.scores]
        total = sum(e[1:], e[0])
        return df.withColumns({f"{prefix}{c}": x / total for c, x in zip(self.classes, e)})


def gaussian_naive_bayes(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1e-9) -> ScoreModel:
    """Variances are smoothed by smoothing times the largest overall feature variance."""
    m = moments(df, features, label)
    prior = m.n / m.n.sum()
    mu = (prior[:, None] * m.mean).sum(0)
    overall = (prior[:, None] * (np.diagonal(m.cov, axis1=1, axis2=2) + (m.mean - mu) ** 2)).sum(0)
    var = np.diagonal(m.cov, axis1=1, axis2=2) + smoothing * overall.max()
    scores = []
    for c in range(len(m.classes)):
        s = F.lit(float(math.log(prior[c]) - 0.5 * np.log(2 * math.pi * var[c]).sum()))
        for i, f in enumerate(features):
            gap = F.col(f).cast("double") - float(m.mean[c, i])
            s = s - gap * gap * float(0.5 / var[c, i])
        scores.append(s)
    return ScoreModel(m.classes, scores)


def linear_discriminant(df: DataFrame, features: Sequence[str], label: str, shrinkage: float = 0.0) -> ScoreModel:
    """Common covariance (1 - s) S + s tr(S) / d I of the classes; the score is linear."""
    m = moments(df, features, label)
    prior, d = m.n / m.n.sum(), len(features)
    cov = (prior[:, None, None] * m.cov).sum(0)
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d)
    w = np.linalg.lstsq(cov, m.mean.T, rcond=None)[0].T
    bias = -0.5 * (m.mean * w).sum(1) + np.log(prior)
    scores = []
    for c in range(len(m.classes)):
        s = F.lit(float(bias[c]))
        for i, f in enumerate(features):
            s = s + F.col(f).cast("double") * float(w[c, i])
        scores.append(s)
    return ScoreModel(m.classes, scores)


def quadratic_discriminant(df: DataFrame, features: Sequence[str], label: str, regularisation: float = 0.0) -> ScoreModel:
    """Covariance per class (divided by n - 1), its eigenvalues pulled to 1: (1 - r) l + r."""
    m = moments(df, features, label)
    prior = m.n / m.n.sum()
    scores = []
    for c in range(len(m.classes)):
        cov = m.cov[c] * m.n[c] / max(1.0, m.n[c] - 1)
        value, axes = np.linalg.eigh(cov)
        value = np.maximum((1 - regularisation) * value + regularisation, 1e-300)
        inverse = axes @ np.diag(1 / value) @ axes.T
        gap = [F.col(f).cast("double") - float(m.mean[c, i]) for i, f in enumerate(features)]
        s = F.lit(float(math.log(prior[c]) - 0.5 * np.log(value).sum()))
        for i in range(len(features)):
            for j in range(i, len(features)):
                s = s - gap[i] * gap[j] * float(inverse[i, j] * (0.5 if i == j else 1.0))
        scores.append(s)
    return ScoreModel(m.classes, scores)


# ---------------------------------------------------------------- nearest neighbours


def _distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of q from every row of t, summed by dimension as a column expression would; NaN: not defined."""
    out = np.zeros((len(q), len(t)))
    if metric == "cosine":
        for x, y in zip(q.T, t.T):
            out += x[:, None] * y
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((t * t).sum(1))
        return 1 - out / np.where(size == 0, np.nan, size)
    for x, y in zip(q.T, t.T):
        gap = np.abs(x[:, None] - y)
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        else:
            out += gap if metric == "manhattan" else gap * gap
    return out if metric in ("manhattan", "chebyshev") else np.sqrt(out)


def vote(neighbours: DataFrame, query: str = "query", weights: str = "uniform") -> DataFrame:
    """(query, prediction) of (query, label, distance): uniform, 1/d (exact matches alone vote if there are any)
    or -d weights; ties go to the smallest label."""
    w = {"uniform": F.lit(1.0), "negative": -F.col("distance")}.get(weights)
    if w is None:
        exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy(query))
        w = F.when(exact == 1, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.nullif(F.col("distance"), F.lit(0.0)))
    votes = neighbours.withColumn("_w", w).groupBy(query, "label").agg(F.round(F.sum("_w"), 12).alias("_w"))
    return votes.groupBy(query).agg(F.max_by("label", F.struct("_w", -F.col("label"))).alias("prediction"))


#: Most training rows and queries of one block of the exact search, of SLICE queries at a time; bytes of vectors of a block, and of the blocks one task holds.
TRAIN_BLOCK, QUERY_BLOCK, SLICE = 8192, 8192, 128
BLOCK_BYTES, HELD_BYTES = 1 << 23, 1 << 27


def _matrix(v: pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors as rows; what is missing is NaN."""
    out = np.full((len(v), max(length, 1)), np.nan)
    lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
    if len(v) and length and (lengths == length).all():
        out[:] = pc.list_flatten(v).to_numpy(zero_copy_only=False).reshape(len(v), length)
        return out
    for x, values in zip(out, v.to_pylist()):
        if values is not None:
            x[: len(values)] = [np.nan if e is None else e for e in values]
    return out


def _pairs(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """_distances of row by row pairs: the same sums in the same order."""
    out = np.zeros(len(q))
    if metric == "cosine":
        for x, y in zip(q.T, t.T):
            out += x * y
        size = np.sqrt((q * q).sum(1)) * np.sqrt((t * t).sum(1))
        return 1 - out / np.where(size == 0, np.nan, size)
    for x, y in zip(q.T, t.T):
        gap = np.abs(x - y)
        out += gap * gap
    return np.sqrt(out)


class _Pair:
    """A block of queries q against one of training rows t, made ready for matrix products; hashes: of both, a row for each table."""

    def __init__(self, q: np.ndarray, t: np.ndarray, metric: str, hashes: tuple[np.ndarray, np.ndarray] | None = None):
        self.t, self.metric, self.hashes = t, metric, hashes
        self.plain = metric not in ("cosine", "euclidean") or not (np.isfinite(q).all() and np.isfinite(t).all()) or not len(t)
        if self.plain:
            return
        if metric == "cosine":
            size, other = np.sqrt((q * q).sum(1))[:, None], np.sqrt((t * t).sum(1))[:, None]
            self.plain = not (size.all() and other.all())
            if self.plain:
                return
            q, t = q / size, t / other
        else:
            centre = t.mean(0)
            q, t = q - centre, t - centre
        square = (t * t).sum(1)
        self.square = (q * q).sum(1)
        # rows a, b with a . b = |q - t|^2 - |q|^2, and what the error of a product is a multiple of
        self.a, self.b = np.c_[-2 * q, np.ones(len(q))], np.c_[t, square].T
        self.scale = (q.shape[1] + 8) * (2 * np.sqrt(self.square * square.max()) + square.max())
        self.single = (self.a.astype(np.float32), self.b.astype(np.float32)) if self.scale.max(initial=0) < 1e30 else None

    def squares(self, limit: np.ndarray, rows: slice) -> np.ndarray:
        """Distances as the products give them."""
        return (2 * limit if self.metric == "cosine" else limit * limit) - self.square[rows]

    def met(self, rows: slice) -> np.ndarray:
        out = np.zeros((len(self.hashes[0][0][rows]), len(self.t)), bool)
        for x, y in zip(*self.hashes):
            out |= x[rows, None] == y
        return out


def _near_pairs(q: np.ndarray, rows: slice, pair: _Pair, top: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) that hold each row's top nearest ones and all ties, without those beyond a row's limit; q: these rows of the pair.

    Matrix products find the pairs in question, first in single precision, with a margin over their error; only for those the distance is summed by
    dimension.  With hashes only pairs that share one count.
    """
    known = np.isfinite(limit).all()
    met = pair.met(rows) if pair.hashes is not None and (pair.plain or not known) else None

    def least(key: np.ndarray) -> np.ndarray:
        if key.shape[1] < top:
            return np.full(len(key), np.inf)
        out = np.partition(key, top - 1, axis=1)[:, top - 1]
        return np.where(np.isnan(out), np.inf, out)

    if pair.plain:
        dist = _distances(q, pair.t, pair.metric)
        key = np.where(np.isnan(dist), np.inf, dist)
        key = key if met is None else np.where(met, key, np.nan)  # NaN sorts behind the rest and is no pair
        at, of = np.nonzero(key <= np.minimum(least(key), limit)[:, None])
        return at, of, dist[at, of]
    for single in (True, False) if pair.single else (False,):
        a, b = pair.single if single else (pair.a, pair.b)
        key = a[rows] @ b
        if met is not None:
            key = np.where(met, key, np.nan)
        cut = pair.squares(limit, rows)
        if not known:
            cut = np.minimum(cut, least(key))
        cut = cut + (2.4e-7 if single else 2e-12) * pair.scale[rows] + 1e-30
        near = key <= np.nextafter(cut.astype(key.dtype), np.inf, dtype=key.dtype)[:, None]
        if not single or np.count_nonzero(near) <= 64 * top * len(q):
            break
    at, of = np.divmod(np.flatnonzero(near), near.shape[1])
    if pair.hashes is not None and met is None:
        shared = np.zeros(len(at), bool)
        for x, y in zip(*pair.hashes):
            shared |= x[rows][at] == y[of]
        at, of = at[shared], of[shared]
    return at, of, _pairs(q[at], pair.t[of], pair.metric)


class _Best:
    """The k nearest training rows of a block of queries among the blocks that it has met, by (distance, id); undefined distances last."""

    def __init__(self, queries: pa.Array, q: np.ndarray, k: int, metric: str, hashes: np.ndarray | None = None):
        self.queries, self.q, self.k, self.metric, self.hashes = queries, q, k, metric, hashes
        self.limit, self.found = np.full(len(q), np.inf), None

    def add(self, ids: pa.Array, labels: pa.Array, t: np.ndarray, hashes: np.ndarray | None = None) -> None:
        """A block of training rows, in the order of their ids."""
        width = max(self.q.shape[1], t.shape[1])
        q, t = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan) if x.shape[1] < width else x for x in (self.q, t))
        pair = _Pair(q, t, self.metric, None if hashes is None else (self.hashes, hashes))
        top, parts = min(self.k, len(t)), []
        for low in range(0, len(q) if top else 0, SLICE):
            rows = slice(low, low + SLICE)
            at, of, dist = _near_pairs(q[rows], rows, pair, top, self.limit[rows])
            if len(at) > top * len(q[rows]):
                order = np.lexsort((of, np.where(np.isnan(dist), np.inf, dist), np.isnan(dist), at))
                order = order[_first(at[order], top)]
                at, of, dist = at[order], of[order], dist[order]
            parts.append((at + low, of, dist))
        if not sum(len(at) for at, _, _ in parts):
            return
        at, of, dist = (np.concatenate(x) for x in zip(*parts))
        of = pa.array(of)
        found = pa.table([pa.array(at, pa.int64()), pa.array(dist, mask=np.isnan(dist)), ids.take(of), labels.take(of)], names=["at", "distance", "id", "label"])
        found = pa.concat_tables([self.found, found]) if self.found is not None else found
        found = found.take(pc.sort_indices(found, sort_keys=[("at", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
        at = found.column("at").to_numpy()
        kept = _first(at, self.k)
        self.found = found.take(pa.array(np.flatnonzero(kept))).combine_chunks()
        at, dist = self.found.column("at").to_numpy(), self.found.column("distance").to_numpy()
        last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
        full = np.bincount(at, minlength=len(q))[at[last]] == self.k
        self.limit[at[last]] = np.where(full & ~np.isnan(dist[last]), dist[last], np.inf)

    def table(self) -> pa.Table:
        if self.found is None:
            return None
        return pa.table([self.queries.take(self.found.column("at")), *(self.found.column(c) for c in ("id", "label", "distance"))], names=["query", "id", "label", "distance"])


def _first(at: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n of their group; at: groups, in order."""
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    return np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) < n


def _nearest_in_blocks(k: int, metric: str):
    """Of a pair of blocks: each query's k nearest training rows, by (distance, id); undefined distances last."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        train = table.filter(pa.array(side == 1)).sort_by("id")
        queries = table.filter(pa.array(side == 0))
        length = pc.max(pc.list_value_length(table.column("v"))).as_py() or 0
        best = _Best(queries.column("query").combine_chunks(), _matrix(queries.column("v"), length), k, metric)
        best.add(train.column("id"), train.column("label"), _matrix(train.column("v"), length))
        found = best.table()
        return found if found is not None else pa.table([table.column(c).slice(0, 0) for c in ("query", "id", "label")] + [pa.array([], pa.float64())], names=["query", "id", "label", "distance"])

    return run


def _packed(size: int, tables: int, metric: str):
    """Rows as blocks of at most size rows: one row a block, its vectors in bytes, in single precision where that is exact.

    A block holds vectors of one length; those with missing or non-finite values (for cosine: zeros alone) have blocks of their own,
    so that the others can be compared by products.
    """

    def data(x: np.ndarray) -> tuple[bytes, bool]:
        with np.errstate(over="ignore", invalid="ignore"):
            small = x.astype(np.float32)
        single = bool(((small == x) | np.isnan(x)).all())
        return (small if single else x).tobytes(), single

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held)
        del held
        lengths = pc.fill_null(pc.list_value_length(whole.column("v")), 0).to_numpy()
        for length in np.unique(lengths):
            of = whole.take(pa.array(np.flatnonzero(lengths == length))).sort_by("id")
            v = _matrix(of.column("v"), int(length))
            odd = ~np.isfinite(v).all(1) | ((v == 0).all(1) if metric == "cosine" else False)
            h = _matrix(of.column("h"), tables) if tables else np.zeros((len(v), 0))
            most = max(1, min(size, BLOCK_BYTES // (8 * v.shape[1])))
            for rows in (np.flatnonzero(~odd), np.flatnonzero(odd)):
                for part in np.array_split(rows, -(-len(rows) // most)) if len(rows) else []:
                    (vectors, v_single), (hashes, h_single) = data(v[part]), data(h[part])
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), of.column(c).take(pa.array(part)).combine_chunks()) for c in ("id", "label")]
                    columns = [pa.array([number], pa.int64()), pa.array([v.shape[1]], pa.int32()), *lists, pa.array([vectors], pa.binary()), pa.array([v_single]), pa.array([hashes], pa.binary()), pa.array([h_single])]
                    yield pa.RecordBatch.from_arrays(columns, _BLOCK)
                    number += 1

    return run


_BLOCK = ["number", "width", "id", "label", "v", "v_single", "h", "h_single"]


def _search(k: int, metric: str, tables: int):
    """Rows of a block of queries and one of training rows, in the order of the blocks of queries: the k nearest of every query among the rows of this task."""

    def values(batch: pa.RecordBatch, side: str, name: str, row: int) -> np.ndarray:
        single = batch.column(f"{side}_{name}_single")[row].as_py()
        return np.frombuffer(batch.column(f"{side}_{name}")[row].as_buffer(), np.float32 if single else np.float64).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def done() -> Iterator[pa.RecordBatch]:
            found = best.table() if best is not None else None
            yield from found.to_batches() if found is not None else []

        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row]  # noqa: E731, B023
                hashes = lambda side: values(batch, side, "h", row).reshape(-1, tables).T.copy() if tables else None  # noqa: E731, B023
                if value("q_number").as_py() != now:
                    yield from done()
                    now = value("q_number").as_py()
                    best = _Best(value("q_id").values, values(batch, "q", "v", row).reshape(-1, value("q_width").as_py()), k, metric, hashes("q"))
                best.add(value("t_id").values, value("t_label").values, values(batch, "t", "v", row).reshape(-1, value("t_width").as_py()), hashes("t"))
        yield from done()

    return run


def nearest(train: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", vector: str = "x", label: str = "y", id_col: str = "id") -> DataFrame:
    """(query, id, label, distance) of the k nearest training rows, by (distance, id); exact, for any number of rows.

    Rows are packed in blocks, once, in the shared folder.  A task reads some blocks of queries and some of training rows and keeps the k best of every query;
    those of the tasks are merged by query.  No vector is shuffled for a pair of blocks.
    """
    index = train.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    return _in_blocks(index, asked, k, metric)


def _in_blocks(index: DataFrame, asked: DataFrame, k: int, metric: str, tables: int = 0) -> DataFrame:
    """index: id, label, v; asked: query, v; with tables both have an array h of that many hashes, and only rows that share one with the query count."""
    kinds = {f.name: f.dataType.simpleString() for f in [*index.schema, *asked.schema]}
    cores = index.sparkSession.sparkContext.defaultParallelism
    more = ["h"] * (tables > 0)

    def packed(df: DataFrame, size: int, side: str) -> tuple[DataFrame, int]:
        rows, values = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(0))), F.lit(0))).first()
        blocks = max(1, -(-8 * rows // (7 * size)), -(-8 * values // BLOCK_BYTES), min(cores, rows // 1024))
        names = {"number": "long", "width": "int", "id": f"array<{df.schema['id'].dataType.simpleString()}>", "label": f"array<{kinds['label']}>", "v": "binary", "v_single": "boolean", "h": "binary", "h_single": "boolean"}
        out = written(df.repartition(blocks).mapInArrow(_packed(size, tables, metric), ", ".join(f"{n} {t}" for n, t in names.items())))
        return out.toDF(*[f"{side}_{n}" for n in names]), values

    left, _ = packed(asked.select(F.col("query").alias("id"), F.lit(None).cast(kinds["label"]).alias("label"), "v", *more), QUERY_BLOCK, "q")
    right, values = packed(index.select("id", "label", "v", *more), TRAIN_BLOCK, "t")
    parts = max(1, -(-8 * values // HELD_BYTES), -(-cores // max(1, left.rdd.getNumPartitions())))
    schema = ", ".join(f"{name} {kinds[name]}" for name in ("query", "id", "label")) + ", distance double"
    pairs = left.crossJoin(right.coalesce(parts).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(_search(k, metric, tables), schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def nearest_lsh(train: DataFrame, queries: DataFrame, k: int, bucket: float, tables: int = 8, radius: float = float("inf"), vector: str = "x", label: str = "y", id_col: str = "id", others: bool = False, whole: bool = False) -> DataFrame:
    """Approximate k nearest training rows through bucketed random projections (euclidean); others: a query's own id is no neighbour.

    Rows that share a bucket of any table are compared, inside pairs of blocks: no pair is a row of a table, and a vector is packed once, not
    for each table and bucket.  The products of a pair of blocks cover all its rows, so buckets only leave neighbours out; whole: rows that
    share none count as well, the result is exact, and vectors without a distance (null, not finite) are no neighbours and have none.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    row = lambda df, *more: df.select(F.col(id_col).alias("id"), *more, F.col(vector).cast("array<double>").alias("v"))
    t, q = row(train, F.col(label).alias("label")), row(queries).withColumnRenamed("id", "query")
    wanted = k + 1 if others else k
    if whole:
        pairs = _in_blocks(t, q, wanted, "euclidean")
    else:
        t, q = (x.withColumn("_v", array_to_vector("v")) for x in (t, q))
        model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=1).fit(t)
        hashed = lambda df: model.transform(df).withColumn("h", F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])).drop("_v")
        pairs = _in_blocks(hashed(t), hashed(q), wanted, "euclidean", tables)
    pairs = pairs.where(F.col("distance") < radius) if whole or radius != float("inf") else pairs
    pairs = pairs.where("query <> id") if others else pairs
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
