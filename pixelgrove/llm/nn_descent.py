"""Near-duplicate embeddings by NN-descent.

A neighbour graph is refined until it settles: start lists come from blocks of equal signs along
random directions, then every round compares, at each node, the node's neighbours and reverse neighbours
with each other (neighbours of neighbours) and keeps each one's best, until few list entries change.
There are as many directions as two vectors at the threshold need to meet in one block with a probability of
``met``, so their number grows with the logarithm of a label's size.  Lists are short (saturated ones longer), so they
alone would lose links between dense groups: every block of a comparison therefore also gives a
spanning forest of all its pairs at the threshold, and groups come from these ties.

An audit judges every label on a sample of its own: it compares the sampled vectors with all of the label's rows, in blocks,
and takes a larger sample where it has seen links of fewer than ``audit_vectors`` vectors.  Labels in which too many links lie outside the
groups, by link or by vector, get further rounds with fresh directions, and as the last step (at once up to ``direct_rows`` rows) all their
rows are compared, in pairs of blocks.  Labels whose links are too rare for a judgement are compared whole up to ``whole_rows`` rows; larger ones get
fresh directions once and are reported as not judged.  What the audit saw of each label is logged and written to ``report``.

Edges at the threshold give groups; inside each group links are confirmed and counted exactly in
double precision, in blocks, so that the counts are whole however short the lists were.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, fixed_binary, forget, group_bounds, grouped, in_blocks, lists, materialise, sized

#: Vectors of one start block, of one exact block, members compared at one node at once, and vectors of one block of the last step.
START_BLOCK, EXACT_BLOCK, NODE_BLOCK, WHOLE_BLOCK = 192, 128, 128, 1024
#: Signs along random directions that a start block can be told by.
BITS = 40
#: Sets of directions that are worked on at once.
DIRECTIONS = 6
#: The lists have settled when at most this share of their entries is new.
SETTLED = 0.01
#: Rows that a comparison gives: list entries, and ties (links that hold a group together, whatever the lists keep).
_FOUND = "id long, nbr long, sim float, tie boolean"


_LOG = logging.getLogger(__name__)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, unit vector in double) of the vectors that can have links."""
    for batch in batches:
        column = batch.column(2)
        at = np.asarray(column.offsets).astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        wrong = np.append(0, np.cumsum(~np.isfinite(values)))
        size = np.diff(at)
        fine = (size > 0) & (wrong[at[1:]] == wrong[at[:-1]])
        for c in batch.columns:
            fine &= c.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(size[fine]).tolist():
            rows = np.flatnonzero(fine & (size == dim))
            x = values[at[rows][:, None] + np.arange(dim)]
            top = np.abs(x).max(1)
            rows, x = rows[top > 0], x[top > 0] / top[top > 0, None]  # no overflow or underflow in the norm
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(rows), dim, np.int32)), fixed_binary(x)], ["vec_id", "label", "dim", "v"])


@lru_cache(64)
def _directions(dim: int, seeds: tuple[int, ...]) -> np.ndarray:
    """BITS directions for each seed, one per column."""
    return np.concatenate([np.random.default_rng([s, dim]).standard_normal((dim, BITS)) for s in seeds], 1)


def _projected(seeds: tuple[int, ...]):
    """code: for each seed, the signs along its directions, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").to_pylist()
            code = np.zeros((len(f), len(seeds)), np.int64)
            size = np.array([len(x) // 4 for x in f])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                m = np.frombuffer(b"".join(f[x] for x in at), np.float32).reshape(len(at), dim)
                sign = (m @ _directions(dim, seeds) > 0).reshape(len(at), len(seeds), BITS)
                code[at] = sign @ (1 << np.arange(BITS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("f"), lists(code.reshape(-1), np.arange(len(f) + 1) * len(seeds), pa.int64())], ["id", "part", "f", "code"])

    return run


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links, as pairs of places."""
    left = link.any(1)
    x, y = [], []
    while left.any():
        open_ = [int(left.argmax())]
        left[open_[0]] = False
        while open_:
            at = open_.pop()
            more = np.flatnonzero(link[at] & left)
            left[more] = False
            open_ += more.tolist()
            x.append(np.full(len(more), at))
            y.append(more)
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return join(x), join(y)


def _best(k: int, level: float):
    """Of rows sorted by block keys with f: each one's k best others of its block, and the block's ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["part", "seed", "block", "sub"], 4000):
            keys = [table.column(c).to_numpy() for c in ("part", "seed", "block", "sub")]
            ids, f = table.column("id").to_numpy(), table.column("f").to_pylist()
            bounds = group_bounds(*keys)
            a, b, s, ties = [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                n = hi - lo
                if n < 2:
                    continue
                m = np.frombuffer(b"".join(f[lo:hi]), np.float32).reshape(n, -1)
                sim = m @ m.T
                np.fill_diagonal(sim, -2)
                top = min(k, n - 1)
                best = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                own = ids[lo:hi]
                a.append(np.repeat(own, top))
                b.append(own[best].reshape(-1))
                s.append(np.take_along_axis(sim, best, 1).reshape(-1))
                ties.append(own[np.stack(_forest(sim >= level))])
            yield _rows(a, b, s, ties)

    return run


def _rows(a: list, b: list, s: list, ties: list) -> pa.RecordBatch:
    n, more = sum(map(len, a)), sum(x.shape[1] for x in ties)
    join = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    a, b = a + [x[0] for x in ties], b + [x[1] for x in ties]
    return pa.RecordBatch.from_arrays([join(a, np.int64), join(b, np.int64), join([*s, np.ones(more)], np.float32), pa.array(np.arange(n + more) >= n)], ["id", "nbr", "sim", "tie"])


def _lists(k: int, most: int, level: float):
    """Of entries sorted by id: each one's k best distinct neighbours; up to most of those at the level (saturated lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["id"]):
            i, n, s, fresh = (table.column(c).to_numpy() for c in ("id", "nbr", "sim", "fresh"))
            order = np.lexsort((fresh, n, i))  # a pair that is known stays as it is
            i, n, s, fresh = i[order], n[order], s[order], fresh[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (n[1:] != n[:-1])
            i, n, s, fresh = i[first], n[first], s[first], fresh[first]
            order = np.lexsort((fresh, -s, i))
            i, n, s, fresh = i[order], n[order], s[order], fresh[order]
            bounds = group_bounds(i)
            size = np.diff(bounds)
            rank = np.arange(len(i)) - np.repeat(bounds[:-1], size)
            keep = (rank < k) | ((rank < most) & (s >= level))
            yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(n[keep]), pa.array(s[keep]), pa.array(fresh[keep])], ["id", "nbr", "sim", "fresh"])

    return run


def _local_join(k: int, level: float):
    """At each node (rows sorted by z, sub): members compared with each other; each one's best that beat its list, and the ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["z", "sub"], 20_000):
            z, sub, ids, worst = (table.column(c).to_numpy() for c in ("z", "sub", "u", "worst"))
            f = table.column("f").to_pylist()
            bounds = group_bounds(z, sub)
            a, b, s, ties = [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                n = hi - lo
                if n < 2:
                    continue
                m = np.frombuffer(b"".join(f[lo:hi]), np.float32).reshape(n, -1)
                sim = m @ m.T
                np.fill_diagonal(sim, -2)
                top = min(k, n - 1)
                best = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                value = np.take_along_axis(sim, best, 1)
                x, y = np.nonzero(value > worst[lo:hi, None])
                a.append(ids[lo + x])
                b.append(ids[lo + best[x, y]])
                s.append(value[x, y])
                ties.append(ids[lo:hi][np.stack(_forest(sim >= level))])
            yield _rows(a, b, s, ties)

    return run


def _all_ties(level: float):
    """Of rows sorted by (part, i, j): the ties of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["part", "i", "j"], 2000):
            ids, f = table.column("id").to_numpy(), table.column("f").to_pylist()
            bounds = group_bounds(*(table.column(c).to_numpy() for c in ("part", "i", "j")))
            ties = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                m = np.frombuffer(b"".join(f[lo:hi]), np.float32).reshape(hi - lo, -1)
                link = m @ m.T >= level
                np.fill_diagonal(link, False)
                ties.append(ids[lo:hi][np.stack(_forest(link))])
            yield _rows([], [], [], ties)

    return run


class Graph:
    """Neighbour lists of reps (id, part, n, f), kept as a scratch table of edges, and the ties found so far."""

    def __init__(self, reps: DataFrame, level: float, k: int, most: int, met: float, fixed: int | None = None) -> None:
        self.reps, self.level, self.k, self.most, self.met, self.fixed, self.seed = reps, level, k, most, met, fixed, 0
        self.edges: DataFrame | None = None
        self.ties: list[DataFrame] = []
        self.sizes = materialise(reps.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")
        self.largest = self.sizes.agg(F.max("n")).first()[0] or 0
        #: Chance that vectors at the level have equal signs along a direction.
        self.same = 1 - math.acos(min(1.0, max(-1.0, level))) / math.pi

    def _of(self, parts: DataFrame | None) -> DataFrame:
        return self.reps if parts is None else self.reps.join(sized(parts.select("part")), "part", "left_semi")

    def directions(self, n: int) -> int:
        """Sets of directions after which a pair at the level has met with probability met, in a part of n vectors."""
        bits = max(0, math.ceil(math.log2(max(1, n) / START_BLOCK)))
        together = self.same**bits
        return 1 if together >= self.met else math.ceil(math.log(1 - self.met) / math.log1p(-together))

    def _keep(self, found: DataFrame) -> bool:
        """Takes in what a comparison found; whether the lists have settled."""
        found = materialise(found, "found")
        self.ties.append(found.where("tie").select("id", "nbr"))
        rows = found.where("not tie").select("id", "nbr", "sim", F.lit(True).alias("fresh"))
        if self.edges is not None:
            rows = rows.union(self.edges.withColumn("fresh", F.lit(False)))
        after = materialise(rows.repartition("id").sortWithinPartitions("id").mapInArrow(_lists(self.k, self.most, self.level), "id long, nbr long, sim float, fresh boolean"), "graph")
        if self.edges is not None:
            forget(self.edges)
        self.edges = after.select("id", "nbr", "sim")
        total, new = after.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        return new <= SETTLED * total

    def start(self, parts: DataFrame | None = None) -> None:
        """Best neighbours inside blocks of equal signs along fresh random directions, of some parts or all."""
        need = self.fixed or self.directions(self.largest)
        while need > 0:
            self._blocks(self._of(parts), tuple(range(self.seed, self.seed + min(need, DIRECTIONS))))
            self.seed += min(need, DIRECTIONS)
            need -= DIRECTIONS

    def _blocks(self, reps: DataFrame, seeds: tuple[int, ...]) -> None:
        rows = materialise(reps.select("id", "part", "f").mapInArrow(_projected(seeds), "id long, part long, f binary, code array<long>"), "codes")
        codes = rows
        rows = rows.join(sized(self.sizes), "part").select("id", "part", "f", "n", F.posexplode("code").alias("seed", "code"))
        rows = rows.where((F.col("seed") == 0) | (F.col("n") > START_BLOCK))  # a part of one block meets as a whole
        bits = lambda count, block: F.greatest(F.ceil(F.log2(F.col(count) / block)), F.lit(0))
        low = lambda n: F.pmod("code", F.pow(F.lit(2.0), F.least(n, F.lit(BITS))).cast("long"))
        rows = rows.withColumn("bits", bits("n", START_BLOCK)).withColumn("block", low(F.col("bits")))
        keys = ["part", "seed", "block"]
        count = lambda name: sized(materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), "crowd"))
        rows = rows.join(count("c"), keys)  # a crowded block is told by more signs
        rows = rows.withColumn("block", low(F.col("bits") + bits("c", 2 * START_BLOCK)))
        rows = rows.join(count("e"), keys)  # and dealt out at random if it still is one
        rows = rows.withColumn("sub", F.pmod(F.xxhash64("id", "seed"), F.ceil(F.col("e") / (2 * START_BLOCK))))
        keys = ["part", "seed", "block", "sub"]
        rows = rows.select(*keys, "id", "f").repartition(*keys).sortWithinPartitions(*keys)
        self._keep(rows.mapInArrow(_best(self.k, self.level), _FOUND))
        forget(codes)

    def refine(self) -> bool:
        """One NN-descent round; whether the lists have settled."""
        worst = self.edges.groupBy("id").agg(F.min("sim").alias("worst"))
        both = self.edges.select(F.col("id").alias("z"), F.col("nbr").alias("u")).union(self.edges.select("nbr", "id")).union(self.reps.select("id", "id")).distinct()
        crowd = both.groupBy("z").agg(F.count(F.lit(1)).alias("c"))
        members = both.join(crowd, "z").withColumn("sub", F.pmod(F.xxhash64("u", "z"), F.ceil(F.col("c") / NODE_BLOCK)))
        vectors = self.reps.select(F.col("id").alias("u"), "f").join(worst.withColumnRenamed("id", "u"), "u", "left").fillna(-2.0, ["worst"])
        members = members.select("z", "u", "sub").join(vectors, "u").repartition("z", "sub").sortWithinPartitions("z", "sub")
        return self._keep(members.select("z", "sub", "u", "worst", "f").mapInArrow(_local_join(4, self.level), _FOUND))

    def settle(self, rounds: int = 1) -> None:
        """At least so many rounds, and on until few entries change; lists only get better, so this ends."""
        done = 0
        while not self.refine() or done + 1 < rounds:
            done += 1

    def compare_all(self, parts: DataFrame | None = None) -> None:
        """The ties of all pairs of some parts, or all."""
        rows = in_blocks(self._of(parts).select("id", "part", "f").join(sized(self.sizes), "part"), "part", "n", "id", WHOLE_BLOCK)
        rows = rows.select("part", "i", "j", "id", "f").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
        self.ties.append(materialise(rows.mapInArrow(_all_ties(self.level), _FOUND), "found").select("id", "nbr"))

    def groups(self) -> DataFrame:
        """(id, g) of the vectors that ties hold together."""
        ties = self.ties[0]
        for more in self.ties[1:]:
            ties = ties.union(more)
        out = materialise(components(ties.select(F.col("id").alias("a"), F.col("nbr").alias("b"))).withColumnsRenamed({"node": "id", "component": "g"}), "groups")
        for old in self.ties:
            forget(old)
        self.ties = [out.select("id", F.col("g").alias("nbr"))]
        return out

    def audit(self, groups: DataFrame, sample: int, most_sample: int, audit_vectors: int, done: DataFrame | None) -> DataFrame:
        """(part, n, sampled, seen, links, inside, share, judged) of every part but those of done.

        Of sampled vectors: seen have links, links of them, inside of which are inside one group; share is inside / links or its mean over the vectors if
        less.  A part is judged on audit_vectors vectors with links or all its rows.  At most most_sample vectors are taken at once.
        """
        sizes = self.sizes if done is None else self.sizes.join(sized(done.select("part")), "part", "left_anti")
        own = self.reps.join(groups, "id", "left").select("id", "part", F.coalesce("g", "id").alias("g"), "f")
        open_parts = materialise(sizes, "open")
        states: list[DataFrame] = []
        for limit in (sample, most_sample):
            many = open_parts.count()
            if not many:
                break
            quota = min(limit, most_sample / many)
            space = 1 << 30
            line = F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(space)) < F.lit(space) * F.least(F.lit(1.0), F.lit(float(quota)) / F.col("n"))
            within = own.join(sized(open_parts), "part")
            chosen = materialise(within.where(line).select("id", "part", "g", "f"), "sample")
            by_part: dict[tuple[int, int], list] = {}
            for r in chosen.toLocalIterator():  # most_sample vectors, about
                by_part.setdefault((r["part"], len(r["f"])), []).append((r["id"], r["g"], r["f"]))
            asked = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.stack([np.frombuffer(x[2], np.float32) for x in v])) for k, v in by_part.items()}
            each = within.select("id", "part", "g", "f").mapInArrow(_audited(asked, self.level), "part long, q long, links long, inside long")
            each = each.groupBy("part", "q").agg(F.sum("links").alias("links"), F.sum("inside").alias("inside"))
            share = F.least(F.sum("inside") / F.sum("links"), F.avg(F.col("inside") / F.col("links")))
            each = each.groupBy("part").agg(F.count(F.lit(1)).alias("seen"), F.sum("links").alias("links"), F.sum("inside").alias("inside"), share.alias("share"))
            taken = chosen.groupBy("part").agg(F.count(F.lit(1)).alias("sampled"))
            state = open_parts.select("part", "n").join(taken, "part", "left").join(each, "part", "left").fillna(0, ["sampled", "seen", "links", "inside"]).fillna(1.0, ["share"])
            state = materialise(state.withColumn("judged", (F.col("seen") >= audit_vectors) | (F.col("sampled") >= F.col("n"))), "state")
            final = limit == most_sample or quota < limit
            states.append(state if final else state.where("judged"))
            if final:
                break
            open_parts = materialise(state.where("not judged").select("part", "n"), "open")
        none = open_parts.sparkSession.createDataFrame([], "part long, n long, sampled long, seen long, links long, inside long, share double, judged boolean")
        return reduce(DataFrame.unionByName, states, none)


def _audited(asked: dict, level: float):
    """Of all rows: how many are linked with each sampled vector of their part, and how many of them share its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, p, g = (batch.column(c).to_numpy() for c in ("id", "part", "g"))
            f = batch.column("f").to_pylist()
            size = np.array([len(x) for x in f], np.int64)
            for part in np.unique(p).tolist():
                for n in np.unique(size[p == part]).tolist():
                    if (part, n) not in asked:
                        continue
                    qi, qg, q = asked[part, n]
                    at = np.flatnonzero((p == part) & (size == n))
                    for some in np.array_split(at, max(1, len(at) * len(qi) // (1 << 22))):
                        m = np.frombuffer(b"".join(f[x] for x in some), np.float32).reshape(len(some), -1)
                        x, y = np.nonzero(m @ q.T >= level)
                        real = i[some[x]] != qi[y]
                        x, y = x[real], y[real]
                        links = np.bincount(y, minlength=len(qi))
                        inside = np.bincount(y[g[some[x]] == qg[y]], minlength=len(qi))
                        seen = links > 0
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), part)), pa.array(qi[seen]), pa.array(links[seen]), pa.array(inside[seen])], ["part", "q", "links", "inside"])

    return run


def _exact(threshold: float):
    """Of (g, i, j, side, id, copies, v) sorted by (g, i, j): exact link counts (id, id, n) and a forest of links (a, b, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["g", "i", "j"], 2000):
            g, i, j, block, ids, copies = (table.column(c).to_numpy() for c in ("g", "i", "j", "block", "id", "copies"))
            v = table.column("v").to_pylist()
            bounds = group_bounds(g, i, j)
            a, b, n = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                m = np.frombuffer(b"".join(v[lo:hi]), np.float64).reshape(hi - lo, -1)
                own, many = ids[lo:hi], copies[lo:hi]
                link = m @ m.T >= threshold
                np.fill_diagonal(link, False)
                if i[lo] != j[lo]:  # links inside a block are counted where i = j
                    link &= block[lo:hi][:, None] != block[lo:hi]
                a += [own]
                b += [own]
                n += [link @ many]
                forest = Forest(hi - lo)
                for x in range(hi - lo - 1):
                    for y in np.flatnonzero(link[x, x + 1 :]).tolist():
                        if forest.join(x, x + 1 + y):
                            a.append(own[[x]])
                            b.append(own[[x + 1 + y]])
                            n.append(np.zeros(1, np.int64))
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([cat(a), cat(b), cat(n)], ["a", "b", "n"])

    return run


def near_embeddings(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    k: int = 8,
    most: int = 32,
    met: float = 0.99,
    directions: int | None = None,
    rounds: int = 2,
    sample: int = 1024,
    most_sample: int = 16_384,
    audit_vectors: int = 40,
    direct_rows: int = 20_000,
    whole_rows: int = 200_000,
    recall: float = 0.995,
    extra_rounds: int = 4,
    report: list[dict] | None = None,
) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    met: chance to meet that sets the number of directions, unless directions gives it; rounds: least number of rounds before the lists may count as settled; extra_rounds: times that fresh directions
    are tried before all rows of a label are compared, when the audit's recall is missed in it; sample, most_sample: vectors that an audit takes of a
    label at first, and of all labels at most; audit_vectors: with links, on which a label is judged; direct_rows: rows up to which a label that misses the recall is compared whole at
    once; whole_rows: rows up to which one that cannot be judged is; report: a list that takes what each audit saw of the first 10,000 labels.

    Vectors are compared only with equal, non-null labels (and equal length).  Equal directions count as
    copies of one vector from the start, so thousands of copies are one node.

    Defined cases: null, empty and zero vectors, and such with null or non-finite components, link with nothing and
    are their own component; repeated rows of one vec_id are one vector in the counts (the smallest, if they
    differ) and each returned; a null vec_id has no links, a null component and is kept; other columns are ignored.
    """
    ids = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    source = vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("string"), F.col(f"`{vector_col}`").cast("array<double>"))
    unit = materialise(source.mapInArrow(_unit, "vec_id long, label string, dim int, v binary"), "vectors")
    unit = materialise(unit.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("x")).select("vec_id", "x.*"), "unit")
    classes = unit.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column("v").to_pylist()]
            yield batch.append_column("f", pa.array(f, pa.binary()))

    classes = classes.select("label", "dim", "v", "id", "copies", F.xxhash64("label", "dim").alias("part"))
    classes = materialise(classes.mapInArrow(single, "label string, dim int, v binary, id long, copies long, part long, f binary"), "classes")

    graph = Graph(classes.select("id", "part", "f"), threshold - 1e-4, k, most, met, directions)
    graph.start()
    graph.settle(rounds)
    groups = graph.groups()
    done: DataFrame | None = None
    for attempt in range(extra_rounds + 1):
        state = materialise(graph.audit(groups, sample, most_sample, audit_vectors, done), "audit")
        seen = [r.asDict() for r in state.orderBy("share", "part").limit(10_000).collect()]
        _LOG.info("audit %d: %s", attempt, seen)
        if report is not None:
            report.append({"attempt": attempt, "parts": seen})
        short, rare = state.where(F.col("judged") & (F.col("share") < recall)), state.where("not judged")
        whole = rare.where(F.col("n") <= whole_rows).union(short.where(F.col("n") <= direct_rows))
        again = short.where(F.col("n") > direct_rows)
        again = again if attempt else again.union(rare.where(F.col("n") > whole_rows))
        if attempt == extra_rounds:
            whole, again = whole.union(short), again.limit(0)
        compared = not whole.isEmpty()
        if compared:
            graph.compare_all(whole)
            done = materialise(whole.select("part") if done is None else done.union(whole.select("part")), "done")
        going_on = not again.isEmpty()
        if going_on:
            graph.start(again)
            graph.settle()
        if compared or going_on:
            groups = graph.groups()
        if not going_on:
            break

    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    members = groups.join(sizes, "g").join(classes.select("id", "copies", "v"), "id")
    n = F.ceil(F.col("m") / F.lit(EXACT_BLOCK)).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("id", "g"), n).cast("int"))
    members = in_blocks(members, "g", "m", "id", EXACT_BLOCK).select("g", "i", "j", "block", "id", "copies", "v")
    members = members.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = materialise(members.mapInArrow(_exact(threshold), "a long, b long, n long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = components(found.where("a <> b").select("a", "b")).withColumnsRenamed({"node": "id", "component": "c"})
    told = classes.join(counts, "id", "left").join(parts, "id", "left")
    told = told.select("label", "dim", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "id").alias("c"))
    each = unit.join(told, ["label", "dim", "v"]).select("vec_id", "n", "c")
    component = F.coalesce("c", "vec_id")
    return ids.join(each, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
