"""Clustering quality over a contingency table (keys, label, pred, n) and over feature rows.

A contingency has classes x clusters rows per key, however many pixels stand behind it, so the
windows here are over small groups.  Pair counts use decimals: n squared overflows integers early.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import _sized, written

EPS = 1e-15


def _margins(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds a (label total), b (prediction total) and total to the non-zero cells."""
    t = table.where("n > 0")
    w = lambda *c: Window.partitionBy(*[F.col(k) for k in keys], *c)
    return t.withColumns({"a": F.sum("n").over(w("label")), "b": F.sum("n").over(w("pred")), "total": F.sum("n").over(w() if keys else Window.partitionBy())})


# ---------------------------------------------------------------- matching clusters to classes


def max_agreement(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every cluster takes its most frequent label (the smallest on ties); counts by (label, new prediction)."""
    best = table.groupBy(*keys, "pred").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("mapped"))
    return table.join(best, [*keys, "pred"]).groupBy(*keys, "label", F.col("mapped").alias("pred")).agg(F.sum("n").alias("n"))


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns (shortest augmenting paths with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, came = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], came[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[came[j0]], came[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


def assignment(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one assignment of clusters to classes with the largest agreement: counts by (label, new prediction);
    clusters beyond the number of classes become prediction -1.  One small group per key."""
    columns = [*keys, "label", "pred", "n"]
    group = table.select(*columns) if keys else table.select(*columns, F.lit(0).alias("_one"))
    on = list(keys) or ["_one"]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot_table(index="label", columns="pred", values="n", aggfunc="sum", fill_value=0)
        to = {m.columns[j]: m.index[i] for i, j in _assign(m.to_numpy().sum() - m.to_numpy().astype(float))}
        out = rows.assign(pred=[to.get(p, -1) for p in rows["pred"]])
        return out.groupby([*keys, "label", "pred"], as_index=False)["n"].sum()[columns]

    return group.groupBy(*on).applyInPandas(solve, table.select(*columns).schema)


def multiclass_scores(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, iou of every class that is both a label and a prediction, and the accuracy."""
    m = _margins(table, keys)
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy()
    m = m.withColumn("accuracy", F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).over(w) / F.col("total"))
    labels = m.select(*keys, F.col("label").alias("class_name"), "a", "total", "accuracy").distinct()
    preds = m.select(*keys, F.col("pred").alias("class_name"), "b").distinct()
    hits = m.where("label = pred").select(*keys, F.col("label").alias("class_name"), F.col("n").alias("tp"))
    on = [*keys, "class_name"]
    t = labels.join(preds, on).join(hits, on, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    p, r = F.col("tp") / F.col("b"), F.col("tp") / F.col("a")
    f1 = F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return t.select(*on, "accuracy", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("tp") / (F.col("a") + F.col("b") - F.col("tp"))).alias("iou"))


# ---------------------------------------------------------------- pairs of points


def pair_confusion(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs of points: p00 apart in both, p01 together in clusters only, p10 in classes only, p11 in both."""
    d = lambda x: F.col(x).cast("decimal(19,0)")
    square = lambda x: (d(x) * d(x)).cast("decimal(38,0)")
    cells = table.groupBy(*keys).agg(F.sum("n").alias("N"), F.sum(square("n")).alias("sq"))
    once = lambda c: table.groupBy(*keys, c).agg(F.sum("n").alias("t")).groupBy(*keys).agg(F.sum(square("t")).alias(f"sq_{c}"))
    rows, cols = once("label"), once("pred")
    t = cells.join(rows, list(keys)).join(cols, list(keys)) if keys else cells.crossJoin(rows).crossJoin(cols)  # without keys: three single rows
    N = F.col("N").cast("decimal(38,0)")
    p11 = F.col("sq") - N
    p10, p01 = F.col("sq_label") - F.col("sq"), F.col("sq_pred") - F.col("sq")
    p00 = square("N") - F.col("sq_label") - F.col("sq_pred") + F.col("sq")
    return t.select(*keys, *[x.cast("double").alias(n) for n, x in (("p00", p00), ("p01", p01), ("p10", p10), ("p11", p11))])


def _div(a: Column, b: Column, zero: float | Column) -> Column:
    zero = F.lit(float(zero)) if not isinstance(zero, Column) else zero
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def pair_scores(pairs: DataFrame, keys: Sequence[str] = (), beta: float = 1.0, zero: float = 1.0) -> DataFrame:
    """Rand, adjusted Rand, pair precision / recall / F / IoU and Fowlkes-Mallows of pair_confusion rows."""
    a, b, c, d = (F.col(x) for x in ("p00", "p01", "p10", "p11"))
    total = a + b + c + d
    adjusted = _div(2 * (d * a - c * b), (d + c) * (c + a) + (d + b) * (b + a), 1)
    adjusted = F.when((b == 0) & (c == 0), 1.0).otherwise(adjusted)
    k = beta**2
    return pairs.select(
        *keys,
        _div(a + d, total, 1).alias("rand"),
        adjusted.alias("adjusted_rand"),
        _div(d, d + b, zero).alias("pair_precision"),
        _div(d, d + c, zero).alias("pair_recall"),
        _div((1 + k) * d, (1 + k) * d + k * c + b, zero).alias("pair_f"),
        _div(d, d + c + b, zero).alias("pair_iou"),
        F.when(d == 0, 0.0).otherwise(F.sqrt(_div(d, d + b, 0)) * F.sqrt(_div(d, d + c, 0))).alias("fowlkes_mallows"),
    )


def balanced_pairs(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pair agreement normalised by class sizes, and its Rand score.

    together: mean over classes of two or more points of the share of their pairs in one cluster;
    apart: mean over pairs of classes of the share of their pairs of points in different clusters.  Cells of later
    classes and later clusters are paired, which is half of the discordant pairs.  One class: apart
    is 1; none of two points: together is 1.
    """
    m = _margins(table, keys).withColumn("n", F.col("n").cast("double"))
    per = m.groupBy(*keys, "label").agg(F.max("a").alias("a"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).where("a > 1")
    together = per.groupBy(*keys).agg(F.avg(F.col("s") / (F.col("a") * (F.col("a") - 1))).alias("together"))
    x, y = m.select(*keys, "label", "pred", "n", "a"), m.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("label", "pred", "n", "a")])
    later = (F.col("label2") > F.col("label")) & (F.col("pred2") > F.col("pred"))
    both = x.join(y, list(keys)).where(later) if keys else x.join(F.broadcast(y), later)
    apart = both.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n2") / (F.col("a") * F.col("a2"))).alias("d"))
    classes = m.groupBy(*keys).agg(F.count_distinct("label").alias("k"))
    one = lambda l, r: l.join(r, list(keys), "left") if keys else l.join(F.broadcast(r), F.lit(True), "left")
    t = one(one(classes, together), apart)
    k = F.col("k")
    t = t.withColumns({"together": F.coalesce("together", F.lit(1.0)), "apart": F.when(k < 2, 1.0).otherwise(F.coalesce("d", F.lit(0.0)) / F.nullif(k * (k - 1) / 2, F.lit(0.0)))})
    return t.select(*keys, "together", "apart", ((F.col("together") + F.col("apart")) / 2).alias("balanced_rand"))


# ---------------------------------------------------------------- information


def entropy(table: DataFrame, of: str, keys: Sequence[str] = (), name: str = "entropy") -> DataFrame:
    """-sum p ln p of the totals of a column of the contingency."""
    t = table.groupBy(*keys, of).agg(F.sum("n").alias("n")).where("n > 0")
    g = t.groupBy(*keys).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return g.select(*keys, (F.log("N") - F.col("s") / F.col("N")).alias(name))


def mutual_information(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    m = _margins(table, keys)
    term = F.col("n") / F.col("total") * (F.log("n") + F.log("total") - F.log("a") - F.log("b"))
    term = F.when(F.abs(term) < EPS, 0.0).otherwise(term)
    return m.groupBy(*keys).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_information"))


_AVERAGES = {
    "min": lambda x, y: F.least(x, y),
    "geometric": lambda x, y: F.sqrt(x * y),
    "arithmetic": lambda x, y: (x + y) / 2,
    "max": lambda x, y: F.greatest(x, y),
}


def information_scores(table: DataFrame, keys: Sequence[str] = (), average: str = "arithmetic", beta: float = 1.0) -> DataFrame:
    """Entropies, mutual information, its normalised form, homogeneity, completeness, V-measure."""
    join = lambda l, r: l.join(r, list(keys)) if keys else l.crossJoin(r)  # noqa: E731  without keys: single rows
    t = join(join(entropy(table, "label", keys, "h_label"), entropy(table, "pred", keys, "h_pred")), mutual_information(table, keys))
    mi, hl, hp = F.col("mutual_information"), F.col("h_label"), F.col("h_pred")
    hom, com = _div(mi, hl, mi), _div(mi, hp, mi)
    mean = _AVERAGES[average](hl, hp)
    v = F.when((hom == 0) | (com == 0), 0.0).otherwise((1 + beta) * hom * com / F.nullif(beta * hom + com, F.lit(0.0)))
    return t.select(*keys, hl, hp, mi, _div(mi, mean, 1).alias("normalised_mi"), hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"))


def _log_factorial(x: Column) -> Column:
    """ln x!: exact product below 20, then Stirling's series (error under 1e-13)."""
    z = x.cast("double") + 1
    z = F.when(x < 20, z + 20).otherwise(z)  # ln gamma(z) from gamma(z + 20) for small values
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    small = sum((F.log(x.cast("double") + 1 + k) for k in range(20)), F.lit(0.0))
    return F.when(x < 20, series - small).otherwise(series)


def expected_mutual_information(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean mutual information of random tables with the same margins (hypergeometric model).

    Every pair of margins contributes one row per cell value within 12 deviations and 30 of its mean; by Bernstein's bound the
    others weigh less than 1e-19 together.  So rows grow with the square root of the smaller margins.
    """
    m = _margins(table, keys)
    a = m.select(*keys, "label", "a", "total").distinct()
    b = m.select(*keys, "pred", "b").distinct()
    pairs = a.join(b, list(keys)) if keys else a.join(_sized(b), F.lit(True))
    A, B, N, n = F.col("a"), F.col("b"), F.col("total"), F.col("x")
    mean = A * B.cast("double") / N
    reach = 12 * F.sqrt(mean * (N - A) / N * (N - B) / F.greatest(N - 1, F.lit(1))) + 30
    low, high = F.greatest(F.lit(0), A + B - N, F.floor(mean - reach)), F.least(A, B, F.ceil(mean + reach))
    rows = pairs.withColumn("x", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    lf = _log_factorial
    weight = F.exp(lf(A) + lf(B) + lf(N - A) + lf(N - B) - lf(N) - lf(n) - lf(A - n) - lf(B - n) - lf(N - A - B + n))
    term = F.when(n == 0, 0.0).otherwise(n / N * F.log(N / A * (n / B)))
    # the weights of a pair add up to 1, which takes out the rounding of the large factorials
    each = rows.groupBy(*keys, "label", "pred").agg((F.sum(term * weight) / F.sum(weight)).alias("e"))
    return each.groupBy(*keys).agg(F.sum("e").alias("expected_mi"))


def adjusted_mutual_information(table: DataFrame, keys: Sequence[str] = (), average: str = "arithmetic") -> DataFrame:
    join = lambda l, r: l.join(r, list(keys)) if keys else l.crossJoin(r)  # noqa: E731  without keys: single rows
    t = join(information_scores(table, keys, average), expected_mutual_information(table, keys))
    mean = _AVERAGES[average](F.col("h_label"), F.col("h_pred"))
    low = mean - F.col("expected_mi")
    low = F.when(low < 0, F.least(low, F.lit(-2.2e-16))).otherwise(F.greatest(low, F.lit(2.2e-16)))
    same = (F.col("h_label") == 0) & (F.col("h_pred") == 0)
    return t.select(*keys, "expected_mi", F.when(same, 1.0).otherwise((F.col("mutual_information") - F.col("expected_mi")) / low).alias("adjusted_mi"))


# ---------------------------------------------------------------- sets


def cluster_f(table: DataFrame, keys: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Sum over labels of their share times the best F of any cluster."""
    m = _margins(table, keys)
    p, r = F.col("n") / F.col("b"), F.col("n") / F.col("a")
    f = (1 + beta**2) * p * r / (beta**2 * p + r)
    best = m.groupBy(*keys, "label").agg(F.max(f).alias("f"), F.max("a").alias("a"), F.max("total").alias("total"))
    return best.groupBy(*keys).agg(F.sum(F.col("f") * F.col("a") / F.col("total")).alias("cluster_f"))


def bcubed(table: DataFrame, keys: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    m = _margins(table, keys)
    n = F.col("n").cast("double")
    t = m.groupBy(*keys).agg((F.sum(n * n / F.col("b")) / F.max("total")).alias("bcubed_precision"), (F.sum(n * n / F.col("a")) / F.max("total")).alias("bcubed_recall"))
    p, r = F.col("bcubed_precision"), F.col("bcubed_recall")
    return t.withColumn("bcubed_f", (1 + beta**2) * p * r / (beta**2 * p + r))


def label_distribution(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys, "label").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- geometry


def dispersion(rows: DataFrame, features: Sequence[str], cluster: str = "pred") -> DataFrame:
    """Per cluster: n, centroid (array) and within-cluster squared distance, from one pass of sums and squares."""
    sums = [F.sum(f).alias(f"s_{f}") for f in features]
    squares = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    g = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *sums, F.sum(squares).alias("_sq"))
    centre = F.array(*[F.col(f"s_{f}") / F.col("n") for f in features])
    norm = sum((F.col(f"s_{f}") * F.col(f"s_{f}") for f in features), F.lit(0.0))
    return g.select(cluster, "n", centre.alias("centroid"), (F.col("_sq") - norm / F.col("n")).alias("within"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(rows: DataFrame, features: Sequence[str], cluster: str = "pred") -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance(i, j); spread: mean distance to the centroid."""
    centres = dispersion(rows, features, cluster).select(cluster, "centroid")
    point = F.array(*[F.col(f).cast("double") for f in features])
    spread = rows.join(_sized(centres), cluster).groupBy(cluster).agg(F.avg(_distance(point, F.col("centroid"))).alias("spread"), F.first("centroid").alias("centroid"))
    spread = written(spread)
    other = spread.select(*[F.col(c).alias(f"{c}2") for c in (cluster, "spread", "centroid")])
    pairs = spread.join(_sized(other), F.col(cluster) != F.col(f"{cluster}2"))  # clusters x clusters
    gap = _distance(F.col("centroid"), F.col("centroid2"))
    worst = pairs.groupBy(cluster).agg(F.max(F.when(gap > 0, (F.col("spread") + F.col("spread2")) / F.nullif(gap, F.lit(0.0))).otherwise(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, features: Sequence[str], cluster: str = "pred") -> DataFrame:
    """Between-cluster over within-cluster dispersion, by degrees of freedom; no within-dispersion gives 1."""
    per = dispersion(rows, features, cluster)
    dims = range(len(features))
    g = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum("within").alias("w"), *[F.sum(F.col("n") * F.get("centroid", F.lit(i))).alias(f"t{i}") for i in dims], F.sum(F.col("n") * sum((F.get("centroid", F.lit(i)) ** 2 for i in dims), F.lit(0.0))).alias("q"))
    between = F.col("q") - sum((F.col(f"t{i}") ** 2 for i in dims), F.lit(0.0)) / F.col("N")
    return g.select(F.when(F.col("w") == 0, 1.0).otherwise(between * (F.col("N") - F.col("k")) / F.nullif(F.col("w") * (F.col("k") - 1), F.lit(0.0))).alias("calinski_harabasz"))
