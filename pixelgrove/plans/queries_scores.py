"""Registered queries over scored pixels and clusterings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batchwise, bundles, classify, cluster_metrics, distribution, metrics, results
from ..sources import chips
from ..operators import contingency as C
from . import views
from .rounding import rounded
from .views import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _cells(n: str = "1") -> str:
    cell = lambda c: f"coalesce(sum(CASE WHEN {c} THEN {n} END), 0)::BIGINT"
    parts = [f"{cell(f'label = {a} AND pred = {b}')} AS n{a}{b}" for a in (0, 1) for b in (0, 1)]
    return ", ".join([*parts, f"{cell('label = -1')} AS invalid"])


def _scores() -> str:
    out = ["round((n00 + n11) / nullif(n00 + n01 + n10 + n11, 0), 6) + 0.0 AS accuracy"]
    for c in (0, 1):
        o = 1 - c
        tp, fp, fn = f"n{c}{c}", f"n{o}{c}", f"n{c}{o}"
        share = lambda b, z: f"CASE WHEN {b} = 0 THEN {z} ELSE {tp} / nullif({b}, 0) END"
        p, r = share(f"({tp} + {fp})", 1.0), share(f"({tp} + {fn})", 1.0)
        f1 = f"CASE WHEN ({p}) = 0 OR ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0) END"
        for name, x in (("precision", p), ("recall", r), ("f1", f1), ("iou1", share(f"({tp} + {fp} + {fn})", 1.0)), ("iou0", share(f"({tp} + {fp} + {fn})", 0.0))):
            out.append(f"round({x}, 6) + 0.0 AS {name}_{c}")
    return ", ".join(out)


_VALID = "n00 + n01 + n10 + n11 > 0"


@query(f"{sql('scored')}, c AS (SELECT chip, {_cells()} FROM scored GROUP BY chip) SELECT chip, {_scores()} FROM c WHERE {_VALID}")
def scores_per_chip(spark: SparkSession, d: str) -> DataFrame:
    counts = C.with_valid(C.binary_counts(views.scored(spark, d), ["chip"]))
    return rounded(metrics.scores(counts, ["chip"]))


@query(
    f"""{sql('scored')}, c AS (SELECT 'chip' AS level, region, chip, {_cells()} FROM scored GROUP BY region, chip
        UNION ALL SELECT 'region', region, NULL, {_cells()} FROM scored GROUP BY region UNION ALL SELECT 'total', NULL, NULL, {_cells()} FROM scored)
        SELECT level, region, chip, {_scores()} FROM c WHERE {_VALID}"""
)
def scores_by_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.scores(C.with_valid(C.by_level(views.scored(spark, d))), ["level", "region", "chip"]))


@query(f"{sql('scored')}, c AS (SELECT chip, {_cells()} FROM scored GROUP BY chip) SELECT round(avg((n00 + n11) / (n00 + n01 + n10 + n11)), 6) + 0.0 AS objective, count(*) AS n_keys FROM c WHERE {_VALID}")
def objective_mean_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.objective(C.binary_counts(views.scored(spark, d), ["chip"]), metrics.accuracy()))


@query(
    f"""{sql('scored')}, c AS (SELECT chip, {_cells()} FROM scored GROUP BY chip), s AS (SELECT chip, {_scores()} FROM c WHERE {_VALID})
        SELECT chip, 'accuracy' AS metric, NULL::INT AS class_name, accuracy AS value FROM s """
    + " ".join(f"UNION ALL SELECT chip, '{m}', {c}, {m}_{c} FROM s" for m in ("precision", "recall", "f1", "iou1", "iou0") for c in (0, 1))
)
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    counts = C.with_valid(C.binary_counts(views.scored(spark, d), ["chip"]))
    return rounded(metrics.long_rows(metrics.scores(counts, ["chip"]), ["chip"]))


@query(
    f"""{sql('scored')}, n AS (SELECT region, label, pred, count(*) AS n FROM scored GROUP BY ALL),
        l AS (SELECT DISTINCT region, label FROM n), p AS (SELECT DISTINCT region, pred FROM n)
        SELECT region, label, pred, coalesce(n, 0) AS n FROM l JOIN p USING (region) LEFT JOIN n USING (region, label, pred)"""
)
def dense_contingency(spark: SparkSession, d: str) -> DataFrame:
    return C.densify(C.contingency(views.scored(spark, d), ["region"]), ["region"])


@query(
    f"""{sql('scored')}, k AS (SELECT DISTINCT chip FROM scored WHERE label <> -1), g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, pred)),
        n AS (SELECT chip, label, pred, count(*) AS n FROM scored GROUP BY ALL)
        SELECT chip, g.label, g.pred, coalesce(n.n, 0) AS n FROM k CROSS JOIN g LEFT JOIN n USING (chip, label, pred)"""
)
def normalised_contingency(spark: SparkSession, d: str) -> DataFrame:
    return C.normalised(C.contingency(views.scored(spark, d), ["chip"]), ["chip"])


@query(f"{sql('scored')} SELECT label, pred, count(*) AS n FROM scored GROUP BY ALL")
def merged_contingency(spark: SparkSession, d: str) -> DataFrame:
    t = views.scored(spark, d)
    parts = [C.contingency(t.where(F.col("region") == r)) for r in range(5)]
    return C.merge(parts)


# ---------------------------------------------------------------- distributions


@query(f"{sql('scored')} SELECT region, label AS class_name, count(*) AS n FROM scored GROUP BY ALL UNION ALL SELECT NULL, label, count(*) FROM scored GROUP BY label")
def label_distribution_by_region(spark: SparkSession, d: str) -> DataFrame:
    return distribution.class_counts(views.scored(spark, d))


@query(f"{sql('scored')} SELECT region, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 6) + 0.0 AS share FROM scored GROUP BY region")
def region_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.region_share(views.scored(spark, d)))


@query(f"{sql('scored')}, c AS (SELECT region, label AS class_name, count(*) AS n FROM scored GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY region), 6) + 0.0 AS share FROM c")
def class_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.class_share(views.scored(spark, d)))


# chips here are small parts of a supplier's rows, so that all types occur
_FLAGS = f"""{sql('scored')}, p AS (SELECT n_regionkey AS region, l_orderkey AS chip, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    f AS (SELECT region, chip, bool_and(label = 0) AS dry_only, bool_and(label = -1) AS no_data_only, bool_and(label <> 1) AS no_flood FROM p GROUP BY ALL),
    t AS (SELECT *, CASE WHEN no_data_only THEN 'no data' WHEN dry_only THEN 'dry' WHEN no_flood THEN 'dry and no data' ELSE 'flood' END AS chip_type FROM f)"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    line = views.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    place = views.table(spark, d, "supplier").join(views.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    t = line.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("n_regionkey").alias("region"), F.col("l_orderkey").alias("chip"), label.alias("label"))
    return distribution.chip_flags(t, ["region", "chip"])


@query(f"{_FLAGS} SELECT * FROM t")
def chip_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


@query(
    f"""{_FLAGS}, c AS (SELECT region, chip_type, count(*) AS n FROM t GROUP BY ALL)
        SELECT region, chip_type, n, round(n / sum(n) OVER (PARTITION BY region), 6) + 0.0 AS share_in_region, round(sum(n) OVER (PARTITION BY chip_type) / sum(n) OVER (), 6) + 0.0 AS share_overall FROM c"""
)
def chip_type_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distribution.chip_type_share(_flags(spark, d)))


# ---------------------------------------------------------------- clusterings

_N = f"{sql('clusters')}, n AS (SELECT label, pred, count(*) AS n FROM clusters GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY pred) AS b, sum(n) OVER () AS t FROM n)"


def _table(spark: SparkSession, d: str) -> DataFrame:
    return C.contingency(views.clusters(spark, d))


@query(
    f"""{_N}, best AS (SELECT pred, label AS mapped FROM n QUALIFY row_number() OVER (PARTITION BY pred ORDER BY n DESC, label) = 1),
        x AS (SELECT label, mapped AS pred, sum(n) AS n FROM n JOIN best USING (pred) GROUP BY ALL),
        l AS (SELECT label AS class_name, sum(n) AS a FROM x GROUP BY 1), p AS (SELECT pred AS class_name, sum(n) AS b FROM x GROUP BY 1), h AS (SELECT label AS class_name, n AS tp FROM x WHERE label = pred),
        s AS (SELECT class_name, a, b, coalesce(tp, 0) AS tp FROM l JOIN p USING (class_name) LEFT JOIN h USING (class_name))
        SELECT class_name, round((SELECT sum(n) FROM x WHERE label = pred) / (SELECT sum(n) FROM x), 6) AS accuracy, round(tp / b, 6) AS precision, round(tp / a, 6) AS recall,
        round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / b) * (tp / a) / (tp / b + tp / a) END, 6) AS f1, round(tp / (a + b - tp), 6) AS iou FROM s"""
)
def max_agreement_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.multiclass_scores(cluster_metrics.max_agreement(_table(spark, d))))


@query(
    f"""{_N}, q AS (SELECT (SELECT sum(n * n) FROM n) AS sq, (SELECT sum(a * a) FROM (SELECT sum(n) AS a FROM n GROUP BY label)) AS sa, (SELECT sum(b * b) FROM (SELECT sum(n) AS b FROM n GROUP BY pred)) AS sb, (SELECT sum(n) FROM n) AS t),
        c AS (SELECT (t * t - sa - sb + sq)::DOUBLE AS p00, (sb - sq)::DOUBLE AS p01, (sa - sq)::DOUBLE AS p10, (sq - t)::DOUBLE AS p11 FROM q)
        SELECT round((p00 + p11) / (p00 + p01 + p10 + p11), 6) AS rand, round(2 * (p11 * p00 - p10 * p01) / ((p11 + p10) * (p10 + p00) + (p11 + p01) * (p01 + p00)), 6) + 0.0 AS adjusted_rand, round(p11 / (p11 + p01), 6) AS pair_precision, round(p11 / (p11 + p10), 6) AS pair_recall,
        round(2 * p11 / (2 * p11 + p10 + p01), 6) AS pair_f, round(p11 / (p11 + p10 + p01), 6) AS pair_iou, round(sqrt(p11 / (p11 + p01)) * sqrt(p11 / (p11 + p10)), 6) AS fowlkes_mallows FROM c"""
)
def pair_confusion_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.pair_scores(cluster_metrics.pair_confusion(_table(spark, d))))


@query(
    f"""{_N}, per AS (SELECT label, max(a) AS a, sum(n * (n - 1)) AS s FROM m GROUP BY 1 HAVING max(a) > 1), tg AS (SELECT avg(s / (a * (a - 1))) AS x FROM per),
        ap AS (SELECT sum(x.n * y.n / (x.a * y.a)) AS x FROM m x JOIN m y ON y.label > x.label AND y.pred > x.pred), k AS (SELECT count(DISTINCT label) AS k FROM m)
        SELECT round(tg.x, 6) AS together, round(ap.x / (k * (k - 1) / 2), 6) AS apart, round((tg.x + ap.x / (k * (k - 1) / 2)) / 2, 6) AS balanced_rand FROM tg, ap, k"""
)
def balanced_rand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.balanced_pairs(_table(spark, d)))


@query(
    f"""{_N}, h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM (SELECT DISTINCT label, a, t FROM m)) AS hl, (SELECT -sum(b / t * ln(b / t)) FROM (SELECT DISTINCT pred, b, t FROM m)) AS hp, (SELECT sum(n / t * ln(n * t / (a * b))) FROM m) AS mi)
        SELECT round(hl, 6) AS h_label, round(hp, 6) AS h_pred, round(mi, 6) AS mutual_information, round(mi / ((hl + hp) / 2), 6) AS normalised_mi, round(mi / hl, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / hl) * (mi / hp) / (mi / hl + mi / hp), 6) AS v_measure FROM h"""
)
def information_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.information_scores(_table(spark, d)))


_LOG_WEIGHT = " ".join(f"{sign} lgamma({x} + 1)" for sign, x in zip("++++-----", ("a", "b", "t - a", "t - b", "t", "k", "a - k", "b - k", "t - a - b + k")))


@query(
    f"""{_N}, g AS (SELECT DISTINCT label, a::DOUBLE AS a FROM m), h AS (SELECT DISTINCT pred, b::DOUBLE AS b FROM m), z AS (SELECT max(t)::DOUBLE AS t FROM m),
        x AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM g, h, z),
        e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp({_LOG_WEIGHT})) AS e FROM x),
        i AS (SELECT sum(n / t * ln(n::DOUBLE * t / (a::DOUBLE * b))) AS mi FROM m), p AS (SELECT -sum(a / t * ln(a / t)) AS hl FROM g, z), q AS (SELECT -sum(b / t * ln(b / t)) AS hp FROM h, z)
        SELECT round(e, 6) AS expected_mi, round((mi - e) / greatest((hl + hp) / 2 - e, 2.2e-16), 6) + 0.0 AS adjusted_mi FROM e, i, p, q"""
)
def adjusted_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.adjusted_mutual_information(_table(spark, d)))


#: Class scores of the counts x (label, pred, n), by class.
_CLASS_SCORES = """l AS (SELECT label AS class_name, sum(n) AS a FROM x GROUP BY 1), p AS (SELECT pred AS class_name, sum(n) AS b FROM x GROUP BY 1), h AS (SELECT label AS class_name, n AS tp FROM x WHERE label = pred),
        s AS (SELECT class_name, a, b, coalesce(tp, 0) AS tp FROM l JOIN p USING (class_name) LEFT JOIN h USING (class_name))
        SELECT class_name, round((SELECT sum(n) FROM x WHERE label = pred) / (SELECT sum(n) FROM x), 6) AS accuracy, round(tp / b, 6) AS precision, round(tp / a, 6) AS recall,
        round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / b) * (tp / a) / (tp / b + tp / a) END, 6) AS f1, round(tp / (a + b - tp), 6) AS iou FROM s"""


@query(
    # every one-to-one choice of labels for the clusters, one cluster a step; the view has fewer clusters than labels
    f"""{_N.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT pred, row_number() OVER (ORDER BY pred) AS i FROM (SELECT DISTINCT pred FROM n)),
        w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS total
            UNION ALL SELECT k.i, list_append(used, g.label::BIGINT), total + coalesce(n.n, 0) FROM w JOIN k ON k.i = w.i + 1 JOIN (SELECT DISTINCT label FROM n) g ON NOT list_contains(used, g.label::BIGINT) LEFT JOIN n ON n.label = g.label AND n.pred = k.pred),
        best AS (SELECT used FROM w WHERE i = (SELECT max(i) FROM k) ORDER BY total DESC, used LIMIT 1),
        x AS (SELECT label, used[k.i] AS pred, sum(n) AS n FROM n JOIN k USING (pred), best GROUP BY ALL), {_CLASS_SCORES}"""
)
def assignment_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.multiclass_scores(cluster_metrics.assignment(_table(spark, d))))


@query(f"{_N}, f AS (SELECT label, max(2 * (n / b) * (n / a) / (n / b + n / a)) AS f, max(a) AS a, max(t) AS t FROM m GROUP BY 1) SELECT round(sum(f * a / t), 6) AS cluster_f FROM f")
def cluster_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.cluster_f(_table(spark, d)))


@query(f"{_N}, s AS (SELECT sum(n * n / b) / max(t) AS p, sum(n * n / a) / max(t) AS r FROM m) SELECT round(p, 6) AS bcubed_precision, round(r, 6) AS bcubed_recall, round(2 * p * r / (p + r), 6) AS bcubed_f FROM s")
def bcubed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.bcubed(_table(spark, d)))


_F4 = ["f1", "f2", "f3", "f4"]
_CENTRES = f"{sql('feat')}, c AS (SELECT y, count(*) AS n, avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3, avg(f4) AS c4 FROM feat GROUP BY y)"


@query(
    f"""{_CENTRES} SELECT c.y, n, round(c1, 6) + 0.0 AS c1, round(c2, 6) + 0.0 AS c2, round(c3, 6) + 0.0 AS c3, round(c4, 6) + 0.0 AS c4, round(sum((f1 - c1) ** 2 + (f2 - c2) ** 2 + (f3 - c3) ** 2 + (f4 - c4) ** 2), 6) AS within
        FROM c JOIN feat USING (y) GROUP BY ALL"""
)
def cluster_dispersion(spark: SparkSession, d: str) -> DataFrame:
    t = cluster_metrics.dispersion(views.feat(spark, d), _F4, "y")
    return rounded(t.select("y", "n", *[F.get("centroid", F.lit(i)).alias(f"c{i + 1}") for i in range(4)], "within"))


@query(
    f"""{sql('feat')}, g AS (SELECT *, (id % 5) AS k FROM feat), c AS (SELECT k, avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3, avg(f4) AS c4 FROM g GROUP BY k),
        s AS (SELECT c.k, c1, c2, c3, c4, avg(sqrt((f1 - c1) ** 2 + (f2 - c2) ** 2 + (f3 - c3) ** 2 + (f4 - c4) ** 2)) AS s FROM g JOIN c USING (k) GROUP BY ALL),
        r AS (SELECT a.k, max((a.s + b.s) / sqrt((a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 + (a.c3 - b.c3) ** 2 + (a.c4 - b.c4) ** 2)) AS r FROM s a JOIN s b ON a.k <> b.k GROUP BY 1) SELECT round(avg(r), 4) AS davies_bouldin FROM r"""
)
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.davies_bouldin(views.feat(spark, d).withColumn("k", F.col("id") % 5), _F4, "k"), 4)


@query(
    f"""{sql('feat')}, g AS (SELECT *, (id % 5) AS k FROM feat), o AS (SELECT avg(f1) AS o1, avg(f2) AS o2, avg(f3) AS o3, avg(f4) AS o4, count(*) AS t FROM g), c AS (SELECT k, count(*) AS n, avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3, avg(f4) AS c4 FROM g GROUP BY k),
        b AS (SELECT sum(n * ((c1 - o1) ** 2 + (c2 - o2) ** 2 + (c3 - o3) ** 2 + (c4 - o4) ** 2)) AS b, count(*) AS k, max(t) AS t FROM c, o), w AS (SELECT sum((f1 - c1) ** 2 + (f2 - c2) ** 2 + (f3 - c3) ** 2 + (f4 - c4) ** 2) AS w FROM g JOIN c USING (k))
        SELECT round(b * (t - k) / (w * (k - 1)), 4) AS calinski_harabasz FROM b, w"""
)
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster_metrics.calinski_harabasz(views.feat(spark, d).withColumn("k", F.col("id") % 5), _F4, "k"), 4)


# ---------------------------------------------------------------- random batches

_ITER, _SIZE = 20, 4


@query(
    f"""{sql('scored')}, c AS (SELECT chip, coalesce(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 END), 0) AS tp, coalesce(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 END), 0) AS fp, coalesce(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 END), 0) AS fn, coalesce(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 END), 0) AS tn FROM scored WHERE label <> -1 GROUP BY chip),
        r AS (SELECT *, (row_number() OVER (PARTITION BY iter ORDER BY md5('42|' || iter || '|' || chip), chip) - 1) // {_SIZE} AS batch FROM c, range({_ITER}) t(iter)),
        b AS (SELECT iter, batch, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM r GROUP BY ALL),
        v AS (SELECT iter, CASE WHEN tp = 0 THEN CASE WHEN fp = 0 AND fn = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE tp / (tp + fp + fn) END AS iou, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, CASE WHEN tp = 0 THEN CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE tp / (tp + fp) END AS precision, CASE WHEN tp = 0 THEN CASE WHEN fn = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE tp / (tp + fn) END AS recall FROM b),
        f AS (SELECT *, CASE WHEN precision = 0 AND recall = 0 THEN 1.0::DOUBLE ELSE 2 * precision * recall / nullif(precision + recall, 0) END AS f1 FROM v),
        u AS (UNPIVOT f ON iou, accuracy, precision, recall, f1 INTO NAME metric VALUE value), p AS (SELECT iter, metric, avg(value) AS mean, stddev_pop(value) AS std FROM u GROUP BY ALL)
        SELECT metric, {_SIZE} AS batch_size, """
    + ", ".join(f"round({f}({c}), 6) + 0.0 AS {c}_{n}" for c in ("mean", "std") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    + " FROM p GROUP BY metric"
)
def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    counts = batchwise.remap(C.contingency(views.scored(spark, d), ["chip"]), ["chip"])
    return rounded(batchwise.batch_metrics(counts, "chip", _ITER, _SIZE))


# ---------------------------------------------------------------- classifiers by aggregation


@query(
    f"""{sql('feat')}, s AS (SELECT y, count(*) / (SELECT count(*) FROM feat) AS p, avg(f1) AS m1, avg(f2) AS m2, var_pop(f1) AS v1, var_pop(f2) AS v2 FROM feat GROUP BY y), e AS (SELECT 1e-9 * greatest(var_pop(f1), var_pop(f2)) AS e FROM feat),
        l AS (SELECT id, s.y, ln(p) - 0.5 * (ln(2 * pi() * (v1 + e)) + ln(2 * pi() * (v2 + e))) - 0.5 * ((f1 - m1) ** 2 / (v1 + e) + (f2 - m2) ** 2 / (v2 + e)) AS score FROM feat, s, e)
        SELECT id, y AS prediction FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, y) = 1"""
)
def naive_bayes_sql(spark: SparkSession, d: str) -> DataFrame:
    t = views.feat(spark, d)
    return classify.gaussian_naive_bayes(t, ["f1", "f2"], "y").predict(t).select("id", "prediction")


_COV = "count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, var_pop(f1) AS a, covar_pop(f1, f2) AS b, var_pop(f2) AS c"


@query(
    f"""{sql('feat')}, s AS (SELECT y, {_COV} FROM feat GROUP BY y), w AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b, sum(n * c) / sum(n) AS c, sum(n) AS t FROM s), h AS (SELECT 0.9 * a + 0.1 * (a + c) / 2 AS a, 0.9 * b AS b, 0.9 * c + 0.1 * (a + c) / 2 AS c, t FROM w),
        k AS (SELECT y, (h.c * m1 - h.b * m2) / (h.a * h.c - h.b * h.b) AS w1, (h.a * m2 - h.b * m1) / (h.a * h.c - h.b * h.b) AS w2, m1, m2, ln(n / t) AS p FROM s, h)
        SELECT id, k.y AS prediction FROM feat, k QUALIFY row_number() OVER (PARTITION BY id ORDER BY w1 * f1 + w2 * f2 - 0.5 * (w1 * m1 + w2 * m2) + p DESC, k.y) = 1"""
)
def lda_2d(spark: SparkSession, d: str) -> DataFrame:
    t = views.feat(spark, d)
    return classify.linear_discriminant(t, ["f1", "f2"], "y", 0.1).predict(t).select("id", "prediction")


@query(
    f"""{sql('feat')}, s AS (SELECT y, {_COV} FROM feat GROUP BY y), u AS (SELECT y, n, m1, m2, a * n / (n - 1) AS a, b * n / (n - 1) AS b, c * n / (n - 1) AS c, (SELECT count(*) FROM feat) AS t FROM s),
        l AS (SELECT id, u.y, ln(n / t) - 0.5 * ln(a * c - b * b) - 0.5 * (c * (f1 - m1) ** 2 - 2 * b * (f1 - m1) * (f2 - m2) + a * (f2 - m2) ** 2) / (a * c - b * b) AS score FROM feat, u)
        SELECT id, y AS prediction FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, y) = 1"""
)
def qda_2d(spark: SparkSession, d: str) -> DataFrame:
    t = views.feat(spark, d)
    return classify.quadratic_discriminant(t, ["f1", "f2"], "y").predict(t).select("id", "prediction")


@query(
    f"""{sql('feat')}, p AS (SELECT q.id AS query, t.id, t.y, sqrt((q.f1 - t.f1) ** 2 + (q.f2 - t.f2) ** 2 + (q.f3 - t.f3) ** 2 + (q.f4 - t.f4) ** 2) AS dist FROM feat q, feat t WHERE t.id % 5 <> 0 AND q.id % 20 = 0),
        k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5), v AS (SELECT query, y, count(*) AS n FROM k GROUP BY ALL)
        SELECT query, y AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, y) = 1"""
)
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    t = views.feat(spark, d).withColumn("x", F.array("f1", "f2", "f3", "f4"))
    near = classify.nearest(t.where("id % 5 <> 0"), t.where("id % 20 = 0"), 5)
    return classify.vote(near)


# ---------------------------------------------------------------- bundles and scans


@query(
    f"""{sql('scored')}, n AS (SELECT region, label, pred, count(*) AS n FROM scored WHERE label <> -1 GROUP BY ALL),
        l AS (SELECT region, label AS c, sum(n) AS a FROM n GROUP BY ALL), p AS (SELECT region, pred AS c, sum(n) AS b FROM n GROUP BY ALL), h AS (SELECT region, label AS c, n AS tp FROM n WHERE label = pred),
        s AS (SELECT region, c, a, b, coalesce(tp, 0) AS tp FROM l JOIN p USING (region, c) LEFT JOIN h USING (region, c)),
        w AS (SELECT region, c AS class_name, tp / b AS precision, tp / a AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / b) * (tp / a) / (tp / b + tp / a) END AS f1, tp / (a + b - tp) AS iou FROM s)
        SELECT region, metric || '.no_clouds' AS metric, class_name, round(value, 6) + 0.0 AS value FROM (UNPIVOT w ON precision, recall, f1, iou INTO NAME metric VALUE value)
        UNION ALL SELECT region, 'accuracy.no_clouds', NULL, round(sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n), 6) + 0.0 FROM n GROUP BY region"""
)
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bundles.bundle(C.contingency(views.scored(spark, d), ["region"]), ["region"]))


def _by_part(x: str, suffix: str) -> str:
    """Rows of class scores of the counts x (part, label, pred, n)."""
    return f"""SELECT part, metric || '{suffix}' AS metric, class_name, value FROM (UNPIVOT (SELECT part, c AS class_name, tp / b AS precision, tp / a AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / b) * (tp / a) / (tp / b + tp / a) END AS f1, tp / (a + b - tp) AS iou
            FROM (SELECT l.part, l.c, a, b, coalesce(tp, 0) AS tp FROM (SELECT part, label AS c, sum(n) AS a FROM {x} GROUP BY ALL) l JOIN (SELECT part, pred AS c, sum(n) AS b FROM {x} GROUP BY ALL) p USING (part, c) LEFT JOIN (SELECT part, label AS c, n AS tp FROM {x} WHERE label = pred) h USING (part, c)))
            ON precision, recall, f1, iou INTO NAME metric VALUE value)
        UNION ALL SELECT part, 'accuracy{suffix}', NULL, sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) FROM {x} GROUP BY part"""


@query(
    f"""WITH n AS (SELECT vec_id % 4 AS part, label, list_position(embedding[1:4], list_max(embedding[1:4]))::INT - 1 AS pred, count(*) AS n FROM embeddings GROUP BY ALL),
        m AS (SELECT *, sum(n) OVER (PARTITION BY part, label) AS a, sum(n) OVER (PARTITION BY part, pred) AS b, sum(n) OVER (PARTITION BY part) AS t FROM n),
        best AS (SELECT part, pred, label AS mapped FROM n QUALIFY row_number() OVER (PARTITION BY part, pred ORDER BY n DESC, label) = 1),
        x AS (SELECT part, label, mapped AS pred, sum(n) AS n FROM n JOIN best USING (part, pred) GROUP BY ALL),
        q AS (SELECT part, sum(n * n) AS sq, sum(n * a) AS sa, sum(n * b) AS sb, max(t) AS t FROM m GROUP BY 1),
        c AS (SELECT part, (t * t - sa - sb + sq)::DOUBLE AS p00, (sb - sq)::DOUBLE AS p01, (sa - sq)::DOUBLE AS p10, (sq - t)::DOUBLE AS p11 FROM q),
        pairs AS (SELECT part, (p00 + p11) / (p00 + p01 + p10 + p11) AS rand, 2 * (p11 * p00 - p10 * p01) / ((p11 + p10) * (p10 + p00) + (p11 + p01) * (p01 + p00)) AS adjusted_rand, p11 / (p11 + p01) AS pair_precision, p11 / (p11 + p10) AS pair_recall,
            2 * p11 / (2 * p11 + p10 + p01) AS pair_f, p11 / (p11 + p10 + p01) AS pair_iou, sqrt(p11 / (p11 + p01)) * sqrt(p11 / (p11 + p10)) AS fowlkes_mallows FROM c),
        i AS (SELECT part, -sum(n / t * ln(a / t)) AS hl, -sum(n / t * ln(b / t)) AS hp, sum(n / t * ln(n * t / (a * b))) AS mi FROM m GROUP BY 1),
        info AS (SELECT part, hl AS h_label, hp AS h_pred, mi AS mutual_information, mi / ((hl + hp) / 2) AS normalised_mi, mi / hl AS homogeneity, mi / hp AS completeness, 2 * (mi / hl) * (mi / hp) / (mi / hl + mi / hp) AS v_measure FROM i),
        f AS (SELECT part, sum(f * a / t) AS cluster_f FROM (SELECT part, label, max(2 * (n / b) * (n / a) / (n / b + n / a)) AS f, max(a) AS a, max(t) AS t FROM m GROUP BY ALL) GROUP BY 1),
        bc AS (SELECT part, p AS bcubed_precision, r AS bcubed_recall, 2 * p * r / (p + r) AS bcubed_f FROM (SELECT part, sum(n * n / b) / max(t) AS p, sum(n * n / a) / max(t) AS r FROM m GROUP BY 1)),
        tg AS (SELECT part, avg(s / (a * (a - 1))) AS together FROM (SELECT part, label, max(a) AS a, sum(n * (n - 1)) AS s FROM m GROUP BY ALL HAVING max(a) > 1) GROUP BY 1),
        ap AS (SELECT x.part, sum(x.n * y.n / (x.a * y.a)) AS d FROM m x JOIN m y ON y.part = x.part AND y.label > x.label AND y.pred > x.pred GROUP BY 1),
        bal AS (SELECT part, together, d / (k * (k - 1) / 2) AS apart, (together + d / (k * (k - 1) / 2)) / 2 AS balanced_rand FROM tg JOIN ap USING (part) JOIN (SELECT part, count(DISTINCT label) AS k FROM m GROUP BY 1) USING (part)),
        rows AS ({_by_part('n', '.no_clouds')} UNION ALL {_by_part('x', '.max_agree.no_clouds')}"""
    + "".join(f" UNION ALL SELECT part, metric || '.no_clouds', NULL, value FROM (UNPIVOT {t} ON COLUMNS(* EXCLUDE (part)) INTO NAME metric VALUE value)" for t in ("pairs", "info", "f", "bc", "bal"))
    + ") SELECT part, metric, class_name::INT AS class_name, round(value, 6) + 0.0 AS value FROM rows"
)
def clustering_bundle(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "embeddings")
    first = F.slice("embedding", 1, 4)
    rows = t.select((F.col("vec_id") % 4).alias("part"), "label", (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("pred"))
    return rounded(bundles.bundle(C.contingency(rows, ["part"]), ["part"], clustering=True))


@query(
    f"""{sql('scored')}, m AS (SELECT region, {_cells()} FROM scored GROUP BY region), c AS (SELECT region, label AS class_name, count(*) AS n FROM scored GROUP BY ALL)
        SELECT region, class_name, n, round((n00 + n11) / nullif(n00 + n01 + n10 + n11, 0), 6) + 0.0 AS accuracy FROM m JOIN c USING (region)"""
)
def region_metrics_with_labels(spark: SparkSession, d: str) -> DataFrame:
    t = views.scored(spark, d)
    scores = C.binary_counts(t, ["region"]).select("region", metrics.accuracy().alias("accuracy"))
    labels = distribution.class_counts(t).where("region is not null")
    return rounded(results.region_table(scores, labels, "region", "region", "region").select("region", "class_name", "n", "accuracy"))


@query("SELECT l_orderkey AS chip, l_linenumber AS row, round(l_discount * 10)::INT % 2 AS label FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0)")
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem")
    label = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.round(F.col("l_discount") * 10) % 2)
    rows = t.select(F.col("l_orderkey").alias("chip"), F.col("l_linenumber").alias("row"), label.alias("label"))
    return chips.labels_only(rows, ["chip"]).withColumn("label", F.col("label").cast("int"))


@query("SELECT o_orderkey AS chip, o_custkey AS row, round(o_totalprice, 2) AS band, c_acctbal AS elevation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON c_custkey = o_custkey")
def elevation_join(spark: SparkSession, d: str) -> DataFrame:
    data = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("chip"), F.col("o_custkey").alias("row"), F.round("o_totalprice", 2).alias("band"))
    dem = views.table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("elevation"))
    return chips.with_elevation(data, dem, ["row"]).select("chip", "row", "band", "elevation")


@query("SELECT l_orderkey AS pix, l_linenumber AS line, 1 - l_discount AS dry, l_discount AS water, CASE WHEN l_returnflag = 'A' THEN 'invalid' WHEN (l_returnflag <> 'N') = (l_discount > 0.5) THEN CASE WHEN l_discount > 0.5 THEN 'TP' ELSE 'TN' END ELSE CASE WHEN l_discount > 0.5 THEN 'FP' ELSE 'FN' END END AS category FROM lineitem")
def two_class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import spectral as S

    t = views.table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    both = S.two_class("l_discount")
    return t.select(F.col("l_orderkey").alias("pix"), F.col("l_linenumber").alias("line"), both["dry"].alias("dry"), both["water"].alias("water"), S.confusion_category(label, "l_discount", True).alias("category"))
