"""Registered queries over metric rows, lineage, grids, names, estimators and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import classify, columns, estimators, lineage, neighbours, params, results

from ..sources import chips, tables
from ..streaming import contingency as stream
from . import grid, views
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


# ---------------------------------------------------------------- metric rows

_ML = sql("metric_long")


@query(
    f"""{_ML}, a AS (SELECT config, class, seed, avg(value) AS m, nullif(stddev_samp(value), 0) AS s FROM metric_long GROUP BY ALL)
        SELECT config, class, round(avg(m), 5) + 0.0 AS mean, round(avg(s), 5) + 0.0 AS std, round(nullif(stddev_samp(m), 0), 5) + 0.0 AS mean_std, round(nullif(stddev_samp(s), 0), 5) + 0.0 AS std_std FROM a GROUP BY ALL"""
)
def seed_averages(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.seed_averages(views.metric_long(spark, d), ["config", "class"]), 5)


@query(f"{_ML}, a AS (SELECT config, seed, class, avg(value) AS v FROM metric_long GROUP BY ALL) SELECT config, seed, round(max(CASE WHEN class = 0 THEN v END), 8) + 0.0 AS value_0, round(max(CASE WHEN class = 1 THEN v END), 8) + 0.0 AS value_1 FROM a GROUP BY ALL")
def class_pivot(spark: SparkSession, d: str) -> DataFrame:
    per = views.metric_long(spark, d).groupBy("config", "seed", "class").agg(F.avg("value").alias("value"))
    return rounded(results.class_columns(per, ["config", "seed"]), 8)


@query(f"{_ML}, a AS (SELECT config, class, seed, max(value) AS v FROM metric_long GROUP BY ALL) SELECT config, class, " + ", ".join(f"max(CASE WHEN seed = {s} THEN v END) AS value_{s}" for s in (2, 4)) + " FROM a WHERE seed IN (2, 4) GROUP BY ALL HAVING count(DISTINCT seed) = 2")
def batch_pivot(spark: SparkSession, d: str) -> DataFrame:
    per = views.metric_long(spark, d).groupBy("config", "class", "seed").agg(F.max("value").alias("value"))
    return results.batch_columns({s: per.where(F.col("seed") == s).drop("seed") for s in (2, 4)}, ["config", "class"])


@query(f"{_ML}, x AS (SELECT config, seed, avg(value) AS x FROM metric_long WHERE class = 0 GROUP BY ALL), y AS (SELECT config, seed, avg(value) AS y FROM metric_long WHERE class = 1 GROUP BY ALL) SELECT config, seed, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y FROM x JOIN y USING (config, seed)")
def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = views.metric_long(spark, d)
    return rounded(results.metric_pairs(t.where("class = 0"), t.where("class = 1"), ["config", "seed"]), 8)


@query(f"{_ML} SELECT seed, min(value) AS low, round(quantile_cont(value, 0.25), 6) + 0.0 AS q1, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.75), 6) + 0.0 AS q3, max(value) AS high, round(avg(value), 8) + 0.0 AS mean FROM metric_long GROUP BY seed")
def box_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.box_summary(views.metric_long(spark, d), "seed"), 8)


_HIST_LO, _HIST_HI = 0.0, 0.1000001


@query(
    f"""{_ML}, x AS (SELECT value FROM metric_long WHERE value BETWEEN {_HIST_LO} AND {_HIST_HI}), s AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM x),
        k AS (SELECT greatest(ceil(log2(n) + 1), ceil({_HIST_HI} / (2 * (b - a) / n ** (1 / 3.0))))::INT AS k FROM s),
        c AS (SELECT least(floor(value / {_HIST_HI} * k), k - 1)::INT AS bin, count(*) AS n FROM x, k GROUP BY 1)
        SELECT g.bin::INT AS bin, round((g.bin + 0.5) * {_HIST_HI} / k, 8) AS centre, coalesce(n, 0) AS n FROM k, range(0, 10000) g(bin) LEFT JOIN c ON c.bin = g.bin WHERE g.bin < k"""
)
def metric_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.metric_histogram(views.metric_long(spark, d), "value", _HIST_LO, _HIST_HI), 8)


@query(f"{_ML} SELECT config, count(value) AS count, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 8) AS q1, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75), 8) AS q3, max(value) AS max FROM metric_long GROUP BY config")
def describe_metric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.describe(views.metric_long(spark, d), "value", ["config"]), 8)


@query("SELECT l_returnflag AS config, round(regr_slope(l_extendedprice, ln(l_quantity)), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, ln(l_quantity)), 4) + 0.0 AS intercept, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def log_fit(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "config")
    return rounded(results.log_fit(t, ["config"], "l_quantity", "l_extendedprice"), 4)


@query(
    """WITH r AS (SELECT l_returnflag AS config, l_orderkey % 5 AS f, l_extendedprice AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem),
        u AS (SELECT *, false AS log FROM r UNION ALL SELECT config, f, x, ln(y), true FROM r WHERE y > 0),
        st AS (SELECT config, log, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS dx, stddev_pop(y) AS dy FROM u GROUP BY ALL),
        z AS (SELECT config, log, f, (x - mx) / dx AS x, (y - my) / dy AS y FROM u JOIN st USING (config, log)),
        t AS (SELECT config, log, f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM z GROUP BY ALL),
        q AS (SELECT *, sum(n) OVER w AS n1, sum(n) OVER w - n AS rn, sum(sx) OVER w - sx AS rx, sum(sy) OVER w - sy AS ry, sum(sxx) OVER w - sxx AS rxx, sum(sxy) OVER w - sxy AS rxy, sum(sxy) OVER w AS wxy FROM t WINDOW w AS (PARTITION BY config, log)),
        b AS (SELECT *, (rxy - rx * ry / rn) / (rxx - rx * rx / rn + alpha) AS b FROM q, (SELECT power(10.0::DOUBLE, 5 - 2 * i / 39.0::DOUBLE) AS alpha FROM range(40) a(i))),
        e AS (SELECT config, log, alpha, any_value(n1) AS n, any_value(wxy) AS wxy, -sum(syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx) / sum(n) AS score FROM (SELECT *, (ry - b * rx) / rn AS a FROM b) GROUP BY ALL),
        k AS (SELECT e.*, wxy / (n + alpha) * dy / dx AS slope, mx, my FROM e JOIN st USING (config, log) QUALIFY row_number() OVER (PARTITION BY config ORDER BY round(score, 9) DESC, log, alpha DESC) = 1)
        SELECT config, log, round(alpha, 4) AS alpha, round(score, 4) + 0.0 AS score, round(slope, 4) + 0.0 AS slope, round(my - slope * mx, 4) + 0.0 AS intercept, n::BIGINT AS n FROM k"""
)
def ridge_choice(spark: SparkSession, d: str) -> DataFrame:
    """The price that is paid against the list price."""
    t = views.table(spark, d, "lineitem").withColumn("paid", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    t = t.withColumnRenamed("l_returnflag", "config")
    return rounded(results.ridge_choice(t, ["config"], "l_extendedprice", "paid", F.col("l_orderkey")), 4)


@query(
    f"""{_ML}, a AS (SELECT config, seed, data_id % 50 AS run, round(avg(value), 8) AS v, round(max(value), 8) AS w FROM metric_long GROUP BY ALL)
        SELECT config AS bucket, config, seed, run, v, w, row_number() OVER (PARTITION BY config ORDER BY v DESC NULLS LAST, w DESC NULLS LAST, seed, run)::INT AS rank FROM a QUALIFY rank <= 5"""
)
def best_configurations(spark: SparkSession, d: str) -> DataFrame:
    per = views.metric_long(spark, d).groupBy("config", "seed", (F.col("data_id") % 50).alias("run")).agg(F.round(F.avg("value"), 8).alias("v"), F.round(F.max("value"), 8).alias("w"))
    return results.best_configurations(per, ["v", "w"], ["seed", "run"], F.col("config"))


@query(f"{_ML} SELECT config, round(max(value), 8) AS high, round(avg(value), 8) AS mean FROM metric_long GROUP BY config")
def groups_by_maximum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(results.groups_by_maximum(views.metric_long(spark, d), "config"), 8)


@query("""SELECT o_orderkey, o_orderpriority, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, o_orderpriority) AS merged FROM orders JOIN customer ON o_custkey = c_custkey""")
def equi_join_and_merge(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = views.table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    t = results.equi_join(o, c, {"o_custkey": "c_custkey"}).drop("o_custkey")
    both = columns.merge_equivalent(t.withColumns({"a": F.col("segment"), "b": F.col("o_orderpriority")}), ["a", "b"], "merged")
    return both.select("o_orderkey", "o_orderpriority", "c_name", "segment", "merged")


@query("""WITH a AS (SELECT o_custkey AS k, nullif(o_orderpriority, '5-LOW') AS p, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS k, nullif(o_orderpriority, '5-LOW') AS p, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
    SELECT a.k, a.p, n, value FROM a JOIN b ON a.k = b.k AND a.p IS NOT DISTINCT FROM b.p""")
def null_safe_metric_join(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), "o_totalprice", "o_orderstatus")
    a = o.groupBy("k", "p").agg(F.count(F.lit(1)).alias("n"))
    b = o.where("o_orderstatus = 'O'").groupBy("k", "p").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return results.join_metric(a, b, ["k", "p", "step_id"], ["value"])


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS first, 'a' AS name FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS last, 'b' AS name FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT k, first, coalesce(a.name, b.name) AS name, last FROM a FULL JOIN b USING (k)""")
def outer_coalesce(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.min("o_orderkey").alias("first")).withColumn("name", F.lit("a"))
    b = o.where("o_orderstatus = 'O'").groupBy("k").agg(F.max("o_orderkey").alias("last")).withColumn("name", F.lit("b"))
    return results.outer_coalesce(a, b, ["k"], ["name"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def members(spark: SparkSession, d: str) -> DataFrame:
    c, o = views.table(spark, d, "customer").select("c_custkey"), views.table(spark, d, "orders").select("o_custkey")
    inside = results.with_members(c, o, "c_custkey").withColumn("has_orders", F.lit(True))
    return inside.unionByName(results.without_members(c, o, "c_custkey").withColumn("has_orders", F.lit(False)))


@query("SELECT s_suppkey AS id, 'supplier' AS kind, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, 'customer', c_name, c_mktsegment FROM customer")
def typed_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    refs = s.select("id", F.lit("supplier").alias("kind")).union(c.select("id", F.lit("customer")))
    return results.by_type(refs, {"supplier": s, "customer": c}, "kind", "id")


# ---------------------------------------------------------------- lineage

_WALK = """w AS (SELECT p_partkey AS source, p_partkey AS here, 0 AS depth FROM part WHERE p_partkey BETWEEN 1 AND 3 UNION ALL SELECT w.source, e.successor, w.depth + 1 FROM w JOIN edges e ON e.predecessor = w.here {cond})"""


@query(f"{sql('edges').replace('WITH', 'WITH RECURSIVE')}, {_WALK.format(cond='WHERE w.here % 10 <> 7')} SELECT source, here AS target, depth FROM w WHERE here % 10 = 7")
def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d)
    start = views.table(spark, d, "part").where("p_partkey BETWEEN 1 AND 3").select("p_partkey")
    goals = e.where("successor % 10 = 7").select("successor")
    return lineage.search(e, start, goals)


@query(f"{sql('edges').replace('WITH', 'WITH RECURSIVE')}, {_WALK.format(cond='')} SELECT source, here AS node, depth FROM w")
def lineage_recursive(spark: SparkSession, d: str) -> DataFrame:
    start = views.table(spark, d, "part").where("p_partkey BETWEEN 1 AND 3").select("p_partkey")
    return lineage.closure_sql(spark, views.edges(spark, d), start)


@query(f"{sql('edges').replace('WITH', 'WITH RECURSIVE')}, {_WALK.format(cond='WHERE w.here % 10 <> 7')}, h AS (SELECT source, here AS target, depth FROM w WHERE here % 10 = 7) SELECT source, target, depth FROM h QUALIFY depth = min(depth) OVER (PARTITION BY source)")
def closest_metric(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d)
    start = views.table(spark, d, "part").where("p_partkey BETWEEN 1 AND 3").select("p_partkey")
    return lineage.closest_metric(e, start, e.where("successor % 10 = 7").select("successor"))


#: Two predecessors a node, so that paths meet again: the number of paths grows with the depth, that of nodes does not.
_MESH = """edges AS (SELECT p_partkey // 2 AS predecessor, p_partkey AS successor FROM part WHERE p_partkey >= 1 UNION ALL SELECT p_partkey // 2 - 1, p_partkey FROM part WHERE p_partkey >= 4),
    starts AS (SELECT p_partkey AS id FROM part WHERE p_partkey BETWEEN 1 AND 3)"""


def _mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = views.table(spark, d, "part")
    more = part.where("p_partkey >= 4").select((F.floor(F.col("p_partkey") / 2) - 1).cast("bigint").alias("predecessor"), F.col("p_partkey").alias("successor"))
    goals = part.where("p_partkey % 10 = 7").select("p_partkey")
    return views.edges(spark, d).unionByName(more), part.where("p_partkey BETWEEN 1 AND 3").select("p_partkey"), goals


@query(
    f"""WITH RECURSIVE {_MESH}, w AS (SELECT id AS source, id AS here, 0 AS depth, 1::HUGEINT AS paths FROM starts
            UNION ALL SELECT w.source, e.successor, w.depth + 1, sum(w.paths)::HUGEINT FROM w JOIN edges e ON e.predecessor = w.here GROUP BY w.source, e.successor, w.depth)
        SELECT source, here AS target, depth, paths::BIGINT AS paths FROM w WHERE here % 10 = 7"""
)
def lineage_path_counts(spark: SparkSession, d: str) -> DataFrame:
    """J9 over a graph in which paths meet: how many of each length lead to each target."""
    found = lineage.path_counts(*_mesh(spark, d), end_at_match=False)
    return found.withColumn("paths", F.col("paths").cast("bigint"))


@query(
    f"""WITH RECURSIVE {_MESH}, w AS (SELECT p_partkey AS source, p_partkey AS here, 0 AS depth FROM part WHERE p_partkey % 4 = 1
            UNION SELECT w.source, e.successor, w.depth + 1 FROM w JOIN edges e ON e.predecessor = w.here WHERE w.here % 10 <> 7)
        SELECT source, here AS target, depth FROM w WHERE here % 10 = 7 QUALIFY depth = min(depth) OVER (PARTITION BY source)"""
)
def closest_metric_mesh(spark: SparkSession, d: str) -> DataFrame:
    """J10 over a graph in which paths meet."""
    edges, _, goals = _mesh(spark, d)
    return lineage.closest_metric(edges, views.table(spark, d, "part").where("p_partkey % 4 = 1").select("p_partkey"), goals)


@query(
    f"""{sql('edges').replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT p_partkey AS node, p_retailprice AS value FROM part WHERE p_partkey % 10 = 7),
    n AS (SELECT p_brand AS module, p_partkey AS source FROM part WHERE p_brand = 'Brand#12' OR (p_brand = 'Brand#23' AND p_size = 7)),
    w AS (SELECT source, source AS here, 0 AS depth FROM n UNION ALL SELECT w.source, e.successor, w.depth + 1 FROM w JOIN edges e ON e.predecessor = w.here WHERE w.here NOT IN (SELECT node FROM m)),
    h AS (SELECT DISTINCT source, here, depth FROM w WHERE here IN (SELECT node FROM m) QUALIFY depth = min(depth) OVER (PARTITION BY source)),
    v AS (SELECT module, value FROM n JOIN h USING (source) JOIN m ON m.node = h.here)
    SELECT module, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM v GROUP BY 1"""
)
def module_comparison(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("type"), "p_size")
    metric = part.where("p_partkey % 10 = 7").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("value"))
    found = lineage.module_metrics(nodes, views.edges(spark, d), metric, ["Brand#12", "Brand#23"], filters=[None, {"p_size": 7}])
    return rounded(results.box_summary(found, "module"))


@query(f"{sql('edges')}, n AS (SELECT predecessor AS node FROM edges UNION SELECT successor FROM edges) SELECT node, node IN (SELECT predecessor FROM edges) AND node NOT IN (SELECT successor FROM edges) AS root, node IN (SELECT successor FROM edges) AND node NOT IN (SELECT predecessor FROM edges) AS final FROM n")
def root_final_flags(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d)
    nodes = e.select(F.col("predecessor").alias("node")).union(e.select("successor")).distinct()
    return lineage.root_and_final(nodes, e)


@query("""WITH r AS (SELECT o_custkey % 40 AS ex, o_orderkey AS run, map_from_entries([('status', o_orderstatus), ('priority', o_orderpriority)]) AS config FROM orders), t AS (SELECT DISTINCT o_custkey % 40 AS ex, dense_rank() OVER (ORDER BY o_orderstatus)::BIGINT AS trial, o_orderstatus AS s FROM orders),
    m AS (SELECT t.ex, trial, min(run) AS run FROM t JOIN r ON r.ex = t.ex AND r.config['status'] = s GROUP BY ALL) SELECT ex, min(trial) AS trial, run FROM m GROUP BY ex, run""")
def run_matching(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").withColumn("ex", F.col("o_custkey") % 40)
    runs = o.select("ex", F.col("o_orderkey").alias("run"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("config"))
    states = views.table(spark, d, "orders").select("o_orderstatus").distinct()
    lower = states.withColumnRenamed("o_orderstatus", "l")
    rank = states.join(F.broadcast(lower), F.col("l") <= F.col("o_orderstatus")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("trial"))  # a handful of states
    trials = o.select("ex", "o_orderstatus").distinct().join(F.broadcast(rank), "o_orderstatus")
    trials = trials.select("ex", "trial", F.create_map(F.lit("status"), "o_orderstatus").alias("config"))
    return results.match_runs(trials, runs, "ex")


@query("SELECT s_name AS name, (row_number() OVER (ORDER BY s_name) + (SELECT max(n_nationkey) FROM nation))::BIGINT AS id FROM supplier")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    new = views.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    have = views.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return lineage.surrogate_ids(new, have, "id", ["name"])


@query("WITH s AS (SELECT l_orderkey, l_linenumber AS step, list(DISTINCT l_suppkey) AS nodes FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY ALL), a AS (SELECT l_orderkey, step, unnest(nodes) AS n FROM s) SELECT DISTINCT x.n AS predecessor, y.n AS successor FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND y.step = x.step + 1")
def sequence_edges(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(views.table(spark, d, "lineitem").where("l_orderkey % 100 = 0"))  # the rows that its twin covers


@query("WITH s AS (SELECT l_orderkey, l_linenumber AS step, list(DISTINCT l_suppkey) AS nodes FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, step, unnest(nodes) AS n FROM s) SELECT DISTINCT x.n AS predecessor, y.n AS successor FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND y.step = x.step + 1")
def sequence_edges_all(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(views.table(spark, d, "lineitem"))


def _sequences(lines: DataFrame) -> DataFrame:
    t = lines.groupBy(F.col("l_orderkey").alias("sequence"), F.col("l_linenumber").alias("step")).agg(F.collect_set("l_suppkey").alias("starts"))
    return lineage.sequence_edges(t.withColumn("ends", F.col("starts")))


@query(f"{_ML}, g AS (SELECT c.config, s.seed::INT AS seed FROM (VALUES ('A'), ('N'), ('X')) c(config), range(1, 10) s(seed)) SELECT config, seed FROM g WHERE NOT EXISTS (SELECT 1 FROM metric_long m WHERE m.config = g.config AND m.seed = g.seed)")
def pending_grid(spark: SparkSession, d: str) -> DataFrame:
    table = grid.grid(spark, {"config": ["A", "N", "X"], "seed": list(range(1, 10))})
    done = views.metric_long(spark, d).select("config", "seed").distinct().withColumn("state", F.lit("COMPLETE"))
    return grid.pending(table, done)


# ---------------------------------------------------------------- names and values


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url FROM pages), f AS (SELECT page_id, host || '_' || page_id || '_S1Hand.tif' AS path FROM u)
    SELECT page_id, regexp_extract(path, '([^/\\\\_]+)_(\\d+)_[^/\\\\]*$', 1) AS region, regexp_extract(path, '([^/\\\\_]+)_(\\d+)_[^/\\\\]*$', 2)::BIGINT AS chip_id, replace(path, 'S1Hand', 'S2Hand') AS rewritten, '.tif' AS ext FROM f WHERE NOT contains(path, 'spam')""")
def manifest_rewrite(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("_"), F.col("page_id").cast("string"), F.lit("_S1Hand.tif")).alias("path"))
    t = chips.with_keys(p.select("path"), exclude="spam").join(p, "path")
    t = chips.rewrite_manifest(t.withColumnRenamed("path", "data_file"), "S1Hand", "S2Hand")
    return t.select("page_id", "region", "chip_id", F.col("data_file").alias("rewritten"), scalars.extension(F.col("data_file")).alias("ext"))


@query("""WITH k AS (SELECT event_id, 'k=' || CASE event_id % 6 WHEN 0 THEN (props->>'k') WHEN 1 THEN '1.5' WHEN 2 THEN 'none' WHEN 3 THEN 'True' WHEN 4 THEN 'nan' ELSE event_type END AS kv, props, event_type, event_id % 6 AS m FROM events)
    SELECT event_id, 'k' AS key, CASE m WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'null' WHEN 3 THEN 'bool' WHEN 4 THEN 'float' ELSE 'string' END AS kind, CASE WHEN m = 0 THEN (props->>'k')::BIGINT END AS int_value, CASE WHEN m = 1 THEN 1.5::DOUBLE END AS float_value, CASE WHEN m = 3 THEN true END AS bool_value, CASE WHEN m = 5 THEN event_type END AS string_value FROM k""")
def parse_key_value(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    m = F.col("event_id") % 6
    value = F.when(m == 0, F.get_json_object("props", "$.k")).when(m == 1, "1.5").when(m == 2, "none").when(m == 3, "True").when(m == 4, "nan").otherwise(F.col("event_type"))
    kv = scalars.key_value(F.concat(F.lit("k="), value))
    t = e.select("event_id", F.array_join(kv["key"], ",").alias("key"), scalars.typed_value(kv["value"]).alias("v"))
    return t.select("event_id", "key", "v.kind", "v.int_value", F.when(~F.isnan("v.float_value"), F.col("v.float_value")).alias("float_value"), "v.bool_value", "v.string_value")


@query("SELECT doc_id, source AS name, doc_id AS seed, CASE WHEN doc_id % 2 = 0 THEN source || ';' || lang ELSE source END AS joined, left(source, 2) || 'X' || substr(source, 4) AS replaced FROM documents")
def name_seed_split(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "documents").select("doc_id", "source", "lang")
    parts = scalars.name_and_seed(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")))
    items = scalars.split_list(F.concat_ws(";", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))
    return t.select("doc_id", parts["name"].alias("name"), parts["seed"].alias("seed"), scalars.joined(items).alias("joined"), scalars.replace_first(F.col("source"), "c", "X").alias("replaced"))


@query("""SELECT l_orderkey AS trial_num, min(l_shipdate) AS start_time, max(l_shipdate) AS end_time FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1""")
def complete_trials(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number"), "l_returnflag").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    raw = t.select("number", F.when(F.col("l_returnflag") == "N", "COMPLETE").otherwise("FAIL").alias("state"), text("a").alias("datetime_start"), text("b").alias("datetime_complete"), F.lit(0.5).alias("values_0"))
    return tables.trials(raw)


# ---------------------------------------------------------------- estimators (rows only)


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    t = views.feat(spark, d).select("id", F.col("y").cast("int").alias("label"), "f1", "f2", "f3", "f4")
    return t.where("id % 4 <> 0"), t, ["f1", "f2", "f3", "f4"]


def _predicted(spark: SparkSession, d: str, name: str, **params) -> DataFrame:
    train, every, features = _split(spark, d)
    model = estimators.fit(train, estimators.make(name, **params), features, balanced=name != "gaussian_nb")
    return estimators.predict(model, every).select("id", "label", "prediction")


@query()
def gbt(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "gbt", leaves=8, trees=5)


@query()
def forest(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "rf", leaves=8, trees=10)


@query()
def linear_svc(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "sgd", loss="hinge", alpha=0.1, steps=20)


@query()
def logistic(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, "sgd", loss="log", steps=20)


@query()
def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    """M10 for every row: its five nearest other rows, whether they share a bucket or not."""
    t = views.feat(spark, d)
    return classify.vote(classify.nearest_lsh(t, t, 5, bucket=2.0, others=True, whole=True), weights="distance")


@query()
def knn_large(spark: SparkSession, d: str) -> DataFrame:
    """M10: cosine neighbours through hash tables whose recall is measured; every row is indexed, the stated queries are ids divisible by 20."""
    t = views.feat(spark, d)
    found = neighbours.nearest_large(t, t.where("id % 20 = 0"), 5, metric="cosine", others=True)
    return classify.vote(found.neighbours, weights="distance").withColumn("recall", F.lit(found.recall))


_NEAR_ALL = f"""{sql('feat')}, p AS (SELECT q.id AS query, t.id, t.y, round(1 - list_cosine_similarity(q.x, t.x), 12) AS dist FROM feat q, feat t WHERE q.id % 20 = 0 AND q.id <> t.id),
        k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY dist, id) <= 5)"""


@query(f"{_NEAR_ALL} SELECT query, id, round(dist, 6) + 0.0 AS distance FROM k")
def knn_exact_all(spark: SparkSession, d: str) -> DataFrame:
    """M9 over all rows and dimensions, by cosine."""
    t = views.feat(spark, d)
    near = classify.nearest(t, t.where("id % 20 = 0"), 6, "cosine").where("query <> id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 12), "id"))
    return rounded(near.withColumn("r", rank).where("r <= 5").select("query", "id", "distance"))


# ---------------------------------------------------------------- streams


_EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_LABELS = """s AS (SELECT ts, event_type, CASE WHEN user_id % 7 = 0 THEN -1 ELSE (value > 20)::INT END AS label, (event_id % 3 = 0)::INT AS pred FROM events)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)
    label = F.when(F.col("user_id") % 7 == 0, -1).otherwise((F.col("value") > 20).cast("int"))
    return raw.select("ts", "event_type", label.alias("label"), (F.col("event_id") % 3 == 0).cast("int").alias("pred"))


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """The stream's output once everything that is there has been read, through a table in the shared folder."""
    folder = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/rows"

    stream.run(df, stream.by_epoch(out), f"{folder}/state", mode).awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {_LABELS} SELECT event_type, label, pred, count(*) AS n FROM s GROUP BY ALL")
def stream_contingency(spark: SparkSession, d: str) -> DataFrame:
    rows = _drained(spark, stream.running_contingency(_events(spark, d), ["event_type"]), "complete")
    return rows.groupBy("event_type", "label", "pred").agg(F.max_by("n", "epoch").alias("n"))


@query(f"WITH {_LABELS}, w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, sum((label = 1 AND pred = 1)::INT) AS tp, sum((label = 0 AND pred = 1)::INT) AS fp, sum((label = 1 AND pred = 0)::INT) AS fn, sum((label = 0 AND pred = 0)::INT) AS tn FROM s GROUP BY 1) SELECT start, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 6) AS iou FROM w WHERE tp + fp + fn + tn > 0")
def stream_window_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = _drained(spark, stream.windowed_counts(_events(spark, d), "ts", "1 day", "1 day"), "update")
    last = counts.groupBy("start").agg(*[F.max_by(c, "epoch").alias(c) for c in ("n00", "n01", "n10", "n11", "invalid")])
    scores = stream.windowed_scores(last)
    return rounded(scores.select("start", "accuracy", F.col("iou1_1").alias("iou")))


_SCORED_EVENTS = """e AS (SELECT event_id, value AS a, json_extract(props, '$.k')::DOUBLE AS b, (user_id % 3 = 0)::INT AS y FROM events), t AS (SELECT * FROM e WHERE event_id % 2 = 0),
    c AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM t), z AS (SELECT event_id, (a - ma) / sa AS a, (b - mb) / sb AS b, y FROM e, c)"""


@query(
    f"""WITH {_SCORED_EVENTS}, u AS (SELECT * FROM z WHERE event_id % 2 = 0), s AS (SELECT y, count(*) / (SELECT count(*) FROM u) AS p, avg(a) AS m1, avg(b) AS m2, var_pop(a) AS v1, var_pop(b) AS v2 FROM u GROUP BY y), g AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM u),
        l AS (SELECT event_id, s.y, ln(p) - 0.5 * (ln(2 * pi() * (v1 + e)) + ln(2 * pi() * (v2 + e))) - 0.5 * ((a - m1) ** 2 / (v1 + e) + (b - m2) ** 2 / (v2 + e)) AS score FROM z, s, g)
        SELECT event_id, y AS prediction FROM l QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, y) = 1"""
)
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Stored parameters and a model fitted before, applied to a stream of events."""
    features = lambda t: t.select("event_id", F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    train = features(views.table(spark, d, "events")).where("event_id % 2 = 0")
    store = tables.Store(spark, f"{lineage.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("parameters", params.fit_standard(train, ["a", "b"]))
    found = params.parameters(store["parameters"], ["a", "b"], "standard")
    model = classify.gaussian_naive_bayes(params.apply(train, found, "standard"), ["a", "b"], "y")
    raw = spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)
    scored = stream.score_stream(features(raw), model, found)
    return _drained(spark, scored.select("event_id", "prediction"), "append").select("event_id", "prediction")
