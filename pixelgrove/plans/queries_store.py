"""Registered queries over column sets, catalogs, the stored tables, packed sets, keys and saved scores, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, variants
from ..operators import columns, estimators, lineage, results, spatial, user
from ..sources import chips, folders, tables
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


# ---------------------------------------------------------------- column sets and catalogs


@query(f"{sql('bands')} SELECT pix, line, round(b1 * 2, 8) + 0.0 AS b1, round(b3 * 2, 8) + 0.0 AS b3, round(b1 * 2 + b3 * 2, 8) + 0.0 AS total FROM bands")
def channel_steps(spark: SparkSession, d: str) -> DataFrame:
    keys = ["pix", "line"]
    steps = [
        lambda t: columns.keep(t, ["b1", "b3", "b4"], keys),
        lambda t: columns.discard(t, "b4"),
        lambda t: columns.per_channel(t, lambda c: F.col(c) * 2, keys),
        lambda t: columns.derive_if_absent(t, "total", F.col("b1") + F.col("b3")),
        lambda t: columns.derive_if_absent(t, "total", F.lit(None)),
    ]
    return rounded(columns.in_sequence(views.bands(spark, d), steps), 8)


@query(f"{sql('bands')} SELECT pix, line, b3, b4, 'optical' AS name FROM bands")
def catalog_choice(spark: SparkSession, d: str) -> DataFrame:
    b = views.bands(spark, d)
    entries = columns.Catalog().add("radar", b.select("pix", "line", "b1", "b2"), 4, "train").add("optical", b.select("pix", "line", "b3", "b4"), 8, "train")
    with_labels = entries.spread([lambda c: c.retain("radar").remove("radar").add("label", b.select("pix", "line", "b6"), 2, "train")])
    name = with_labels.find(kind=6, kind_mode="or_not", channels=["b3", "b4"], split="train")
    return with_labels[name].withColumn("name", F.lit(name))


_BITS = {"and": "& 6) = 6", "or": "& 6) <> 0", "and_not": "& 6) <> 6", "or_not": "& 6) = 0"}
_NAMED = {"and": "l_returnflag = 'A' AND l_linestatus = 'F'", "or": "l_returnflag = 'A' OR l_linestatus = 'F'", "and_not": "NOT (l_returnflag = 'A' AND l_linestatus = 'F')", "or_not": "NOT (l_returnflag = 'A' OR l_linestatus = 'F')"}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"(l_linenumber {x} AS kind_{m}" for m, x in _BITS.items()) + ", " + ", ".join(f"{x} AS names_{m}" for m, x in _NAMED.items()) + ", concat_ws('_', CASE WHEN l_linenumber & 1 <> 0 THEN 'unknown' END, CASE WHEN l_linenumber & 2 <> 0 THEN 'label' END, CASE WHEN l_linenumber & 4 <> 0 THEN 's1' END) AS name FROM lineitem")
def predicate_modes(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("names"))
    kind = F.col("l_linenumber")
    bits = [columns.predicate(kind, 6, m).alias(f"kind_{m}") for m in _BITS]
    named = [columns.channel_predicate(F.col("names"), ["A", "F"], m).alias(f"names_{m}") for m in _NAMED]
    return t.select("l_orderkey", "l_linenumber", *bits, *named, scalars.kind_name(kind).alias("name"))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS value_1, o_orderpriority AS config_inner_priority, 'F' AS config_status FROM orders WHERE o_orderstatus = 'F'")
def wide_result(spark: SparkSession, d: str) -> DataFrame:
    """Nested configurations as columns, without those that are empty or unwanted, of the wanted status, values suffixed."""
    o = views.table(spark, d, "orders")
    inner = F.struct(F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("empty"))
    t = o.select("o_orderkey", F.round("o_totalprice", 4).alias("value"), "o_clerk" if "o_clerk" in o.columns else F.lit("c").alias("o_clerk"), F.struct(F.col("o_orderstatus").alias("status"), inner.alias("inner")).alias("config"))
    t = columns.drop_empty_columns(columns.flatten(t))
    t = columns.matching(columns.drop_if_present(t, ["o_clerk", "absent"]), {"config_status": "F"})
    return columns.suffixed(t, "_1", ["value"])


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'SAR_' || source WHEN 1 THEN 'RGB' ELSE 'O_' || source END AS space FROM documents) SELECT doc_id, space, regexp_matches(space, 'SAR[^"]*(_[^"]*)*') AS sar_included, contains(space, '_') AS mixed FROM s""")
def feature_space_flags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 3
    space = F.when(m == 0, F.concat(F.lit("SAR_"), "source")).when(m == 1, "RGB").otherwise(F.concat(F.lit("O_"), "source"))
    t = views.table(spark, d, "documents").select("doc_id", space.alias("space"))
    return t.select("*", *[c.alias(n) for n, c in columns.feature_space_flags(F.col("space")).items()])


# ---------------------------------------------------------------- keys, runs and configurations


@query("SELECT a.l_orderkey AS trial, a.l_linenumber AS experiment, a.l_quantity AS value, b.l_tax AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_returnflag = 'R'")
def multi_key_join(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem")
    a = t.select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("experiment"), F.col("l_quantity").alias("value"))
    b = t.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("e"), F.col("l_tax").alias("other"))
    return results.equi_join(a, b, {"trial": "t", "experiment": "e"})


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b USING (k) WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1")
def merge_mismatches(spark: SparkSession, d: str) -> DataFrame:
    o, c = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return results.mismatches(o, c, ["k"])


@query("SELECT min(o_orderkey) AS folder FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def wanted_run(spark: SparkSession, d: str) -> DataFrame:
    config = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("customer"), F.col("o_custkey").cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED")
    runs = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("folder"), config.alias("config"), status.alias("status"))
    return results.matching_run(runs, {"priority": "1-URGENT", "seed": "4"}, ignore_source=["customer"], ignore_target=["seed"])


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer)
    SELECT 'both' AS part, k FROM (SELECT k FROM c INTERSECT SELECT k FROM o) UNION ALL SELECT 'only_left', k FROM (SELECT k FROM c EXCEPT SELECT k FROM o) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM o)""")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    c, o = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), views.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return results.union_all([t.select(F.lit(name).alias("part"), "k") for name, t in results.key_sets(c, o).items()])


@query(f"{sql('metric_long')}, a AS (SELECT config, seed, round(avg(value), 8) AS value FROM metric_long GROUP BY ALL) SELECT config, seed, value FROM a ORDER BY value DESC NULLS LAST, config, seed LIMIT 1")
def best_single(spark: SparkSession, d: str) -> DataFrame:
    per = views.metric_long(spark, d).groupBy("config", "seed").agg(F.round(F.avg("value"), 8).alias("value"))
    return results.best_single(per, "value")


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) SELECT o_orderkey, s = 'F' AS has_status, p IS NULL AS has_null, false AS has_other, round(o_orderkey / 7.0, 4) AS ratio FROM m""")
def map_containment(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    t = views.table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), priority).alias("m"))
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v).cast("string"))
    return t.select("o_orderkey", scalars.contains_map(F.col("m"), one("status", "F")).alias("has_status"), scalars.contains_map(F.col("m"), one("priority", None)).alias("has_null"), scalars.contains_map(F.col("m"), one("absent", None)).alias("has_other"), scalars.half_up(F.col("o_orderkey") / 7).alias("ratio"))


@query(f"""{sql('metric_long')}, done AS (SELECT DISTINCT config, seed FROM metric_long), g AS (SELECT config, CASE WHEN config <> 'X' THEN seed END AS seed FROM (VALUES ('A'), ('N'), ('X')) c(config), (SELECT seed::INT AS seed FROM range(1, 10) s(seed)))
    SELECT DISTINCT config, seed FROM g WHERE NOT EXISTS (SELECT 1 FROM done m WHERE m.config = g.config AND m.seed IS NOT DISTINCT FROM g.seed)""")
def conditional_grid(spark: SparkSession, d: str) -> DataFrame:
    table = grid.grid(spark, {"config": ["A", "N", "X"], "seed": list(range(1, 10))}, {"seed": F.col("config") != "X"})
    done = views.metric_long(spark, d).select("config", "seed").distinct().withColumn("state", F.lit("COMPLETE"))
    return grid.pending(table, done)


# ---------------------------------------------------------------- lineage and identifiers


@query(
    f"""{sql('edges').replace('WITH', 'WITH RECURSIVE')}, w AS (SELECT successor AS source, successor AS here, 0 AS depth FROM edges WHERE successor NOT IN (SELECT predecessor FROM edges)
        UNION ALL SELECT w.source, e.predecessor, w.depth + 1 FROM w JOIN edges e ON e.successor = w.here WHERE w.here % 10 <> 7) SELECT source, here AS target, depth FROM w WHERE here % 10 = 7"""
)
def last_evaluation(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d)
    finals = e.select(F.col("successor").alias("node")).join(e.select(F.col("predecessor").alias("node")), "node", "left_anti")
    return lineage.last_evaluation(e, finals, e.where("successor % 10 = 7").select("successor"))


@query("""WITH have AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS seed FROM customer), want AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS seed FROM supplier UNION ALL SELECT name, seed FROM have)
    SELECT id::BIGINT AS id, name, seed FROM have UNION ALL SELECT (row_number() OVER (ORDER BY name, seed) + (SELECT max(id) FROM have))::BIGINT, name, seed FROM (SELECT DISTINCT name, seed FROM want) w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.name = w.name AND h.seed IS NOT DISTINCT FROM w.seed)""")
def experiment_ids(spark: SparkSession, d: str) -> DataFrame:
    have = views.table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("seed"))
    new = views.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("seed"))
    return lineage.get_or_create(have, new.union(have.select("name", "seed")))


@query("SELECT source AS f_name, max(doc_id) AS id FROM documents GROUP BY 1")
def artifact_ids(spark: SparkSession, d: str) -> DataFrame:
    return lineage.artifact_ids(views.table(spark, d, "documents").select(F.col("source").alias("f_name"), F.col("doc_id").alias("id")))


# ---------------------------------------------------------------- stored tables, packed sets, scores


def _folder(spark: SparkSession, name: str) -> str:
    return f"{lineage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"{sql('edges')} SELECT predecessor, successor, 'first' AS run FROM edges WHERE successor % 2 = 0 UNION ALL SELECT predecessor, successor, 'second' FROM edges WHERE successor % 2 = 1")
def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """A typed table made where absent, to which two runs append; read back through a read-only store."""
    e, folder = views.edges(spark, d), _folder(spark, "store")
    store = tables.Store(spark, folder)
    store.create_if_absent("is_successor", tables.SCHEMAS["is_successor"] + ", run string")
    for rest, run in ((0, "first"), (1, "second")):
        store.append("is_successor", e.where(F.col("successor") % 2 == rest).withColumn("run", F.lit(run)))
    return tables.Store(spark, folder, read_only=True)["is_successor"]


@query(f"{sql('raster')} SELECT 'R' || region AS region, chip, row, col, v, (v > 0)::INT AS label FROM raster WHERE region <> 0")
def packed_set(spark: SparkSession, d: str) -> DataFrame:
    """Data and labels packed by region, read as the split without one region, and merged by key."""
    base, keys = _folder(spark, "packed"), ["region", "chip", "row", "col"]
    t = views.raster(spark, d).withColumn("region", F.when(F.col("region") == 0, "Bolivia").otherwise(F.concat(F.lit("R"), "region")))
    chips.pack(t.select(*keys, "v"), base, "S1", "weak")
    chips.pack(chips.labels_only(t.select(*keys, (F.col("v") > 0).cast("int").alias("label")), keys[:2]), base, "label", "weak")
    data, labels = (chips.read_split(spark, [f"{base}/absent", base], kind, "weak-bolivia") for kind in ("S1", "label"))
    return chips.data_with_labels(data, labels, keys).withColumn("label", F.col("label").cast("int"))


@query()
def batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted on one split scores all of them; the probabilities are stored by split and read back."""
    t = views.feat(spark, d).withColumn("split", F.element_at(F.array(*[F.lit(s) for s in chips.SPLITS]), (F.col("id") % 4 + 1).cast("int")))
    t = t.select("split", "id", F.col("y").cast("int").alias("label"), "f1", "f2", "f3", "f4", (1.0 + F.abs("f1")).alias("weight"))
    model = estimators.fit(t.where("split = 'train'"), estimators.make("gaussian_nb"), ["f1", "f2", "f3", "f4"], weight="weight")
    path = _folder(spark, "scores")
    estimators.score_splits(t, model, path, ["id"])
    return spark.read.parquet(path)


@query()
def per_channel_labels(spark: SparkSession, d: str) -> DataFrame:
    """One model for each channel, side by side."""
    t = views.feat(spark, d).select("id", F.col("y").cast("int").alias("label"), "f1", "f2")
    models = estimators.fit_per_channel(t, lambda: estimators.make("gaussian_nb"), ["f1", "f2"])
    return estimators.predict_per_channel(models, t).select("id", "label", "f1-label", "f2-label")


# ---------------------------------------------------------------- folders of chips and runs


@query(f"{sql('raster')} SELECT (['train', 'valid', 'test', 'bolivia'])[chip % 4 + 1] AS split, 'R' || region AS region, chip::BIGINT AS chip_id, row, col, v, v * v AS power FROM raster WHERE chip % 4 IN (0, 1) AND region <> 0 AND chip % 3 <> 1")
def chip_scan(spark: SparkSession, d: str) -> DataFrame:
    """Chips written as files by split, read back through the data source: two splits, some regions, what a split list names."""
    folder = _folder(spark, "chips")
    split = F.element_at(F.array(*[F.lit(s) for s in chips.SPLITS]), (F.col("chip") % 4 + 1).cast("int"))
    t = views.raster(spark, d).select(split.alias("split"), F.concat(F.lit("R"), "region").alias("region"), F.col("chip").cast("long").alias("chip_id"), "row", "col", "v", (F.col("v") * F.col("v")).alias("power"))
    listed = lineage.written(folders.save_chips(t, folder, ["v", "power"], "S1Hand"))
    wanted = listed.where(F.regexp_extract("file", r"_(\d+)_", 1).cast("int") % 3 != 1)
    wanted.select("file", F.replace("file", F.lit("S1"), F.lit("Label"))).write.csv(f"{folder}/lists")
    scan = folders.chips(spark, folder, ["v", "power"], splits=["train", "valid"], regions=["R1", "R2", "R3", "R4"], layer="S1Hand")
    return chips.in_manifest(scan, chips.manifest(spark, f"{folder}/lists")).drop("file")


_RUNS = "SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_suppkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM supplier"


@query(f"WITH r AS ({_RUNS}) SELECT 'run_' || s_suppkey AS folder, s_nationkey AS nation, s_acctbal AS balance FROM r WHERE status = 'COMPLETED' AND s_suppkey % 7 <> 3")
def run_folders(spark: SparkSession, d: str) -> DataFrame:
    """Run folders written and read back: those that are complete and have all three files."""
    root, s = _folder(spark, "runs"), views.table(spark, d, "supplier")
    config = F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))
    status = F.when(F.col("s_suppkey") % 5 == 0, "FAILED").otherwise("COMPLETED")
    rows = s.select(F.concat(F.lit("run_"), "s_suppkey").alias("folder"), config.alias("config"), F.when(F.col("s_suppkey") % 7 != 3, "{}").alias("pipeline"), status.alias("status"))
    lineage.written(folders.save_runs(rows, root))
    found = folders.runs(spark, root).select("folder", F.from_json("config", "nation int, balance double").alias("c"))
    return found.select("folder", "c.nation", "c.balance")


# ---------------------------------------------------------------- typed values


@query("SELECT event_id // 50 AS trial, key || '_' || event_id AS param, CASE WHEN event_id % 3 = 0 THEN 'varchar' ELSE 'bigint' END AS name, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.' || key) END AS value, (event_id % 3 <> 0)::INT AS numeric FROM (SELECT *, unnest(json_keys(props)) AS key FROM events)")
def trial_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Trial -> parameter -> {name, attributes, value} from JSON whose keys are not known, written as typed trees and read back."""
    e = views.table(spark, d, "events")
    odd = F.col("event_id") % 3 == 0
    each = variants.entries(e, ["event_id", "event_type"], "props")
    value = F.when(odd, F.to_variant_object(F.struct(F.col("event_type").alias("v")))).otherwise(F.to_variant_object(F.struct(F.variant_get("value", "$", "bigint").alias("v"))))
    made = each.select((F.floor(F.col("event_id") / 50)).cast("bigint").alias("trial"), F.concat_ws("_", "key", "event_id").alias("param"), F.when(odd, "varchar").otherwise("bigint").alias("name"), F.try_variant_get(value, "$.v", "variant").alias("v"))
    tree = made.select("trial", "param", "name", F.parse_json(variants.typed(F.col("v"))).alias("attributes"), F.col("v").alias("value"))
    path = _folder(spark, "distributions")
    tables.save_distributions(tree, path)
    back = tables.load_distributions(spark, path)
    kind = F.try_variant_get("attributes", "$.type", "string")
    return back.select("trial", "param", "name", variants.text(variants.resolved(F.col("attributes"))).alias("value"), (kind == "bigint").cast("int").alias("numeric"))


# ---------------------------------------------------------------- functions of the user


@query(f"{sql('raster')}, z AS (SELECT region, chip, col // 8 AS zone, v FROM raster), m AS (SELECT region, chip, zone, count(*) AS n, sum(v) AS a, sum(v * v) AS b, sum(v * v * v) AS c, max(v) - min(v) AS span FROM z GROUP BY ALL) SELECT region, chip, zone, round((c / n - 3 * a / n * b / n + 2 * (a / n) ** 3) / (b / n - (a / n) ** 2) ** 1.5, 5) + 0.0 AS skewness, round(span, 6) AS span FROM m")
def zonal_user_property(spark: SparkSession, d: str) -> DataFrame:
    """A property that the user supplies, from partial results of every batch: skewness from power sums, and the span."""
    t = views.raster(spark, d).withColumn("zone", F.floor(F.col("col") / 8).cast("int"))

    def skew(s):
        m = s[1] / s[0]
        return (s[3] / s[0] - 3 * m * s[2] / s[0] + 2 * m * m * m) / F.pow(s[2] / s[0] - m * m, F.lit(1.5))

    a = user.zonal_property(t, ["region", "chip"], "zone", ["v"], lambda v: (len(v), v.sum(), (v * v).sum(), (v**3).sum()), ["sum"] * 4, skew, "skewness")
    b = user.zonal_property(t, ["region", "chip"], "zone", ["v"], lambda v: (v.min(), v.max()), ["min", "max"], lambda s: s[1] - s[0], "span")
    out = a.join(b, ["region", "chip", "zone"]).withColumnsRenamed({"v-skewness": "skewness", "v-span": "span"})
    return rounded(out.withColumn("skewness", F.round("skewness", 5)), 6)


@query(f"{sql('raster')}, g AS (SELECT region, chip, max(v) AS top FROM raster GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY region, chip) - 1 AS index FROM g) SELECT region, chip, row, col, index, round(v / top + index, 6) + 0.0 AS v FROM raster JOIN i USING (region, chip)")
def per_item_function(spark: SparkSession, d: str) -> DataFrame:
    """A function of each chip and its number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def scaled(item: pa.Table, index: int) -> pa.Table:
        v = pc.add(pc.divide(item.column("v"), pc.max(item.column("v"))), float(index))
        return item.set_column(item.column_names.index("v"), "v", v).append_column("index", pa.array([index] * item.num_rows, pa.int64()))

    t = views.raster(spark, d).select("region", "chip", "row", "col", "v")
    return rounded(user.per_item(t, ["region", "chip"], scaled, "region int, chip int, row int, col int, v double, index long"))


@query(f"{sql('raster')} SELECT region, chip, (least(max(row) + 1, 8) * least(max(col) + 1, 40))::BIGINT AS n, 0::BIGINT AS wrong, round(sum(v), 6) + 0.0 AS total FROM raster GROUP BY ALL")
def flips_and_crops(spark: SparkSession, d: str) -> DataFrame:
    """Random flips, then a random crop: data and labels stay together (wrong: pixels whose label is not their value's), and a flip loses nothing."""
    keys = ["region", "chip"]
    t = views.raster(spark, d).withColumn("label", (F.col("v") > 0).cast("int"))
    t = spatial.random_flip(spatial.random_flip(t, keys, "row", 0.5, 3), keys, "col", 0.5, 4)
    whole = t.groupBy(*keys).agg(F.sum("v").alias("total"))
    t = spatial.random_crop(t, keys, 8, 40, 5)
    t = t.groupBy(*keys).agg(F.countDistinct("row", "col").alias("n"), F.sum((F.col("label") != (F.col("v") > 0).cast("int")).cast("int")).alias("wrong"))
    return rounded(t.join(whole, keys))
