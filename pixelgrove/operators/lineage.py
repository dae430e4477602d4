"""Lineage of modules: reachability, closest metrics, flags, surrogate ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Levels of a search that one job works on; each is aggregated, and all are written at its end.
LEVELS = 5
#: Rows up to which the edges and flags of a search are broadcast; beyond, each level's join shuffles.
BROADCAST_ROWS = 400_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _steps(edges: DataFrame, target: DataFrame, stop: DataFrame | None, forward: bool) -> tuple[DataFrame, DataFrame]:
    """Edges as (_from, _to, _n: how often, _goal, _stop: flags of _to), and (id, _goal, _stop) of targets and stops."""
    a, b = ("predecessor", "successor") if forward else ("successor", "predecessor")
    flags = target.select(F.col(target.columns[0]).alias("id"), F.lit(True).alias("_goal"), F.lit(False).alias("_stop"))
    if stop is not None:
        flags = flags.union(stop.select(F.col(stop.columns[0]), F.lit(False), F.lit(True)))
    flags = flags.groupBy("id").agg(F.max("_goal").alias("_goal"), F.max("_stop").alias("_stop"))
    every = edges.groupBy(F.col(a).alias("_from"), F.col(b).alias("_to")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_n"))
    return written(_flagged(every.withColumnRenamed("_to", "id"), flags).withColumnRenamed("id", "_to")), written(flags)


def _flagged(rows: DataFrame, flags: DataFrame) -> DataFrame:
    out = rows.join(flags, "id", "left")
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("_goal", "_stop")})


def _written_and_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df through a table in the shared folder, and how many rows meet the condition, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return out, seen.get["n"]


def path_counts(edges: DataFrame, start: DataFrame, target: DataFrame, stop: DataFrame | None = None, forward: bool = True, end_at_match: bool = True, max_levels: int = 1000) -> DataFrame:
    """(source, target, depth, paths): how many paths of each length lead from start ids to target ids along the edges.

    A start that is a target matches at depth 0 (as often as it is given).  end_at_match prunes branches at a match; a stop id ends its
    branch.  The frontier is kept by (source, node) with a count, so paths that meet again cost nothing.  Where a source
    goes on for more levels than it has nodes, its paths run in a cycle: an error, as are more than max_levels levels.
    """
    step, flags = _steps(edges, target, stop, forward)
    step = _sized(step)
    first = start.groupBy(F.col(start.columns[0]).alias("id")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("paths"))
    level = _flagged(first, flags).select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("depth"), "paths", "_goal", "_stop")
    done: list[DataFrame] = []
    depth, check = 0, 4
    while True:
        parts = [level]
        for _ in range(LEVELS):
            live = parts[-1].where(~F.col("_stop") & ~(F.col("_goal") & F.lit(end_at_match)))
            onward = live.join(step.withColumnsRenamed({"_goal": "_g", "_stop": "_s"}), F.col("at") == F.col("_from"))
            depth += 1
            # no literal of the depth: the code that is generated for one level serves all
            counts = onward.groupBy("source", F.col("_to").alias("at"), (F.col("depth") + 1).alias("depth"), F.col("_g").alias("_goal"), F.col("_s").alias("_stop"))
            counts = counts.agg(F.sum(F.col("paths") * F.col("_n")).cast("decimal(38,0)").alias("paths"))
            parts.append(counts.select("source", "at", "depth", "paths", "_goal", "_stop"))
        made, ahead = _written_and_counted(reduce(DataFrame.unionByName, parts if not done else parts[1:]), F.col("depth") == depth)
        done.append(made)
        if not ahead:
            break
        level = made.where(F.col("depth") == depth)
        if depth >= max_levels:
            raise ValueError(f"paths of over {max_levels} levels; do the edges hold a cycle?")
        if depth >= check:
            nodes = reduce(DataFrame.unionByName, done).select("source", "at").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("nodes"))
            if not level.select("source").distinct().join(nodes, "source").where(F.col("nodes") <= depth).isEmpty():
                raise ValueError(f"a path of {depth} steps over fewer nodes: the edges hold a cycle")
            check *= 2
    found = reduce(DataFrame.unionByName, done).where("_goal")
    return found.select("source", F.col("at").alias("target"), "depth", "paths")


def search(edges: DataFrame, start: DataFrame, target: DataFrame, stop: DataFrame | None = None, forward: bool = True, end_at_match: bool = True, max_levels: int = 1000) -> DataFrame:
    """(source, target, depth), one row for each path of path_counts."""
    counted = path_counts(edges, start, target, stop, forward, end_at_match, max_levels)
    block = 10_000
    many = counted.withColumn("_b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("paths") / block).cast("int") - 1)))
    size = F.least(F.lit(block), F.col("paths") - F.col("_b").cast("decimal(38,0)") * block).cast("int")
    return many.withColumn("_p", F.explode(F.sequence(F.lit(1), size))).select("source", "target", "depth")


def nearest(edges: DataFrame, start: DataFrame, target: DataFrame, stop: DataFrame | None = None, forward: bool = True, max_levels: int = 1000) -> DataFrame:
    """(source, target, depth): of each start id the distinct target ids at the least depth.

    A (source, node) that was reached before is not gone on from again, nor a source that has matched; so cycles end by
    themselves.  One job works on LEVELS levels.
    """
    step, flags = _steps(edges, target, stop, forward)
    step = _sized(step).withColumnsRenamed({"_goal": "_g", "_stop": "_s"})
    first = _flagged(start.select(F.col(start.columns[0]).alias("id")).distinct(), flags)
    level = written(first.select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("depth"), "_goal", "_stop"))
    seen, depth = level, 0
    while depth < max_levels:
        over = seen.groupBy("source").agg(F.max("_goal").alias("_done")).where("_done").select("source")
        parts = [level.join(over, "source", "left_anti")]
        for _ in range(LEVELS):
            depth += 1
            onward = parts[-1].where("not _stop and not _goal").join(step, F.col("at") == F.col("_from"))
            parts.append(onward.select("source", F.col("_to").alias("at"), (F.col("depth") + 1).alias("depth"), F.col("_g").alias("_goal"), F.col("_s").alias("_stop")).distinct())
        new = reduce(DataFrame.unionByName, parts[1:]).groupBy("source", "at", "_goal", "_stop").agg(F.min("depth").alias("depth"))
        new = new.join(seen.select("source", "at"), ["source", "at"], "left_anti")
        made, ahead = _written_and_counted(new.select(*level.columns), F.col("depth") == depth)
        seen = seen.unionByName(made)
        if not ahead:
            break
        level = made.where(F.col("depth") == depth)
    else:
        raise ValueError(f"nodes over {max_levels} levels away")
    hits = seen.where("_goal")
    least = hits.groupBy("source").agg(F.min("depth").alias("depth"))
    return hits.join(least, ["source", "depth"]).select("source", F.col("at").alias("target"), "depth")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one with a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure_sql(spark: SparkSession, edges: DataFrame, start: DataFrame, max_levels: int = 1000) -> DataFrame:
    """All (source, node, depth) reachable, as a recursive query; the session's limit of rows of such queries is lifted.

    Every level is a merge join: neither the edges nor a level, which both grow with the input, pass through the driver.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""WITH RECURSIVE walk(source, node, depth) MAX RECURSION LEVEL {int(max_levels)} AS (
             SELECT id, id, 0 FROM {{start}}
             UNION ALL SELECT /*+ MERGE(e) */ walk.source, e.successor, walk.depth + 1 FROM walk JOIN {{edges}} e ON e.predecessor = walk.node)
           SELECT source, node, depth FROM walk""",
        edges=edges,
        start=start.select(F.col(start.columns[0]).alias("id")),
    )


def closest_metric(edges: DataFrame, modules: DataFrame, metric_nodes: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """(source, target, depth): the nearest metric nodes below each module; parameters (by source) joined last."""
    near = nearest(edges, modules, metric_nodes)
    return near.join(parameters, "source") if parameters is not None else near


def per_module(modules: Sequence[str], given: Sequence | None, name: str) -> list:
    """One setting per module: a single one, or none, holds for all."""
    given = [None] if given is None else list(given)
    if len(given) not in (1, len(modules)):
        raise ValueError(f"{name}: one value, or one for each of the {len(modules)} modules")
    return given * len(modules) if len(given) == 1 else given


def module_metrics(
    nodes: DataFrame,
    edges: DataFrame,
    metric: DataFrame,
    modules: Sequence[str],
    experiments: Sequence[str | None] | None = None,
    filters: Sequence[Mapping | None] | None = None,
    kind: str = "type",
    experiment: str = "experiment",
) -> DataFrame:
    """(module, source, target, value): the closest metrics of several modules, each with its own experiment and filter.

    nodes: node, kind, experiment and configuration columns; metric: node, value; filters: column -> wanted value (null-safe).
    One search serves all modules.
    """
    if len(modules) < 2:
        raise ValueError("a comparison needs two modules or more")
    chosen = None
    for name, ex, wanted in zip(modules, per_module(modules, experiments, "experiments"), per_module(modules, filters, "filters")):
        part = nodes.where(F.col(kind) == name)
        for column, value in {**({experiment: ex} if ex is not None else {}), **(wanted or {})}.items():
            part = part.where(F.col(column).eqNullSafe(F.lit(value)))
        part = part.select(F.lit(name).alias("module"), F.col("node").alias("source"))
        chosen = part if chosen is None else chosen.union(part)
    near = closest_metric(edges, chosen.select("source").distinct(), metric.select("node").distinct())
    return chosen.join(near.select("source", "target"), "source").join(metric.select(F.col("node").alias("target"), "value"), "target").select("module", "source", "target", "value")


def last_evaluation(edges: DataFrame, finals: DataFrame, metric_nodes: DataFrame) -> DataFrame:
    """From final modules back to the metric modules."""
    return search(edges, finals, metric_nodes, forward=False)


def root_and_final(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """root: part of the relation and nobody's successor; final: part of it and nobody's predecessor."""
    has = lambda c, name: edges.select(F.col(c).alias(node)).distinct().withColumn(name, F.lit(True))
    t = nodes.join(has("predecessor", "_p"), node, "left").join(has("successor", "_s"), node, "left")
    p, s = F.coalesce("_p", F.lit(False)), F.coalesce("_s", F.lit(False))
    return t.select(node, (p & ~s).alias("root"), (s & ~p).alias("final"))


def sequence_edges(steps: DataFrame) -> DataFrame:
    """(predecessor, successor) from (sequence, step, start_node, end_node): the ends of a step meet the starts of the next."""
    a = steps.select("sequence", (F.col("step") + 1).alias("step"), F.explode("ends").alias("predecessor"))
    b = steps.select("sequence", "step", F.explode("starts").alias("successor"))
    return a.join(b, ["sequence", "step"]).select("predecessor", "successor").distinct()


def surrogate_ids(new: DataFrame, existing: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """new with ids that go on from the largest existing one, by order.

    Ids come from range-partition offsets, so the rows are never brought into one task.
    """
    parts = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = written(parts)
    low = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = existing.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("_max"))
    low = low.select("_p", "_first", before.alias("_before")).join(F.broadcast(start), F.lit(True))
    out = parts.join(F.broadcast(low), "_p")  # one row per partition
    return out.withColumn(id_col, F.col("_max") + 1 + F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before", "_max")


def get_or_create(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Experiments (id, name, seed) with the wanted (name, seed) added where absent (null seeds match); duplicates are an error."""
    double = existing.groupBy("name", "seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not double.isEmpty():
        raise ValueError("experiments are not unique")
    same = (F.col("w.name") == F.col("e.name")) & F.col("w.seed").eqNullSafe(F.col("e.seed"))
    fresh = wanted.distinct().alias("w").join(existing.alias("e"), same, "left_anti")
    return existing.unionByName(surrogate_ids(fresh, existing, "id", ["name", "seed"]).select(existing.columns))


def artifact_ids(artifacts: DataFrame) -> DataFrame:
    """Name -> id; the last one with a name wins."""
    return artifacts.groupBy("f_name").agg(F.max("id").alias("id"))
