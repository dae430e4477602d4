"""Queries over stored runs and metric rows: joins, averaging, pivots, reports, best configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- joins


def equi_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Join on left column -> right column; the right keys are dropped."""
    renamed = right.withColumnsRenamed({r: f"_r_{i}" for i, r in enumerate(on.values())})
    cond = reduce(lambda a, b: a & b, [left[a] == renamed[f"_r_{i}"] for i, a in enumerate(on)])
    return left.join(renamed, cond, how).drop(*[f"_r_{i}" for i in range(len(on))])


def join_metric(df: DataFrame, metric: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Inner join on those keys that both sides have; null keys match each other."""
    on = [k for k in keys if k in df.columns and k in metric.columns]
    right = metric.select(*[F.col(k).alias(f"_k_{k}") for k in on], *values)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on])
    return df.join(right, cond).drop(*[f"_k_{k}" for k in on])


def outer_coalesce(left: DataFrame, right: DataFrame, on: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Full outer join; shared columns take the left value, else the right one."""
    r = right.withColumnsRenamed({c: f"_y_{c}" for c in shared})
    out = left.join(r, list(on), "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_y_{c}")) for c in shared}).drop(*[f"_y_{c}" for c in shared])


def class_columns(metric: DataFrame, keys: Sequence[str], cls: str = "class", value: str = "value", classes: Sequence = (0, 1)) -> DataFrame:
    """Rows of classes side by side: value_<class>."""
    per = [F.max(F.when(F.col(cls) == c, F.col(value))).alias(f"{value}_{c}") for c in classes]
    return metric.groupBy(*keys).agg(*per)


def batch_columns(metrics: Mapping[int, DataFrame], on: Sequence[str], value: str = "value") -> DataFrame:
    """One column per batch size, by one union and one pivot instead of a tree of joins."""
    every = reduce(lambda a, b: a.unionByName(b), [m.select(*on, value, F.lit(size).alias("_size")) for size, m in metrics.items()])
    per = [F.max(F.when(F.col("_size") == s, F.col(value))).alias(f"{value}_{s}") for s in metrics]
    full = reduce(lambda a, b: a & b, [F.col(f"{value}_{s}").isNotNull() for s in metrics])
    return every.groupBy(*on).agg(*per).where(full)


def with_members(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def without_members(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def by_type(df: DataFrame, tables: Mapping[str, DataFrame], type_col: str, id_col: str) -> DataFrame:
    """Rows joined with the table that their type names; columns that a type lacks are null."""
    tagged = [t.withColumn(type_col, F.lit(name)) for name, t in tables.items()]
    return df.join(union_all(tagged), [type_col, id_col], "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, or that occur more than once: empty if a checked 1:1 merge is possible."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = side(left, "n_left").join(side(right, "n_right"), list(keys), "full").fillna(0, ["n_left", "n_right"])
    return both.where("n_left <> 1 or n_right <> 1")


def match_runs(trials: DataFrame, runs: DataFrame, group: str, trial_config: str = "config", run_config: str = "config") -> DataFrame:
    """(trial, run): a run whose config contains the trial's, in the same group; the lowest run wins, and a run serves
    one trial (the lowest).  Configs are maps; the trial's first entry is part of the join key, so only plausible pairs meet."""
    t = trials.select(F.col(group), F.col("trial"), F.col(trial_config).alias("_t"))
    t = t.withColumn("_e", F.element_at(F.array_sort(F.map_entries("_t")), 1))
    t = t.select(group, "trial", "_t", F.col("_e.key").alias("_key"), F.col("_e.value").alias("_value"))
    r = runs.select(F.col(group), F.col("run"), F.col(run_config).alias("_r"), F.explode(run_config).alias("_key", "_value"))
    pairs = t.join(r, [group, "_key", "_value"])
    pairs = pairs.where(F.forall(F.map_entries("_t"), lambda e: F.try_element_at("_r", e["key"]).eqNullSafe(e["value"])))
    first = pairs.groupBy(group, "trial").agg(F.min("run").alias("run"))
    return first.groupBy(group, "run").agg(F.min("trial").alias("trial")).select(group, "trial", "run")


def matching_run(runs: DataFrame, wanted: Mapping[str, str], ignore_source: Sequence[str] = (), ignore_target: Sequence[str] = (), oldest: bool = True) -> DataFrame:
    """The completed run whose config equals the wanted one, after leaving keys out on either side; the oldest by default."""
    rest = {k: v for k, v in wanted.items() if k not in ignore_target}
    config = F.map_filter("config", lambda k, v: ~k.isin(*ignore_source)) if ignore_source else F.col("config")
    equal = F.size(config) == len(rest)
    for k, v in rest.items():
        equal = equal & (F.try_element_at(config, F.lit(k)) == v)
    hits = runs.where((F.col("status") == "COMPLETED") & equal)
    return hits.agg((F.min if oldest else F.max)("folder").alias("folder"))


# ---------------------------------------------------------------- averaging and reports


def seed_averages(df: DataFrame, keys: Sequence[str], seed: str = "seed", value: str = "value", over_seeds: bool = True, digits: int = 5) -> DataFrame:
    """Mean and sample deviation over data points per (keys, seed), then over seeds; a deviation of 0 is null."""
    std = lambda c: F.nullif(F.stddev_samp(c), F.lit(0.0))
    first = df.groupBy(*keys, seed).agg(F.avg(value).alias("mean"), std(value).alias("std"))
    if not over_seeds:
        return first.select(*keys, seed, F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"))
    second = first.groupBy(*keys).agg(F.avg("mean").alias("m"), F.avg("std").alias("s"), std("mean").alias("ms"), std("std").alias("ss"))
    return second.select(*keys, *[F.round(c, digits).alias(n) for c, n in (("m", "mean"), ("s", "std"), ("ms", "mean_std"), ("ss", "std_std"))])


def metric_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Averages of two metrics per configuration, side by side: one union, one aggregation."""
    both = a.select(*keys, F.lit(0).alias("_m"), value).unionByName(b.select(*keys, F.lit(1).alias("_m"), value))
    per = [F.avg(F.when(F.col("_m") == i, F.col(value))).alias(n) for i, n in enumerate(names)]
    out = both.groupBy(*keys).agg(*per)
    return out.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def box_summary(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """min, q1, median, q3, max and mean per key; largest maximum first, then largest mean."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    g = df.groupBy(key).agg(F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    g = g.select(key, "low", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high", "mean")
    return g.orderBy(F.desc("high"), F.desc("mean"), key)


def metric_histogram(df: DataFrame, value: str = "value", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, centre, n) on a fixed range; the number of bins is the larger of Sturges' and Freedman-Diaconis' rule."""
    x = df.where(F.col(value).between(low, high))
    s = x.agg(F.count(F.lit(1)).alias("n"), F.percentile(value, 0.25).alias("a"), F.percentile(value, 0.75).alias("b"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    bins = auto_bins(s["n"], s["a"] or 0.0, s["b"] or 0.0, high - low)
    place = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (low + (F.col("bin") + 0.5) * (high - low) / bins).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def auto_bins(n: int, q1: float, q3: float, span: float) -> int:
    import math

    if not n:
        return 1
    sturges = math.ceil(math.log2(n) + 1)
    width = 2 * (q3 - q1) / n ** (1 / 3)
    return max(sturges, math.ceil(span / width) if width > 0 else 1)


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    q = lambda p: F.percentile(value, p)
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("max"))


def log_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares y = slope ln x + intercept per key, over positive x."""
    t = df.where(F.col(x) > 0).withColumn("_lx", F.log(x))
    return t.groupBy(*keys).agg(F.regr_slope(y, "_lx").alias("slope"), F.regr_intercept(y, "_lx").alias("intercept"), F.count(F.lit(1)).alias("n"))


def ridge_fit(df: DataFrame, x: str, y: str, ridge: float = 1.0, folds: int = 5) -> dict:
    """Ridge regression on standardised x of y and of ln y; the form with the lower cross-validated error is taken."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna())
    rows = StandardScaler(inputCol="_v", outputCol="_f", withMean=True).fit(rows).transform(rows)
    best = None
    for log in (False, True):
        part = rows.where("_y > 0").withColumn("label", F.log("_y")) if log else rows.withColumn("label", F.col("_y"))
        cv = CrossValidator(estimator=LinearRegression(featuresCol="_f", regParam=ridge), estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(metricName="r2"), numFolds=folds, seed=1)
        model = cv.fit(part)
        if best is None or model.avgMetrics[0] > best["r2"]:
            best = {"log": log, "r2": model.avgMetrics[0], "slope": float(model.bestModel.coefficients[0]), "intercept": model.bestModel.intercept}
    return best


#: Exponents of ten of the penalties that are tried.
RIDGE_EXPONENTS = (5.0, 3.0, 40)


def ridge_choice(df: DataFrame, keys: Sequence[str], x: str, y: str, fold: Column, folds: int = 5, exponents: tuple[float, float, int] = RIDGE_EXPONENTS) -> DataFrame:
    """Per key: a ridge line of y, or of ln y, on x, whichever predicts left-out rows better: log, alpha, score, slope, intercept, n.

    x and the response are standardised; score is minus the mean squared error of the rows of every fold under the line of all
    others; penalties run over 10 ** exponents (first, last, how many).  slope and intercept are in the units of x and y (or ln y).  Every fold's
    moments are summed once, and the others' are the total minus them, so the folds and penalties cost no further pass.

    Rows where x or y is null or not finite are left out, for ln y also those with y <= 0.  Ties go to y, then to the larger penalty.
    """
    first, last, many = exponents
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.pmod(fold, F.lit(folds)).alias("_f")).where(fine("_x") & fine("_y"))
    forms = F.explode(F.array(F.struct(F.lit(False).alias("log"), F.col("_y").alias("y")), F.struct((F.col("_y") > 0).alias("log"), F.when(F.col("_y") > 0, F.log("_y")).alias("y"))))
    rows = rows.select(*keys, "_x", "_f", forms.alias("_t")).where("_t.y is not null").select(*keys, "_x", "_f", F.col("_t.log").alias("log"), F.col("_t.y").alias("_y"))
    parts = {"n": F.lit(1.0), "sx": F.col("_x"), "sy": F.col("_y"), "sxx": F.col("_x") * F.col("_x"), "sxy": F.col("_x") * F.col("_y"), "syy": F.col("_y") * F.col("_y")}
    sums = rows.groupBy(*keys, "log", "_f").agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    whole = Window.partitionBy(*keys, "log")
    sums = sums.withColumns({f"t_{k}": F.sum(k).over(whole) for k in parts})
    mean = {v: F.col(f"t_s{v}") / F.col("t_n") for v in "xy"}
    sd = {v: F.sqrt(F.greatest(F.col(f"t_s{v}{v}") / F.col("t_n") - mean[v] * mean[v], F.lit(0.0))) for v in "xy"}
    sums = sums.withColumns({"mx": mean["x"], "my": mean["y"], "dx": F.when(sd["x"] > 0, sd["x"]).otherwise(1.0), "dy": F.when(sd["y"] > 0, sd["y"]).otherwise(1.0)})

    def standard(pre: str) -> dict[str, Column]:
        """The moments of the standardised variables from those of the plain ones."""
        n, sx, sy, sxx, sxy, syy = (F.col(f"{pre}{k}") for k in parts)
        mx, my, dx, dy = (F.col(c) for c in ("mx", "my", "dx", "dy"))
        return {
            "n": n, "sx": (sx - n * mx) / dx, "sy": (sy - n * my) / dy, "sxx": (sxx - 2 * mx * sx + n * mx * mx) / (dx * dx),
            "sxy": (sxy - mx * sy - my * sx + n * mx * my) / (dx * dy), "syy": (syy - 2 * my * sy + n * my * my) / (dy * dy),
        }

    own, total = standard(""), standard("t_")
    sums = sums.select(*keys, "log", "t_n", "mx", "my", "dx", "dy", F.struct(*[v.alias(k) for k, v in own.items()]).alias("o"), F.struct(*[v.alias(k) for k, v in total.items()]).alias("t"))
    steps = F.array(*[F.lit(float(10 ** (first + (last - first) * i / max(many - 1, 1)))) for i in range(many)])

    def line(m: dict[str, Column], alpha: Column) -> tuple[Column, Column]:
        slope = (m["sxy"] - m["sx"] * m["sy"] / m["n"]) / (m["sxx"] - m["sx"] * m["sx"] / m["n"] + alpha)
        return slope, (m["sy"] - slope * m["sx"]) / m["n"]

    o = {k: F.col(f"o.{k}") for k in parts}
    rest = {k: F.col(f"t.{k}") - o[k] for k in parts}
    tried = sums.withColumn("alpha", F.explode(steps)).where(rest["n"] > 0)
    b, a = line(rest, F.col("alpha"))
    error = o["syy"] - 2 * a * o["sy"] - 2 * b * o["sxy"] + o["n"] * a * a + 2 * a * b * o["sx"] + b * b * o["sxx"]
    once = lambda c: F.first(c).alias(c)
    scored = tried.groupBy(*keys, "log", "alpha").agg((-F.sum(error) / F.sum(o["n"])).alias("score"), *map(once, ("t_n", "mx", "my", "dx", "dy", "t")))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("log", "alpha", "score", "t_n", "mx", "my", "dx", "dy", "t"), F.struct(F.round("score", 9), ~F.col("log"), F.col("alpha"))).alias("b")).select(*keys, "b.*")
    b, a = line({k: F.col(f"t.{k}") for k in parts}, F.col("alpha"))
    slope = b * F.col("dy") / F.col("dx")
    return best.select(*keys, "log", "alpha", "score", slope.alias("slope"), (F.col("my") + a * F.col("dy") - slope * F.col("mx")).alias("intercept"), F.col("t_n").cast("long").alias("n"))


def best_configurations(df: DataFrame, metrics: Sequence[str], key: Sequence[str], bucket: Column | None = None, k: int = 5) -> DataFrame:
    """The k best rows of each bucket by the metrics, descending, nulls last, then by key."""
    order = [*[F.desc_nulls_last(m) for m in metrics], *key]
    if bucket is None:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy("bucket").orderBy(*order)
    return df.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_single(df: DataFrame, value: str) -> DataFrame:
    """The one row with the largest value (ties: smallest other columns)."""
    return df.orderBy(F.desc_nulls_last(value), *[c for c in df.columns if c != value]).limit(1)


def groups_by_maximum(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    g = df.groupBy(key).agg(F.max(value).alias("high"), F.avg(value).alias("mean"))
    return g.orderBy(F.desc("high"), F.desc("mean"), key)


def region_table(metrics: DataFrame, labels: DataFrame, module: str = "module", data: str = "data_id", step: str = "step_id") -> DataFrame:
    """Region metrics with the label counts of the same module, data and step."""
    return metrics.join(labels, list(dict.fromkeys([module, data, step])))


def key_sets(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    return {"both": a.intersect(b), "only_left": a.subtract(b), "either": a.union(b).distinct()}
