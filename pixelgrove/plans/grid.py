"""Conditional parameter grids and sweeps over what is not evaluated yet."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: Mapping[str, Sequence], only_if: Mapping[str, Column] | None = None) -> DataFrame:
    """All combinations, as a table; a parameter is null where its condition (on parameters before it) does not hold.

    A small literal table: its rows are the product of the given values.
    """
    out = spark.range(1).select()
    for name, options in values.items():
        every = F.array(*[F.lit(v) for v in options])
        cond = (only_if or {}).get(name)
        every = every if cond is None else F.when(cond, every).otherwise(F.slice(F.transform(every, lambda x: F.when(F.lit(False), x)), 1, 1))
        out = out.withColumn(name, F.explode(every))
    return out.distinct()


def pending(table: DataFrame, done: DataFrame, state: str = "state", complete: str = "COMPLETE") -> DataFrame:
    """Grid rows without a complete run (null parameters match)."""
    keys = table.columns
    d = done.where(F.col(state) == complete).select(*[F.col(k).alias(f"_d_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_d_{k}"))
    return table.join(d, same, "left_anti")


def sweep(table: DataFrame, done: DataFrame, evaluate: Callable[[dict], float], sink: Callable[[DataFrame], None]) -> int:
    """Evaluates every pending row (each one a distributed job of its own) and appends its result at once."""
    spark, n = table.sparkSession, 0
    for row in pending(table, done).toLocalIterator():
        config = row.asDict()
        value = float(evaluate(config))
        out = spark.createDataFrame([row], table.schema).withColumn("value", F.lit(value)).withColumn("state", F.lit("COMPLETE"))
        sink(out)
        n += 1
    return n
