"""Functions that a user supplies: a property of zones with partial results that merge, and a function of whole items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import surrogate_ids, written

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def zonal_property(df: DataFrame, keys: Sequence[str], zone: str, bands: Sequence[str], state: Callable[[np.ndarray], Sequence[float]], merge: Sequence[str], finish: Callable[[Sequence[Column]], Column], name: str) -> DataFrame:
    """(keys, zone, <band>-<name>) of a property of the values of every zone.

    state turns some of a zone's values of one band (without null and NaN) into numbers, merge says how each of them is combined with those of
    the zone's other values (sum, min or max), finish makes the property of the combined ones (null where a zone has no value).  state
    sees a zone's part of an Arrow batch, so nothing is shuffled but states, and a zone of any size is no task of its own.
    """
    if unknown := set(merge) - set(_MERGE):
        raise ValueError(f"states are merged by sum, min or max, not {sorted(unknown)}")
    by, many = [*keys, zone], len(merge)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            order = table.select(by).append_column("_i", pa.array(np.arange(batch.num_rows))).sort_by([(c, "ascending") for c in by])
            at = order.column("_i").to_numpy()
            zones = [order.column(c).combine_chunks().dictionary_encode("encode") for c in by]
            codes = [(z.chunk(0) if isinstance(z, pa.ChunkedArray) else z).indices.to_numpy(zero_copy_only=False) for z in zones]
            new = np.zeros(len(at), bool)
            new[0] = True
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            start = np.flatnonzero(new)
            values = [table.column(b).to_numpy()[at] for b in bands]
            states = []
            for a, e in zip(start.tolist(), [*start[1:].tolist(), len(at)]):
                row = []
                for v in values:
                    some = v[a:e][~np.isnan(v[a:e])]
                    row += [float(x) for x in state(some)] if len(some) else [None] * many
                states.append(row)
            columns = [order.column(c).take(pa.array(start)).combine_chunks() for c in by]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[i] for r in states], pa.float64()) for i in range(many * len(bands))]], [*by, *[f"_s{i}" for i in range(many * len(bands))]])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"_s{i} double" for i in range(many * len(bands)))])
    rows = df.select(*by, *[F.col(b).cast("double").alias(b) for b in bands]).mapInArrow(partial, schema)
    merged = rows.groupBy(*by).agg(*[_MERGE[how](f"_s{b * many + i}").alias(f"_s{b * many + i}") for b in range(len(bands)) for i, how in enumerate(merge)])
    return merged.select(*by, *[finish([F.col(f"_s{k * many + i}") for i in range(many)]).alias(f"{b}-{name}") for k, b in enumerate(bands)])


def per_item(df: DataFrame, keys: Sequence[str], function: Callable[[pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """function(item, index) of every item (the rows of equal keys); index counts the items from 0 on in the order of their keys.

    A task holds one item at a time.
    """
    none = df.sparkSession.createDataFrame([], "_index long")
    index = written(surrogate_ids(df.select(*keys).distinct(), none, "_index", list(keys)))
    index = index.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    rows = df.join(index, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]).drop(*[f"_k_{i}" for i in range(len(keys))])

    def run(table: pa.Table) -> pa.Table:
        return function(table.drop_columns(["_index"]), table.column("_index")[0].as_py())

    return rows.groupBy("_index").applyInArrow(run, schema)
