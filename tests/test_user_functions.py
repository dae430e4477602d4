"""Functions of the user: zonal properties from merging states, and functions of whole items."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelgrove.operators import user

ROWS = [(None if c == 2 else c, z, float(v) if v % 11 else None, float("nan") if v % 13 == 0 else -float(v)) for c in range(3) for z in ("a", None, "b") for v in range(1, 60 + 20 * c)]


def zones(spark, n):
    return spark.createDataFrame(ROWS, "chip int, zone string, v double, w double").repartition(n)


@pytest.mark.parametrize("parts", [1, 7])
def test_states_of_any_parts_merge(spark, parts):
    state = lambda x: (len(x), x.sum(), (x * x).sum(), x.min(), x.max())
    finish = lambda s: F.round(s[2] / s[0] - (s[1] / s[0]) ** 2 + s[4] - s[3], 6)
    got = user.zonal_property(zones(spark, parts), ["chip"], "zone", ["v", "w"], state, ["sum", "sum", "sum", "min", "max"], finish, "own")
    want = {}
    for chip, zone, v, w in ROWS:
        own = want.setdefault((chip, zone), ([], []))
        if v is not None:
            own[0].append(v)
        if w == w:
            own[1].append(w)
    assert {(r.chip, r.zone): (r["v-own"], r["w-own"]) for r in got.collect()} == {k: tuple(pytest.approx(np.var(x) + np.ptp(x), abs=1e-5) for x in v) for k, v in want.items()}


def test_zones_without_values_and_wrong_merges(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", float("nan")), (1, "b", 2.0)], "chip int, zone string, v double")
    got = user.zonal_property(df, ["chip"], "zone", ["v"], lambda x: (x.max(),), ["max"], lambda s: s[0], "top")
    assert {(r.zone, r["v-top"]) for r in got.collect()} == {("a", None), ("b", 2.0)}
    assert user.zonal_property(df.limit(0), ["chip"], "zone", ["v"], lambda x: (1,), ["sum"], lambda s: s[0], "n").count() == 0
    with pytest.raises(ValueError):
        user.zonal_property(df, ["chip"], "zone", ["v"], lambda x: (1,), ["mean"], lambda s: s[0], "n")


def test_items_are_counted_in_the_order_of_their_keys(spark):
    def first(item: pa.Table, index: int) -> pa.Table:
        return pa.table({"chip": item.column("chip").slice(0, 1), "zone": item.column("zone").slice(0, 1), "rows": [item.num_rows], "index": [index]})

    got = user.per_item(zones(spark, 5), ["chip", "zone"], first, "chip int, zone string, rows long, index long").collect()
    order = sorted(got, key=lambda r: (r.chip is not None, r.chip or 0, r.zone is not None, r.zone or ""))
    assert [r["index"] for r in order] == list(range(9)) and sum(r.rows for r in got) == len(ROWS)
