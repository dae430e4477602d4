"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from pixelgrove.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    show = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{float(x):.5g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["boxcar", "lee", "filtered_spaces", "median_window", "tiled_threshold"])
@pytest.mark.parametrize("rows", [2, 3])
def test_ragged_last_chip(spark, tmp_path, name, rows):
    """The last chip is lower than the border of 7 x 7: the twins of these filters leave it out, those of the _all queries do not."""
    con, some = duckdb.connect(), f"(SELECT * FROM '{DATA}/embeddings.parquet' WHERE vec_id < {32 + rows} ORDER BY vec_id)"
    con.execute(f"COPY {some} TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    seen = {}
    for n in [name] + [f"{name}_all"] * (f"{name}_all" in registry.queries()):
        got, want = registry.queries()[n](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[n]).df()
        assert canonical(got) == canonical(want)
        seen[n] = set(got["chip"]) if n != "filtered_spaces" else set(got[got["filter"].notna()]["chip"])
    assert f"{name}_all" not in seen or 2 in seen[f"{name}_all"] - seen[name] or name == "filtered_spaces"


def test_majority_window_odd_rows(spark, tmp_path):
    """Missing and repeated rows, a missing key, missing, empty and shorter vectors, null and NaN components."""
    con, width = duckdb.connect(), 12
    vector = f"list_transform(range({width}), lambda i: CASE WHEN (i * 7 + n) % 11 = 0 THEN NULL WHEN (i + n) % 13 = 0 THEN 'nan'::FLOAT ELSE sin(i * i + n * 3)::FLOAT END)"
    odd = "CASE WHEN n = 20 THEN NULL WHEN n = 21 THEN []::FLOAT[] WHEN n % 16 = 9 THEN v[1:5] ELSE v END"
    rows = f"SELECT n AS vec_id, {vector} AS v FROM range(0, 75) t(n) WHERE n NOT BETWEEN 3 AND 8 AND n NOT BETWEEN 30 AND 50"
    rows = f"SELECT vec_id, v, vec_id AS n FROM ({rows}) UNION ALL SELECT 17, {vector}, n FROM range(90, 91) t(n) UNION ALL SELECT NULL, {vector}, n FROM range(91, 92) t(n)"
    con.execute(f"COPY (SELECT vec_id, {odd} AS embedding, 0 AS label FROM ({rows})) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = registry.queries()["majority_window"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["majority_window"]).df()
    assert len(want) > 100 and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["linear_svc", "logistic"])
def test_models_on_odd_vectors(spark, tmp_path, name):
    """Missing, short, NaN and infinite vectors are neither trained on nor predicted; the other rows are as without them."""
    con, all_rows = duckdb.connect(), f"'{DATA}/embeddings.parquet'"
    odd = "CASE vec_id WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 8 THEN ['nan'::FLOAT FOR x IN embedding] WHEN 9 THEN ['nan'::FLOAT FOR x IN embedding] WHEN 12 THEN embedding[1:3] WHEN 13 THEN embedding[1:3] WHEN 16 THEN ['inf'::FLOAT FOR x IN embedding] WHEN 17 THEN ['-inf'::FLOAT FOR x IN embedding] ELSE embedding END"
    bad = {4, 5, 8, 9, 12, 13, 16, 17}
    rows = {}
    for part, query in (("odd", f"SELECT vec_id, {odd} AS embedding, label FROM {all_rows}"), ("plain", f"SELECT * FROM {all_rows} WHERE vec_id NOT IN {tuple(sorted(bad))}")):
        (tmp_path / part).mkdir()
        con.execute(f"COPY ({query} ORDER BY vec_id) TO '{tmp_path}/{part}/embeddings.parquet' (FORMAT parquet)")
        rows[part] = {r.id: (r.label, r.prediction) for r in registry.queries()[name](spark, f"{tmp_path}/{part}").collect()}
    assert len(rows["odd"]) == con.execute(f"SELECT count(*) FROM {all_rows}").fetchone()[0]
    assert {i for i, (_, prediction) in rows["odd"].items() if prediction is None} == bad
    assert {i: r for i, r in rows["odd"].items() if i not in bad} == rows["plain"]


def test_logistic_is_the_optimum(spark):
    """Newton steps on the same weighted likelihood; rows within a thin margin of the boundary may go either way."""
    rows = duckdb.sql(f"SELECT vec_id, label % 2 AS y, embedding[1:4]::DOUBLE[] AS x FROM '{DATA}/embeddings.parquet'").fetchall()
    ids, y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    train = ids % 4 != 0
    a, t = np.c_[x, np.ones(len(x))][train], y[train]
    w = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    spread = a[:, :4].std(axis=0)
    penalty, beta = 1e-4 * np.r_[spread**2, 0], np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (w * (p - t)) + penalty * beta)
    margin = np.c_[x, np.ones(len(x))] @ beta
    got = {r.id: r.prediction for r in registry.queries()["logistic"](spark, DATA).collect()}
    clear = np.abs(margin) > 1e-3
    assert clear.mean() > 0.98 and set(got) == set(ids.tolist())
    assert all(got[i] == int(m > 0) for i, m in zip(ids[clear].tolist(), margin[clear]))
