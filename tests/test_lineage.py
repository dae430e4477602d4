"""Reachability over graphs in which paths meet, repeat and run in cycles, against brute force."""

import random
from collections import Counter

import pytest

from pixelgrove.operators import lineage


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "predecessor long, successor long").repartition(2)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def brute(pairs, start, target, stop=(), end_at_match=True):
    out, frontier, depth = Counter(), Counter((s, s) for s in start), 0
    while frontier:
        ahead = Counter()
        for (s, at), n in frontier.items():
            if at in target:
                out[s, at, depth] += n
            if at in stop or at in target and end_at_match:
                continue
            for a, b in pairs:
                if a == at:
                    ahead[s, b] += n
        frontier, depth = ahead, depth + 1
    return out


def diamonds(n):
    """n diamonds in a row: node 3k leads to 3k + 1 and 3k + 2, and both to 3k + 3."""
    return [x for k in range(n) for x in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]


@pytest.mark.parametrize("seed, end, stop", [(1, True, ()), (2, False, ()), (3, True, (4, 9)), (4, False, (5,))])
def test_paths_of_random_graphs(spark, seed, end, stop):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.25]
    pairs += pairs[:3]  # an edge given twice is two paths
    start, target = [0, 1, 2, 2, 5], {3, 5, 8, 11, 13}
    want = brute(pairs, start, target, stop, end)
    args = (edges_of(spark, pairs), ids(spark, *start), ids(spark, *target), ids(spark, *stop) if stop else None)
    counted = lineage.path_counts(*args, end_at_match=end).collect()
    assert {(r.source, r.target, r.depth): int(r.paths) for r in counted} == dict(want)
    assert Counter(tuple(r) for r in lineage.search(*args, end_at_match=end).collect()) == want
    back = lineage.path_counts(edges_of(spark, [(b, a) for a, b in pairs]), *args[1:], forward=False, end_at_match=end).collect()
    assert sorted(back) == sorted(counted)


@pytest.mark.parametrize("seed", [5, 6])
def test_nearest(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(40)]  # with cycles and loops
    target, want = {3, 7, 12}, set()
    for s in range(20):
        seen, level, depth = {s}, {s}, 0
        while level and not level & target:
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            depth += 1
        want |= {(s, t, depth) for t in level & target}
    got = [tuple(r) for r in lineage.closest_metric(edges_of(spark, pairs), ids(spark, *range(20)), ids(spark, *target)).collect()]
    assert sorted(got) == sorted(want)


def test_many_diamonds(spark):
    """Thirty diamonds are 2 ** 30 paths: counted and searched without listing them."""
    pairs = edges_of(spark, diamonds(30))
    near = lineage.nearest(pairs, ids(spark, 0), ids(spark, 90)).collect()
    assert [tuple(r) for r in near] == [(0, 90, 60)]
    counted = lineage.path_counts(pairs, ids(spark, 0), ids(spark, 90)).collect()
    assert [(r.source, r.target, r.depth, int(r.paths)) for r in counted] == [(0, 90, 60, 2**30)]
    few = lineage.search(edges_of(spark, diamonds(11)), ids(spark, 0), ids(spark, 33))
    assert few.count() == 2**11 and few.distinct().count() == 1


def test_cycles_are_errors(spark):
    for pairs in ([(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 1)], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 2), (4, 9)]):
        with pytest.raises(ValueError, match="cycle"):
            lineage.path_counts(edges_of(spark, pairs), ids(spark, 0), ids(spark, 9)).collect()
        assert lineage.nearest(edges_of(spark, pairs), ids(spark, 0), ids(spark, 77)).count() == 0
    assert lineage.path_counts(edges_of(spark, [(0, 1), (1, 0)]), ids(spark, 0), ids(spark, 1)).count() == 1  # ends at its match


def test_shuffled_when_the_edges_are_many(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 2)
    pairs = diamonds(3)
    assert lineage.path_counts(edges_of(spark, pairs), ids(spark, 0), ids(spark, 9)).first().paths == 8


def test_empty(spark):
    none = edges_of(spark, [])
    assert lineage.search(none, ids(spark, 1), ids(spark, 1)).count() == 1
    assert lineage.search(none, ids(spark), ids(spark, 1)).count() == 0
    assert lineage.nearest(none, ids(spark, 1), ids(spark, 2)).count() == 0


def test_recursive_closure_broadcasts_nothing(spark):
    edges = spark.createDataFrame([(k // 2, k) for k in range(1, 32)], "predecessor long, successor long")
    walk = lineage.closure_sql(spark, edges, spark.createDataFrame([(1,)], "id long"))
    assert "strategy=merge" in walk._jdf.queryExecution().optimizedPlan().toString()
    assert walk.count() == 31
