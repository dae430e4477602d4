"""The Merkle manifest against a tree built with lists."""

import random
import zlib

import pytest
from brute import sha
from pyspark.sql import functions as F

from pixelgrove.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `group` int, tree string, digest int, path string, place int"


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def tampered(row):
    i, source, lang, n, text = row
    return (i, source, lang, n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n, text)


def brute(rows):
    order = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in order}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, r in enumerate(own[x]):
            now, siblings = leaf(tampered(r)), []
            for tree, j in ((trees[x], i), (top, k)):
                for level in tree[:-1]:
                    other = level[j ^ 1] if j ^ 1 < len(level) else ""
                    now = sha(other + now if j & 1 else now + other)
                    siblings.append(other)
                    j //= 2
            out.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], sha("".join(siblings)), now, now == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA).repartition(3)


def check(spark, rows):
    more = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.try_add("n_chars", F.lit(1).cast("long"))).otherwise(F.col("n_chars"))
    made = merkle.manifest(table(spark, rows), claimed=merkle.leaf_digest(COLUMNS, {"n_chars": more}))
    got = sorted(map(tuple, made.verified().collect()), key=str)
    assert got == brute(rows)
    return made, got


def some(n, seed=1):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.03 else i, rng.choice([None, "", "web"]), rng.choices([None, "", "en", "fr", "é", "z"], [1, 1, 12, 3, 1, 0.1])[0], rng.choice([None, 5, 77]), rng.choice([None, "", f"text {i} é"])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("band, n", [(8, 1), (8, 700), (2, 2), (2, 16), (2, 150), (1, 40)])
def test_against_lists(spark, monkeypatch, band, n):
    monkeypatch.setattr(merkle, "BAND", band)
    made, got = check(spark, some(n))
    if n >= 150:
        assert 0 < sum(not r[-1] for r in got) < len(got)
    assert merkle.BAND == band and len(made.nodes) >= 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9])
def test_sizes_around_powers_of_two(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BAND", 2)
    check(spark, [(i, "s", "en", i, "t") for i in range(n)])


def test_empty_table(spark):
    made = merkle.manifest(table(spark, []))
    assert made.root is None and made.verified().count() == 0


def test_intervals_nest(spark, monkeypatch):
    """Every node's interval is the union of its children's, and the leaves' are single ranks."""
    monkeypatch.setattr(merkle, "BAND", 2)
    made = merkle.manifest(table(spark, [(i, "s", "en", i, "t") for i in range(37)]))
    nodes = [r for x in made.nodes for r in x.collect()]
    leaves = {(0, r.lo): (r.lo, r.lo + 1, r.digest.hex()) for r in made.leaves.collect()}
    known = leaves | {(r.level, r.lo): (r.lo, r.hi, r.digest.hex()) for r in nodes}
    assert sorted(r.lo for r in made.leaves.collect()) == list(range(37))
    for r in nodes:
        own = [known[r.level - 1, r.lo]]
        if (r.level - 1, r.lo + (1 << r.level - 1)) in known:
            own.append(known[r.level - 1, r.lo + (1 << r.level - 1)])
        assert (own[0][0], own[-1][1]) == (r.lo, r.hi) and r.digest.hex() == sha("".join(x[2] for x in own))
    assert max(r.level for r in nodes) == 6 and {(r.lo, r.hi) for r in nodes if r.level == 6} == {(0, 37)}


def test_any_change_is_seen(spark):
    """A claim that differs in any column does not lead to the root; an unchanged one does."""
    rows = [(i, "s", "en" if i % 2 else "fr", i, "t") for i in range(20)]
    for name, value in (("text", F.lit("u")), ("lang", F.lit("de")), ("source", F.lit(None)), ("doc_id", F.col("doc_id") + 1)):
        made = merkle.manifest(table(spark, rows), claimed=F.when(F.col("doc_id") == 7, merkle.leaf_digest(COLUMNS, {name: value})))
        assert {r.doc_id for r in made.verified().where("not verified").collect()} == {7}


def test_fold_needs_the_whole_path():
    assert merkle.fold("", "ab") == ("ab", sha(""))
    assert merkle.fold("03" + "00" * 32, "ab") == ("ab", sha(""))
    assert merkle.fold("02" + "00" * 32, "ab") == (sha("ab"), sha(""))
    assert merkle.fold("01" + "cd" * 32, "ab") == (sha("cd" * 32 + "ab"), sha("cd" * 32))
