"""The trie of conversation prefixes against dictionaries of tuples."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from pixelgrove.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, base int, token string, turns string, t int, n_ends int, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, "z") for r in rows], SCHEMA).repartition(3)


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
    return out


def brute(rows):
    members, ends = defaultdict(set), defaultdict(list)
    for c, t in sequences(rows).items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
        ends[tuple(t)].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = below[node]
        leaves[node] = sum(leaves[x] for x in own) if own else 1
        saved[node] = sum(saved[x] for x in own) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(below[x]), leaves[x], saved[x], sha(ends[x]) if x in ends else sha([])) for x, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check(spark, rows):
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(table(spark, rows)).select(*COLUMNS).collect())
    assert got == brute(rows)
    return got


def some(n, seed, alphabet=3, longest=7):
    rng = random.Random(seed)
    texts = ["", "a", "é\U0001f600", "long text " * 20, None, "b", "a\n"][: alphabet + 2]
    rows = []
    for c in rng.sample(range(3 * n), n):
        rows += [(c, k if k else None, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(texts)) for k in range(rng.randrange(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, alphabet", [(1, 1), (2, 1), (60, 1), (400, 3), (400, 5)])
def test_against_tuples(spark, n, alphabet):
    check(spark, some(n, n + alphabet, alphabet))


@pytest.mark.parametrize("shard, cells, least", [(4, 10**6, 3), (50, 60, 3), (9, 10**6, 7), (1, 1, 4)])
def test_nodes_across_shards(spark, monkeypatch, shard, cells, least):
    """Small shards, several rounds: nodes that begin, end and go on at shard limits."""
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "SHARD_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "LEAST_ROWS", least)
    made = prefix_trie._shards
    monkeypatch.setattr(prefix_trie, "_shards", lambda *a: made(*a, shard, cells, least))
    check(spark, some(300, shard, 4))


def test_shards_of_any_order_and_size():
    """Folding all rows as one shard, or in shards of any cuts and rounds, gives the same nodes."""
    rng = random.Random(8)
    for _ in range(60):
        turns = sorted({b"".join(bytes([rng.randrange(2)]) * 19 + bytes([rng.randrange(3)]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 40))})
        ids, n = [rng.randrange(10**6) for _ in turns], [rng.randrange(1, 4) for _ in turns]
        mixed = rng.sample(range(len(turns)), len(turns))
        whole, left = prefix_trie.Shard([turns[i] for i in mixed], None, [ids[i] for i in mixed], [n[i] for i in mixed]).fold(True, True)
        assert left == []
        columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id", "n_ends", "own"]
        want = sorted(zip(*(whole[k] for k in columns)), key=str)
        got, up, rows, plain = [], {}, list(zip(turns, ids, n)), True
        while rows is not None:
            last, cut = len(rows) <= 3 and not plain, []
            while rows:
                k = len(rows) if last else rng.randrange(1, 6)
                part, rows = rows[:k], rows[k:]
                t, *rest = zip(*part)
                shard = prefix_trie.Shard(list(t), None, *map(list, rest)) if plain else prefix_trie.Shard(list(t), [list(x) for x in rest])
                nodes, left = shard.fold(last, True)
                got += zip(*(nodes[k] for k in columns))
                cut += left
            rows, plain = None if last else cut, False
        assert sorted(got, key=str) == want


def test_copies_and_hot_prefixes(spark):
    """A conversation that most ids have, one that all begin with, and one much longer than the rest."""
    rows = [(c, k, "user", f"t{k}") for c in range(0, 600, 5) for k in range(3)]
    rows += [(c, k, "user", f"t{k}" if k < 2 else f"own {c}") for c in range(1, 300, 5) for k in range(4)]
    rows += [(1003, k, "assistant", f"t{k}") for k in range(700)] + [(-7, 1, "a", "x"), (-7, 1, "a", "x"), (-5, 3, None, None)]
    got = check(spark, rows)
    assert max(r[3] for r in got) > 150 and max(r[1] for r in got) > 600


def test_null_ids_and_empty_tables(spark):
    assert check(spark, [(None, 1, "a", "b")]) == []
    assert check(spark, []) == []
    assert len(check(spark, [(None, 1, "a", "b"), (0, 1, "a", "b")])) == 2


def test_lists_of_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_ROWS", 7)
    rows = [(5 * c, 0, "user", "same") for c in range(150)]
    got = check(spark, rows)
    assert sorted(r[1] for r in got) == [0, 1]
