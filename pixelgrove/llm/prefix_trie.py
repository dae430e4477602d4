"""Trie of conversation prefixes, from padded matrices of turn ids.

A conversation is a row of turn ids; sorted, the conversations below a node of the trie are consecutive rows.  A shard of rows
is a matrix, padded with 0: numpy's lexsort orders it, the columns in which a row differs from the one before, OR-accumulated from the
left, mark where the nodes of every depth start, and reduceat sums each depth over them.

Conversations are dealt by range, so only nodes on the path of a shard's first or last row can go on in another shard.  All
other nodes are whole and final; of each shard two rows are left, its first and last, with the parts of the nodes on their
paths.  These rows are sharded again in the same way, until one shard holds them all: every round leaves two rows of
thousands.  A row with such parts and a plain conversation are the same thing to a shard.

Copies of a conversation become one row with a count before they are dealt.  Texts are hashed where they are read and never
shuffled.  A conversation is one row, of 20 bytes for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sized

#: Bytes of a turn in a row: 16 of a digest of role and text, 4 of the text's size.
TURN = 20
#: Rows of a shard, and cells of its matrix where conversations are long (but never fewer than LEAST_ROWS rows).
SHARD_ROWS, SHARD_CELLS, LEAST_ROWS = 20_000, 1 << 20, 64
#: Rows of a piece of a long list of conversations.
PIECE_ROWS = 10_000

_NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id", "n_ends"]
#: Parts of the nodes on a row's path by depth, how they are summed, and what stands for nothing.
_PARTS = ["counts", "lows", "children", "leaves", "saved", "ends", "end_ids"]
_NONE = np.iinfo(np.int64).max
_SUM = [np.add.reduceat, np.minimum.reduceat, *[np.add.reduceat] * 4, np.minimum.reduceat]
_EMPTY = np.array([0, _NONE, 0, 0, 0, 0, _NONE])
_SCHEMA = ", ".join([*(f"{x} long" for x in _NODE), "own binary, parent binary, turns binary", *(f"{x} array<long>" for x in _PARTS)])


# ---------------------------------------------------------------- conversations


def rebuilt(turns: DataFrame, *, step: int = 5, heads: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of every conversation c: the first h turns of conversation c - c % step, then its own after its first h,
    with h = crc32(c) % heads; turns are TURN bytes each.  heads = 1 leaves all as they are."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    token = F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    conv = F.col(f"`{id_col}`").cast("long")
    rows = turns.select(conv.alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), token.alias("token"), (conv - conv % step).alias("base")).where("conv_id is not null")
    # one shuffle for both: a conversation and its base lie in the same partition
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token"))).alias("t"))
    own = own.select("base", "conv_id", F.unhex(F.array_join(F.col("t.token"), "")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.col("turns"))).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int") * TURN
    full = F.concat(F.coalesce(F.substring(head, F.lit(1), h), F.lit(b"")), F.substring("turns", h + 1, F.length("turns")))
    return own.select("conv_id", full.alias("turns"))


# ---------------------------------------------------------------- a shard


class Shard:
    """Rows of one range: turns and the parts of the nodes on each row's path, as matrices by depth."""

    def __init__(self, turns: list[bytes], parts: list[list[list[int]]] | None = None, end_id: list[int] | None = None, n_ends: list[int] | None = None) -> None:
        """Rows with parts, or conversations: the smallest id that has the turns, and how many have them."""
        size = np.array([len(t) // TURN for t in turns], np.int64)
        n, deep = len(size), int(size.max())
        flat = np.frombuffer(b"".join(turns), np.uint8).reshape(-1, TURN)
        row, column = np.repeat(np.arange(n), size), _counting(size)
        matrix, weight = np.zeros((n, deep), np.int32), np.zeros((n, deep), np.int64)
        matrix[row, column] = _ids(flat)
        weight[row, column] = flat[:, 16:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        order = np.lexsort(matrix.T[::-1]) if deep else np.arange(n)
        self.matrix, self.weight, self.size, self.turns = matrix[order], weight[order], size[order], [turns[i] for i in order.tolist()]
        if parts is None:
            count, low = np.array(n_ends, np.int64)[order], np.array(end_id, np.int64)[order]
            here = self.size[:, None] == np.arange(deep + 1)
            every = lambda x: np.broadcast_to(x, (n, deep + 1))
            nothing = every(np.zeros(1, np.int64))
            self.parts = [every(count[:, None]), every(low[:, None]), nothing, nothing, nothing, np.where(here, count[:, None], 0), np.where(here, low[:, None], _NONE)]
        else:
            row, column = np.repeat(np.arange(n), size + 1), _counting(size + 1)
            self.parts = []
            for values, empty in zip(parts, _EMPTY):
                full = np.full((n, deep + 1), empty, np.int64)
                full[row, column] = np.concatenate([np.asarray(x, np.int64) for x in values])
                self.parts.append(full[order])

    def name(self, row: int, depth: int) -> bytes:
        """A name of the node at depth above a row, the same in every shard."""
        return hashlib.blake2b(self.turns[row][: depth * TURN] + depth.to_bytes(8, "big"), digest_size=16).digest()

    def fold(self, last: bool, named: bool) -> tuple[dict[str, list], list[tuple]]:
        """The columns of the nodes that are final here, and the rows left of the first and last row's paths (none in the last shard).
        named: give every node its name, since nodes of earlier shards may have it as their parent."""
        n, deep = self.matrix.shape
        differs = np.ones((n, deep), bool)
        differs[1:] = self.matrix[1:] != self.matrix[:-1]
        starts = np.logical_or.accumulate(differs, axis=1)
        out: dict[str, list] = {k: [] for k in [*_NODE, "own", "parent"]}
        paths = np.repeat(_EMPTY[:, None, None], 2, 1).repeat(deep + 1, 2)  # parts of the first and the last row's nodes
        below: tuple | None = None  # starts, final ones and values of the nodes one deeper
        for depth in range(deep, -1, -1):
            start = np.flatnonzero(starts[:, depth - 1]) if depth else np.zeros(1, np.int64)
            values = [add(p[:, depth], start) for add, p in zip(_SUM, self.parts)]
            node = self.size[start] >= depth
            final = node.copy()
            if not last:
                final[[0, -1]] = False
            if below is not None:
                at, done, (_, _, _, leaves, saved, *_) = below
                up = np.searchsorted(start, at[done], "right") - 1
                np.add.at(values[2], up, 1)
                np.add.at(values[3], up, leaves[done])
                np.add.at(values[4], up, saved[done])
                self._emit(out, below, depth + 1, named)
                out["parent_conv_id"] += [i if f else None for i, f in zip(values[1][up].tolist(), final[up].tolist())]
                out["parent"] += [None if f else self.name(i, depth) for i, f in zip(start[up].tolist(), final[up].tolist())]
            values[3][final & (values[2] == 0)] = 1
            if depth:
                values[4] += np.where(final, (values[0] - 1) * self.weight[start, depth - 1], 0)
            for side, k in enumerate((0, -1)):
                if node[k]:
                    paths[:, side, depth] = [v[k] for v in values]
            below = start, np.flatnonzero(final), values
        if not last:
            return out, self._left(paths)
        self._emit(out, below, 0, named)
        out["parent_conv_id"].append(None)
        out["parent"].append(None)
        return out, []

    def _emit(self, out: dict[str, list], nodes: tuple, depth: int, named: bool) -> None:
        start, done, values = nodes
        count, low, children, leaves, saved, ends, end_id = (v[done].tolist() for v in values)
        out["depth"] += [depth] * len(done)
        for k, v in (("conv_id", low), ("n_convs", count), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved), ("n_ends", ends)):
            out[k] += v
        out["end_id"] += [i if n else None for i, n in zip(end_id, ends)]
        out["own"] += [self.name(i, depth) if named else None for i in start[done].tolist()]

    def _left(self, paths: np.ndarray) -> list[tuple]:
        n = len(self.size)
        if n > 1:  # nodes on both paths go with the first row
            shared = int(min(self.size[0], self.size[-1]))
            differ = np.flatnonzero(self.matrix[0, :shared] != self.matrix[-1, :shared])
            paths[:, 1, : (int(differ[0]) if len(differ) else shared) + 1] = _EMPTY[:, None]
        sides = [(0, 0), (n - 1, 1)][: min(n, 2)]
        return [(self.turns[i], *(p[side, : self.size[i] + 1].tolist() for p in paths)) for i, side in sides]


def _ids(flat: np.ndarray) -> np.ndarray:
    """Numbers of rows of TURN bytes, from 1 on in the order of the bytes; 0 is left for no turn."""
    keys = [np.ascontiguousarray(flat[:, a:b]).view(t).ravel() for a, b, t in ((16, 20, ">u4"), (8, 16, ">u8"), (0, 8, ">u8"))]
    order = np.lexsort(keys)
    new = np.zeros(len(flat), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(flat), np.int32)
    out[order] = np.cumsum(new) + 1
    return out


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batch(nodes: dict[str, list], left: list[tuple]) -> pa.RecordBatch:
    n, m = len(nodes["depth"]), len(left)
    rows = list(zip(*left)) if left else [()] * (1 + len(_PARTS))
    arrays = [pa.array([*nodes[k], *([None] * m)], pa.int64()) for k in _NODE] + [pa.array([*nodes[k], *([None] * m)], pa.binary()) for k in ("own", "parent")]
    arrays += [pa.array([*([None] * n), *rows[0]], pa.binary())] + [pa.array([*([None] * n), *x], pa.list_(pa.int64())) for x in rows[1:]]
    return pa.RecordBatch.from_arrays(arrays, [*_NODE, "own", "parent", "turns", *_PARTS])


def _shards(last: bool, named: bool, most_rows: int = SHARD_ROWS, cells: int = SHARD_CELLS, least: int = LEAST_ROWS):
    """Folds the sorted rows of a partition, shard by shard; all of them as one if it is the last."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        turns, *rest = zip(*rows)
        shard = Shard(list(turns), [list(x) for x in rest]) if named else Shard(list(turns), None, *map(list, rest))
        return _batch(*shard.fold(last, named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        longest = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                wide = max(longest, len(row[0]) // TURN + 1)
                if not last and len(held) >= least and (len(held) >= most_rows or (len(held) + 1) * wide > cells):
                    yield made(held)
                    held, wide = [], len(row[0]) // TURN + 1
                held.append(row)
                longest = wide
        if held:
            yield made(held)

    return run


# ---------------------------------------------------------------- the trie


def _digests(ends: DataFrame) -> DataFrame:
    """(end_id, sha): SHA-256 (hex) of the ascending, comma-joined conv_ids of every end_id.

    A hash is one chain, so a list goes through one task, but as a stream of sorted pieces: no list is held whole.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE_ROWS):
                end, conv = (c.to_numpy() for c in batch.slice(k, PIECE_ROWS).columns)
                cut = np.flatnonzero(np.diff(end, prepend=~end[0])).tolist()
                rows = [(int(end[a]), int(conv[a]), ",".join(map(str, conv[a:b].tolist()))) for a, b in zip(cut, [*cut[1:], len(end)])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["end_id", "first", "piece"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tool = None, None
        for batch in batches:
            done = []
            for end, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if end == now:
                    tool.update(b"," + piece.encode())
                    continue
                if tool is not None:
                    done.append((now, tool.hexdigest()))
                now, tool = end, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["end_id", "sha"])
        if tool is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([tool.hexdigest()])], ["end_id", "sha"])

    line = ends.repartitionByRange("end_id", "conv_id").sortWithinPartitions("end_id", "conv_id")
    cut = line.select("end_id", "conv_id").mapInArrow(pieces, "end_id long, first long, piece string")
    return cut.repartition("end_id").sortWithinPartitions("end_id", "first").mapInArrow(chain, "end_id long, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefixes of conversations (conv_id, turns of TURN bytes each; ids do not repeat): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (over the node's subtree, each node's further members times its last text's bytes) and
    ends_sha256 (of the members that end there)."""
    conversations = materialise(conversations, "conversations")
    rows = materialise(conversations.groupBy("turns").agg(F.min("conv_id").alias("end_id"), F.count(F.lit(1)).alias("n_ends")), "rows")
    left = rows.select("turns", "end_id", "n_ends")
    last = named = False
    nodes = []
    while not last:
        if named:
            n, longest = left.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("turns")), F.lit(0))).first()
            last = n <= LEAST_ROWS or n <= SHARD_ROWS and n * (longest // TURN + 1) <= SHARD_CELLS
            # few rows go through one task, in shards of bounded size; of more, partitions hold some thousands each
            left = left.coalesce(1) if last or n <= SHARD_ROWS else left.repartitionByRange(max(2, n // 2000), "turns")
        else:
            left = left.repartitionByRange("turns")
        made = materialise(left.sortWithinPartitions("turns").mapInArrow(_shards(last, named), _SCHEMA), "shards")
        nodes.append(made.where("turns is null").select(*_NODE, "own", "parent"))
        left, named = made.where("turns is not null").select("turns", *_PARTS), True
    # nodes of a shard below a node that went on elsewhere: there are as many of those as shards have paths
    found = reduce(DataFrame.unionByName, nodes)
    upper = materialise(found.where("own is not null").select(F.col("own").alias("parent"), F.col("conv_id").alias("its")), "upper")
    found = found.drop("own")
    open_ones = found.where("parent is not null").join(sized(upper), "parent").withColumn("parent_conv_id", F.col("its")).drop("its")
    found = found.where("parent is null").unionByName(open_ones)
    ends = rows.where("n_ends > 1").select("turns", "end_id")
    ends = materialise(conversations.join(sized(ends), "turns").select("end_id", "conv_id"), "ends")
    digests = materialise(_digests(ends), "digests")
    out = found.join(sized(digests.withColumnRenamed("end_id", "its_end")), (F.col("end_id") == F.col("its_end")) & (F.col("n_ends") > 1), "left")
    sha = F.when(F.col("n_ends") > 1, F.col("sha")).otherwise(F.sha2(F.when(F.col("n_ends") == 1, F.col("end_id").cast("string")).otherwise("").cast("binary"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def conversation_trie(turns: DataFrame, **options) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text).

    Defined cases: a null role or text is empty; turns are ordered by turn, null first, equal ones by digest, and rows that repeat are turns each; rows with a
    null conv_id belong to no conversation; c % step of a negative c has the sign of c; a rebuilt conversation
    without turns is a member of the root alone; other columns are ignored; an empty table has no nodes.
    """
    return trie(rebuilt(turns, **options))
