"""Neighbourhoods as arrays: chips are cut into tiles with a halo, and a function sees each tile's bands as matrices.

A pixel goes to its tile and to those whose halo it lies in; a chip up to the tile size is one tile and nothing is sent
twice.  All bands of a filter are worked on in the same pass.  A task holds one tile, so chips may have any size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile.
SIDE = 256


@dataclass(frozen=True)
class Tile:
    """Bands with their halo, which halo cells lie in the chip (or fold back into it), and the tile's place: first row and column, the
    chip's size."""

    bands: dict[str, np.ndarray]
    there: np.ndarray
    top: int
    left: int
    rows: int
    cols: int
    halo: int

    @property
    def shape(self) -> tuple[int, int]:
        h, w = self.there.shape
        return h - 2 * self.halo, w - 2 * self.halo

    def shifted(self, a: np.ndarray, down: int, right: int) -> np.ndarray:
        """The values that lie (down, right) of each of the tile's own cells."""
        h, w = self.shape
        k = self.halo
        return a[k + down : k + down + h, k + right : k + right + w]

    def border(self, n: int) -> np.ndarray:
        """Which of the tile's cells are at least n away from each edge of the chip."""
        h, w = self.shape
        r, c = self.top + np.arange(h)[:, None], self.left + np.arange(w)
        return (r >= n) & (c >= n) & (r < self.rows - n) & (c < self.cols - n)


def fold(at: np.ndarray, length: int, kind: str | None) -> np.ndarray:
    """Places beyond the ends folded back (mirror: the edge is not repeated; reflect: it is), as often as needed; -1 without folding."""
    if kind is None:
        return np.where((at >= 0) & (at < length), at, -1)
    period, back = (max(2 * (length - 1), 1), 0) if kind == "mirror" else (2 * length, 1)
    at = np.mod(at, period)
    return np.minimum(at, period - back - at) if period > 1 else np.zeros_like(at)


def _run(keys: Sequence[str], bands: Sequence[str], outputs: Mapping[str, str], halo: int, kind: str | None, function: Callable, side: int):
    def run(table: pa.Table) -> pa.Table:
        row, col, top, left, rows, cols = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "_top", "_left", "_rows", "_cols"))
        top, left, rows, cols = (int(x[0]) for x in (top, left, rows, cols))
        height, width = min(side, rows - top), min(side, cols - left)
        # cells by their place; what is not in the table stays NaN
        at_row, at_col = row - top + halo, col - left + halo
        given = np.zeros((height + 2 * halo, width + 2 * halo), bool)
        given[at_row, at_col] = True
        pick_row = fold(np.arange(top - halo, top + height + halo), rows, kind)
        pick_col = fold(np.arange(left - halo, left + width + halo), cols, kind)
        inside = (pick_row >= 0)[:, None] & (pick_col >= 0)
        index = np.ix_(np.where(pick_row < 0, 0, pick_row - top + halo), np.where(pick_col < 0, 0, pick_col - left + halo))
        filled = {}
        for b in bands:
            cells = np.full(given.shape, np.nan)
            cells[at_row, at_col] = table.column(b).to_numpy()
            filled[b] = np.where(inside, cells[index], np.nan)
        made = function(Tile(filled, inside & given[index], top, left, rows, cols, halo))
        own = np.flatnonzero((at_row >= halo) & (at_col >= halo) & (at_row < halo + height) & (at_col < halo + width))
        r, c = at_row[own] - halo, at_col[own] - halo
        first = pa.array(np.zeros(len(own), np.int64))
        columns = [table.column(k).take(first) for k in keys] + [table.column(x).take(pa.array(own)) for x in ("row", "col")]
        return pa.table([*columns, *[pa.array(made[name][r, c]) for name in outputs]], names=[*keys, "row", "col", *outputs])

    return run


def apply(df: DataFrame, keys: Sequence[str], bands: Sequence[str], outputs: Mapping[str, str], halo: int, kind: str | None, function: Callable[[Tile], dict[str, np.ndarray]], side: int | None = None) -> DataFrame:
    """(keys, row, col, outputs: name -> type) of every pixel; function gives the outputs of a tile from its bands.

    Null bands are NaN; pixels that a chip lacks are NaN and not there; a chip ends at its largest row and column.
    """
    side = max(side or SIDE, halo + 1)
    size = df.groupBy(*keys).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    cells = df.select(*keys, "row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    joined = cells.join(size.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]) if keys else cells.crossJoin(F.broadcast(size))

    def starts(at: str, length: str):
        low = F.greatest(F.floor((F.col(at) - halo) / F.lit(side)), F.lit(0))
        high = F.least(F.floor((F.col(at) + halo) / F.lit(side)), F.floor((F.col(length) - 1) / F.lit(side)))
        return F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda t: t * side)

    dealt = joined.withColumn("_top", F.explode(starts("row", "_rows"))).withColumn("_left", F.explode(starts("col", "_cols")))
    dealt = dealt.select(*keys, "_top", "_left", "_rows", "_cols", "row", "col", *bands)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "row", "col")), *(f"`{c}` {k}" for c, k in outputs.items())])
    return dealt.groupBy(*keys, "_top", "_left").applyInArrow(_run(keys, bands, outputs, halo, kind, function, side), schema)


def box_mean(tile: Tile, a: np.ndarray) -> np.ndarray:
    """Mean over the whole halo window of each of the tile's cells; NaN and what is not there count as 0."""
    k, (h, w) = tile.halo, tile.shape
    a = np.where(np.isnan(a), 0.0, a)
    lines = sum(a[i : i + h] for i in range(2 * k + 1))
    return sum(lines[:, i : i + w] for i in range(2 * k + 1)) / (2 * k + 1) ** 2
