"""Feature spaces: named sets of derived columns, and their products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S

# Band triples of the colour spaces.
RGB, O3 = ("Red", "Green", "Blue"), ("SWIR-2", "NIR", "Red")


def _at(bands: Mapping[str, str] | None, name: str) -> str:
    return (bands or {}).get(name, name)


def _hsv(name: str, triple, bands, compat: bool) -> dict[str, Column]:
    parts = S.hsv(*[_at(bands, b) for b in triple], compat=compat)
    return {f"{k}({name})": v for k, v in parts.items()}


def optical(bands: Mapping[str, str] | None = None, compat: bool = False) -> dict[str, dict[str, Column]]:
    """The eleven optical spaces; bands maps roles to columns."""
    b = lambda n: _at(bands, n)
    awei = S.awei(b("Green"), b("NIR"), b("SWIR-1"), b("SWIR-2"), compat)
    aweish = S.aweish(b("Blue"), b("Green"), b("NIR"), b("SWIR-1"), b("SWIR-2"))
    water = {"cAWEI": {"AWEI": awei, "AWEISH": aweish}, "cNDWI": {n: S.index(n, bands) for n in ("NDWI", "MNDWI1", "MNDWI2")}}
    colour = {"HSV(RGB)": _hsv("RGB", RGB, bands, compat), "HSV(O3)": _hsv("O3", O3, bands, compat)}
    raw = {"RGB": {n: F.col(f"`{b(n)}`").cast("double") for n in RGB}, "O3": {n: F.col(f"`{b(n)}`").cast("double") for n in O3}}
    both = {**water["cAWEI"], **water["cNDWI"]}
    return {
        "RGB": raw["RGB"],
        "O3": raw["O3"],
        "cNDWI": water["cNDWI"],
        "cAWEI": water["cAWEI"],
        "cAWEI+cNDWI": both,
        "HSV(RGB)": colour["HSV(RGB)"],
        "HSV(O3)": colour["HSV(O3)"],
        "HSV(O3)+cAWEI": {**colour["HSV(O3)"], **water["cAWEI"]},
        "HSV(O3)+cNDWI": {**colour["HSV(O3)"], **water["cNDWI"]},
        "HSV(O3)+cAWEI+cNDWI": {**colour["HSV(O3)"], **both},
        "O3+cAWEI+cNDWI": {**raw["O3"], **both},
    }


def radar(bands: Mapping[str, str] | None = None) -> dict[str, Column]:
    return {n: F.col(f"`{_at(bands, n)}`").cast("double") for n in ("VV", "VH")}


def all_spaces(bands: Mapping[str, str] | None = None, compat: bool = False) -> dict[str, dict[str, Column]]:
    """Radar, the optical spaces and their products with radar: 23 in all."""
    sar, opt = radar(bands), optical(bands, compat)
    return {"SAR": sar, **opt, **{f"SAR_{n}": {**sar, **c} for n, c in opt.items()}}


def clustering_spaces(bands: Mapping[str, str] | None = None, compat: bool = False, full: bool = False) -> dict[str, dict[str, Column]]:
    """Spaces for clustering: the optical ones and radar; full adds the products."""
    every = all_spaces(bands, compat)
    return every if full else {k: v for k, v in every.items() if not k.startswith("SAR_")}


def build(df: DataFrame, space: Mapping[str, Column], keys: list[str]) -> DataFrame:
    """One projection with all columns of a space."""
    return df.select(*[F.col(f"`{k}`") for k in keys], *[c.alias(n) for n, c in space.items()])


def by_filter(filters: list[str | None], bands: Mapping[str, str] | None = None) -> dict[tuple[str | None, str], dict[str, Column]]:
    """(filter, space) registry; unknown filter names are an error."""
    from ..operators.spatial import FILTER_ALIASES

    for f in filters:
        if f is not None and f.casefold().strip() not in FILTER_ALIASES:
            raise ValueError(f"unknown filter: {f}")
    return {(f, n): c for f in filters for n, c in all_spaces(bands).items()}


def filtered(
    df: DataFrame,
    filters: Sequence[str | None],
    keys: Sequence[str],
    *,
    names: Sequence[str] | None = None,
    split: str = "split",
    train: str = "train",
    evaluation: str = "valid",
    radar: Sequence[str] = ("VV", "VH"),
    bands: Mapping[str, str] | None = None,
    clustering: bool = False,
    full: bool = False,
) -> dict[str | None, dict[str, tuple[DataFrame, DataFrame]]]:
    """{filter: {space: (training rows, evaluation rows)}} of a pixel table (split, keys, row, col, bands); rows: keys, row, col and the space's columns.

    The speckle filter (None: none) only touches the radar bands and works on the rows of one split, which are chosen before it.  names: the
    wanted spaces, by default all of them (clustering, full: those for clustering); an unknown filter or space is an error.  All frames are
    plans: nothing runs before one of them is used.
    """
    from ..operators import spatial

    by_filter(list(filters))  # checks the names
    every = clustering_spaces(bands, full=full) if clustering else all_spaces(bands)
    if unknown := set(names or ()) - set(every):
        raise ValueError(f"unknown spaces: {sorted(unknown)}")
    at = [*keys, "row", "col"]

    def cleaned(name: str | None, part: DataFrame) -> DataFrame:
        return part if name is None else part.drop(*radar).join(spatial.speckle_filter(name, part, keys, list(radar)), at)

    out: dict[str | None, dict[str, tuple[DataFrame, DataFrame]]] = {}
    for f in filters:
        rows = [cleaned(f, df.where(F.col(split) == s)) for s in (train, evaluation)]
        out[f] = {n: (build(rows[0], every[n], at), build(rows[1], every[n], at)) for n in names or every}
    return out
