"""Per-pixel expressions over band columns.  All take and give Column, so they stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guard against zero denominators: the square root of double precision's unit roundoff.
EPS = math.sqrt(2.2e-16)


def _c(x: str | Column) -> Column:
    return F.col(f"`{x}`").cast("double") if isinstance(x, str) else x.cast("double")


def normalised_difference(a: str | Column, b: str | Column, rescale: bool = True) -> Column:
    """(a - b) / (a + b); a zero sum shifts both by EPS, so 0/0 is 1.  rescale=False: a - b."""
    a, b = _c(a), _c(b)
    if not rescale:
        return a - b
    total = a + b
    return F.when(total == 0, (a - b + EPS) / F.lit(EPS)).otherwise((a - b) / F.nullif(total, F.lit(0.0)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """(a + EPS) / (b + EPS)."""
    return (_c(a) + EPS) / F.nullif(_c(b) + EPS, F.lit(0.0))


def linear_ratio(vv: str = "VV", vh: str = "VH", rescale: bool = True) -> Column:
    return normalised_difference(vv, vh, rescale)


# The band pairs of the water, moisture and vegetation indices.
INDEX_BANDS = {
    "NDWI": ("Green", "NIR"),
    "MNDWI1": ("SWIR-1", "Green"),
    "MNDWI2": ("SWIR-2", "Green"),
    "NDMI1": ("NIR", "SWIR-1"),
    "NDMI2": ("NIR", "SWIR-2"),
    "NDVI": ("NIR", "Red"),
}


def index(name: str, bands: dict[str, str] | None = None, rescale: bool = True) -> Column:
    """A named index; bands maps roles to columns (default: the roles themselves)."""
    a, b = INDEX_BANDS[name]
    at = bands or {}
    return normalised_difference(at.get(a, a), at.get(b, b), rescale)


def awei(green="Green", nir="NIR", swir1="SWIR-1", swir2="SWIR-2", compat: bool = False) -> Column:
    """4 (G - S1) - (0.25 NIR + 2.75 S2); compat swaps NIR and S1, as stored parameters were made with."""
    g, n, s1, s2 = _c(green), _c(nir), _c(swir1), _c(swir2)
    if compat:
        n, s1 = s1, n
    return 4 * (g - s1) - (0.25 * n + 2.75 * s2)


def aweish(blue="Blue", green="Green", nir="NIR", swir1="SWIR-1", swir2="SWIR-2") -> Column:
    return _c(blue) + 2.5 * _c(green) - 1.5 * (_c(nir) + _c(swir1)) - 0.25 * _c(swir2)


def hsv(red, green, blue, compat: bool = False) -> dict[str, Column]:
    """hue (0 to 1), saturation, value; red wins ties, then green; compat swaps green and blue first."""
    r, g, b = _c(red), _c(green), _c(blue)
    if compat:
        g, b = b, g
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    degrees = F.when(top == r, 60 * (g - b) / span + F.when(g < b, 360.0).otherwise(0.0)).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    return {"hue": F.coalesce(degrees / 360, F.lit(0.0)), "saturation": F.coalesce(span / F.nullif(top, F.lit(0.0)), F.lit(0.0)), "value": top}


def range_clip(x, low: float | Column, scale: float | Column) -> Column:
    """(x - low) / scale inside [0, 1]."""
    return F.greatest(F.least((_c(x) - low) / scale, F.lit(1.0)), F.lit(0.0))


def standardised(x, mean: float | Column, scale: float | Column) -> Column:
    return (_c(x) - mean) / scale


def radar_clean(x, low: float = -50.0, high: float = 1.0) -> Column:
    """NaN and null to 0, infinities to the bounds, clip to [low, high], rescale to [0, 1]."""
    clean = F.coalesce(F.nanvl(_c(x), F.lit(0.0)), F.lit(0.0))
    return (F.greatest(F.least(clean, F.lit(high)), F.lit(low)) - low) / (high - low)


def display_range(x, low: float, high: float) -> Column:
    """Linear remap for display, clipped to [0, 1]."""
    return F.greatest(F.least(_c(x) - low, F.lit(high - low)), F.lit(0.0)) / (high - low)


def luminance(red, green, blue) -> Column:
    return 0.2125 * _c(red) + 0.7154 * _c(green) + 0.0721 * _c(blue)


def confusion_category(label, pred, is_probability: bool = False) -> Column:
    """invalid, TN, TP, FP or FN; a probability is positive above 0.5."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    positive = _c(pred) > 0.5 if is_probability else _c(pred) == 1
    return (
        F.when(label.isNull() | (label < 0), "invalid")
        .when((label == 0) & ~positive, "TN")
        .when((label == 1) & positive, "TP")
        .when((label == 0) & positive, "FP")
        .otherwise("FN")
    )


def bits_and(columns: Sequence[str]) -> Column:
    out = F.col(f"`{columns[0]}`").cast("int")
    for c in columns[1:]:
        out = out.bitwiseAND(F.col(f"`{c}`").cast("int"))
    return out


def bits_or(columns: Sequence[str]) -> Column:
    out = F.col(f"`{columns[0]}`").cast("int")
    for c in columns[1:]:
        out = out.bitwiseOR(F.col(f"`{c}`").cast("int"))
    return out


def threshold(x, t: float) -> Column:
    """1 above t, else 0."""
    return (_c(x) > t).cast("int")


def most_likely(columns: Sequence[str]) -> Column:
    """Position of the largest of the columns; the first wins ties."""
    values = F.array(*[_c(c) for c in columns])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def two_class(p) -> dict[str, Column]:
    """(dry, water) probabilities of a one-channel water probability."""
    return {"dry": 1 - _c(p), "water": _c(p)}
