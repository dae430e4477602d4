"""Scalar helpers over strings, maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_and_seed(x: Column) -> dict[str, Column]:
    """'name_12' -> (name, 12), split at the last underscore; without a number the seed is null."""
    seed = F.regexp_extract(x, r"^(.*)_(\d+)$", 2)
    has = seed != ""
    return {"name": F.when(has, F.regexp_extract(x, r"^(.*)_(\d+)$", 1)).otherwise(x), "seed": F.when(has, seed.cast("bigint"))}


def region_and_id(path: Column) -> dict[str, Column]:
    """REGION_ID_LAYER.tif -> region and id."""
    pattern = r"([^/\\_]+)_(\d+)_[^/\\]*$"
    number = F.regexp_extract(path, pattern, 2)
    return {"region": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), "chip_id": F.when(number != "", number.cast("bigint"))}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def replace_first(x: Column, what: str, by: str) -> Column:
    """Only the first occurrence of a literal."""
    at = F.instr(x, what)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(by), F.substring(x, at + len(what), F.length(x)))).otherwise(x)


def joined(items: Column) -> Column:
    return F.array_join(items, ";")


def split_list(x: Column) -> Column:
    return F.split(x, ";")


def typed_value(x: Column) -> Column:
    """Parse of a literal as a struct: kind and the value in the column of its kind.

    Order: int, float (with nan), null, bool, else string; surrounding blanks do not count.
    """
    x = F.trim(x)
    low = F.lower(x)
    whole = F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.cast("bigint"))
    real = F.when(whole.isNull() & x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.cast("double")).when(low == "nan", F.lit(float("nan")))
    nothing = low.isin("null", "none", "")
    flag = F.when(low.isin("true", "false"), low == "true")
    kind = F.when(whole.isNotNull(), "int").when(real.isNotNull(), "float").when(nothing, "null").when(flag.isNotNull(), "bool").otherwise("string")
    return F.struct(kind.alias("kind"), whole.alias("int_value"), real.alias("float_value"), flag.alias("bool_value"), F.when(kind == "string", x).alias("string_value"))


def key_value(x: Column) -> dict[str, Column]:
    """'key=value' split at the first '='; a key with commas is a tuple key (array)."""
    key = F.trim(F.substring_index(x, "=", 1))
    return {"key": F.split(key, r"\s*,\s*"), "value": F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x)))}


def contains_map(outer: Column, inner: Column) -> Column:
    """Every entry of inner is in outer with an equal (null-safe) value."""
    return F.forall(F.map_entries(inner), lambda e: F.map_contains_key(outer, e["key"]) & F.try_element_at(outer, e["key"]).eqNullSafe(e["value"]))


def half_up(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


def kind_name(kind: Column) -> Column:
    """Bit mask 1 unknown, 2 label, 4 first sensor, 8 second sensor -> 'label_s1_s2'."""
    part = lambda bit, name: F.when(kind.bitwiseAND(F.lit(bit)) != 0, name)
    return F.concat_ws("_", part(1, "unknown"), part(2, "label"), part(4, "s1"), part(8, "s2"))
