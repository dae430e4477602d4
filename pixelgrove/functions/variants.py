"""Semi-structured values: JSON whose keys are not known, and trees of {type, value} pairs, as VARIANT columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """(keys, key, value: VARIANT): the top-level entries of a column of JSON objects, one row each; what is no JSON object has none."""
    rows = df.select(*keys, F.try_parse_json(json).alias("_v"))
    rows = rows.where(F.schema_of_variant("_v").startswith("OBJECT"))
    each = df.sparkSession.tvf.variant_explode(F.col("_v").outer())
    return rows.lateralJoin(each).select(*keys, "key", "value")


def typed(value: Column) -> Column:
    """A VARIANT as the JSON text of {type, value}; the type is the one that its schema names."""
    body = F.concat(F.lit('{"type":"'), F.lower(F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)), F.lit('","value":'), F.coalesce(F.to_json(value), F.lit("null")), F.lit("}"))
    return body


def resolved(value: Column) -> Column:
    """The VARIANT that a {type, value} tree stands for: the text of its value where there is one, else of the tree itself."""
    inner = F.try_variant_get(value, "$.value", "variant")
    return F.coalesce(inner, value)


def text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, everything else as JSON."""
    plain = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0) == "STRING"
    return F.when(plain, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
