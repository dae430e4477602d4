"""Column-set operators, masks and catalogs of named relations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame | None]


def keep(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Only the named channels (and keys), in the given order; unknown names are an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown channels: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *names]])


def discard(df: DataFrame, names: Sequence[str] | str) -> DataFrame:
    names = [names] if isinstance(names, str) else names
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown channels: {missing}")
    return df.drop(*names)


def in_sequence(df: DataFrame, steps: Sequence[Step], may_end: bool = False) -> DataFrame | None:
    """Applies steps in turn; a step that gives None ends it if that is allowed."""
    for step in steps:
        out = step(df)
        if out is None:
            if may_end:
                return None
            raise ValueError("a step gave no result")
        df = out
    return df


def fan_out(df: DataFrame, derived: Mapping[str, Column], keys: Sequence[str], keep_source: bool = False) -> DataFrame:
    """All derived columns side by side in one projection."""
    source = [c for c in df.columns if c not in keys] if keep_source else []
    clash = set(source) & set(derived)
    if clash:
        raise ValueError(f"channels exist already: {sorted(clash)}")
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *source]], *[v.alias(k) for k, v in derived.items()])


def per_channel(df: DataFrame, make: Callable[[str], Column], keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keys], *[make(c).alias(c) for c in df.columns if c not in keys])


def derive_if_absent(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, column)


def derive_only(df: DataFrame, name: str, column: Column, keys: Sequence[str]) -> DataFrame:
    """A derived step that replaces the channels: keys and the new channel."""
    return df.select(*[F.col(f"`{k}`") for k in keys], (F.col(f"`{name}`") if name in df.columns else column).alias(name))


# ---------------------------------------------------------------- masks


def valid_mask(df: DataFrame, source: str, name: str = "mask", mask_label: int = -1) -> DataFrame:
    return df.withColumn(name, F.col(f"`{source}`") != mask_label)


def spread_mask(df: DataFrame, mask: str, value: float, channels: Sequence[str]) -> DataFrame:
    """Where the mask channel equals value, the other channels take it too."""
    hit = F.col(f"`{mask}`") == value
    return df.withColumns({c: F.when(hit, F.lit(value)).otherwise(F.col(f"`{c}`")) for c in channels if c != mask})


def combine_masks(target: DataFrame, source: DataFrame, keys: Sequence[str], channels: Mapping[str, str], value: float = -1) -> DataFrame:
    """target's channels become value where the mapped source channel is; rows are matched by keys."""
    marks = source.select(*keys, *[F.col(f"`{s}`").alias(f"_m{k}") for k, s in enumerate(channels.values())])
    out = target.join(marks, list(keys), "left")
    out = out.withColumns({t: F.when(F.col(f"_m{k}") == value, F.lit(value)).otherwise(F.col(f"`{t}`")) for k, t in enumerate(channels)})
    return out.drop(*[f"_m{k}" for k in range(len(channels))])


# ---------------------------------------------------------------- catalogs of relations


class Catalog:
    """Named relations with kind (bit mask: 2 label, 4 and 8 sensors), split and channels."""

    def __init__(self, entries: Mapping[str, tuple[DataFrame, int, str]] | None = None) -> None:
        self.entries = dict(entries or {})

    def add(self, name: str, df: DataFrame, kind: int, split: str) -> Catalog:
        return Catalog({**self.entries, name: (df, kind, split)})

    def retain(self, name: str) -> Catalog:
        return Catalog({name: self.entries[name]})

    def remove(self, name: str) -> Catalog:
        return Catalog({k: v for k, v in self.entries.items() if k != name})

    def merge(self, other: Catalog) -> Catalog:
        """Equal names must carry the same relation."""
        for k in self.entries.keys() & other.entries.keys():
            a, b = self.entries[k], other.entries[k]
            if a[0] is not b[0] or a[1:] != b[1:]:
                raise ValueError(f"conflicting entries for {k}")
        return Catalog({**self.entries, **other.entries})

    def spread(self, steps: Sequence[Callable[[Catalog], Catalog]], keep_source: bool = True) -> Catalog:
        out = self if keep_source else Catalog()
        for step in steps:
            out = out.merge(step(self))
        return out

    def find(self, *, kind: int | None = None, kind_mode: str = "and", channels: Sequence[str] | None = None, channel_mode: str = "and", split: str | None = None) -> str:
        """The one name that satisfies all given predicates."""
        test = {
            "and": lambda have, want: have & want == want,
            "or": lambda have, want: bool(have & want),
            "and_not": lambda have, want: have & want != want,
            "or_not": lambda have, want: not have & want,
        }
        found = []
        for name, (df, k, s) in self.entries.items():
            if kind is not None and not test[kind_mode](k, kind):
                continue
            if channels is not None and not test[channel_mode](frozenset(df.columns), frozenset(channels)):
                continue
            if split is None or s == split:
                found.append(name)
        if len(found) != 1:
            raise LookupError(f"expected one relation, found {found}")
        return found[0]

    def __getitem__(self, key: str | int) -> DataFrame:
        return self.entries[list(self.entries)[key] if isinstance(key, int) else key][0]


def predicate(kind: Column, mask: int, mode: str) -> Column:
    """The bit-mask test of a catalog as a column expression."""
    hit = kind.bitwiseAND(F.lit(mask))
    return {"and": hit == mask, "or": hit != 0, "and_not": hit != mask, "or_not": hit == 0}[mode]


def channel_predicate(channels: Column, names: Sequence[str], mode: str) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    every = F.size(F.array_except(wanted, channels)) == 0
    some = F.arrays_overlap(wanted, channels)
    return {"and": every, "or": some, "and_not": ~every, "or_not": ~some}[mode]


# ---------------------------------------------------------------- wide result tables


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in all rows (one aggregate of counts)."""
    if not df.columns:
        return df
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[i]])


def merge_equivalent(df: DataFrame, names: Sequence[str], into: str) -> DataFrame:
    """First non-null of the columns, which are dropped."""
    there = [c for c in names if c in df.columns]
    merged = F.coalesce(*[F.col(f"`{c}`") for c in there])
    return df.withColumn("_merged", merged).drop(*there).withColumnRenamed("_merged", into)


def drop_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def matching(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows equal in all given columns."""
    for c, v in values.items():
        df = df.where(F.col(f"`{c}`") == v)
    return df


def suffixed(df: DataFrame, suffix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in columns})


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to top-level columns a_b."""
    from pyspark.sql.types import StructType

    def walk(prefix: str, name: str, schema) -> list[Column]:
        out = []
        for f in schema.fields:
            path, label = f"{prefix}`{f.name}`", f"{name}{sep}{f.name}" if name else f.name
            out += walk(path + ".", label, f.dataType) if isinstance(f.dataType, StructType) else [F.col(path).alias(label)]
        return out

    return df.select(*walk("", "", df.schema))


def feature_space_flags(space: Column) -> dict[str, Column]:
    """Whether a feature space's name has a radar part, and whether it mixes parts."""
    return {"sar_included": space.rlike(r'SAR[^"]*(_[^"]*)*'), "mixed": space.contains("_")}


def balance_weights(df: DataFrame, cls: str, name: str = "weight") -> DataFrame:
    """n / (classes * rows of the class), from a small table of class counts."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    weights = counts.join(F.broadcast(total), F.lit(True)).select(cls, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(F.broadcast(weights), cls)  # one row per class
