"""License scan: an exact set-similarity join of text blocks with license templates, in SQL functions only.

A block (one line of a text) matches a template if it holds at least ``share`` percent of the template's
distinct tokens.  As in prefix-filter joins, tokens are ordered by how many blocks of the
corpus hold them, rarest first:

* prefix filter: with t tokens and o = ceil(share * t / 100) needed ones, a match holds one of the
  t - o + 1 rarest tokens of the template,
* length filter: a block needs at least o of the templates' tokens,
* positional filter: if the first common token is the template's p-th (from 0) and the block's q-th, at most
  min(t - p, b - q) tokens can be common, which must reach o; b is the number of template tokens in the block.

Only the templates' tokens are counted (their number is that of the fixed templates), so the order
is a bounded table; other tokens of a block cannot be common and have no place in it.  Only a block's prefix of b - o + 1 tokens,
with the least o, is exploded.  Surviving candidates are verified by intersection.

A notice that is wrapped over several lines is found by blocks of another kind (``window_matches``): every stretch of
``room`` percent of a template's words, wherever it starts in the whole text.  The same order and prefix give the places to look at; what
lies within a stretch's length of such a place is its block, with at least o of the template's tokens from the p-th on (length and
positional filter); its stretches are then counted one by one.

Beside the join, four fixed phrases are located word by word (the base labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences by which works state their license, and its label.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}

#: A word byte class for Java: of the code points below 0x80 only digits and letters, and all others.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _phrase(words: str) -> str:
    return _GAP.join(words.split(" "))


def _pattern(phrases: list[str]) -> str:
    """Places of any phrase; upper and lower case of A-Z alike (Java's (?i) folds ASCII only)."""
    return rf"(?i)(?<!{_WORD})(?:{'|'.join(_phrase(x) for x in phrases)})(?!{_WORD})"


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("long")


def base_scan(text: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base (array of labels) of a text column."""
    text = F.coalesce(text, F.lit(""))
    # a plain substring test guards the look-arounds: every phrase holds one of these words
    maybe = text.rlike("(?i)license|cc")
    anywhere = _pattern(list(PHRASES))
    n = F.when(maybe, F.regexp_count(text, F.lit(anywhere))).otherwise(0).cast("long")
    # by extraction: Java's positions count UTF-16 units, Spark's substrings code points
    first = F.when(n > 0, _word_count(F.regexp_extract(text, r"(?s)^(.*?)" + anywhere, 1)))
    last = F.when(n > 0, _word_count(F.regexp_extract(text, r"(?s)^(.*)" + anywhere, 1)))
    labels = [F.when(n > 0, F.when(text.rlike(_pattern([p])), F.lit(label))) for p, label in PHRASES.items()]
    return {"n_words": _word_count(text), "n_base": n, "first_word": first, "last_word": last, "base": F.array_sort(F.array_compact(F.array(*labels)))}


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def _tokens(line: Column) -> Column:
    return F.array_distinct(_words(line))


def _template_rows() -> list[tuple[int, str, list[str]]]:
    return [(k, label, sorted(set(text.split(" ")))) for k, (text, label) in enumerate(TEMPLATES.items())]


def _any_of(words: list[str]) -> str:
    """A pattern of these words and no others, branching letter by letter, so that few branches are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [h + (_any_of(rest) if rest != [""] else "") for h, rest in sorted(heads.items()) if h]
    if len(parts) == 1 and not ends:
        return parts[0]
    return f"(?:{'|'.join(parts)}){'?' if ends else ''}"  # longest first; a word's end is tested behind the pattern


def _whole(words: list[str]) -> str:
    """Any of these words as a whole word, A-Z in either case."""
    return rf"(?i)(?<!{_WORD})({_any_of(words)})(?!{_WORD})"


def token_order(docs: DataFrame, text_col: str) -> dict[str, int]:
    """Of every template token: the number of lines that hold it, as one aggregation without a shuffle of tokens."""
    names = sorted({t for _, _, own in _template_rows() for t in own})
    line = F.explode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line")
    lines = docs.select(line)
    # tokens are tested as whole words on the raw line, so no token array is built in this pass
    found = lines.select(F.regexp_extract_all(F.col("line"), F.lit(_whole(names)), 1).alias("t"))
    found = found.where(F.size("t") > 0).select(F.explode(F.array_distinct(F.transform("t", lambda x: F.lower(x)))).alias("t"))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def template_matches(docs: DataFrame, *, id_col: str, text_col: str, share: int, order: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, label, containment) of every (line, template) pair that reaches the share; order: what token_order gives, if it is there already."""
    spark = docs.sparkSession
    order = token_order(docs, text_col) if order is None else order
    rows, rare = [], set()
    for k, label, own in _template_rows():
        own = sorted(own, key=lambda t: (order.get(t, 0), t))
        need = -(-share * len(own) // 100)
        for p, token in enumerate(own[: len(own) - need + 1]):
            rows.append((token, k, label, own, p, need))
            rare.add(token)
    # the fixed templates' prefixes: at most as many rows as the templates have tokens
    prefixes = spark.createDataFrame(rows, "token string, template int, label string, own array<string>, p int, need int")
    least = min(r[5] for r in rows)
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.explode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(_whole(sorted(rare))))
    ranked = sorted({t for _, _, own in _template_rows() for t in own}, key=lambda t: (order.get(t, 0), t))
    # the block's template tokens in the global order
    lines = lines.withColumn("tokens", F.array_intersect(F.array(*[F.lit(x) for x in ranked]), _tokens(F.col("line")))).where(F.size("tokens") >= least)
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)
    hits = lines.select("doc_id", "tokens", F.posexplode(prefix).alias("q", "token")).join(F.broadcast(prefixes), "token")
    hits = hits.where(F.least(F.size("own") - F.col("p"), F.size("tokens") - F.col("q")) >= F.col("need"))
    common = F.size(F.array_intersect("tokens", "own"))
    hits = hits.withColumn("common", common).where("common >= need")
    return hits.groupBy("doc_id", "label").agg(F.max(F.col("common") / F.size("own")).alias("containment"))


def window_matches(docs: DataFrame, *, id_col: str, text_col: str, share: int, room: int, order: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, label, containment) of every template that reaches the share in some stretch of a text.

    A stretch that matches holds at least one prefix token of its template; the rarest one it holds, the template's p-th, is
    a place from which it is found, and all its common tokens are the p-th or later ones.  order: as in template_matches.
    """
    spark = docs.sparkSession
    order = token_order(docs, text_col) if order is None else order
    rows = []
    for k, (words, label) in enumerate(TEMPLATES.items()):
        size = -(-room * len(words.split(" ")) // 100)
        own = sorted(set(words.split(" ")), key=lambda t: (order.get(t, 0), t))
        need = -(-share * len(own) // 100)
        for p, token in enumerate(own[: len(own) - need + 1]):
            rows.append((token, k, label, own[p:], len(own), need, size))
    # the fixed templates' prefixes: at most as many rows as the templates have tokens
    prefixes = spark.createDataFrame(rows, "token string, template int, label string, rest array<string>, tokens int, need int, size int")
    rare, reach = sorted({r[0] for r in rows}), max(r[6] for r in rows)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(_whole(rare)))
    texts = texts.select("doc_id", _words(F.col("text")).alias("words"))
    # places of rare tokens, each with the words around it: bounded rows, however long the text is
    token = F.array(*[F.lit(x) for x in rare])
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(token, w), i)), lambda i: i.isNotNull())
    first = lambda i: F.greatest(i - (reach - 1), F.lit(0))
    near = F.transform(at, lambda i: F.struct((i - first(i)).alias("at"), F.slice("words", first(i) + 1, i - first(i) + reach).alias("around")))
    places = texts.select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.at", "x.around", F.element_at("x.around", F.col("x.at") + 1).alias("token"))
    hits = places.join(F.broadcast(prefixes), "token")
    # from here on only the words within the template's own reach
    start = F.greatest(F.col("at") - (F.col("size") - 1), F.lit(0))
    hits = hits.withColumn("block", F.slice("around", start + 1, F.col("at") - start + F.col("size"))).withColumn("at", F.col("at") - start)
    hits = hits.where(F.size(F.array_intersect("block", "rest")) >= F.col("need")).distinct()
    stretch = F.transform(F.sequence(F.lit(0), F.col("at")), lambda s: F.size(F.array_intersect(F.slice("block", s + 1, F.col("size")), F.col("rest"))))
    hits = hits.withColumn("common", F.array_max(stretch)).where("common >= need")
    return hits.groupBy("doc_id", "label").agg(F.max(F.col("common") / F.col("tokens")).alias("containment"))


def scan_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 80, room: int = 125) -> DataFrame:
    """Per row of docs: doc_id, labels (sorted, comma-joined) of the templates found in a stretch of the text, and the best containment.

    Defined cases: null, empty and other texts without a match: no labels (an empty string) and 0; lines do not matter; rows that
    share a doc_id share the labels of all their texts; a null doc_id has none; further columns are ignored,
    whatever their names.
    """
    match = window_matches(docs, id_col=id_col, text_col=text_col, share=share, room=room).where("doc_id is not null")
    match = match.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("containment").alias("containment"))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).join(match, "doc_id", "left")
    return out.select("doc_id", F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 80, room: int = 125) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Blocks are the lines of a text and its stretches of room percent of a template's words, so wrapped notices are found.
    score is 1 with a base phrase, else the best containment, else 0.

    Defined cases: null texts count as empty: no words, no labels (empty strings), score 0; rows that share a doc_id
    share the template labels of all their texts; a null doc_id has base labels only; further columns
    are ignored, whatever their names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[c.alias(n) for n, c in base_scan(text).items()])
    how = {"id_col": id_col, "text_col": text_col, "share": share, "order": token_order(docs, text_col)}
    match = template_matches(docs, **how).unionByName(window_matches(docs, room=room, **how)).where("doc_id is not null")
    match = match.groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base.join(match, "doc_id", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
