"""Language identification by compression.

Each language has a zstandard raw-content dictionary: lower-cased texts of that language.  A text
is encoded with every dictionary; the smallest result names the language, and the margin to the
next one is the score.  Narrow margins are marked rejected.

Dictionaries come from a bounded sample: per language at most ``texts`` training texts (the
smallest hashes of ``slots`` slots), ``dictionary_bytes`` bytes in all.  Classification reads
every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3


def has_letter(text: str) -> bool:
    """Whether any code point is of Unicode's category L (numerals such as ½ or Ⅷ are not)."""
    return any(map(str.isalpha, text))


def train(
    docs: DataFrame,
    *,
    rows: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts: int = 120,
    text_bytes: int = 1500,
    max_languages: int = 500,
) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows that rows allows."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null and id is not null")
    if rows is not None:
        known = known.where(rows)
    # a stretch of each text, chosen by hash
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.char_length("text") - text_bytes + 1, F.lit(1))).cast("int")
    hashed = known.select("lang", F.substring("text", start + 1, F.lit(text_bytes)).alias("text"), F.xxhash64("id").alias("h"))
    slots = hashed.groupBy("lang", F.pmod("h", F.lit(texts)).alias("slot")).agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    out: dict[str, list[tuple[int, bytes]]] = {}
    languages = known.select("lang").distinct().count()
    if languages > max_languages:
        raise ValueError(f"{languages} languages, but max_languages is {max_languages}")
    for row in slots.toLocalIterator():
        out.setdefault(row["lang"], []).append((row["slot"], row["text"].encode().lower()))
    return {lang: b"\n".join(t for _, t in sorted(own)) for lang, own in sorted(out.items())}


@lru_cache(8)
def _compressors(content: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for x in content:
        d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.01) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1: how much smaller the best encoding is than the second), rejected.

    Defined cases: null, empty and letterless texts are ``und`` with score 0, rejected; without any learned language
    all are; a single learned language takes all others with score 0, rejected; ties go to the first
    name; repeated rows and further columns change nothing.
    """
    names = sorted(dictionaries)
    content = tuple(dictionaries[x] for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(content)
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                if not tools or not text or not has_letter(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                data = text.encode().lower()
                size = np.array([len(t.compress(data)) for t in tools])
                best = int(size.argmin())
                lang.append(names[best])
                second = np.partition(size, 1)[1] if len(size) > 1 else size[0]
                score.append(float(second - size[best]) / float(second))
            s = np.array(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(s), pa.array(s < narrow)], ["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
