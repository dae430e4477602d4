"""Token ids of the packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pixelgrove.llm import packing
from pixelgrove.llm.common import column_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts, path=PATH):
    ids, limits = packing.token_ids(*column_bytes(pa.array(texts)), path)
    return [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:])]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, texts):
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_single_cases(tokenizer):
    texts = ["İ.", "İ,", "aİ!", "a'İ", "don't", "I'LL'VE", "'s", "'", "''s", "!'s", "'re", "'r", "'S'T'Ré", "it's.", "", " ", "3.14", "ǅ.", "ŉ!", "á.", "x y", "²³", "×÷", "<|endoftext|>a", "<|ENDOFTEXT|>"]
    assert ids_of(texts) == expected(tokenizer, texts)


@pytest.mark.parametrize("seed", range(4))
def test_random_strings(tokenizer, seed):
    rng = random.Random(seed)
    parts = list("abstmdrevlABSTMDREVL'’.,!?-_ \n\t\r\x0b\x0c\x1c\x850123456789éÀßİıŉǅſΣσς×÷ªº²½́̈  ​中文가👍") + ["<|endoftext|>", "<|", "|>", "'s", "'LL", "don't", "I'm", "İ.", "é", "’s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    assert ids_of(texts) == expected(tokenizer, texts)


def test_letters_that_grow_when_lower_cased(tokenizer):
    grow = [chr(c) for c in range(0x250) if len(chr(c).lower()) > 1 or not chr(c).lower().isalpha() and chr(c).isalpha()]
    texts = [f"{a}{mark}{b}" for a in ["", "x", *grow] for b in ["", "y", *grow] for mark in ".,!?;:'-"]
    assert ids_of(texts) == expected(tokenizer, texts)


def test_long_runs_and_a_full_table(tokenizer, monkeypatch):
    texts = ["x" * 300 + " " + "xy" * 40, "word " * 1000, "".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " for i in range(600))]
    monkeypatch.setattr(packing, "CACHE_RUNS", 200)
    for text in texts:
        assert ids_of([text]) == expected(tokenizer, [text])


def test_other_tokenizers_take_whole_documents():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello there, it's 42  degrees", "", "naïve İ."]
    assert ids_of(texts, path) == expected(Tokenizer.from_file(path), texts)


def test_table_of_runs():
    known = packing._Known()
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64) >> np.uint64(1))
    keys = np.append(keys, keys[:1] + np.uint64(1))  # same slot
    known.add(keys, np.repeat(np.arange(len(keys), dtype="<u4"), 2), np.full(len(keys), 2))
    row = known.find(keys)
    assert (known.ids[known.limits[row]] == np.arange(len(keys))).all()
    assert known.find(np.array([2**62 + 12345], np.uint64)).tolist() == [-1]


def test_last_bytes_of_a_block(tokenizer):
    """Each text alone, so that it ends the block: contractions there are one token as anywhere else."""
    rng = random.Random(9)
    texts = ["it's", "we don't", "I'm", "The end of the dog's", "he'd", "'s", "x'", "x'r", "x're", "x'v", "you've", "we'll", "we'l", "don'T", "it's's", "1's", "é's", "it'ß", "it's ", "it's."]
    texts += ["".join(rng.choice("ab'stmdrevl ,1é") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    for text in texts:
        assert ids_of([text]) == expected(tokenizer, [text]), text


@pytest.mark.parametrize("block, rows", [(1, 1000), (40, 1000), (1 << 18, 3)])
def test_ids_do_not_depend_on_blocks(spark, tokenizer, monkeypatch, block, rows):
    """Whatever texts share a block or a batch, a document's checksum is that of the tokenizer's ids."""
    ends = ["'s", "'t", "'m", "'d", "'re", "'ve", "'ll", "'", "", "x"]
    texts = [f"word {i} we{ends[i % len(ends)]}" for i in range(40)]
    monkeypatch.setattr(packing, "BLOCK_BYTES", block)
    monkeypatch.setattr(packing, "SLICE", rows)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc_id", "text"])
    got = {}
    frame = type("Frame", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: list(run(iter([batch])))})()
    for out in packing.pieces(frame, PATH, 2048, 1, "doc_id", "text"):
        got |= dict(zip(out.column(0).to_pylist(), out.column(3).to_pylist()))
    want = {i: zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for i, ids in enumerate(expected(tokenizer, texts))}
    assert got == want
