"""Archives: exact round trips, types of records, dictionaries and the files' own form."""

import base64
import hashlib
import os
import random
import struct

import pytest
import zstandard

from pixelgrove.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, size int, first string, revisit int, page int, more string, payload int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "f", 2, 3, "m", 4) for r in rows], SCHEMA).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        own = first.get(t or "") if len((t or "").encode()) >= least else i
        again = own is not None and own != i
        out.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", own if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    page = lambda n: "<html>\r\n\r\n" + " ".join(f"<p>w{rng.randrange(300)} é\U0001f600</p>" for _ in range(n))
    out = [(i, f"http://h{i % 7}.example/{i}", page(rng.randrange(60))) for i in range(200)]
    out += [(300 + i, "http://copy.example/", out[3][2]) for i in range(90)] + [(-5, "u", out[3][2])]
    out += [(400, None, None), (401, "", ""), (399, "a\r\nWARC-Type: x\tb", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "n", out[4][2]), (None, "n", "only here"), (None, "n", "only here")]
    out += [out[5], out[5], (402, "long", "x" * 3_000_000), (403, "x", "\r\n\r\n"), (404, "x", "\x00")]
    rng.shuffle(out)
    return out


def test_round_trip(spark, rows, tmp_path):
    files = warc.write(table(spark, rows), str(tmp_path / "warc"))
    back = warc.read(files)
    got = back.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert sum(r.records for r in files.collect()) == len(rows)
    whole = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert whole == {digest(t): (t or "").encode() for _, _, t in rows}
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    urls = {r.page_id: r.url for r in got if r.page_id is not None and r.page_id != 399}
    assert urls == {i: u for i, u, _ in rows if i is not None and i != 399}
    assert [r.url for r in got if r.page_id == 399] == ["a%0D%0AWARC-Type: x%09b"]


def test_least_length(spark, rows):
    got = warc.archive(table(spark, rows), least=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 100)


def test_many_files_and_plain_readers(spark, rows, tmp_path):
    """Files follow each other at the size bound; each begins with its dictionary, and each record is a frame of its own."""
    files = warc.write(table(spark, rows), str(tmp_path / "warc"), file_bytes=2000).collect()
    assert len(files) > 3 and {os.path.dirname(r.path) for r in files} == {str(tmp_path / "warc")}
    for r in files:
        data = open(r.path, "rb").read()
        assert len(data) >= r.bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        tool, rest, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), data[8 + size :], 0
        while rest:
            one = tool.decompressobj()
            text = one.decompress(rest)
            assert one.eof and text.startswith(b"WARC/1.1\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")
            rest, n = one.unused_data, n + 1
        assert n == r.records


def test_dictionary_of_the_archive_helps(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", f"<html><head><title>News of the day {i * i % 977}</title></head><body><nav>Home About Contact</nav><p>{i * 7919 % 10007}</p></body></html>") for i in range(4000)]
    with_own = sum(r.bytes for r in warc.write(table(spark, rows), str(tmp_path / "a")).collect())
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    without = sum(len(plain.compress(warc.record(i, u, t.encode(), None, False, "1970-01-01T00:00:00Z"))) for i, u, t in rows)
    assert with_own < 0.6 * without


def test_small_and_odd_samples():
    """The trainer is never given what it cannot take."""
    for sample in ([], [b""], [b"x"], [b""] * 63 + [b"x" * 70000], [b"abcdefg"] * 20000, [b"a" * 2000] * 64, [os.urandom(2000) for _ in range(64)], [b"q" * 1100] * 63):
        assert len(warc.dictionary(sample)) <= warc.DICTIONARY_BYTES


def test_empty_table_and_damage(spark, rows, tmp_path):
    assert warc.archive(table(spark, [])).count() == 0
    files = warc.write(table(spark, rows[:20]), str(tmp_path / "warc"))
    path = files.first().path
    data = bytearray(open(path, "rb").read())
    data[-3] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        warc.read(files).count()


def test_attempts_that_failed_leave_no_records(spark, rows, tmp_path):
    """Only listed files count: what else lies in the folder is not read."""
    folder = tmp_path / "warc"
    files = warc.write(table(spark, rows), str(folder))
    warc.write(table(spark, rows), str(folder))
    assert warc.read(files, payloads=False).count() == len(rows)
