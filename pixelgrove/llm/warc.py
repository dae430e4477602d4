"""WARC archives whose records are compressed one by one with a dictionary that the archive itself carries.

A task writes the rows of its partition as records of a file: it builds a Zstandard dictionary from a bounded sample of the
file's own records, puts it into a leading skippable frame, and makes every record a frame of its own, so that a reader
can start at any record.  A file that reaches ``file_bytes`` is followed by another, with a new dictionary.

Payloads that occur before are not stored again: of equal ones the record with the smallest id is the
response, the others are revisits that name it.  Only the digests of payloads that repeat are joined back to the rows.

Files are named by attempt and listed in a table (``write``'s result) that Spark commits, so what a lost or repeated task leaves behind
is in no list.  Paths are opened with pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_dir, sized

# The skippable frame of a dictionary, the record header and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

DICTIONARY_BYTES, SAMPLE_BYTES, RECORD_BYTES = 1 << 16, 1 << 21, 1 << 16
LEVEL = 3
_LISTED = "path string, records long, bytes long"


# ---------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def _page(urn: str) -> int | None:
    own = urn.strip("<>").split(":")[2]
    return int(own) if own else None


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """A record: a response with its payload, or a revisit that names the response of the page first."""
    digest = payload_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _one_line(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": REVISIT if revisit else None,
        "WARC-Refers-To": _urn(first, digest) if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in fields.items() if v is not None]]
    return b"\r\n".join(lines) + _END + block + _END


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode().split(":", 1) for x in lines)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive opened for reading."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    content = file.read(size)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    with io.BufferedReader(tool.stream_reader(file, read_across_frames=True), 1 << 17) as plain:
        while line := plain.readline():
            if line.rstrip(b"\r\n") != VERSION:
                raise ValueError("a record does not begin with its version")
            fields = _fields(list(iter(lambda: plain.readline().rstrip(b"\r\n"), b"")))
            block = plain.read(int(fields["content-length"]))
            if plain.read(4) != _END:
                raise ValueError("a record does not end where its length says")
            yield fields, block


# ---------------------------------------------------------------- dictionary and files


def dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary, or, of a sample too small to train on, its last bytes as raw content."""
    long = [x for x in sample if len(x) >= 64]  # the trainer cannot take few or very short samples
    total = sum(map(len, long))
    if len(long) >= 64 and total >= 16 * 4096:
        size = min(DICTIONARY_BYTES, total // 16)
        try:
            return zstandard.train_dictionary(size, long, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # nothing in the sample repeats, or everything does
            pass
    return b"".join(sample)[-DICTIONARY_BYTES:]


class _Archive:
    """One file: a dictionary frame, then a frame for each record."""

    def __init__(self, folder: str, sample: list[bytes]) -> None:
        self.path, self.count, self.size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
        system, at = fs.FileSystem.from_uri(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(at, compression=None)
        content = dictionary(sample)
        own = zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None
        self.tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        self.file.write(struct.pack("<II", DICTIONARY_MAGIC, len(content) if own else 0) + (content if own else b""))

    def add(self, data: bytes) -> None:
        frame = self.tool.compress(data)
        self.file.write(frame)
        self.count += 1
        self.size += len(frame)

    def listed(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.count]), pa.array([self.size])], ["path", "records", "bytes"])


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    page, url, html, first, revisit = (x.to_pylist() for x in batch.slice(k, 256).columns)
                    for row in zip(page, url, html, first, revisit):
                        yield record(row[0], row[1], row[2].encode(), row[3], row[4], date)

        rows = made()
        archive: _Archive | None = None
        held: list[bytes] = []
        waiting = 0
        for data in rows:
            if archive is None:
                held.append(data)
                waiting += len(data)
                if waiting < SAMPLE_BYTES:
                    continue
                archive = _Archive(folder, [x[:RECORD_BYTES] for x in held])
                for x in held:
                    archive.add(x)
                held, waiting = [], 0
            else:
                archive.add(data)
            if archive.size >= file_bytes:
                yield archive.listed()
                archive = None
        if held:
            archive = _Archive(folder, [x[:RECORD_BYTES] for x in held])
            for x in held:
                archive.add(x)
        if archive is not None:
            yield archive.listed()

    return run


def write(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record per row of pages below folder (default: the shared scratch folder) and list the files (path, records, bytes).

    Payloads of fewer than ``least`` bytes are stored each time.

    Defined cases: null and empty html have an empty payload and are equal to each other; a null url has no target; control
    characters of a url are percent-encoded; a row with a null id revisits the smallest id with its payload and is a response where there is none;
    rows equal in id and payload have one record each, with the same type and record id; other columns are ignored; an empty
    table has no file.
    """
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc"
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("html"))
    # equal payloads: by digest, length and another hash, since SHA-1 alone can be made to collide
    keys = {"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html"), "more": F.xxhash64("html")}
    seen = rows.select("page", *[v.alias(k) for k, v in keys.items()]).where(F.col("size") >= least)
    again = seen.groupBy(*keys).agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = materialise(again, "repeated")
    out = rows.withColumns(keys).join(sized(again), list(keys), "left")
    out = out.select("page", "url", "html", "first", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))).alias("revisit"))
    return materialise(out.mapInArrow(_write(folder, date, file_bytes), _LISTED), "files")


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split(" ")[0] for x in _READ.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, at = fs.FileSystem.from_uri(path)
            rows: list[tuple] = []
            held = 0
            with system.open_input_stream(at, compression=None) as file:
                for fields, block in records(file):
                    head, _, payload = block.partition(_END)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind, first = fields["warc-type"], None
                    size = int(_fields(head.split(b"\r\n")[1:])["content-length"])
                    if kind == "revisit":
                        first = _page(fields["warc-refers-to"])
                    elif len(payload) != size or payload_digest(payload) != digest:
                        raise ValueError(f"a payload in {path} does not have its digest")
                    stored = payload if payloads and kind == "response" else None
                    rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, first, stored))
                    held += len(stored or b"")
                    if len(rows) == 5000 or held >= 1 << 24:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def read(files: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Per record of the listed archives (a column path): page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for
    revisits; for all without payloads).  The payloads of responses are checked against their digests."""
    n = files.count()
    # archives are read in tasks of their own, up to several a partition slot
    spread = files.select("path").repartition(max(1, min(n, 16 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return spread.mapInArrow(_read(payloads), _READ)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """write, then read without payloads: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read(write(pages, folder, **options), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
