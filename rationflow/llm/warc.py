"""Operator 11: WARC archives whose records share a Zstandard dictionary.

``write_archive`` makes one record of every page.  Pages with equal payloads
have one ``response``, that with the largest id; the others are ``revisit``
records that name it and carry no payload.  A dictionary is trained on a
bounded sample of the records; every file begins with it in a skippable frame
and every record is a frame of its own, so a record can be read alone.

The files are written by Spark's text sink, whose commit protocol leaves no
half-written or doubled files behind when executors are lost, in any store that
Spark writes to.  The sink ends a row with a separator; here that is an empty
skippable frame, which decoders pass over, so the files stay plain Zstandard.  A
file holds at most ``FILE_ROWS`` records of at most about ``FILE_BYTES`` bytes; its
rows are filled up with empty frames so that the sink begins a new file there.

``read_archive`` reads such files record by record and works out size and digest
from the payloads themselves; those of a revisit come from its headers.

Defined cases: a null payload is empty; a null id gives records without an id,
which come before all ids; of equal rows one is the response; a null address is
left out; control signs in addresses are percent-encoded; an empty table gives an
archive without records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import new_table
from .util import named, written

# Fixed values of the formats.
DICTIONARY_MAGIC, ZSTD_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame; all its bytes are ASCII.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)

FILE_ROWS, FILE_BYTES = 4096, 16 << 20
#: The dictionary is trained on this many records, chosen by a hash of their
#: payload's digest over the whole table, and on this much of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32 << 10, 64 << 10
LEVEL = 6


def payload(column: str = "html"):
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# -- records -----------------------------------------------------------------

def record_id(page, url: str | None, digest: str, locator) -> str:
    """The same row always has the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest} {locator}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(page, url: str | None, locator, digest: str, size: int, date: str, body: bytes | None, refers_to: dict | None = None) -> bytes:
    """One record of a payload with ``size`` bytes.  A revisit, for which
    ``refers_to`` has page, url and locator of the response, holds the head of
    the answer alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to else head + body
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}",
             f"WARC-Record-ID: {record_id(page, url, digest, locator)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page is not None:
        lines.append(f"Page-ID: {page}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        to, to_url = refers_to["page"], refers_to["url"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(to, to_url, digest, refers_to['locator'])}"]
        if to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(to_url)}")
        if to is not None:
            lines.append(f"Refers-To-Page-ID: {to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, answer headers, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its block")
    answer, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in answer.decode().split("\r\n")[1:]), body


# -- frames ------------------------------------------------------------------

def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends: its header and the
    headers of its blocks are read, the blocks passed over."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    while True:
        head = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def frames(data: bytes) -> Iterator[bytes]:
    """The decompressed records of a file's bytes."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at:at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4:at + 8], "little")
            if magic == DICTIONARY_MAGIC and end > at + 8:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8:end])))
        elif magic == ZSTD_MAGIC:
            end = frame_end(view, at)
            yield reader.decompress(view[at:end])
        else:
            raise ValueError(f"no frame at byte {at}")
        at = end


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where there are too few to train on, they
    are the dictionary themselves."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


# -- Spark -------------------------------------------------------------------

def leaders(rows: DataFrame, least: int = 0) -> DataFrame:
    """Of every payload that several rows have: its digest and the row that
    is the response.  Rows are a locator, an id, an address and a digest here,
    folded in each task before they meet, so a common payload is no hot group."""
    return (rows.where(F.col("size") >= least).groupBy(F.col("sha").alias("_sha"))
            .agg(F.count("*").alias("_n"), F.max(F.struct(F.col("page_id").alias("page"), "locator", "url")).alias("to"))
            .where("_n > 1").select("_sha", "to"))


def dictionary(pages: DataFrame, date: str) -> bytes:
    """Trained in one task on the bounded sample."""
    lot = F.shiftrightunsigned(F.xxhash64("page_id", "sha", "locator"), 11) / float(1 << 53)
    share = 2.0 * SAMPLE_ROWS / max(1, pages.count())  # twice what is taken, so that few rows meet
    rows = (pages.select("page_id", "url", "locator", "sha", "size", F.substring("body", 1, SAMPLE_BYTES).alias("body"), lot.alias("lot"))
            .where((F.col("lot") < share) & (F.col("size") > 0)).orderBy("lot", "locator").limit(SAMPLE_ROWS))

    def run(batches):
        samples = [record(page, url, loc, base32(bytes.fromhex(sha)), size, date, body)
                   for b in batches for page, url, loc, sha, size, body, _ in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], names=["d"])

    found = rows.coalesce(1).mapInArrow(run, "d binary").collect()  # one row of at most DICTIONARY_BYTES
    return bytes(found[0]["d"]) if found else b""


def _packer(words: bytes, date: str, file_rows: int, file_bytes: int):
    """Rows of pages -> rows of frames; each file's worth begins with the
    dictionary and is filled up to ``file_rows`` rows."""
    def run(batches):
        shared = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **shared)
        rows = size = 0
        for b in batches:
            out = []
            for page, url, loc, sha, n, body, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                frame = packer.compress(record(page, url, loc, base32(bytes.fromhex(sha)), n, date, body, to))
                if rows and (rows == file_rows or size + len(frame) > file_bytes):
                    out += [b""] * (file_rows - rows)
                    rows = size = 0
                if not rows:
                    out.append(dictionary_frame(words))
                    rows = 1
                out.append(frame)
                rows, size = rows + 1, size + len(frame)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def write_archive(pages: DataFrame, path: str, date: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html",
                  locator: str | None = None, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> None:
    """Writes the records of ``pages`` to files under ``path``.  ``least``: bytes
    a payload has at least to be revisited.  ``locator``: a column that tells
    equal rows apart (such as file and row number); without it the pages are
    written once to give them one."""
    src = pages.select(named(key).alias("page_id"), named(url).cast("string").alias("url"), payload(html).alias("body"),
                       *([named(locator).alias("locator")] if locator else []))
    if not locator:
        src = written(src.withColumn("locator", F.monotonically_increasing_id()))
    src = src.withColumns({"sha": F.sha1("body"), "size": F.octet_length("body")})
    words = dictionary(src, date)
    # written, so that Spark knows how small it is and broadcasts it if it may
    first = written(leaders(src.select("page_id", "url", "locator", "sha", "size"), least))
    copy = F.col("to").isNotNull() & (F.col("locator") != F.col("to.locator"))
    rows = src.join(first, (F.col("sha") == F.col("_sha")) & (F.col("size") >= least), "left").select(
        "page_id", "url", "locator", "sha", "size", F.when(~copy, F.col("body")).alias("body"), F.when(copy, F.col("to")).alias("to"))
    (rows.mapInArrow(_packer(words, date, file_rows, file_bytes), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", file_rows).text(path))


RECORDS = StructType([StructField("page_id", LongType()), StructField("payload_bytes", LongType()),
                      StructField("payload_digest", StringType()), StructField("record_type", StringType()),
                      StructField("refers_to", LongType()), StructField("record_id", StringType()),
                      StructField("refers_to_record", StringType()), StructField("url", StringType()), StructField("payload", BinaryType())])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record (``RECORDS``); the payload of a revisit is null."""
    def rows(data):
        for raw in frames(data):
            fields, answer, body = parse(raw)
            kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (base32(hashlib.sha1(body).digest()) != sha or len(body) != int(answer["Content-Length"])):
                raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
            number = lambda name: int(fields[name]) if name in fields else None
            yield (number("Page-ID"), int(answer["Content-Length"]), sha, kind, number("Refers-To-Page-ID"), fields["WARC-Record-ID"],
                   fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"), body if kind == "response" else None)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                        ("refers_to_record", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for data in b.column(0):
                part, size = [], 0
                for r in rows(data.as_py()):
                    part.append(r)
                    size += r[1]
                    if len(part) == 1000 or size > FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, date: str, locator: str | None = None, **columns) -> DataFrame:
    """Writes the archive into the shared folder and reads it back."""
    path = new_table(pages.sparkSession, "warc")
    write_archive(pages, path, date, locator=locator, **columns)
    return read_archive(pages.sparkSession, path)
