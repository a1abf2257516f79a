"""WARC archives: writer with deduplicated payloads, and a splittable reader.

Writer: every record is a gzip member of its own. Of records with equal payloads
of at least ``min_bytes`` bytes, the one with the smallest id is a response and
the others are revisit records that refer to it. Members go through Spark's own
writer, so archives can lie in any store: a member ends in the high byte of its
length, which is 0, and the writer puts that byte there as its line separator
(a member of 16 MB or more gets an empty member behind it, which ends so too).

Reader: tasks scan byte ranges for the gzip magic (it is the line separator of the
scan) and a range owns the records that start inside it. The magic can also occur
within compressed data: a candidate member is only taken for one if its header
decodes to a WARC header, otherwise its bytes continue the member before. Where a
member's rest lies behind such a false magic in a later range, both pieces are
kept as fragments and put together afterwards. A file whose name ends in ``.gz`` is read
in the same way, but by one task, as Spark cuts no file of that name into ranges.

Defined results: null payloads are empty; a null id or url leaves its header out;
control characters in a url are percent-encoded; of equal ids with equal payloads
the smallest url is the response, and rows equal in all three are the same record
and so are all responses; damaged members are returned as ``damaged``
records, never dropped; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import map_arrow, small_batches

MAGIC = b"\x1f\x8b\x08"
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
_RECORD = "id string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, verified boolean"
_SCAN = f"kind string, path string, block long, seq long, data binary, {_RECORD}"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(fields: list[tuple[str, str | None]], block: bytes, level: int = LEVEL) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.flush()
    return out


def _record_id(page: str | None, url: str | None) -> str:
    return f"<urn:page:{'' if page is None else page}:{zlib.crc32((url or '').encode())}>"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = LEVEL) -> None:
    """Write archives below ``path``; ids are kept as text."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    first = rows.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min(F.struct(F.col("id").isNull(), "id", "url")).alias("first"))
    first = first.select("sha", F.lit(True).alias("shared"), F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"))
    rows = rows.join(first, "sha", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "shared", "first_id", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, url, payload, shared, *first in zip(*(c.to_pylist() for c in b.columns)):
                revisit = bool(shared) and [i, url] != first
                own, other = _record_id(i, url), _record_id(*first)
                if url is not None:
                    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", other)]
                out.append(member(fields, http if revisit else http + payload, level)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = map_arrow(rows, run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def _inflate(data: bytes) -> tuple[bytes, bool]:
    """What can be decoded of the first member in ``data``, and whether it is whole."""
    unpacker = zlib.decompressobj(31)
    try:
        out = unpacker.decompress(data)
    except zlib.error:
        return b"", False
    return out, unpacker.eof


def _starts(data: bytes) -> bool:
    """Whether a candidate's header decodes to the head of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 5) == b"WARC/"
    except zlib.error:
        return False


def _empty_member(data: bytes) -> bool:
    return len(data) <= 64 and _inflate(data) == (b"", True)


def _between(text: str | None) -> str | None:
    """The id in a record id."""
    found = re.fullmatch(r"<urn:page:(.*):\d+>", text or "", re.DOTALL)
    return found[1] or None if found else None


def parse(data: bytes) -> tuple:
    """The columns of one record; ``verified``: the payload has the digest its header names."""
    raw, whole = _inflate(data)
    head, split, block = raw.partition(b"\r\n\r\n")
    if not whole or not split or not head.startswith(b"WARC/"):
        return (None, "damaged", None, None, None, None, None, data, False)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.lower()] = v.strip()
    block = block[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    own = (_between(fields.get("warc-record-id")), kind, fields.get("warc-record-id"), _between(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        return (*own, named, int(size[1]) if size else None, None, None)
    found = digest(payload)
    return (*own, found, len(payload), payload, found == named)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole records (kind ``record``), and pieces of members cut by a false magic."""
    small_batches(spark)
    # the reader must not inflate files named .gz: members are told apart here
    as_is = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    reader = spark.read.option("io.compression.codecs", as_is.CLASSNAME).option(as_is.OPT_EXTENSION, ".gz")
    lines = reader.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seq, out = None, None, 0, []

        def close() -> None:  # the end of a range: the member may go on in the next one
            if held is not None:
                out.append(("piece", *at, seq, held, *[None] * 9))

        for b in batches:
            for value, *where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if where != at:
                    close()
                    at, held, seq = where, None, 0
                    if where[1] == 0 and not value:
                        continue  # before the first magic
                data = MAGIC + value
                if _starts(data) or _empty_member(data):
                    if held is not None:
                        out.append(("record", *at, seq, None, *parse(held)))
                    held = None if _empty_member(data) else data
                elif held is not None:
                    held += data
                else:
                    out.append(("piece", *at, seq, data, *[None] * 9))
                if held is not None and _inflate(held)[1]:
                    out.append(("record", *at, seq, None, *parse(held)))
                    held = None
                seq += 1
            yield _batch(out)
            out = []
        close()
        yield _batch(out)

    return map_arrow(lines, run, _SCAN)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _SCAN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _stitch(pieces: pa.Table) -> pa.Table:
    """Put the pieces of one file together, in the order of their ranges."""
    rows = sorted(zip(*(pieces.column(c).to_pylist() for c in ("block", "seq", "data"))), key=lambda r: r[:2])
    out, held = [], None
    for block, seq, data in rows:
        if _starts(data):
            if held is not None:
                out.append(("record", None, block, seq, None, *parse(held)))
            held = data
        else:
            held = (held or b"") + data
        if _inflate(held)[1]:
            out.append(("record", None, block, seq, None, *parse(held)))
            held = None
    if held is not None:
        out.append(("record", None, 0, 0, None, *parse(held)))
    return pa.Table.from_batches([_batch(out)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    found = scan(spark, path)
    mended = found.where(F.col("kind") == "piece").select("path", "block", "seq", "data").groupBy("path").applyInArrow(_stitch, _SCAN)
    return found.where(F.col("kind") == "record").unionByName(mended).select(*names)


