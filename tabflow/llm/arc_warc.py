"""Legacy archive converter: ARC 1.x / 2.x records to WARC 1.0, and a WARC reader.

ARC: every file opens with a version block whose second line tells the version
and whose third line names the header fields; each record is one header line,
then as many content bytes as its last field declares. The URL may hold stray
spaces, so header lines are split from the right. Broken lines are skipped until
the next readable header.

WARC: identifiers are name-based UUIDs of (archive, offset), 14-digit dates become
ISO 8601, records with an HTTP response inside become ``response`` and others
``resource``, and payload and block digests are taken from the bytes. Records
with equal payloads of at least ``min_bytes`` are written once: the one with the
largest key stays, the others become ``revisit`` records that refer to it.

Both kinds of file are written by Spark's text writer (its committer handles lost
tasks; the record separators are the formats' own) and read as binary files, so
any store that Spark knows will do. A task holds one archive at a time; archives
are as large as an input partition.

Defined results: a null page is an empty payload; a null or blank URL becomes
``http://unknown.invalid/``, white space inside one is percent-encoded; rows with
a null key are written without it, refer to a keyed copy if there is one and are
responses otherwise; repeated rows that share the largest key are all responses;
an empty table makes no archive and an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import ready, small_side
from tabflow.session import scratch_path

MIN_REVISIT_BYTES = 1000
KEY_HEADER = "X-Record-Key"
UNKNOWN_URL = "http://unknown.invalid/"
_CRLF = b"\r\n"
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = ("archive string, offset long, version int, url string, ip string, date string, mime string, is_http boolean, "
          "record_key long, payload_bytes long, payload_sha1 string, record_id string")
WARC_ROW = ("record_type string, record_id string, url string, date string, record_key long, payload_bytes long, "
            "payload_digest string, refers_to_id string, refers_to_key long, digest_ok boolean")


def _unzip(data: bytes) -> tuple[bytes, frozenset[int]]:
    """Content of a plain file or of all members of a gzip file, and where in it the
    file and each member start."""
    if data[:2] != b"\x1f\x8b":
        return data, frozenset([0])
    out, starts, size = [], [], 0
    while data:
        z = zlib.decompressobj(31)
        starts.append(size)
        out.append(z.decompress(data))
        size += len(out[-1])
        data = z.unused_data.lstrip(b"\0")
    return b"".join(out), frozenset(starts)


def _head(block: bytes | memoryview) -> int:
    """Length of the HTTP head of a block (0 if it has none): up to the first empty
    line, whichever way lines end."""
    if bytes(block[:5]) != b"HTTP/":
        return 0
    for size in (1 << 16, len(block)):
        part = bytes(block[:size])
        ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := part.find(mark)) >= 0]
        if ends:
            return min(ends)
    return 0


def _header_value(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return m.group(1).decode("utf-8", "replace") if m else None


def _key(head: bytes) -> int | None:
    v = _header_value(head, KEY_HEADER)
    return int(v) if v and re.fullmatch(r"-?\d+", v) else None


def clean_url(url: str | None) -> str:
    u = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), (url or "").strip())
    return u or UNKNOWN_URL


# ---------------------------------------------------------------- ARC
def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
              date: str = "20010203040506") -> None:
    """Archives the pages as gzipped ARC files: version 1 and version 2 in turn, one
    file per partition, each opening with its version block."""
    ready(pages.sparkSession)
    src = pages.select(pages[id_col].cast("long").alias("k"), pages[url_col].cast("string").alias("u"),
                       F.coalesce(pages[body_col].cast("binary"), F.lit(b"")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"pages-{part:06d}.arc"
        opened, offset = False, 0
        for batch in batches:
            out, held = [], 0
            if not opened and batch.num_rows:
                opened = True
                body = f"{version} 0 Archive\n{_FIELDS[version]}\n".encode()
                more = "200 - - 0 " + name + " " if version == 2 else ""
                out.append(f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n".encode() + body)
                offset += len(out[-1]) + 1
            for k, u, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                html = html.as_py()
                key = f"{KEY_HEADER}: {k}\r\n" if k is not None else ""
                content = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n"
                           f"{key}\r\n").encode() + html
                more = ""
                if version == 2:
                    more = f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
                out.append(f"{clean_url(u)} 0.0.0.0 {date} text/html {more}{len(content)}\n".encode() + content)
                offset += len(out[-1]) + 1
                held += len(out[-1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])

    rows = src.mapInArrow(run, "r binary").select(F.col("r").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _version_block(content: bytes) -> tuple[int, list[str]] | None:
    """Version and field names of a version block's content; None if it is none."""
    lines = content.decode("utf-8", "replace").splitlines()
    if len(lines) > 1 and re.match(r"[12]( |$)", lines[0]) and lines[1].startswith("URL"):
        return int(lines[0].split()[0]), lines[1].split()
    return None


def parse_arc(data: bytes, starts: frozenset[int] = frozenset([0])) -> Iterator[tuple[int, int, dict, memoryview]]:
    """(offset, version, header fields, content) of every record after the version block.

    A version block opens the file, or a gzip member of a file put together from
    several (``starts``). Anywhere else a ``filedesc:`` url is a url like any other."""
    view, pos, n = memoryview(data), 0, len(data)
    version, names = 1, _FIELDS[1].split()
    while pos < n:
        end = data.find(b"\n", pos)
        if end < 0:
            return
        line = data[pos:end].rstrip(b"\r").decode("utf-8", "replace")
        opens = line.split(" ") if pos in starts and line.startswith("filedesc:") else []
        if len(opens) >= 5 and re.fullmatch("[0-9]+", opens[-1]):
            size = int(opens[-1])
            found = _version_block(bytes(view[end + 1:end + 1 + size]))
            if found:
                version, names = found
                pos = end + 1 + size
                pos += data[pos:pos + 1] == b"\n"
                continue
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) < 5 or not re.fullmatch("[0-9]+", parts[-1]):
            pos = end + 1
            continue
        size = int(parts[-1])
        content = view[end + 1:end + 1 + size]
        if len(parts) == len(names):
            yield pos, version, dict(zip(names, parts, strict=True)), content
        else:
            pos = end + 1
            continue
        pos = end + 1 + size
        if data[pos:pos + 1] == b"\n":
            pos += 1


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def read_arc(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """The records of the ARC files under ``path``; with their content on request."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    schema = RECORD + (", block binary" if with_block else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(),
             pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.binary()] if with_block else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                data, starts = _unzip(batch.column(1)[i].as_py())
                cols: list[list] = [[] for _ in names]
                held = 0
                for offset, version, h, content in parse_arc(data, starts):
                    cut = _head(content)
                    head = bytes(content[:cut])
                    row = [name, offset, version, h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], cut > 0,
                           _key(head), len(content) - cut, hashlib.sha1(content[cut:]).hexdigest(),
                           uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}#{h['URL']}#{h['Archive-date']}").urn]
                    if with_block:
                        row.append(bytes(content))
                        held += len(content)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                    if held > 4_000_000 or len(cols[0]) >= 5000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols, types)), names=names)
                        cols, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols, types)), names=names)

    return files.mapInArrow(run, schema)


def iso_date(date: str) -> str:
    """14-digit (or shorter) ARC date to ISO 8601; unreadable ones to the epoch."""
    d = re.sub(r"\D", "", date or "")
    d = (d + "00000101000000"[len(d):])[:14] if len(d) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


# ---------------------------------------------------------------- WARC
def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes the ARC files under ``arc_path`` as gzipped WARC files to ``warc_path``.

    The archives are parsed twice: once for digests, which alone are grouped, once
    for the contents, which meet the few payloads that occur more than once."""
    records = read_arc(spark, arc_path).where((F.col("payload_bytes") >= min_bytes) & F.col("is_http"))
    stays = F.max(F.struct("record_key", "record_id", "url", "date")).alias("m")
    repeated = (records.groupBy("payload_sha1", "payload_bytes").agg(F.count("*").alias("n"), stays)
                .where((F.col("n") > 1) & F.col("m.record_key").isNotNull())
                .select("payload_sha1", "payload_bytes", F.col("m.record_key").alias("to_key"), F.col("m.record_id").alias("to_id"),
                        F.col("m.url").alias("to_url"), F.col("m.date").alias("to_date")))
    rows = (read_arc(spark, arc_path, with_block=True)
            .join(small_side(repeated, "warc-repeated", 100_000), ["payload_sha1", "payload_bytes"], "left"))
    again = F.col("to_key").isNotNull() & F.col("is_http") & (F.col("record_key").isNull() | (F.col("record_key") < F.col("to_key")))
    rows = rows.select("url", "ip", "date", "mime", "is_http", "record_id", "payload_sha1", "payload_bytes", "block",
                       *[F.when(again, F.col(c)).alias(c) for c in ("to_key", "to_id", "to_url", "to_date")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened = TaskContext.get().partitionId(), False
        for batch in batches:
            out, held = [], 0
            for r in _rows(batch):
                if not opened:
                    opened = True
                    out.append(_info(part))
                out.append(warc_record(r))
                held += len(out[-1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])

    out = rows.mapInArrow(run, "r binary").select(F.col("r").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}


def _serial(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block


def _info(part: int) -> bytes:
    block = b"software: ARC to WARC conversion\r\nformat: WARC File Format 1.0\r\n"
    return _serial([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo-{part}').urn}>"),
                    ("WARC-Date", "2001-02-03T04:05:06Z"), ("Content-Type", "application/warc-fields")], block)


def warc_record(r: dict) -> bytes:
    """One WARC record without its trailing separator."""
    block, revisit = r["block"], r["to_id"] is not None
    if revisit:
        block = block[:_head(block)]
    kind = "revisit" if revisit else "response" if r["is_http"] else "resource"
    h = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Target-URI", clean_url(r["url"])),
         ("WARC-Date", iso_date(r["date"])), ("WARC-IP-Address", r["ip"]),
         ("WARC-Payload-Digest", _b32(bytes.fromhex(r["payload_sha1"]))), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
         ("Payload-Length", str(r["payload_bytes"]))]
    if revisit:
        h += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
              ("WARC-Refers-To", f"<{r['to_id']}>"), ("WARC-Refers-To-Target-URI", clean_url(r["to_url"])),
              ("WARC-Refers-To-Date", iso_date(r["to_date"])), ("Refers-To-Key", str(r["to_key"]))]
    h.append(("Content-Type", "application/http; msgtype=response" if r["is_http"] else r["mime"]))
    return _serial(h, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict, memoryview]]:
    """(header fields in lower case, block) of every record, by declared lengths."""
    view, pos = memoryview(data), 0
    while True:
        pos = data.find(b"WARC/", pos)
        if pos < 0:
            return
        end = data.find(b"\r\n\r\n", pos)
        if end < 0:
            return
        lines = data[pos:end].decode("utf-8", "replace").split("\r\n")[1:]
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(h.get("content-length", "0"))
        yield h, view[end + 4:end + 4 + size]
        pos = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path`` (without warcinfo). Payload sizes
    and digests of responses come from their bytes, those of revisits from their
    headers; ``digest_ok`` tells whether header and bytes agree."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    names = [f.split()[0] for f in WARC_ROW.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def row(h: dict, block: memoryview) -> list:
        cut = _head(block)
        said = h.get("warc-payload-digest", "").partition(":")[2]
        said = base64.b32decode(said).hex() if said else None
        if h["warc-type"] == "revisit":
            size, digest = int(h.get("payload-length", "0")), said
            ok = _b32(hashlib.sha1(block).digest()) == h.get("warc-block-digest")
        else:
            size, digest = len(block) - cut, hashlib.sha1(block[cut:]).hexdigest()
            ok = digest == said
        to = h.get("refers-to-key")
        return [h["warc-type"], h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), h.get("warc-date"), _key(bytes(block[:cut])),
                size, digest, h.get("warc-refers-to", "").strip("<>") or None, int(to) if to else None, ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cols: list[list] = [[] for _ in names]
                for h, block in parse_warc(_unzip(batch.column(0)[i].as_py())[0]):
                    if h.get("warc-type") in (None, "warcinfo"):
                        continue
                    for col, v in zip(cols, row(h, block), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols, types)), names=names)

    return files.mapInArrow(run, WARC_ROW)


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, **columns) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC read back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, digest_ok``."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, **columns)
    convert(spark, arc, warc, min_bytes)
    return read_warc(spark, warc).select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         F.col("refers_to_key").alias("refers_to"), "digest_ok")
