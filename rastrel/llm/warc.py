"""WARC archives: writing with segmentation and chunked transfer framing, reading with reassembly.

Writing: each task makes one .warc.gz file at a time, one gzip member per record, under a name that only the attempt
that finishes gets. A payload that another record has already (the one with the smallest page id) becomes a revisit
record without it. A block longer than a segment goes on in continuation records, which carry the origin's record id,
their number and, the last one, the total length.

Reading: files are read as streams, a record at a time. Unsegmented records are complete in the task that reads
them; only segments are shuffled, grouped by the origin's id, put in order of their numbers, checked against the total
length, and then decoded like the others. What can't be read becomes a row with its fault, and reading goes on: at the
next record of the member, or the next gzip member of the file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, materialise, same, shared_path, small

#: Bytes of a block above which it is segmented: a few KB, so that a good part of all pages is.
SEGMENT = 4 << 10
#: Bytes of a chunk in the chunked transfer coding.
CHUNK = 8 << 10
#: Bytes of records after which a task begins another file.
FILE_BYTES = 256 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Bytes of a header line, and lines of a header, at most.
LINE = 64 << 10
LINES = 1000
_GZIP = b"\x1f\x8b\x08"
_READ = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_FIELDS = "record_id string, page_id string, url string, record_type string, refers_to string, payload_digest string, number int, total long, body binary, payload_bytes long, fault string"


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. ValueError if it is cut short or
    its framing is not that of the coding: a size is hexadecimal digits alone, a line break ends every chunk."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        digits = data[at:end].partition(b";")[0].strip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            raise ValueError("chunk of no size")
        size, at = int(digits, 16), end + 2
        if not size:
            return b"".join(out)
        if at + size + 2 > len(data):
            raise ValueError("chunk cut short")
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        out.append(data[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[\x20\t]*chunked", head) else body


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}", "", ""]
    return b"".join(["\r\n".join(lines).encode(), block, b"\r\n\r\n"])


def _field(text: str | None) -> str | None:
    """A value that no line break, space or other character can break out of its header line."""
    return None if text is None else quote(text, safe="")


def records(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT, unique: str = "") -> Iterator[bytes]:
    """The WARC records of a page. unique: tells rows apart that share a page id."""
    name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{unique}|{page_id}|{url}'.encode()).digest())}>"
    target = None if url is None else "".join(c if c >= " " else "%%%02X" % ord(c) for c in url)
    common = [("WARC-Record-ID", name), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Page-ID", _field(page_id))]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        yield record("revisit", [*common, kind, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", _field(refers_to))], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield record("response", [*common, kind], block)
        return
    parts = range(0, len(block), segment)
    for number, at in enumerate(parts, 1):
        part = block[at : at + segment]
        if number == 1:
            yield record("response", [*common, kind, ("WARC-Segment-Number", "1")], part)
        else:
            own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{name}|{number}'.encode()).digest())}>"
            last = str(len(block)) if number == len(parts) else None
            yield record("continuation", [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), ("WARC-Segment-Total-Length", last)], part)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """fields (names in lower case), block and fault of each record of an uncompressed archive. After a fault reading
    goes on at the next line that begins a record."""
    lost = False
    while line := stream.readline(LINE):
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                yield {}, b"", "no WARC record here"
            continue
        lost, fields = False, {}
        for _ in range(LINES):
            line = stream.readline(LINE)
            if not line.strip():
                break
            key, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                fields[key.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not re.fullmatch("[0-9]{1,15}", length):
            lost = True
            yield fields, b"", "record of no length"
            continue
        block = _take(stream, int(length))
        yield fields, block, None if len(block) == int(length) else "record cut short"


def _take(stream: BinaryIO, n: int) -> bytes:
    """n bytes or what is left of them; memory follows what is there, whatever n says."""
    out = []
    while n and (part := stream.read(min(n, 1 << 20))):
        out.append(part)
        n -= len(part)
    return b"".join(out)


class _Member(io.RawIOBase):
    """The bytes of one gzip member, taken from a source as they are needed; rest is what follows it there."""

    def __init__(self, source: BinaryIO, head: bytes):
        self.source, self.rest, self.unpack, self.ready = source, head, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready and not self.unpack.eof:
            data = self.rest or self.source.read(_READ)
            if not data:
                raise zlib.error("member cut short")
            self.rest = b""
            self.ready = self.unpack.decompress(data, _READ)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse_file(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """parse() of a file as it is or, if it begins like one, of gzip members one after another. A member that can't be
    unpacked is a fault; the next place that looks like the beginning of one is tried."""
    head = source.read(_READ)
    if not head.startswith(_GZIP):
        yield from parse(io.BufferedReader(_Plain(source, head)))
        return
    while head or (head := source.read(_READ)):
        at = head.find(_GZIP)
        if at < 0:
            head = head[-2:] + more if (more := source.read(_READ)) else b""
            continue
        member = _Member(source, head[at:])
        try:
            yield from parse(io.BufferedReader(member))
            head = member.rest
        except zlib.error:
            yield {}, b"", "member that can't be unpacked"
            head = head[at + 1 :] if len(head) > at + 3 else head[at + 1 :] + source.read(_READ)


class _Plain(io.RawIOBase):
    def __init__(self, source: BinaryIO, head: bytes):
        self.source, self.head = source, head

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head or self.source.read(_READ)
        n = min(len(buffer), len(data))
        buffer[:n], self.head = data[:n], data[n:]
        return n


def first_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """digest, first (the smallest page id): of payloads of at least `least` bytes that more than one row has."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    return sums.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")


def write_archives(pages: DataFrame, folder: str, least: int = 0, segment: int = SEGMENT, level: int = 1) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) under folder, in a store that pyarrow opens; path,
    n_records, n_bytes of the files.

    Null html is an empty payload, null ids and urls are left out of the header, what could break a header line is
    escaped; repeated rows are records each; an empty table gives no files; other columns are ignored.
    """
    firsts = materialise(first_pages(pages, least), "firsts")
    firsts = small(firsts, firsts.count())
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest")).join(firsts, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~same(F.col("page_id"), F.col("first")), F.col("first").cast("string"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        out, done, count, size, total = None, [], 0, 0, 0

        def close() -> None:
            out.close()
            path = f"{root}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            fs.move(draft, path)
            done.append((path, count, size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    draft = f"{root}/_draft-{task.taskAttemptId()}-{len(done)}-{uuid.uuid4().hex}"
                    out, count, size = fs.open_output_stream(draft, compression=None), 0, 0
                total += 1
                for one in records(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), segment, f"{task.partitionId()}-{total}"):
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(pack.compress(one) + pack.flush())
                    count, size = count + 1, size + len(one)
                if size > FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return materialise(map_batches(rows, write, "path string, n_records long, n_bytes long"), "manifest")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _row(fields: dict[str, str], block: bytes, fault: str | None, keep: bool) -> list:
    """A row of _FIELDS. Records at fault have no number, so that they are no segments."""
    kind = fields.get("warc-type")
    origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
    named = [None if (v := fields.get(k)) is None else unquote(v) for k in ("page-id", "refers-to-page-id")]
    wanted = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = [origin, named[0], fields.get("warc-target-uri"), kind, named[1], wanted, None, None, None, None, fault]
    numbers = [fields.get(k) for k in ("warc-segment-number", "warc-segment-total-length")]
    if fault is None and any(n is not None and not re.fullmatch("[0-9]{1,9}", n) for n in numbers):
        row[10] = "segment of no number"
    elif fault is None and numbers[0] is not None:
        row[6:9] = int(numbers[0]), None if numbers[1] is None else int(numbers[1]), block
    elif fault is None and kind == "response":
        row[8:] = _decoded(block, wanted, keep)
    elif fault is None and kind == "continuation":
        row[10] = "segment of no number"
    return row


def _decoded(block: bytes, wanted: str | None, keep: bool) -> list:
    """body, payload_bytes, fault."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return [None, None, str(e)]
    fault = "digest differs" if wanted and digest(payload) != wanted else None
    return [payload if keep else None, len(payload), fault]


def _arrow(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split(" ")[0] for x in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (if keep), fault (why a record's
    payload is not to be trusted, else null) of every response and revisit in the files of manifest (path), gzipped or
    not, and of every place that can't be read.

    A segmented record whose segments are not 1 to n, or don't have the total length, is at fault and has no payload.
    Revisits have no payload of their own: payload_bytes is null. Bad headers, lengths, numbers, chunks, members that
    can't be unpacked and files cut short are rows with a fault, of what is known of the record. Records of other types
    are passed over. An empty manifest gives no rows; its other columns are ignored, and a file named twice is read twice.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    for fields, block, fault in parse_file(raw):
                        if fault is None and fields.get("warc-type") not in ("response", "revisit", "continuation"):
                            continue
                        rows.append(_row(fields, block, fault, keep))
                        held += len(rows[-1][8] or b"") + 500
                        if held > 8 << 20:
                            yield _arrow(rows)
                            rows, held = [], 0
                if rows:
                    yield _arrow(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    parts = materialise(map_batches(files, read, _FIELDS), "records")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):  # one payload at a time
                segments = sorted(row["segments"], key=lambda s: s["number"])
                head = next((s for s in segments if s["number"] == 1 and s["record_type"] == "response"), None)
                body = b"".join(s["body"] for s in segments)
                totals = {s["total"] for s in segments if s["total"] is not None}
                meta = [row["record_id"], *(head[k] if head else None for k in ("page_id", "url")), "response", None, head["payload_digest"] if head else None, None, None]
                if head is None or [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or totals != {len(body)}:
                    out.append([*meta, None, None, "segments missing or of another length"])
                else:
                    out.append([*meta, *_decoded(body, head["payload_digest"], keep)])
            yield _arrow(out)

    segment = F.struct("number", "total", "record_type", "page_id", "url", "payload_digest", "body")
    joined = map_batches(parts.where("number is not null").groupBy("record_id").agg(F.collect_list(segment).alias("segments")), join, _FIELDS)
    whole = parts.where("number is null").union(joined)
    return whole.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *([F.col("body").alias("payload")] if keep else []), "fault")


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, fault of every row of pages (page_id, url, html),
    as read back from archives that it writes to the shared folder.

    Null html is an empty payload; payloads shorter than least are never revisits; rows that repeat the id of a
    payload's first page are responses too; a row without an id refers to the first page with its payload, if any has
    an id. A payload read back is checked against its digest. An empty table gives no rows; other columns are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = shared_path(spark, "warc")
    read = read_archives(spark, write_archives(pages, folder, least, segment), folder)
    read = materialise(read.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}), "read")
    needed = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("_id"), F.col("payload_digest").alias("_digest")).distinct()
    needed = materialise(needed, "needed")
    needed = small(needed, needed.count())
    responses = read.where("record_type = 'response'")
    lengths = responses.join(needed, _is(responses, needed, "page_id"), "left_semi").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    lengths = materialise(lengths, "lengths")
    lengths = small(lengths, lengths.count())
    revisits = read.where("record_type = 'revisit'")
    filled = revisits.join(lengths, _is(revisits, lengths, "refers_to"), "left").select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "fault")
    return responses.select(*filled.columns).union(filled)


def _is(records: DataFrame, table: DataFrame, column: str) -> Column:
    return (records[column] == table["_id"]) & (records["payload_digest"] == table["_digest"])
