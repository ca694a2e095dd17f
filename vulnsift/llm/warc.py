"""WARC archives: writing pages as records, and a reader that salvages what it can from damaged archives.

An archive is a run of gzip members, one record each (plain records are read too). Archives are kept as
binary rows of a Parquet table in the shared folder: every reader and every store that Spark reaches can
open them, and Spark's commit leaves whole archives only. The salvage reader checks each member and record;
after a failed check it looks for the next member or version line that checks out, goes on there, and logs
the bytes in between as a quarantined gap. Members of several records are searched in the same way, as far as they unpack.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import keep_table, rows_of

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
MIN_REVISIT = 100
#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"  # the pages carry no time of their own


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head and leaves the payload to the record it refers to."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", DATE), ("WARC-Target-URI", uri or "urn:none")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8")
    return b"WARC/1.1\r\n" + lines + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp, so that a rerun writes the same bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Salvaged:
    """Records as (offset, headers, block), and gaps as (start, end, why)."""

    records: list = field(default_factory=list)
    gaps: list = field(default_factory=list)


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | str:
    """The record that starts at `at`: headers in lower case, block and the position after it; or what is wrong."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at:at + 10]):
        return "no version line"
    end = data.find(CRLF + CRLF, at)
    if end < 0:
        return "header without end"
    headers = {}
    for line in data[at:end].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return "no content length"
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop:stop + 4] != CRLF + CRLF:
        return "record cut short or of wrong length"
    block = data[start:stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        return "block digest differs"
    want = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and want.startswith("sha256:"):
        if hashlib.sha256(block.partition(CRLF + CRLF)[2]).hexdigest() != want[7:]:
            return "payload digest differs"
    return headers, block, stop + 4


def _unzipped(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member that starts at `at` holds, the position after it, and what is wrong with it, if anything: then
    the bytes are those unpacked up to there."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos:pos + (1 << 15)]))
            pos = min(len(data), pos + (1 << 15))
    except zlib.error as e:
        # again up to the bad stretch, and on byte by byte: what that stretch gave before the error is not lost
        z = zlib.decompressobj(31)
        out = [z.decompress(data[at:pos])]
        try:
            while True:
                out.append(z.decompress(data[pos:pos + 1]))
                pos += 1
        except zlib.error:
            return b"".join(out), pos, f"gzip: {e}"
    return b"".join(out), pos - len(z.unused_data), "" if z.eof else "gzip member cut short"


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _unpacked_records(data: bytes) -> tuple[list, list]:
    """The records (headers, block) of a member's unpacked bytes that check out, and the gaps between them."""
    records, gaps, at, lost, why = [], [], 0, None, ""
    while at < len(data):
        one = parse(data, at)
        if isinstance(one, str):
            if lost is None:
                lost, why = at, one
            following = _VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            gaps.append((lost, at, why))
            lost = None
        records.append(one[:2])
        at = one[2]
    if lost is not None:
        gaps.append((lost, len(data), why))
    return records, gaps


def _one(data: bytes, at: int) -> tuple[list, int, str, list]:
    """The records of the member or plain record at `at`, the position after it, what is wrong if it has none or is damaged,
    and the reasons of gaps inside it."""
    if data[at:at + 3] != b"\x1f\x8b\x08":
        found = parse(data, at)
        return ([], at, found, []) if isinstance(found, str) else ([found[:2]], found[2], "", [])
    inner, after, why = _unzipped(data, at)
    records, gaps = _unpacked_records(inner)
    if gaps and not records:
        return [], after, why or gaps[0][2], []
    return records, after, why, [f"{reason} (unpacked bytes {a} to {b})" for a, b, reason in gaps]


def salvage(data: bytes) -> Salvaged:
    """All records of an archive that check out, and the byte gaps between them. Records of one member share its offset; a gap
    among them is logged with the member's place and the unpacked bytes it takes. A damaged member gives its records up to
    the damage, even a single one, and is logged from its start on."""
    out, at, lost, why = Salvaged(), 0, None, ""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    seen, seen_to = [], 0  # records of a damaged member, which its stored bytes may show once more
    while at < len(data):
        records, after, wrong, inside = _one(data, at)
        if at < seen_to and records and not wrong and all(r in seen for r in records):
            at = after
            continue
        if wrong and not records:
            if lost is None:
                lost, why = at, wrong
        else:
            if lost is not None and lost < at:
                out.gaps.append((lost, at, why))
            lost = None
            out.records += [(at, *r) for r in records]
            if wrong:
                lost, why, seen, seen_to = at, "; ".join([wrong, *inside]), records, after
            else:
                out.gaps += [(at, after, reason) for reason in inside]
        if wrong:
            following = starts.search(data, at + 1)
            at = following.start() if following else len(data)
        else:
            at = after
    if lost is not None:
        out.gaps.append((lost, len(data), why))
    return out


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, refers_to of every revisit: pages whose payload of MIN_REVISIT bytes or more equals that of a smaller
    page_id. Groups meet as one row per digest and task; equal pages are split by the join if they are many."""
    marks = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size")) \
        .where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    groups = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")) \
        .where(F.col("last") > F.col("refers_to"))
    hits = marks.join(groups.select("digest", "refers_to"), "digest").where(F.col("page_id") > F.col("refers_to"))
    return hits.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per row of `pages`, in archives of about ARCHIVE_BYTES each: archive, content.

    Null html is the empty payload, a null url `urn:none`. Rows with a null id are stored as responses. Of rows with the
    same id and payload, none refers to the other. An empty table gives no archives. Other columns are not read.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    planned = plan_revisits(rows).withColumnRenamed("page_id", "revisit_id").withColumnRenamed("digest", "of")
    joined = rows.join(planned, (F.col("page_id") == F.col("revisit_id")) & (F.sha2("payload", 256) == F.col("of")), "left")
    arrow = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            return rows_of(arrow, [[f"pages-{part:06d}-{number:04d}.warc.gz"], [b"".join(held)]])

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(member(record(page, url, payload, refers, refers is not None)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    number, held, size = number + 1, [], 0
        if held:
            yield closed()

    return keep_table(joined.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary"), "warc")


RECORD = ("archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
GAP = "archive string, start long, stop long, reason string"
_GAP = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string())])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that could be read from archives (archive, content): a null content holds none.

    payload_bytes is the HTTP length, payload_digest the bare hex digest of the full payload; a response whose payload
    does not match its digest is left out and shows as a gap in `quarantine`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for offset, head, block in salvage(content or b"").records:
                    http, _, payload = block.partition(CRLF + CRLF)
                    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    kind = head.get("warc-type")
                    rows.append((name, offset, page_of(head.get("warc-record-id")), int(size[1]) if size else len(payload),
                                 head.get("warc-payload-digest", "").removeprefix("sha256:"), kind,
                                 page_of(head.get("warc-refers-to")), payload if with_payload and kind == "response" else None))
                if rows:
                    yield rows_of(_RECORD, list(zip(*rows)))

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def quarantine(archives: DataFrame) -> DataFrame:
    """The byte gaps of damaged archives: where each begins and ends, and the first check that failed there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *gap) for name, content in zip(*(c.to_pylist() for c in batch.columns))
                    for gap in salvage(content or b"").gaps]
            if rows:
                yield rows_of(_GAP, list(zip(*rows)))

    return archives.select("archive", "content").mapInArrow(run, GAP)
