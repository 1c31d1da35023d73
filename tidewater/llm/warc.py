"""WARC archives: writing pages as records, and reading them back.

Writing: every page is a `response` record whose block is an HTTP message
with a chunked body.  Of pages with equal payloads of at least
`revisit_min` bytes the one with the largest page_id is written in full and
the others as `revisit` records without payload.  A block longer than
`segment_bytes` is cut into segments: the first record carries
WARC-Segment-Number 1, the rest are `continuation` records that name the
first one as WARC-Segment-Origin-ID, and the last states
WARC-Segment-Total-Length.  Spark's text writer puts the records down (the
record separator CRLF CRLF is its line separator) as gzip files in any store
that Spark writes to; a file holds at most `records_per_file` records of
about `segment_bytes`, so reading one back takes bounded memory.

Reading: files are parsed record by record.  Records in one piece are
decoded where they are read; only segments are shuffled: grouped by origin
identifier, ordered by segment number, checked for gaps and against the
stated total length, joined, and decoded from their chunked framing.

Payloads are grouped by their SHA-256 and length, with map-side
aggregation; only groups of two or more join back, and those that hold more
than a shuffle partition's share of the pages do so by broadcast, so that
their payloads don't meet in one task.

Defined results: a null html is an empty payload; a null url has no target
URI; a null page_id is always a response; rows that share a page_id are
records of their own, and where that page_id is the largest of equal
payloads all its rows are responses; archives may be plain, one gzip stream or a member
per record; a message that is cut, garbled or misses a segment comes back
with `complete` false and a null payload, bytes that are no record are
skipped, and records of other kinds (warcinfo, request, metadata) are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, in_slices, ready, release, shuffle_partitions, stored

REVISIT_MIN = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 2000
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ----------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes | None:
    """The payload of an HTTP message, without its transfer coding."""
    head, sep, body = message.partition(_END)
    if not sep:
        return None
    fields = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    if any(k.strip() == b"transfer-encoding" and v.strip() == b"chunked" for k, _, v in fields):
        return dechunked(body)
    return body


def _record(fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(
        f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url)


def page_records(page_id: int | None, row: int, url: str | None, digest: str, payload: bytes,
                 refers_to: int | None, date: str, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the separator that ends each."""
    def name(n: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{row}/{n}')}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END
    common = {"WARC-Date": date, "WARC-Target-URI": _uri(url), "WARC-Page-Id": page_id}
    first = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(1), **common,
             "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        return [_record({**first, "WARC-Profile": _PROFILE, "WARC-Refers-To-Page-Id": refers_to}, head)]
    block = head + chunked(payload)
    first["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    out, cuts = [], range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        fields = first if n == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": name(n), **common,
                                       "WARC-Segment-Origin-ID": name(1)}
        total = len(block) if n == len(cuts) else None
        out.append(_record({**fields, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": total},
                           block[at:at + segment_bytes]))
    return out


_MARK = b"WARC/"


def inflated(content: bytes) -> bytes:
    """An archive's bytes: as they are, or all gzip members one after the
    other, as far as they can be read."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content:
        member = zlib.decompressobj(47)
        try:
            out.append(member.decompress(content))
            out.append(member.flush())
        except zlib.error:
            break
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields with lower-case names, block, whether it is whole) of each
    record.  What is no record is skipped up to the next one."""
    at = data.find(_MARK)
    while at >= 0:
        end = data.find(_END, at)
        fields = {}
        for line in data[at:max(end, at)].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = fields.get("content-length", "")
        if end < 0 or not size.isdecimal() or "warc-type" not in fields:
            nearest = data.find(b"\r\n" + _MARK, at + 1)
            at = nearest + 2 if nearest >= 0 else -1
            continue
        start, size = end + 4, int(size)
        yield fields, data[start:start + size], start + size <= len(data)
        at = data.find(_MARK, start + size)


# --- writing ------------------------------------------------------------------------

def _write(date: str, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "payload"):
            out = []
            for args in zip(*columns_of(batch, "page_id", "row", "url", "digest", "payload", "refers_to")):
                out += page_records(*args, date, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return run


def write_archives(pages: DataFrame, path: str, *, date: str = "2026-01-01T00:00:00Z", revisit_min: int = REVISIT_MIN,
                   segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write `pages` (page_id, url, html) as archives under `path`."""
    ready(pages)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                       F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("strong", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    same = stored(src.where((F.col("size") >= revisit_min) & F.col("page_id").isNotNull()).groupBy("strong", "size")
                  .agg(F.max("page_id").alias("target"), F.min("page_id").alias("least"), F.count("*").alias("n"))
                  .where("target != least"), "equal-payloads")
    hot = F.col("n") * shuffle_partitions(pages.sparkSession) > same.agg(F.sum("n")).scalar()   # fewer than there are partitions
    few = F.broadcast(same.where(hot).select("strong", "size", F.col("target").alias("hot_target")))
    rows = (src.join(few, ["strong", "size"], "left")
            .withColumn("rest", F.when(F.col("hot_target").isNull(), F.col("strong")).otherwise(
                F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
            .join(same.where(~hot).select(F.col("strong").alias("rest"), "size", "target"), ["rest", "size"], "left")
            .withColumn("target", F.coalesce("hot_target", "target")).select(
        "page_id", F.monotonically_increasing_id().alias("row"), "url", F.sha1("payload").alias("digest"), "payload",
        F.when(F.col("target") != F.col("page_id"), F.col("target")).alias("refers_to")))
    (rows.mapInArrow(_write(date, segment_bytes), "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", _END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


# --- reading ------------------------------------------------------------------------

_PIECES = "page_id long, record_type string, refers_to long, origin string, number long, total long, payload binary"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("payload", pa.binary())])


def _integer(v: str | None) -> int | None:
    return int(v) if v and v.lstrip("-").isdecimal() else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in one piece (no segment number), decoded, and segments with
    their part of the block; other kinds of records are left out."""
    for batch in batches:
        for (content,) in zip(*columns_of(batch, "content")):
            rows, held = [], 0
            for f, block, whole in records_in(inflated(content)):
                kind, number = f["warc-type"], _integer(f.get("warc-segment-number"))
                if kind not in ("response", "revisit", "continuation"):
                    continue
                name = f.get("warc-record-id")
                if number is None:
                    origin, payload = name, payload_of(block) if kind == "response" and whole else None
                else:
                    origin, payload = f.get("warc-segment-origin-id", name), block
                rows.append((_integer(f.get("warc-page-id")), kind, _integer(f.get("warc-refers-to-page-id")),
                             origin, number, _integer(f.get("warc-segment-total-length")), payload))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)],
                                                     schema=_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)],
                                                 schema=_SCHEMA)
        release()


def _reassemble(parts: pa.Table) -> pa.Table:
    """One record from its segments, by number; a repeated segment is used once."""
    rows = {n: (p, t, page, kind) for n, p, t, page, kind in zip(*(
        parts.column(c).to_pylist() for c in ("number", "payload", "total", "page_id", "record_type")))}
    block = b"".join(rows[n][0] for n in sorted(rows))
    total = next((t for _, t, _, _ in rows.values() if t is not None), None)
    whole = sorted(rows) == list(range(1, len(rows) + 1)) and total == len(block)
    payload = payload_of(block) if whole else None
    page = next((p for _, _, p, _ in rows.values() if p is not None), None)
    return pa.table({"page_id": pa.array([page], pa.int64()), "record_type": pa.array(["response"]),
                     "refers_to": pa.array([None], pa.int64()), "n_segments": pa.array([len(rows)], pa.int64()),
                     "payload": pa.array([payload], pa.binary())})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, record_type, refers_to, n_segments,
    payload (null in a revisit), complete."""
    files = spark.read.format("binaryFile").load(path).select("content")
    ready(files)
    pieces = stored(files.mapInArrow(_parse, _PIECES), "pieces")           # every archive is read once
    single = pieces.where("number is null").select(
        "page_id", "record_type", "refers_to", F.lit(1).cast("long").alias("n_segments"), "payload")
    joined = (pieces.where("number is not null").groupBy("origin")
              .applyInArrow(_reassemble, "page_id long, record_type string, refers_to long, n_segments long, payload binary"))
    return single.unionByName(joined).withColumn(
        "complete", F.col("payload").isNotNull() | (F.col("record_type") == "revisit"))
