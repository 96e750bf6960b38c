"""WARC archives: writer with revisit records, and a salvage reader.

The writer makes one gzip member per record (or plain records), rolls files
at a size bound, and lists the finished files in a table; a file that no
finished task lists is never read. Of records with equal payloads the one
with the largest id is the response; the others are revisits of it.

The reader takes files in byte ranges. It checks every member (gzip checksum,
version line, lengths, payload digest). After a failed check it searches for
the next member or version line that checks, goes on from there, and logs the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.llm.shared import file_system, run_folder, staged, text_bytes

VERSION = b"WARC/1.1\r\n"
FILE_BYTES = 32_000_000
#: Above the writer's file size: only foreign files are read in several ranges.
RANGE_BYTES = 64_000_000
MAGIC = b"\x1f\x8b\x08"
_START = {True: re.compile(rb"\x1f\x8b\x08"), False: re.compile(rb"WARC/1\.[01]\r\n")}
_VERSIONS = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")

RECORDS = ("path string, position long, bytes long, gap boolean, reason string, record_type string, record_id string, "
           "uri string, payload_digest string, payload_bytes long, refers_to string, payload binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, sha1: str, size: int, refers_to: str | None) -> bytes:
    """One record, its two closing line ends included."""
    body = payload if kind == "response" else b""
    lines = [b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">",
             b"WARC-Target-URI: " + re.sub(r"[\r\n]", " ", uri).encode(),
             b"WARC-Payload-Digest: sha1:" + sha1.encode(), b"X-Payload-Length: %d" % size]
    if refers_to is not None:
        lines.append(b"WARC-Refers-To: <" + refers_to.encode() + b">")
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(b"Content-Type: text/html")
    lines.append(b"Content-Length: %d" % len(body))
    return VERSION + b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _writer(folder: str, compress: bool):
    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, size, records = fs.open_output_stream(path, compression=None), 0, 0
                payload = r["payload"]
                raw = record("response" if r["refers_to"] is None else "revisit", r["record_id"], r["uri"], payload,
                             digest(payload), len(payload), r["refers_to"])
                raw = _member(raw) if compress else raw
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], names=["path", "size", "records"])
    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, compress: bool = True) -> tuple[DataFrame, str]:
    """Write ``pages(page_id, url, html)``; returns the table of files
    (path, size, records) and the folder's URI.

    A null html is an empty payload and a null url an empty one. Payloads
    below ``min_bytes`` are always responses. Rows that repeat the largest id
    of their payload are responses all; a null id counts as the smallest, is
    kept, and refers to the response by its id. Other columns are ignored."""
    spark = pages.sparkSession
    folder = run_folder(spark, "archives")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("uri"),
                        text_bytes("html").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.length("payload"))
    # the largest id of each payload; a hot payload is one row of the join's small side
    firsts = rows.filter(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first"))
    known = rows.join(firsts, ["sha", "n"], "left")
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    files = known.select(urn.alias("record_id"), "uri", "payload",
                         F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to")) \
        .mapInArrow(_writer(folder, compress), "path string, size long, records long")
    return staged(files, "files"), folder


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, body and length of the record at the start of ``raw``, or
    nothing if a check fails."""
    if not raw.startswith(_VERSIONS):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    head: dict[str, str] = {}
    for line in raw[10:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in head or "warc-record-id" not in head:
        return None
    stop = end + 4 + int(size)
    if raw[stop:stop + 4] != b"\r\n\r\n":
        return None
    body = raw[end + 4:stop]
    want = head.get("warc-payload-digest", "")
    if head["warc-type"] == "response" and want.startswith("sha1:") and digest(body) != want[5:]:
        return None
    return head, body, stop + 4


class _Bytes:
    """A file seen through a window that slides forward."""

    def __init__(self, stream, size: int, ahead: int = 1 << 20):
        self.stream, self.size, self.ahead = stream, size, ahead
        self.start, self.data = 0, b""

    def at(self, position: int, want: int) -> bytes:
        """Up to ``want`` bytes from a position on."""
        stop = min(position + want, self.size)
        if position < self.start or stop > self.start + len(self.data):
            self.stream.seek(position)
            self.start, self.data = position, self.stream.read(max(stop - position, min(self.ahead, self.size - position)))
        return self.data[position - self.start:stop - self.start]


def _record_at(src: _Bytes, position: int, compressed: bool) -> tuple[dict[str, str], bytes, int] | None:
    """The checked record at a position of the file and its length there."""
    want = 1 << 16
    while True:
        raw = src.at(position, want)
        whole = position + len(raw) >= src.size
        if compressed:
            if not raw.startswith(MAGIC):
                return None
            d = zlib.decompressobj(31)
            try:
                out = d.decompress(raw)
            except zlib.error:
                return None
            if d.eof:
                got = parse(out)
                return (got[0], got[1], len(raw) - len(d.unused_data)) if got and got[2] == len(out) else None
        else:
            got = parse(raw)
            if got or not raw.startswith(_VERSIONS):
                return got
            end = raw.find(b"\r\n\r\n")
            size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)\r\n", raw[:end + 2]) if end >= 0 else None
            if end >= 0 and (size is None or end + 8 + int(size[1]) <= len(raw) or position + end + 8 + int(size[1]) > src.size):
                return None
        if whole:
            return None
        want *= 4


def _next_start(src: _Bytes, position: int, limit: int, compressed: bool) -> int:
    """The next place from ``position`` on, below ``limit``, where a record
    may begin; ``limit`` if there is none."""
    step = 1 << 16
    while position < limit:
        raw = src.at(position, step + 16)
        m = _START[compressed].search(raw)
        if m and position + m.start() < limit:
            return position + m.start()
        if position + len(raw) >= src.size or m:
            return limit
        position += max(1, len(raw) - 16)
    return limit


def salvage(stream, size: int, start: int, stop: int, compressed: bool):
    """Records and gaps that begin in [start, stop) of a file.

    Yields (position, length, headers, body) for records and (position,
    length, None, reason) for gaps. A range but the first begins with the
    first record that checks at or after its start; the range before logs
    what lies up to there, so ranges join without overlap. (Bytes of a payload
    that are a whole checked record themselves count as one if a range begins
    between the payload's start and them.)"""
    src = _Bytes(stream, size)

    def good_from(position: int, limit: int) -> tuple[int, object]:
        while position < limit:
            position = _next_start(src, position, limit, compressed)
            if position >= limit:
                break
            got = _record_at(src, position, compressed)
            if got:
                return position, got
            position += 1
        return limit, None

    position = start
    if start > 0:
        position, _ = good_from(start, size)
    own = position < stop
    while position < src.size and own:
        got = _record_at(src, position, compressed)
        if position >= stop and got:
            break  # the range that holds this place begins with it
        if got:
            yield position, got[2], got[0], got[1]
            position += got[2]
            continue
        head = src.at(position, 10)
        reason = "member fails its check" if head.startswith(MAGIC) else \
            "record fails its check" if head.startswith(b"WARC/1.") else "no member or version line"
        after, _ = good_from(position + 1, size)
        yield position, after - position, None, reason
        position = after


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def _reader(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["path"])
                with fs.open_input_file(path) as f:
                    for position, length, head, body in salvage(f, r["size"], r["start"], r["stop"], path.endswith(".gz")):
                        if head is None:
                            rows.append((path, position, length, True, body) + (None,) * 7)
                        else:
                            full = head.get("x-payload-length", str(len(body)))
                            sha1 = head.get("warc-payload-digest", "sha1:" + digest(body)).removeprefix("sha1:")
                            rows.append((path, position, length, False, None, head["warc-type"], _bare(head["warc-record-id"]),
                                         head.get("warc-target-uri"), sha1, int(full) if full.isdecimal() else len(body),
                                         _bare(head.get("warc-refers-to")), body if with_payload else None))
                            held += len(body) * with_payload
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return run


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files in ``files(path, size)``, as ``RECORDS``.

    A gap row has its first byte, its length and the check that failed; the
    other columns are null. Ranges of ``RANGE_BYTES`` are read by different
    tasks. Empty files give nothing."""
    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("start")) \
        .withColumn("stop", F.least(F.col("start") + RANGE_BYTES, F.col("size")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(_reader(with_payload), RECORDS)
