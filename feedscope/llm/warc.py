"""WARC archives written and read as Spark jobs, with segment reassembly.

Writing: one record for each page, its payload in an HTTP response with chunked transfer framing. Of equal
payloads the page with the smallest id is a response, the others revisit it; that is decided on digests and ids alone.
A block longer than a segment goes on in continuation records. Every record is a gzip member of its own, so that a reader
can start at any of them. A file's bytes are one row of Spark's text writer; the line separator that ends it is an
empty gzip member.

Reading: continuation records are grouped by the id of their origin record and stand in order of their segment
number; the total length is verified and chunked framing decoded: a record's segments run through a decoder and a digest one
after another, so that of a long payload a segment is held at a time. The writer holds one payload at a time with
its framed copy, the reader a file and one unpacked record of it. A record that is cut or doesn't add up gives a row with
``error`` and no digest.

A record's id is its page's, with the payload's digest where a page_id has several payloads. Where rows have the same id and
payload, they are numbered within their input partition, on from the counts of the partitions before it, so that no task needs
to see all such rows: they meet their numbers by page, payload and input partition.
``WARC-Refers-To`` names such an id.

Defined cases: a null or empty payload is empty, a very long one is cut into segments; a null url is written as
``urn:none``; rows with the same id and payload are responses all, if their id is the smallest with it; rows without a
page_id are responses; an empty table writes no record and reads back as no rows; columns other than page_id, url
and html are not read. Revisits keep the length of the payload in their HTTP header.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedscope.llm.common import lean, materialise, scratch_path, slices

#: Bytes of a chunk, of a segment's block and of a file.
CHUNK, SEGMENT, FILE_BYTES = 4096, 16384, 16_000_000
#: Fixed value: an empty gzip member, which ends a file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" + "0000")
MAGIC = EMPTY_MEMBER[:2]
#: Bytes of a file that are unpacked at a time.
READ_BYTES = 16384
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string, origin string, segment int, total long, data binary"
_READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("error", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("data", pa.binary())])


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: forty bits of the hash are eight digits."""
    digest = F.sha1(data)
    part = lambda k: F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*map(part, range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _from_files_only(pages: DataFrame) -> DataFrame:
    """The pages, written first unless they are read straight from files: whoever scans files finds the same input partitions."""
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[^A-Za-z]*", "", line).split(" ")[0] for line in plan.strip().split("\n")}
    return pages if nodes <= {"Project", "Filter", "Relation"} else materialise(pages, "pages")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, part, payload, payload_bytes, payload_digest, record_id, before, refers_to and refers_id (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.spark_partition_id().alias("part"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload.cast("binary")).alias("payload_digest"))
    # a narrow row for each page_id and payload; what is decided comes back by both, so that no payload is a hot key
    parts = rows.groupBy("page_id", "payload_digest", "part").agg(F.first("payload_bytes").alias("n"), F.count(F.lit(1)).alias("copies"))
    earlier = F.sum("copies").over(Window.partitionBy("page_id", "payload_digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(earlier, F.lit(0)))  # a row for each input partition with such a page
    each = parts.groupBy("page_id", "payload_digest").agg(F.first("n").alias("n"))
    several = each.groupBy("page_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    same_id = F.col("e.page_id").eqNullSafe(F.col("s.page_id"))
    each = each.alias("e").join(several.alias("s"), same_id).select("e.*", "several")
    plain = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    record_id = F.when(F.col("several") | F.col("page_id").isNull(), F.concat_ws(":", plain, "payload_digest")).otherwise(plain)
    each = each.select("page_id", "payload_digest", "n", record_id.alias("record_id"))
    first = each.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id")).alias("first"))
    own = F.col("first").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("first.page_id")) | (F.col("n") < least_bytes)
    other = lambda c: F.when(~own, F.col(f"first.{c}"))
    planned = each.join(first, "payload_digest", "left").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "record_id", other("page_id").alias("refers_to"), other("record_id").alias("refers_id"))
    placed = parts.select(F.col("page_id").alias("pp"), F.col("payload_digest").alias("dd"), F.col("part").alias("q"), "before")
    planned = planned.join(placed, F.col("p").eqNullSafe(F.col("pp")) & (F.col("d") == F.col("dd"))).drop("pp", "dd")
    # merged at every size, so that payloads are shuffled once; by input partition as well, which spreads a hot page
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("part") == F.col("q"))
    return rows.join(planned.hint("merge"), same).drop("p", "d", "q")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def _record(kind: str, rid: str, url: str, block: bytes, **more: object) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": _DATE, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response"}
    fields |= {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block


def records(rid: str, url: str | None, payload: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page; ``refers`` is the id of the record that it revisits."""
    url = re.sub(r"\s", "%20", url or "urn:none")
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", rid, url, block, WARC_Refers_To=f"<{refers}>", WARC_Payload_Digest=f"sha1:{digest}", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", rid, url, block, WARC_Payload_Digest=f"sha1:{digest}")
        return
    yield _record("response", rid, url, parts[0], WARC_Payload_Digest=f"sha1:{digest}", WARC_Segment_Number=1)
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        yield _record("continuation", f"{rid}:segment:{k}", url, part, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=last)


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record + _END) + z.flush()


def _to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file, from rows sorted by id, payload and input partition."""
    out, held, last, number = [], 0, None, 0
    for b in slices(batches, 256):
        for rid, before, part, url, payload, digest, refers in zip(*(b.column(c) for c in ("record_id", "before", "part", "url", "payload", "payload_digest", "refers_id")), strict=True):
            rid, digest, part = rid.as_py(), digest.as_py(), part.as_py()
            number = number + 1 if (rid, digest, part) == last else before.as_py() + 1
            last = (rid, digest, part)
            for r in records(rid if number == 1 else f"{rid}:row:{number}", url.as_py(), payload.as_py().encode(), digest, refers.as_py()):
                out.append(_member(r))
                held += len(out[-1])
            if held >= FILE_BYTES:
                yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], names=["value"])
                out, held = [], 0
    if out:
        yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the pages as gzipped WARC files of a bounded number of bytes below ``path``."""
    rows = plan_records(_from_files_only(pages.select("page_id", "url", "html")), least_bytes).sortWithinPartitions("record_id", "payload_digest", "part", "url")
    files = rows.mapInArrow(_to_files, "value binary").select(F.col("value").cast("string").alias("value"))
    with lean(pages.sparkSession):
        files.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


class Payload:
    """Takes an HTTP response part by part; keeps the payload's length and SHA-1, and the payload if asked."""

    def __init__(self, keep: bool = False) -> None:
        self.head, self.state, self.left, self.line = b"", "head", 0, b""
        self.sha, self.n, self.kept, self.seen, self.chunks = hashlib.sha1(), 0, [] if keep else None, 0, False

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        self.seen += len(data)
        if self.state == "head":
            self.head += data
            end = self.head.find(_END)
            if end < 0:
                return
            data, self.head = self.head[end + 4 :], self.head[:end]
            self.chunks = bool(re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", self.head))
            self.state = "size" if self.chunks else "rest"
        at = 0
        while at < len(data):
            if self.state == "rest":
                self._take(data[at:])
                return
            if self.state == "data":
                part = data[at : at + self.left]
                self._take(part)
                at, self.left = at + len(part), self.left - len(part)
                if not self.left:
                    self.state = "gap"
            elif self.state in ("over", "broken"):
                return
            else:  # a line: the break after a chunk, a chunk's size, or a trailer
                end = data.find(b"\n", at)
                self.line += data[at:] if end < 0 else data[at:end]
                if end < 0:
                    return
                line, self.line, at = self.line.strip(), b"", end + 1
                if self.state == "gap":
                    self.state = "size"
                elif self.state == "trailer":
                    self.state = "trailer" if line else "over"
                elif re.fullmatch(rb"[0-9A-Fa-f]+", size := line.split(b";")[0].strip()):
                    self.left = int(size, 16)
                    self.state = "data" if self.left else "trailer"
                else:
                    self.state = "broken"

    @property
    def whole(self) -> bool:
        return self.state in ("rest", "over")

    @property
    def digest(self) -> str:
        return b32encode(self.sha.digest()).decode()


def members(data: bytes) -> Iterator[bytes]:
    """A file's gzip members, unpacked one after another; the file itself if it isn't gzipped."""
    if data[:2] != MAGIC:
        yield data
        return
    view, at = memoryview(data), 0
    while view[at : at + 2] == MAGIC:
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            part = view[at : at + READ_BYTES]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def unpack(data: bytes) -> bytes:
    """A file's bytes, gunzipped if need be (one member or one for each record)."""
    return b"".join(members(data))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields in lower case, block) of the records of a member or file; a block that is cut short is None."""
    at = 0
    while m := _VERSION.search(data, at):
        at = m.start()
        end = data.find(_END, at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields.get("content-length", 0))
        block = data[end + 4 : end + 4 + n]
        yield fields, block if len(block) == n else None
        at = end + 4 + n


def _page(rid: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", rid or "")
    return int(m[1]) if m else None


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            rows: list[tuple] = []
            for f, block in (r for m in members(content.as_py()) for r in parse(m)):
                kind, rid = f.get("warc-type"), f.get("warc-record-id", "")
                page, url, digest = _page(rid), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:")
                number = int(f.get("warc-segment-number", 0))
                if kind not in ("response", "revisit", "continuation"):
                    continue
                if block is None:
                    rows.append((page, None, None, kind, None, url, "cut short", rid, 0, None, None))
                elif kind == "revisit":
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", block)
                    rows.append((page, int(m[1]) if m else None, digest, kind, _page(f.get("warc-refers-to")), url, None, rid, 0, None, None))
                elif number:
                    origin, total = f.get("warc-segment-origin-id", rid), f.get("warc-segment-total-length")
                    rows.append((_page(origin), None, digest or None, "response", None, url, None, origin, number, int(total) if total else None, block))
                else:
                    p = Payload()
                    p.feed(block)
                    rows.append((page, *_result(p, digest), kind, None, url, _wrong(p, digest), rid, 0, None, None))
                if len(rows) >= 2000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)


def _wrong(p: Payload, digest: str | None) -> str | None:
    return "not whole" if not p.whole else "digest differs" if digest and digest != p.digest else None


def _result(p: Payload, digest: str | None) -> tuple[int | None, str | None]:
    return (None, None) if _wrong(p, digest) else (p.n, p.digest)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by origin and segment: whole records pass, segments run through their origin's decoder."""
    state: dict | None = None

    def close() -> tuple:
        p, s = state["p"], state
        bad = s["bad"] or ("total length differs" if s["total"] is None or s["total"] != p.seen else None) or _wrong(p, s["digest"])
        n, digest = (None, None) if bad else (p.n, p.digest)
        return (s["page"], n, digest, "response", None, s["url"], bad)

    for b in batches:
        out: list[tuple] = []
        cols = [b.column(f.name).to_pylist() for f in _READ_SCHEMA]
        for page, n, digest, kind, refers, url, error, origin, number, total, data in zip(*cols, strict=True):
            if state and (state["origin"] != origin or not number):
                out.append(close())
                state = None
            if not number:
                out.append((page, n, digest, kind, refers, url, error))
                continue
            if state is None:
                state = {"origin": origin, "p": Payload(), "next": 1, "bad": None, "total": None, "page": page, "url": url, "digest": digest}
            if number < state["next"]:  # a repeated segment
                continue
            if number > state["next"]:
                state["bad"] = "segment missing"
            state["next"], state["total"] = number + 1, total or state["total"]
            if not state["bad"]:
                state["p"].feed(data)
        yield _rows(out)
    if state:
        yield _rows([close()])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(list(_READ_SCHEMA)[:7])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, error of the archives' records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(_from_files, _READ)
    return rows.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_join_segments, _READ.partition(", origin")[0])


def archive_digest(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder and tell what reading them back gives."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")
