"""WARC archives: writing with segmentation, segment reassembly, chunked framing."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Bytes after which a task closes an archive, and bytes of a transfer chunk.
ARCHIVE_BYTES, CHUNK_BYTES = 4 << 20, 1 << 16
VERSION = b"WARC/1.1"
PREFIX = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "1970-01-01T00:00:00Z"


def digest32(payload: Column) -> Column:
    """The SHA-1 of ``payload`` in upper-case base32: four times 40 bits, each eight digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Rows (id, sha, n, refers_to): pages whose payload a page of smaller id has too.

    One id may have several payloads, each with a row of its own.

    Payloads are compared by SHA-1 and length, which alone are shuffled. One
    payload may hold a third of the rows: the counts are combined before the
    shuffle, and the join back is against a written table, so that its large
    partitions can be split.
    """
    keys = pages.filter(F.length(payload_col) >= min_bytes).select(
        F.col(id_col).alias("id"), F.unhex(F.sha1(payload_col)).alias("sha"), F.length(payload_col).alias("n")
    )
    first = materialize(keys.groupBy("sha", "n").agg(F.min("id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "first")
    return materialize(keys.join(first, ["sha", "n"]).filter("id > refers_to").select("id", "sha", "n", "refers_to").distinct(), "revisits")


def _line(value: str) -> bytes:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for lo in range(0, len(payload), size):
        part = payload[lo : lo + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is not closed")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block; a block without HTTP is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    return unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")


def _record(headers: list[tuple[str, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *(k.encode() + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _records(name: str, url: str | None, payload: bytes, refers_to, digest: str, room: int, step: int) -> Iterator[bytes]:
    """The records of one page. If the first archive's ``room`` is too small,
    the block goes on in continuation records of at most ``step`` bytes."""
    about = [("WARC-Record-ID", name.encode()), ("WARC-Date", _DATE.encode()), ("WARC-Payload-Digest", f"sha1:{digest}".encode())]
    if url is not None:
        about.append(("WARC-Target-URI", _line(url)))
    about.append(("Content-Type", b"application/http; msgtype=response"))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        more = [("WARC-Type", b"revisit"), ("WARC-Profile", REVISIT_PROFILE.encode()), ("WARC-Refers-To", f"<{PREFIX}{refers_to}:{digest}>".encode())]
        yield _record([*more, *about], head)
        return
    block = head + chunked(payload)
    if len(block) <= room:
        yield _record([("WARC-Type", b"response"), *about], block)
        return
    room = max(1, room)
    yield _record([("WARC-Type", b"response"), *about, ("WARC-Segment-Number", b"1")], block[:room])
    cuts = list(range(room, len(block), step))
    for k, lo in enumerate(cuts):
        number = k + 2
        headers = [
            ("WARC-Type", b"continuation"),
            ("WARC-Record-ID", f"{name[:-1]}:segment:{number}>".encode()),
            ("WARC-Date", _DATE.encode()),
            ("WARC-Segment-Origin-ID", name.encode()),
            ("WARC-Segment-Number", b"%d" % number),
        ]
        if k == len(cuts) - 1:
            headers.append(("WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(headers, block[lo : lo + step])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write gzipped WARC files to the folder ``path`` through Spark's writer.

    Each task fills archives of ``archive_bytes``; a record that does not fit
    goes on in the next one as continuation segments. Of equal payloads of at
    least ``min_bytes`` bytes the smallest id keeps the response, the others
    become revisit records. A null payload is empty; a null url is left out; an
    empty table writes no record. A record's id is made of the row's id and
    the payload's digest, so rows that repeat an id with other payloads are told
    apart; rows that repeat both are numbered within their task. Rows of a null
    id are always responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    seen = revisits(rows, "id", "payload", min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, used = [], 0
        seen_here: dict[str, int] = {}  # names of rows that may be cut into segments
        for b in batches:
            for row_id, url, data, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                name = f"{PREFIX}{row_id}:{digest}"
                if refers_to is None and 2 * len(data) + 1024 > archive_bytes - used:
                    seen_here[name] = seen_here.get(name, 0) + 1
                    name = name if seen_here[name] == 1 else f"{name}:copy:{TaskContext.get().partitionId()}.{seen_here[name]}"
                for record in _records(f"<{name}>", url, data, refers_to, digest, archive_bytes - used, archive_bytes):
                    parts.append(record)
                    used += len(record)
                    if used >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(parts)], pa.binary())], ["value"])
                        parts, used = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(parts)], pa.binary())], ["value"])

    told = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.length("payload"))
    joined = told.join(seen.hint("shuffle_hash"), ["id", "sha", "n"], "left")
    archives = joined.select("id", "url", "payload", digest32(F.col("payload")).alias("digest"), "refers_to").mapInArrow(run, "value binary")
    (
        archives.select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")  # what ends a record
        .option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(_fields(data[at:end].split(b"\r\n")[1:]))
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_COMPLETE = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, payload binary, error string"
_DIGESTS = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, payload_bytes long, payload_digest string, error string"
_SEGMENT = ", number int, total long, block binary"


def _decoded(block: bytes, kind: str | None) -> tuple[bytes | None, str | None]:
    if kind == "revisit":
        return None, None  # it has its response's headers alone
    try:
        return http_payload(block), None
    except ValueError as why:
        return None, f"framing: {why}"


def _shown(payload: bytes | None, digests: bool) -> tuple:
    """A payload as the columns of a record: itself, or its size and digest."""
    if not digests:
        return (payload,)
    if payload is None:
        return None, None
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_rows(digests: bool):
    """Each record of the archives: a whole one decoded, a segment as it is."""
    schema = (_DIGESTS if digests else _COMPLETE) + _SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for h, block in parse(data):
                    about = h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if "warc-segment-number" not in h:
                        payload, error = _decoded(block, about[0])
                        rows.append((h.get("warc-record-id"), *about, *_shown(payload, digests), error, None, None, None))
                        continue
                    total = h.get("warc-segment-total-length")
                    origin = h.get("warc-segment-origin-id") or h.get("warc-record-id")
                    rows.append((origin, *about, *_shown(None, digests), None, int(h["warc-segment-number"]), total and int(total), block))
                yield _batch(rows, schema)

    return run


_TYPES = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def reassemble(segments: list[tuple[int, bytes]], totals: list[int]) -> tuple[bytes | None, str | None]:
    """The block of one origin's segments in order of their numbers, or what is wrong with them."""
    segments = sorted(segments, key=lambda s: s[0])
    if [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        return None, "segments: numbers are missing or repeated"
    block = b"".join(part for _, part in segments)
    if len(totals) != 1:
        return None, "segments: the last one is missing"
    if totals[0] != len(block):
        return None, f"segments: {len(block)} bytes, {totals[0]} stated"
    return block, None


def _joined(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *about, parts, totals in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                block, error = reassemble([(p["number"], p["block"]) for p in parts], totals)
                payload = None
                if block is not None:
                    payload, error = _decoded(block, about[1])
                rows.append((*about, *_shown(payload, digests), error))
            yield _batch(rows, _DIGESTS if digests else _COMPLETE)

    return run


def read_archives(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Rows (record_id, record_type, target_uri, refers_to, stated_digest, payload, error), one for each record.

    Segments are grouped by the id of the record that they continue, put in
    order of their numbers, checked against the stated total length and joined;
    only segments are shuffled, and a group is one record's. Then chunked
    framing is decoded. A record that fails a check has a null payload and the
    reason in ``error``; a revisit has neither payload nor error. A folder
    without records gives no rows.

    With ``digests``, payload_bytes and payload_digest stand for the payload,
    and the archives are read once, into a table of the records' facts and the
    segments' blocks.
    """
    schema = _DIGESTS if digests else _COMPLETE
    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_record_rows(digests), schema + _SEGMENT)
    if digests:
        records = materialize(records, "records")
    about = ["record_type", "target_uri", "refers_to", "stated_digest"]
    first = F.col("number") == 1
    groups = (
        records.filter("number is not null")
        .groupBy("record_id")
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in about],
            F.collect_list(F.struct("number", "block")).alias("parts"),
            F.collect_list("total").alias("totals"),
        )
    )
    whole = records.filter("number is null").drop("number", "total", "block")
    return whole.unionByName(groups.mapInArrow(_joined(digests), schema))


def _number(column: str) -> Column:
    """The page's id in a record's id."""
    return F.regexp_extract(column, f"{PREFIX}(-?[0-9]+)", 1).try_cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them, and report.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to,
    target_uri, error), one for each page; a revisit's payload is that of the
    response that it names. ``error`` says what is wrong with a record, a
    revisit without its response among them, and is null for a sound one.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    write_archives(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("payload")), path)
    read = read_archives(spark, path, digests=True)
    found = read.withColumn("page_id", _number("record_id")).withColumn("refers_to", _number("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "error"]
    responses, revisit = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    needed = materialize(revisit.select("page_id", "record_type", "refers_to", "target_uri", "stated_digest"), "revisits")
    facts = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "payload_bytes").filter("refers_to is not null")
    facts = facts.dropDuplicates(["refers_to", "stated_digest"])
    facts = materialize(facts.join(needed.select("refers_to", "stated_digest").distinct(), ["refers_to", "stated_digest"], "left_semi"), "facts")
    answered = needed.join(facts, ["refers_to", "stated_digest"], "left").select(
        "page_id",
        "payload_bytes",
        F.when(F.col("payload_bytes").isNotNull(), F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "target_uri",
        F.when(F.col("payload_bytes").isNull(), "revisit: its response is missing").alias("error"),
    )
    wrong = F.when(F.col("payload_digest") != F.col("stated_digest"), "payload: another digest is stated")
    return responses.withColumn("error", F.coalesce("error", wrong)).select(*columns).unionByName(answered.select(*columns))
