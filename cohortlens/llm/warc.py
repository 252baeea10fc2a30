"""WARC archives: writing captures, reading archives back, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an equal payload),
and metadata. Request and metadata name the capture through ``WARC-Concurrent-To``; assembly joins the
three by it and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by, hot_join, hot_keys, hot_of, materialize, new_folder, only, slices

END = b"\r\n\r\n"
#: Bytes of an archive, about: one is closed when it has as many. A writing task holds one, a reading task too.
ARCHIVE_BYTES = 32 << 20
#: A gzip member ends with the uncompressed size, so below this many bytes its last byte is 0.
MEMBER_BYTES = 1 << 24
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, page_id long, payload_digest string, payload_bytes long, payload binary"


def _urn(*parts: object) -> str:
    h = hashlib.sha1("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def response_id(page_id: int | None, digest: str, url: str | None) -> str:
    """The record id of the response for a page: rows that are wholly equal share it."""
    return _urn("response", page_id, digest, url)


def _members(record: bytes) -> Iterator[bytes]:
    """A record and its end as gzip members, one but for records of MEMBER_BYTES and more."""
    data = record + END
    for begin in range(0, len(data), MEMBER_BYTES - 1):
        yield gzip.compress(data[begin : begin + MEMBER_BYTES - 1], 6, mtime=0)


def _record(kind: str, rid: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with the role of each row's payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes the largest page_id is the response
    (``origin`` null), the others revisit it (``origin`` is its page_id). Rows that tie for the
    largest id are all responses, and null ids never are the largest; in a group without any id all are responses.

    Groups are found on digests alone: a partial aggregate over (digest, size), then one join of the pages with
    the groups of two and more, which deals the rows of a large group over salts.
    """
    rows = only(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
    groups = groups.agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("origin"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and origin is not null"))
    met = hot_join(rows, groups.drop("n"), ["digest"], F.struct("page_id", "url"), hot_of(groups, "n", "digest"), "left")
    again = ~F.col("page_id").eqNullSafe(F.col("origin.page_id"))
    return met.select("page_id", "url", "payload", "digest", F.when(again, F.col("origin.page_id")).alias("origin"), F.when(again, F.col("origin.url")).alias("origin_url"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Write each row of ``pages`` (page_id, url, html) as a capture of three records below ``path``.

    Null html is an empty payload, a null url an empty target. Each file is a WARC 1.1 archive with a gzip member for each
    record, of about ARCHIVE_BYTES and the last record more, written by Spark to any file system it knows: a row is an archive and a
    file a row. The text writer ends rows with a zero byte, which is the last byte of a member. Record ids of
    request and metadata hold the task and the row's place in it; they are fixed by the commit of the write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, archive = TaskContext.get().partitionId(), 0, bytearray()
        for part in (p for batch in batches for p in slices(batch, "payload")):
            for page_id, url, payload, digest, origin, origin_url in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                n, out = n + 1, []
                uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                same = [("WARC-Target-URI", uri)]
                seal = _digest(payload)
                if origin is None:
                    rid = response_id(page_id, digest, url)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    out.append(_record("response", rid, [*same, ("WARC-Payload-Digest", seal), ("Content-Type", "application/http;msgtype=response")], head + payload))
                else:
                    rid = _urn("revisit", task, n)
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    more = [("WARC-Refers-To", response_id(origin, digest, origin_url)), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Payload-Digest", seal)]
                    out.append(_record("revisit", rid, [*same, *more, ("Content-Type", "application/http;msgtype=response")], head))
                ask = f"GET {uri} HTTP/1.1\r\nHost: {uri.split('://')[-1].split('/')[0]}\r\n\r\n".encode()
                link = ("WARC-Concurrent-To", rid)
                out.append(_record("request", _urn("request", task, n), [*same, link, ("Content-Type", "application/http;msgtype=request")], ask))
                facts = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
                out.append(_record("metadata", _urn("metadata", task, n), [*same, link, ("Content-Type", "application/warc-fields")], facts))
                for record in out:
                    for member in _members(record):
                        archive += member
                if len(archive) >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(archive[:-1])], pa.binary())], ["value"])
                    archive = bytearray()
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(archive[:-1])], pa.binary())], ["value"])

    planned = plan_revisits(pages, least_bytes).mapInArrow(run, "value binary")
    planned.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _plain(blob: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces, plain or gzip-compressed in one or many members."""
    if blob[:2] != b"\x1f\x8b":
        yield blob
        return
    at, step = 0, 1 << 18
    while at < len(blob):
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(blob):
                raise ValueError("truncated gzip member")
            part = blob[at : at + step]
            at += len(part)
            yield d.decompress(part)
        at -= len(d.unused_data)


def parse_warc(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, plain or compressed: headers in lower case, block. One record is held at a time."""
    pieces, held = _plain(blob), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while len(held) < 7 and more():
            pass
        if not held:
            return
        while (end := held.find(END)) < 0 and held.startswith(b"WARC/1.") and more():
            pass
        if not held.startswith(b"WARC/1.") or end < 0:
            raise ValueError("no WARC record where one should begin")
        head = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        stop = end + 4 + int(head["content-length"])
        while len(held) < stop + 4 and more():
            pass
        if len(held) < stop:
            raise ValueError("truncated WARC record")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records below ``path``, one row each. Response payloads are checked against their digests.

    ``payload`` is null for records without one, and for all when ``with_payload`` is false:
    size and digest are then all that leaves the parser. Broken archives raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64() if f.endswith("long") else pa.binary() if f.endswith("binary") else pa.string() for f in RECORD.split(", ")]
        for batch in batches:
            for blob in held_by(batch, "content"):
                rows: list[tuple] = []
                held = 0
                for head, block in parse_warc(blob.as_py()):
                    kind, page, payload, seal = head["warc-type"], None, None, head.get("warc-payload-digest")
                    if kind == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        if _digest(payload) != seal:
                            raise ValueError(f"payload digest of {head['warc-record-id']}")
                    elif kind == "metadata" and block.startswith(b"page-id: "):
                        text = block[9:].split(b"\r\n")[0]
                        page = int(text) if text else None
                    bare = base64.b32decode(seal[5:]).hex() if seal and seal.startswith("sha1:") else None
                    rows.append((
                        head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
                        head.get("warc-date"), page, bare, None if payload is None else len(payload), payload if with_payload else None,
                    ))
                    held += len(block) if with_payload else 200
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, capture, request, metadata), each a struct of its record or null.

    Records of a capture meet on the id that ``concurrent_to`` names, or their own id where they name none.
    One aggregate does the three-way join; a request or metadata record whose capture is not
    there makes a row with a null capture. Responses that repeat one id (a page row that repeats) are one
    capture with all its metadata records' count in ``n``.
    """
    full = F.struct(*(F.col(c) for c in records.columns))
    kind = F.col("record_type")
    main = kind.isin("response", "revisit")
    return records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).groupBy("capture_id").agg(
        F.max_by(F.when(main, full), F.when(main, F.col("record_id"))).alias("capture"),
        F.max_by(F.when(kind == "request", full), F.when(kind == "request", F.col("record_id"))).alias("request"),
        F.max_by(F.when(kind == "metadata", full), F.when(kind == "metadata", F.col("record_id"))).alias("metadata"),
        F.count_if(main).alias("n"),
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Captures as (page_id, payload_bytes, payload_digest, record_type, refers_to), revisits resolved through the response they refer to.

    Revisits of one response are one key of the join; it is on narrow rows, and deals large groups over salts.
    A revisit whose response is not among the captures keeps its digest and has null size.
    """
    flat = captures.where("capture is not null").select(
        F.col("metadata.page_id").alias("page_id"), "capture.record_id", "capture.refers_to", "capture.record_type",
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.payload_bytes").alias("own_bytes"), "n",
    )
    flat = materialize(flat)
    revisits = flat.where("record_type = 'revisit'").drop("own_bytes")
    responses = flat.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("own_bytes").alias("to_bytes"))
    met = hot_join(revisits, responses, ["refers_to"], F.col("record_id"), hot_keys(revisits, "refers_to"), "left")
    again = F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int"))).alias("_n")
    first = flat.where("record_type = 'response'").select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), again
    )
    later = met.select("page_id", F.col("to_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to_page").alias("refers_to"), again)
    return first.unionByName(later).drop("_n")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives into the shared folder, read them back and assemble: one row per page row.

    Repeated rows come back as often as they were; an empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    path = new_folder(spark)
    write_warc(pages, path)
    return resolve(assemble(read_warc(spark, path, with_payload=False)))
