"""WARC archives: a writer, and a reader that salvages what damage has left.

The writer sends records through Spark's own file writer, so archives can lie in any
store that Spark reaches; each has a bounded number of records, one gzip member each, so
damage stays within a record. `member` gives single records as gzip members, for archives
written elsewhere.

The reader takes plain records, gzip members with one record and gzip streams with many.
It checks the version line, the header, the length, the closing line breaks and the
digest of each record. After a failed check it searches for the next position at which
a member or a version line starts a valid record, goes on from there, and logs the bytes
between as a quarantined gap. A valid record is never dropped because of a bad one.

Of records with equal payloads (of min_bytes at least) the one with the largest page_id
is the response, the others are revisits that refer to it. Nulls: a null payload is
empty, a null url is left out of the header, a null page_id comes before all others. Of
rows with equal payload and id, the last in file order is the response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripforge.llm.common import Scratch, fresh_dir, lookup, numbered, table, tune

ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
RECORD = "archive string, start long, stop long, reason string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data) -> F.Column:
    """SHA-1 of a binary column in upper-case base32, without UDFs: 5 hexadecimal
    digits are 4 digits of base 32."""
    digest, out = F.sha1(data), []
    for i in range(8):
        out.append(F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0"))
    return F.translate(F.concat(*out), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def planned(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """Each page with its payload, digest, record type and the response that it repeats."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = numbered(Scratch(pages.sparkSession, "warc"), rows)
    rows = rows.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("digest", base32_sha1(F.encode("text", "UTF-8")))
    rows = rows.withColumn("_key", F.concat_ws("-", "digest", "bytes"))
    order = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "_uid")
    best = rows.groupBy("_key").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("_n"))
    best = best.select("_key", "_n", F.col("best.page_id").alias("first_id"), F.col("best._uid").alias("first_uid"))
    out = lookup(rows, best, "_key", ["first_id", "first_uid"], "_n")
    return out.withColumn("revisit", (F.col("bytes") >= min_bytes) & (F.col("_uid") != F.col("first_uid")))


def record_text(rows: DataFrame) -> F.Column:
    """The record as text."""
    crlf = F.lit("\r\n")
    name = lambda uid: F.concat(F.lit("<urn:x-record:"), F.col(uid).cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, crlf)
    some = lambda key, value: F.coalesce(line(key, value), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("text")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), crlf,
        line("WARC-Record-ID", name("_uid")), line("WARC-Date", F.lit(DATE)), some("WARC-Target-URI", url),
        some("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("first_uid")), some("WARC-Refers-To-Page-ID", F.col("first_id").cast("string")))).otherwise(""),
        line("WARC-Payload-Length", F.col("bytes").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.encode(block, "UTF-8")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), crlf,
    )
    return F.concat(header, block, F.lit("\r\n\r\n"))


#: An empty gzip member, which a reader passes over.
EMPTY = gzip.compress(b"", 6, mtime=0)


def _archives(archive_bytes: int):
    """Each record as a gzip member, as many as fit an archive in a row, without its last
    byte. That is the highest of the four of the last record's length: 0 for records below
    16 MiB, others get an empty member after theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for x in batch.column(0):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = squeeze.compress(x.as_buffer()) + squeeze.flush()
                raw += EMPTY if raw[-1] else b""
                if held and held + len(raw) > archive_bytes:
                    yield row()
                    out, held = [], 0
                out.append(raw)
                held += len(raw)
        if held:
            yield row()

    return run


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes a record per page; gives the folder of the archives. None is larger than
    archive_bytes, but for one of a single larger record."""
    path = path or fresh_dir(pages.sparkSession, "warc")
    tune(pages.sparkSession)
    rows = planned(pages, id_col, url_col, text_col, min_bytes)
    rows = rows.select(F.encode(record_text(rows), "UTF-8").alias("record")).mapInArrow(_archives(archive_bytes), "archive binary")
    # the text writer ends each row with the byte that the archive is short of
    rows.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    return path


@dataclass
class Found:
    """A record, or with `reason` a gap."""

    start: int
    stop: int
    reason: str | None = None
    header: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class Bad(Exception):
    """What is wrong, and the position before which every other version line fails too, as
    its header is the rest of this one and meets the same fault."""

    def __init__(self, reason: str, upto: int = 0):
        super().__init__(reason)
        self.upto = upto


def plain_record(data, at: int) -> Found:
    """The record that starts there, or Bad with what is wrong."""
    if not (version := VERSION.match(data, at)):
        raise Bad("no version line")
    header, stop = {}, version.end() - 2
    # line by line, of any length: with Bad.upto a header is read once
    while data[stop : stop + 4] != b"\r\n\r\n":
        begin, stop = stop + 2, data.find(b"\r\n", stop + 2)
        if stop < 0:
            raise Bad("header does not end", begin)
        key, colon, value = data[begin:stop].partition(b":")
        if not colon:
            raise Bad("malformed header line", begin)
        header[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length, body = header.get("content-length", ""), stop + 4
    if not length.isascii() or not length.isdigit():
        raise Bad("no length", stop)
    end = body + int(length)
    if end + 4 > len(data):
        raise Bad("truncated", stop)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("wrong length", stop)
    block = bytes(data[body:end])
    if (want := header.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != sha1_text(block):
        raise Bad("wrong block digest")
    payload = block
    if header.get("content-type", "").startswith("application/http"):
        _, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Bad("no HTTP header")
    if header.get("warc-type") == "response" and (want := header.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != sha1_text(payload):
        raise Bad("wrong payload digest")
    return Found(at, end + 4, None, header, payload)


def gzip_member(data, at: int) -> tuple[bytes, int, bool]:
    """What the member holds as far as it can be inflated, where it ends, if it is whole."""
    inflate, out, pos, step = zlib.decompressobj(31), [], at, 1 << 12
    while not inflate.eof and pos < len(data):
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[pos : pos + step]))
        except zlib.error:  # again byte by byte, for what comes before the damage
            try:
                for pos in range(pos, min(pos + step, len(data))):
                    out.append(before.decompress(data[pos : pos + 1]))
            except zlib.error:
                pass
            return b"".join(out), pos, False
        pos, step = pos + step, min(2 * step, 1 << 16)
    return b"".join(out), min(pos, len(data)) - len(inflate.unused_data), inflate.eof


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records, and the gaps between them. Records out of a gzip stream with
    several of them have their positions in the inflated stream."""
    at, gap, reason, known = 0, None, "", (0, "")
    while at < len(data):
        got: list[Found] = []
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                inner, stop, whole = gzip_member(data, at)
                got = list(salvage(inner))
                if not whole and not any(x.reason is None for x in got):
                    raise Bad("damaged member")
                if whole and len(got) == 1:
                    got[0].start, got[0].stop = at, stop
                if not whole:
                    nxt = START.search(data, at + 3)
                    got = [x for x in got if x.reason is None]
                    stop = nxt.start() if nxt else len(data)
                    got.append(Found(at, stop, "damaged member"))
            elif at < known[0] and VERSION.match(data, at):
                raise Bad(known[1])
            else:
                got = [plain_record(data, at)]
                stop = got[0].stop
        except Bad as x:
            known = max(known, (x.upto, str(x)))
            if gap is None:
                gap, reason = at, str(x)
            nxt = START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap is not None:
            yield Found(gap, at, reason)
            gap = None
        yield from got
        at = stop
    if gap is not None:
        yield Found(gap, len(data), reason)


def member(header: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """A single record, as a gzip member or plain."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**header, "WARC-Block-Digest": "sha1:" + sha1_text(block), "Content-Length": len(block)}.items())
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush() if compress else raw


def _parse(with_payload: bool):
    def whole(x: str | None) -> int | None:
        return int(x) if x and re.fullmatch(r"-?\d+", x) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        for batch in batches:
            paths, contents = batch.columns
            for path, content in zip(paths.to_pylist(), contents):
                rows, held = [], 0
                for x in salvage(content.as_buffer().to_pybytes()):
                    h = x.header
                    kind = h.get("warc-type")
                    full = kind != "revisit" and x.reason is None
                    rows.append((
                        path, x.start, x.stop, x.reason, kind, whole(h.get("warc-page-id")), h.get("warc-target-uri"), whole(h.get("warc-refers-to-page-id")),
                        len(x.payload) if full else whole(h.get("warc-payload-length")), sha1_text(x.payload) if full else h.get("warc-payload-digest", "")[5:] or None, x.payload if with_payload and full else None,
                    ))
                    held += len(x.payload) * with_payload
                    if len(rows) >= 2000 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record, and per gap (those with a reason). Archives are read whole, one
    at a time; `write_archives` bounds their size, and Spark reads files of up to 2 GB."""
    tune(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse(with_payload), RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"))
    found = Scratch(spark, "warc").write(read_archives(spark, path, with_payload=False).drop("payload"), "found")
    if gaps := found.where("reason is not null").select("archive", "start", "stop", "reason").limit(5).collect():
        raise ValueError(f"archives have gaps: {gaps}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives have to hold; 5 hexadecimal digits of the SHA-1 are 4 digits of base 32.
ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS u, page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT u, page_id, octet_length(encode(t)) AS n, sha1(t) AS h, first_value(u) OVER same AS best, first_value(page_id) OVER same AS first_id FROM p WINDOW same AS (PARTITION BY t ORDER BY page_id DESC NULLS LAST, u DESC))
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN u = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN u <> best THEN first_id END AS refers_to
FROM d"""
