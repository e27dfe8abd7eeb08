"""WARC archives: a writer of request, response or revisit, and metadata records, and transaction assembly.

Archives are ``.warc.gz`` files of WARC/1.1 records, a gzip member for each record, and begin with a warcinfo record.
They are written by Spark's text writer, so they go to any file system that Spark writes to and survive lost
executors: a member ends in the high byte of its length, which is zero for records below 16 MB (a larger record is
followed by an empty member), and that byte is the writer's line separator. A row of the writer is a stretch of
members of about ``row_bytes``, and a file has at most ``file_rows`` of them, so a file's size is bounded by both and
by its largest records. Reading parses by Content-Length; records meet through WARC-Concurrent-To, one nested row for
each capture, and revisits find their response through WARC-Refers-To.

Record ids derive from page_id, url, payload and an ordinal of the row, settled once in a written table. Defined
results: a null payload is empty; a null page_id is the smallest; every row is a capture, repeated ones too; a null or empty url is about:blank; line ends in
a url are percent-encoded; columns besides the three are ignored; an empty table gives no records and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, materialize, new_path, sliced

END = b"\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: int | None, digest: str, url: str | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page} {digest} {row} {url}')}>"


def record(kind: str, rid: str, date: str, uri: str, content: str, block: bytes, **more: str) -> bytes:
    """One record without its closing line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, **({"WARC-Target-URI": uri} if uri else {}), **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content, "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def transaction(page: int | None, url: str | None, payload: bytes, row: int, first: tuple[int | None, str | None, int] | None, date: str) -> list[bytes]:
    """Request, response and metadata; a revisit of the row ``first`` (page, url, ordinal) if there is one."""
    digest = sha1_32(payload)
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").strip()
    rid = record_id("response", page, digest, url, row)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    more = {"WARC_Payload_Digest": f"sha1:{digest}"}
    if first is not None:
        main = record("revisit", rid, date, uri, "application/http; msgtype=response", http, **more, WARC_Profile=PROFILE, WARC_Refers_To=record_id("response", first[0], digest, first[1], first[2]))
    else:
        main = record("response", rid, date, uri, "application/http; msgtype=response", http + payload, **more)
    try:
        parts = urlsplit(uri)
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:
        path, host = uri, ""
    ask = record("request", record_id("request", page, digest, url, row), date, uri, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), WARC_Concurrent_To=rid)
    note = record("metadata", record_id("metadata", page, digest, url, row), date, uri, "application/warc-fields", f"page-id: {'' if page is None else page}\r\n".encode(), WARC_Concurrent_To=rid)
    return [ask, main, note]


def member(record: bytes) -> bytes:
    """A gzip member of the record and its closing line ends, whose last byte is zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.compress(END) + z.flush()
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def write(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", body_col: str = "html", *, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", row_bytes: int = 1 << 20, file_rows: int = 64, broadcast_rows: int = 500_000) -> None:
    """Write every page's transaction. Of pages with equal payloads of ``least_bytes`` or more, all but that of the smallest id are revisits.

    Payloads that occur more than once are found by hash and length; up to ``broadcast_rows`` of those go to every
    executor, more are joined by a shuffle.
    """
    spark = pages.sparkSession
    rows = pages.select(F.coalesce(F.col(page_col).cast("long"), F.lit(NULL_ID)).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("body").cast("binary"), 256))).withColumn("size", F.octet_length("body"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    same = materialize(rows.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.min(F.struct("page", "url", "row")).alias("first"), F.max("page").alias("last")).where("first.page <> last").drop("last"), "payloads")
    rows = rows.join(F.broadcast(same) if same.count() <= broadcast_rows else same, ["key", "size"], "left").select("page", "url", "body", "row", F.when(F.col("first.page") != F.col("page"), F.col("first")).alias("first"))
    real = lambda x: None if x == NULL_ID else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member(record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo ' + date)}>", date, "", "application/warc-fields", b"format: WARC File Format 1.1\r\n"))
        held, size = [info], 0

        def flush() -> pa.RecordBatch:
            # The writer puts back the last byte.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        for b in sliced(batches, 64):
            for page, url, body, row, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                for r in transaction(real(page), url, body, row, first and (real(first["page"]), first["url"], first["row"]), date):
                    held.append(member(r))
                    size += len(held[-1])
                if size >= row_bytes:
                    yield flush()
                    held, size = [info], 0
        if size:
            yield flush()

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", file_rows).text(path)
    # The text writer names its files .txt; each is moved to its own name once the job has ended.
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name[: -len(".txt")] + ".warc.gz"))


def unzip(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members, or of a plain file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, take = zlib.decompressobj(31), 1 << 12
        while not z.eof and at < len(view):
            yield z.decompress(view[at : at + take])
            # What a small member leaves unused is copied, so members are fed little by little.
            at += min(take, len(view) - at)
            take = min(2 * take, 1 << 20)
        at -= len(z.unused_data)


class Stream(io.RawIOBase):
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.left = piece
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive; ValueError where it is broken."""
    f = io.BufferedReader(Stream(unzip(content)), 1 << 20)
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.partition(b":")
            head[k.decode().strip().lower()] = v.decode().strip()
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield head, block


FIELDS = ("record_id", "kind", "capture", "refers_to", "uri", "date", "digest", "payload_bytes", "page", "payload")
RECORDS = "record_id string, kind string, capture string, refers_to string, uri string, date string, digest string, payload_bytes long, page long, payload binary"


def records(spark, path: str, payload: bool = False) -> DataFrame:
    """One row per record; ``capture`` is the id of the record that it is concurrent to, or its own. Digest and size are those of the payload as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for i in range(b.num_rows):
                out: list[tuple] = []
                for head, block in parse(b.column(0)[i].as_py()):
                    if head.get("warc-type") == "warcinfo":
                        continue
                    kind, page, body = head.get("warc-type", ""), None, b""
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        body = block.partition(END)[2]
                        digest = sha1_32(body)
                    elif kind == "metadata" and block.startswith(b"page-id: "):
                        page = int(x) if (x := block[9:].partition(b"\r\n")[0]) else None
                    out.append((head["warc-record-id"], kind, head.get("warc-concurrent-to", head["warc-record-id"]), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, len(body), page, body if payload else None))
                    if len(out) == 2048 or payload and len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], FIELDS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], FIELDS)

    # A task without rows leaves an empty file; an empty table may leave none at all.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, RECORDS)


def captures(rows: DataFrame) -> DataFrame:
    """One nested row per capture: capture id, request, response (or revisit) and metadata. A repeated record counts once."""
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("record_id", "kind", "uri", "date", "digest", "payload_bytes", "refers_to", "page", "payload")))
    return rows.groupBy("capture").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata")).where("response is not null")


def resolved(found: DataFrame) -> DataFrame:
    """Per capture page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id); revisits take size and digest from their response."""
    flat = materialize(found.select("capture", F.col("metadata.page").alias("page_id"), "response.kind", "response.payload_bytes", "response.digest", "response.refers_to"), "captures")
    there = flat.where("kind = 'response'").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("digest").alias("to_digest"))
    first = flat.where("kind = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = flat.where("kind = 'revisit'").join(there, "refers_to", "left").select("page_id", F.col("to_bytes").alias("payload_bytes"), F.coalesce("to_digest", "digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("to_page").alias("refers_to"))
    return first.unionAll(again)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back and assemble their captures."""
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(captures(records(spark, path)))


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * i}) & 31)::INT + 1, 1)" for g in range(8) for i in range(4))
#: What op7_warc returns, from the pages alone.
OP7_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, n::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
