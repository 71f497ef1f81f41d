"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Tasks write a file each: a gzip member for each record, warcinfo first. A block is an HTTP response, with the page's html as
payload. Of pages with equal payloads the one with the largest id is the response; the others are revisits that name its address and hold the HTTP
head alone. Record ids are made of the file and the place in it, so that no two are the same; page ids are fields of their own. The index (file, offset, length, url, digest, record type) is a stored table, and only files that it
names count, so a task that is run again leaves at most a file that nobody reads. Selected index rows are
dealt out by slices of files to as many readers as the records' bytes need; each sorts its rows by file and offset,
joins ranges that are close, and parses the records from each range.

Defined results: null html is an empty payload; a null url is an empty one (urn:empty in the record, which may not be without); a page without id is a response
unless a page with an id has its payload, and then a revisit; rows that repeat the response's id are responses
too; an empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm.common import new_path, small_batches, stored, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Ranges with a gap of at most GAP bytes are read at once, up to RANGE bytes.
GAP, RANGE = 64_000, 4_000_000
#: Bytes of a file that go to one reader together, bytes of a reader's records (about), and the least number of readers.
SLICE, TASK_BYTES, TASKS = 8_000_000, 64_000_000, 16
#: Fixed value: the date of every record, so that a record is the same whenever it is written.
DATE = "2000-01-01T00:00:00Z"
#: Stands for an empty address.
EMPTY = "urn:empty"
#: Fixed value: the profile of revisits by payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, folder string, path string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[str], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = ["WARC/1.1", *fields, f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def info(path: str) -> bytes:
    """The first record of a file."""
    name = path.rsplit("/", 1)[-1]
    fields = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(path, 0)}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(fields, b"software: deliverix\r\nformat: WARC File Format 1.1\r\n")


def record(path: str, offset: int, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str) -> bytes:
    """The record of a page at its place in a file."""
    fields = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(path, offset)}",
        f"WARC-Warcinfo-ID: {record_id(path, 0)}",
        f"WARC-Target-URI: {url or EMPTY}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {refers_url or EMPTY}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(fields, head if refers_to is not None else head + payload)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a page's record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to and refers_url of every page. A payload with copies is keyed by its digest and length."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    copies = rows.filter(F.col("size") >= LEAST_BYTES).groupBy("sha", "size").agg(F.max(F.struct("page_id", "url")).alias("lead"), F.count("*").alias("n"))
    several = stored(copies.filter("n > 1").select("sha", "size", "lead.page_id", "lead.url").toDF("sha", "size", "lead", "lead_url"), "warc-leads")
    joined = rows.join(several, ["sha", "size"], "left")  # both sides are plain shuffles, so AQE splits the rows of a copied payload
    refers = F.when(F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("lead_url")).alias("refers_url"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes a record for every row of pages(page_id, url, html); returns the stored index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        path = f"{top}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            rows = []
            for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    at = out.write(info(path))
                payload = html.encode()
                digest = digest_of(payload)
                line = lambda x: " ".join((x or "").split())
                data = record(path, at, page_id, line(url), payload, digest, refers_to, line(refers_url))
                out.write(data)
                rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, folder, path, at, len(data)))
                at += len(data)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stored(with_types(pages).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[str, str, int, int]]) -> Iterator[tuple[str, str, int, int, list[tuple[int, int]]]]:
    """Coalesces sorted (folder, path, offset, length): file, start and end of a range, and the records in it."""
    now: tuple[str, str, int, int, list[tuple[int, int]]] | None = None
    for folder, path, offset, length in rows:
        if now and (now[0], now[1]) == (folder, path) and offset - now[3] <= GAP and offset + length - now[2] <= RANGE:
            now = (folder, path, now[2], max(now[3], offset + length), [*now[4], (offset, length)])
        else:
            if now:
                yield now
            now = (folder, path, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(selected: DataFrame) -> DataFrame:
    """The records of selected index rows; the payload of a revisit is null, its length and digest are those of the full one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for folder, path, start, end, records in ranges(rows):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(end - start)
                out = []
                for offset, length in records:
                    fields, block = parse(data[offset - start : offset - start + length])
                    number = lambda k: int(x) if (x := fields.get(k)) else None  # noqa: B023, E731
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and digest_of(block) != digest:
                        raise ValueError(f"damaged record at {path}:{offset}")
                    whole = block if kind == "response" else None
                    out.append((number("X-Page-ID"), int(fields["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page"), fields["WARC-Target-URI"].removeprefix(EMPTY), whole))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    slices = selected.select("folder", "path", F.floor(F.col("offset") / SLICE).alias("slice"), "offset", "length")
    size = slices.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(max(-(-size // TASK_BYTES), TASKS))  # an explicit number: index rows are small, and AQE would join the tasks by their size
    return slices.repartition(tasks, "path", "slice").sortWithinPartitions("path", "offset").drop("slice").mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS size, sha1(html) AS sha FROM p),
leads AS (SELECT html, max(page_id) AS lead, count(*) AS n FROM p GROUP BY html),
r AS (SELECT d.*, CASE WHEN lead IS DISTINCT FROM page_id THEN lead END AS refers_to FROM d JOIN leads USING (html))
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(sha, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
