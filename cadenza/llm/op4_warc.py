"""WARC: archives of pages, read back into a capture index that is merged in global order.

Writing: records are lines of a text table whose line end is the record end CRLF CRLF,
so Spark writes the archives to any store it knows. Records are written by CLASSES of size, each with
its own number of records a file: no file is longer than some 64 MB before it is packed, but for
one of a single longer record, wherever long records stand together. With gzip a file is one stream and an index offset is one
of the unpacked file; with compression "none" it seeks in the file itself.
Of equal payloads of at least LEAST bytes the one with the largest page_id is a
response, the others are revisits that refer to it.

Reading: each archive is parsed by its content lengths and gives a run of index rows,
sorted by (URL key, timestamp, page_id) and written. The runs are range-partitioned by that
key into ranges of about RANGE_ROWS rows, however many runs there are, and each range merges
its slices of runs through a loser tree: a slice stays in the Arrow batches that it came in,
and the tree sees one row of each. Ranges in order, and rows in order within them, make the
capture histories of all URLs. A hot URL's captures are split by timestamp and page_id.

Null html is an empty payload; null urls have the key ''. Rows with a null page_id are
responses. Rows of equal page_id and payload have the same type. An empty table gives
an empty archive. Line ends in urls are percent-encoded; other columns are not archived.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, quoted, shared_dir, written

#: Payload bytes from which copies become revisits.
LEAST = 1000
#: Payload bytes up to which records are in a class (the last has all others), and how many of them a file has at most.
CLASSES = [(64 << 10, 1000), (1 << 20, 64), (8 << 20, 8), (None, 1)]
#: Rows of the index that one task merges: 200 bytes each, some 50 MB.
RANGE_ROWS = 250_000


def record_id(page_id: Column, digest: Column) -> Column:
    """Of page_id and payload; without a page_id, of url and time besides."""
    bare = F.when(page_id.isNull(), F.concat_ws(":", F.lit("none"), "url", F.col("captured").cast("string")))
    h = F.md5(F.concat_ws(":", page_id.cast("string"), bare, digest))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def records(pages: DataFrame, captured: Column) -> DataFrame:
    """record: the text of each page's WARC record, without the end. pages: page_id, url, html."""
    p = pages.select("page_id", "url", captured.alias("captured"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    # which pages are revisits is found without their payloads
    small = p.where(f"size >= {LEAST} AND page_id IS NOT NULL").select("page_id", "digest", "size")
    last = small.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n", "size")
    revisits = small.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    p = p.join(revisits, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), record_id(F.col("page_id"), F.col("digest")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), F.when(again, record_id(F.col("refers_to"), F.col("digest"))), F.lit(">")),
        F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))).cast("string")),
    )
    return p.select(F.concat(head, F.lit("\r\n\r\n"), http, F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str, captured: Column, classes: list[tuple[int | None, int]] = CLASSES, compression: str = "gzip") -> None:
    """Writes the pages' records as WARC files under path. Equal payloads are of one class; a class without pages is not written."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    above, parts = -1, []
    for most, per_file in classes:
        parts.append(((size > above) & (size <= most if most is not None else F.lit(True)), per_file))
        above = most
    counts = pages.agg(*(F.count_if(c).alias(f"c{k}") for k, (c, _) in enumerate(parts))).first()
    used = [p for k, p in enumerate(parts) if counts[k]] or parts[:1]
    for within, per_file in used:
        records(pages.where(within), captured).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of each record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        yield head, raw[end + 4 : stop], at
        at = stop + 4


#: User, host (an address in brackets, or up to a port), and the path and query without a fragment.
URL = re.compile(r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)[^/?#]*([^#]*)", re.S)


def url_key(url: str) -> str:
    """The host's labels reversed, then the path and query: related pages sort together. Without a host, the url."""
    host, rest = URL.match(url.partition("://")[2]).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + ("" if rest.startswith("/") else "/") + rest if host else url


INDEX = "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, run string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """INDEX rows of all archives under path, each file a run in order of url_key, captured, page_id."""
    schema = ddl(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                raw = content.as_py()
                for head, block, offset in parse(gzip.decompress(raw) if name.endswith(".gz") else raw):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    again = head["WARC-Type"] == "revisit"
                    page, to = (int(head[x]) if x in head else None for x in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if again else sha1(payload).hexdigest()
                    size = int(head["X-Payload-Length"]) if again else len(payload)
                    rows.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], page, size, digest, head["WARC-Type"], to, name, offset, name))
                rows.sort(key=order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], names=schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


ARROW = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("run", pa.string())])


def order(row: tuple) -> tuple:
    """The merge's key: Spark's order of url_key, captured, page_id (nulls first), then file and offset."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so that a row costs one climb."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else order(h) for h in self.heads]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self.climb(i)

    def wins(self, i: int, j: int) -> bool:
        a, b = self.keys[i], self.keys[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def climb(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = i
                return
            if self.wins(held, i):
                self.tree[node], i = i, held
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (best := self.tree[0]) >= 0 and self.heads[best] is not None:
            yield self.heads[best]
            self.heads[best] = head = next(self.runs[best], None)
            self.keys[best] = None if head is None else order(head)
            self.climb(best)


def merged(runs: DataFrame) -> DataFrame:
    """The runs' rows in global order: partitions by range, each merged from its pieces of runs."""
    schema = ddl(INDEX)

    def rows_of(slices: list[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices:
            for lo in range(0, b.num_rows, 64):  # few rows at a time leave Arrow
                yield from zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:  # each run's rows are in order and together
            names = b.column(9)
            turn = [0, *(i for i in range(1, b.num_rows) if names[i] != names[i - 1]), b.num_rows]
            for lo, hi in zip(turn, turn[1:], strict=False):
                if hi > lo:
                    pieces.setdefault(names[lo].as_py(), []).append(b.slice(lo, hi - lo))
        out = []
        for row in LoserTree([rows_of(p) for p in pieces.values()]):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], names=schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], names=schema.names)

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    place = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "file", "offset"]
    return runs.repartitionByRange(n, *place).sortWithinPartitions("run", *place).mapInArrow(merge, schema)


def capture_histories(pages: DataFrame, captured: Column, path: str | None = None) -> DataFrame:
    """Archives the pages and returns the merged index of what was written."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/cadenza/warc-{uuid.uuid4().hex}"
    write_archives(pages.select(*[quoted(c) for c in ("page_id", "url", "html")]), path, captured)
    return merged(written(read_runs(spark, path), "warc-runs"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)))  # the table has no times
    out = capture_histories(pages, at)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url FROM pages),
o AS (SELECT *, regexp_replace(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*@', '') AS rest, strlen(payload) >= 1000 AND page_id IS NOT NULL AS large FROM p),
q AS (SELECT *, regexp_extract(rest, '^(\[[^\]/?#]*\]|[^:/?#]*)', 1) AS host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS path FROM o),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM q)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN large AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN large AND page_id < last THEN last END AS refers_to,
  CASE WHEN host = '' THEN url ELSE array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END END AS url_key,
  strftime(make_timestamp((1600000000 + coalesce(page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM r
"""
