"""WARC archives and the external merge of their capture index.

An archive is a file of gzip members, one for each record, so a record is read alone from its place and length in the file. Archives are
written by Spark's own text writer (any Hadoop file system, committed by task): a row is one member, and the line separator an empty
member, which readers of concatenated members skip. They are read back as whole files, member by member. Each
archive yields one locally sorted run of captures; the runs are written, dealt out by ranges of (URL key, timestamp) of bounded size, and each range
merges its share of the runs with a loser tree, which gives the capture histories in global order. Equal payloads are found by aggregation
of digests, and only digests of payloads that repeat meet the pages again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import lean, materialize, scratch_path, small_batches, table

#: Payloads below so many bytes are never revisits; bytes of an archive's payloads, on average, and records at most; captures of a range, about.
MIN_REVISIT, ARCHIVE_BYTES, RECORDS, RANGE_ROWS = 1000, 64 << 20, 5000, 100_000
_END = "\r\n\r\n"
RUN = "url_key string, ts string, page_id long, run string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ORDER = ["url_key", "ts", "page_id", "run", "offset"]


def classify(pages: DataFrame, ident: str = "page_id", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """`pages` with payload_bytes, payload_digest (SHA-1, hex) and refers_to: of equal payloads of `min_revisit` bytes or more the
    largest ident, null in its own row; other rows null."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    facts = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    long_ = F.col("payload_bytes") >= min_revisit
    groups = facts.where(long_).groupBy(F.col("payload_digest").alias("__d")).agg(F.max(ident).alias("__first"), F.count("*").alias("__c"))
    groups = materialize(groups.where("__c > 1").drop("__c"), "payloads")  # a table: where few payloads repeat, its known size lets Spark leave the pages where they are
    # short payloads have no partner; a key of their own keeps them from meeting in one task
    facts = facts.withColumn("__k", F.when(long_, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64(ident, "payload_digest").cast("string"))))
    out = facts.join(groups, F.col("__k") == F.col("__d"), "left").drop("__d", "__k")
    return out.withColumn("refers_to", F.when(~F.col(ident).eqNullSafe(F.col("__first")), F.col("__first"))).drop("__first")


def _member(raw: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


_NOTHING = _member(b"")


def write_archives(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html", captured: F.Column | None = None) -> None:
    """One WARC/1.1 record for each row of `classify`: a response with the payload, or a revisit without it. `captured`: the time of
    capture; without it, `ident` seconds after 2000-01-01."""
    at = captured if captured is not None else F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.abs(F.col(ident)) % F.lit(10**9), F.lit(0)))
    revisit, text = F.col("refers_to").isNotNull(), F.coalesce(F.col(html), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    lines = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", urn(F.col(ident))), ("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", size.cast("string")),
    ]
    head = F.concat(F.lit("WARC/1.1\r\n"), *(x for k, v in lines for x in (F.lit(k + ": "), v, F.lit("\r\n"))))
    extra = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit("\r\n"))
    record = F.concat(head, F.when(revisit, extra).otherwise(""), F.lit("\r\n"), http, F.when(revisit, "").otherwise(text), F.lit(_END))
    n, n_bytes = pages.agg(F.count("*"), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    most = max(1, min(RECORDS, n * ARCHIVE_BYTES // max(n_bytes, 1)))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_arrays([pa.array([_member(x.as_buffer()) for x in b.column(0).slice(lo, 256)], pa.binary())], names=["value"])

    small_batches(pages.sparkSession)
    rows = pages.select(record.alias("value")).mapInArrow(lean(compress), "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host labels reversed, then path and query, in lower case."""
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split(':')[0].split('.')))}){slash}{path.lower()}"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive that has content."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, out, to = zlib.decompressobj(31), [], at
        while not d.eof:
            if to >= len(data):
                raise ValueError(f"the member at {at} has no end")
            out.append(d.decompress(view[to : to + (1 << 16)]))
            to += 1 << 16
        to = min(to, len(data)) - len(d.unused_data)
        if content := b"".join(out):
            yield at, to - at, content
        at = to


def record(content: bytes) -> tuple[dict[str, str], memoryview]:
    """The header and block of one record."""
    end = content.index(b"\r\n\r\n")
    header = dict(x.split(": ", 1) for x in content[:end].decode("utf-8", "replace").split("\r\n")[1:])
    stop = end + 4 + int(header["Content-Length"])
    if content[stop:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its Content-Length says")
    return header, memoryview(content)[end + 4 : stop]


def fetch(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The header and payload of the record that an index entry points to, from those bytes of the archive alone."""
    header, block = record(zlib.decompress(archive[offset : offset + length], 31))
    return header, bytes(block).partition(b"\r\n\r\n")[2]


def _urn(x: str) -> int | None:
    x = x.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def run_of(name: str, content: bytes) -> list[tuple]:
    """The sorted captures of one archive, as rows of `RUN`. The digest of a response is that of what was read."""
    out = []
    for at, length, raw in members(content):
        h, block = record(raw)
        end = bytes(block[:4096]).index(b"\r\n\r\n")
        http, payload = bytes(block[:end]), block[end + 4 :]
        claimed, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b": ", 1)[1])
        if h["WARC-Type"] == "response":
            digest = hashlib.sha1(payload).hexdigest()
            if digest != claimed or size != len(payload):
                raise ValueError(f"{name}, record at {at}: the payload does not have its digest and length")
        out.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], _urn(h["WARC-Record-ID"]), name, at, length, size, claimed, h["WARC-Type"], _urn(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
    out.sort(key=rank)
    return out


def rank(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[3], row[4]


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, so the next row costs one path to the root."""

    def __init__(self, runs: list[list], key: Callable) -> None:
        self.its = [iter(r) for r in runs]
        self.key, self.n = key, len(runs)
        self.heads = [self._next(i) for i in range(self.n)]
        self.losers = [-1] * max(self.n, 1)
        self.winner = -1
        for i in range(self.n):
            self._play(i, building=True)

    def _next(self, i: int) -> tuple | None:
        row = next(self.its[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.n and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._play(i)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives of a folder, each archive's sorted: a row for each record."""
    schema = RUN

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = run_of(name.rsplit("/", 1)[-1], content.as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(lean(parse), schema)


def merge_runs(runs: DataFrame) -> DataFrame:
    """`runs` (a written table) in the global order of URL key, timestamp and ident: dealt out by ranges, each merged by a loser tree.

    A URL that a third of all captures share is split between ranges by timestamp and ident. A range holds about RANGE_ROWS captures, whatever the size of the index."""
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-runs.count() // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_run.setdefault(row[3], []).append(row)
        for rows in by_run.values():
            if any(rank(a) > rank(b) for a, b in zip(rows, rows[1:], strict=False)):  # a shuffle may mix a run's blocks
                rows.sort(key=rank)
        out = []
        for row in LoserTree(list(by_run.values()), rank):
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return runs.repartitionByRange(n, "url_key", "ts", F.col("page_id").asc_nulls_last(), "run", "offset").mapInArrow(lean(merge), runs.schema)


def archive(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` to WARC archives under `path`, read them back and return the capture index in global order (columns `RUN`).

    A null html has an empty payload, a null url an empty target. Of rows that tie for the largest ident of equal payloads, each is a
    response; if every ident of a group is null, so are all. Line breaks in a url are percent-coded. Extra columns are ignored. An empty
    table gives an empty index. An archive is read as a whole and must stay below 2 GB; it holds ARCHIVE_BYTES of payloads on average, so
    that asks for payloads of some tens of megabytes at most where many large ones follow each other."""
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    write_archives(classify(rows), path)
    return merge_runs(materialize(read_runs(pages.sparkSession, path), "runs"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP5 = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
