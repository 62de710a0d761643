"""WARC archives of web pages, and a merged index of their captures.

A payload of at least ``least_bytes`` that stands in several pages is stored once, by the smallest page_id; the others
revisit it. Each record is a gzip member of its own (several, above ``MEMBER_BYTES``), so that an index entry's offset and
length are the bytes to read for one record. Archives are written by Spark's text writer, so they go to any file system
that Spark reaches: a member's last byte is the highest of its size, which is zero, and serves as the line separator.

Reading parses whole archives by the records' lengths and gives one locally sorted run of index entries for each archive.
Runs meet in ranges of (URL key, timestamp, page), and each range merges its runs by a loser tree, so that the ranges in
order are one globally ordered capture history. A URL of any number of captures lies in several ranges.

A join with the shared payloads deals pages by digest; small pages get keys of their own, and adaptive execution splits a
digest of very many pages.

Cases: null html is an empty payload; a null url is an empty one; control characters in a url are dropped; of rows of the
smallest page_id and an equal payload, one is the response and the others revisit it; a null page_id comes after all others
and is named by null; an empty table gives no records; a very large page is one record in several members.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import after_parts, new_path, staged

LEAST_BYTES = 100
ARCHIVE_BYTES = 32 << 20
MEMBER_BYTES = 8 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures without a time of their own are dated from here, by their id.
_EPOCH = 1_704_067_200


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column, ``value``: each page's record. ``pages`` is read twice and its rows are numbered; give a stored table."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x1f\x7f]", "").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    lead = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn("key", F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string"))))
    rows = rows.join(shared, rows["key"] == shared["of"], "left").withColumn("first", F.col("lead.page_id"))
    revisit = F.col("lead").isNotNull() & (F.col("lead.row") != F.col("row"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    when = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", when),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", name(F.col("first"))), _line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block, F.lit(_END)).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **names) -> None:
    html = names.get("html", "html")
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(html), F.lit(0))).alias("m")).first()["m"] or 0
    per_file = max(1, int(archive_bytes / (mean + 600)))

    def compress(batches):
        for batch in batches:
            out = []
            for x in batch.column(0):
                raw = memoryview(x.as_buffer())
                members = [gzip.compress(raw[a : a + MEMBER_BYTES], 6, mtime=0) for a in range(0, len(raw), MEMBER_BYTES)]
                out.append(b"".join(members)[:-1])  # the line separator is the last byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = records(pages, **names).mapInArrow(compress, "value binary").select(F.col("value").cast("string"))
    # the members are compressed already; Hadoop knows them by their ending only, so they have none
    members.write.option("lineSep", "\x00").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def members(archive: memoryview, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member from byte ``at`` on."""
    while at < len(archive):
        inflate, parts, end = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if end >= len(archive):
                raise ValueError(f"the member at byte {at} is cut off")
            parts.append(inflate.decompress(archive[end : end + 16_384]))
            end = min(end + 16_384, len(archive))
        end -= len(inflate.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(archive: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset and length in the archive, headers and block of each record."""
    rest = members(archive)
    for at, size, data in rest:
        head = data.index(b"\r\n\r\n")
        version, *lines = data[:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        end = head + 4 + int(headers["Content-Length"])
        while len(data) < end + 4:  # a large record's further members
            _, more, part = next(rest)
            size, data = size + more, data + part
        if data[end:] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield at, size, headers, memoryview(data)[head + 4 : end]


def url_key(url: str) -> str:
    """The host's labels in reverse, then the path: captures of a site stand together."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#]*)([^#]*)", url)
    host = re.sub(r":\d+$", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


INDEX = "run string, url_key string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"
ORDER = ["url_key", "timestamp", "page_id"]


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of each archive, as one run sorted by URL key, timestamp and page."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, size, h, block in parse(memoryview(content.as_buffer())):
                    http = bytes(block).index(b"\r\n\r\n") + 4
                    if h["WARC-Type"] == "response":
                        payload = block[http:]
                        count, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                        if f"sha256:{digest}" != h["WARC-Payload-Digest"]:
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
                    else:
                        count = int(re.search(rb"Content-Length: (\d+)", bytes(block))[1])
                        digest, refers = h["WARC-Payload-Digest"].removeprefix("sha256:"), _page(h["WARC-Refers-To"])
                    stamp = re.sub(r"\D", "", h["WARC-Date"])
                    rows.append((str(name), url_key(h["WARC-Target-URI"]), stamp, _page(h["WARC-Record-ID"]), h["WARC-Type"], count, digest, refers, at, size))
                rows.sort(key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return archives.mapInArrow(read, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that the next entry costs one match a level."""

    def __init__(self, runs: Sequence[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.n = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node:
            rival = self.losers[node]
            if rival == -1:  # an open place while the tree is built
                self.losers[node] = winner
                return
            if self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.n and self.heads[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


def capture_history(runs: DataFrame) -> DataFrame:
    """All entries in global order: by ``part``, then ``place``."""
    ranges = runs.repartitionByRange(*ORDER).sortWithinPartitions("run", *ORDER)

    def merge(batches):
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks()
        run, *keys = (table.column(c).to_pylist() for c in ["run", *ORDER])
        entries = list(zip(keys[0], keys[1], [(k is not None, k or 0) for k in keys[2]], range(len(run)), strict=True))
        cuts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        order = [e[-1] for e in LoserTree([entries[a:b] for a, b in zip(cuts, cuts[1:])])]
        part = TaskContext.get().partitionId()
        merged = table.take(pa.array(order)).append_column("part", pa.array([part] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    return ranges.mapInArrow(merge, INDEX + ", part int, place long")


def with_global_place(history: DataFrame) -> DataFrame:
    """``history`` with its place among all entries, in place of part and place."""
    return after_parts(history, "part", history.groupBy("part").count(), "base").withColumn("place", F.col("base") + F.col("place")).drop("part", "base")


def digest(pages: DataFrame) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; and its place in the history."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path)
    history = with_global_place(staged(capture_history(staged(capture_runs(spark, path), "captures")), "history"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "place")


DIGEST_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\x00-\x1f\x7f]', '', 'g') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS n, sha256(html) AS digest,
        regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#]*)([^#]*)', 1) AS host,
        regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#]*)([^#]*)', 2) AS path FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') AS stamp,
        array_to_string(list_reverse(string_split(regexp_replace(lower(host), ':[0-9]+$', ''), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, url_key, stamp AS timestamp, row_number() OVER (ORDER BY url_key, stamp, page_id) - 1 AS place FROM k
"""
