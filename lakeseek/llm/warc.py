"""WARC archives and their capture index by external merge.

write_warc() writes records as files of the shared folder, read_warc() reads them
back by Content-Length, each archive as a run of captures sorted by URL key, time and
id. The runs are tables in the shared folder; merge_runs() deals them out by key
range and merges the runs that meet in a range with a loser tree, so capture
histories are in one global order: part by part, place by place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

#: Records of one archive file at most; bytes from which a payload is long; bytes that an archive of long ones should have at most (a longer payload is alone in its file).
FILE_RECORDS, LONG, FILE_BYTES = 2_000, 32_768, 64_000_000
#: Captures of one index part that runs are merged for, and rows of a run whose keys are decoded at once.
PART_CAPTURES, STRETCH = 200_000, 256
RUN = "page_id long, url string, urlkey string, ts string, record_type string, payload_bytes long, payload_digest string, refers_to long, run string, seq int, offset long"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 40 hex digits are four times eight base-32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4))), digits, letters)


def repeated(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(digest, first): payloads of min_payload bytes or more that several pages have, and the smallest page_id of each. Written once."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.where(F.octet_length(html) >= min_payload).select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html.cast("binary")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    return cut(first.select("digest", "first"), "payloads")


def size_class(size: Column) -> Column:
    """0 up to LONG bytes, then n up to LONG * 2^n."""
    return F.when(size <= LONG, 0).otherwise(F.length(F.bin(F.floor((size - 1) / LONG))))


def records(pages: DataFrame, first: DataFrame) -> DataFrame:
    """(page_id, url, html) -> what each record says: digest, length, time, type and what it refers to.

    Of equal payloads that are among the repeated ones, that of the smallest page_id is
    a response and the others are revisits of it. Rows that share that id are all
    responses, as are all if every id is null. Only digests are grouped; a payload
    that a third of all pages share is a key of many rows, which a join can split.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rows = rows.join(first, "digest", "left")
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)))
    when = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select("page_id", "url", "html", "digest", "bytes", when.alias("date"), F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_payload: int = 0) -> str:
    """A record for each row, in gzip files bounded by records and bytes: long payloads have files of their own, by powers of two of their size; times follow page_id. Returns path."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    classes = sorted({0, *(r[0] for r in pages.where(size > LONG).select(size_class(size)).distinct().collect())})  # 32 at most
    first = repeated(pages, min_payload)
    for n in classes:
        most = FILE_RECORDS if n == 0 else max(1, FILE_BYTES // (LONG << n))
        rows = _record_lines(records(pages.where(size_class(size) == n), first))
        rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{n:02d}")
    return path


def _record_lines(rows: DataFrame) -> DataFrame:
    """(value): each record's headers and block, but for the line ends after it."""
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.replace("url", F.lit("\r"), F.lit("%0D")), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: "), F.col("date"), F.lit(f"{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
    )
    return rows.select(F.concat(head, block).alias("value"))


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of one site sort together."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + ("?" + "&".join(sorted(u.query.lower().split("&"))) if u.query else "")


def parse_records(data: io.BufferedIOBase):
    """(headers, block, offset) of each record of an archive; offsets are into what is unpacked, as one archive is one gzip stream."""
    at = 0
    while line := data.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {at}")
        n, headers = len(line), {}
        while (line := data.readline()) != b"\r\n":
            if not line:
                raise ValueError("archive ends inside a record")
            name, _, value = line.decode().rstrip(CRLF).partition(": ")
            headers[name] = value
            n += len(line)
        block = data.read(int(headers["Content-Length"]))
        if len(block) < int(headers["Content-Length"]) or data.read(4) != b"\r\n\r\n":
            raise ValueError("archive ends inside a record")
        yield headers, block, at
        at += n + 2 + len(block) + 4


def _order(row: tuple) -> tuple:
    return row[2], row[3], row[0] is not None, row[0] or 0


def _run(name: str, content: bytes) -> list[tuple]:
    """An archive's captures, sorted. Digest and length of a response are those of the payload as read."""
    ids = lambda urn: None if (x := re.fullmatch(r"<urn:x-page:(.+)>", urn)[1]) == "null" else int(x)
    rows = []
    for h, block, at in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
        refers = ids(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
        url = h.get("WARC-Target-URI", "")
        rows.append((ids(h["WARC-Record-ID"]), url, url_key(url), h["WARC-Date"], h["WARC-Type"], n, digest, refers, name, at))
    rows.sort(key=_order)
    return rows


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Runs of captures: a row for each record of the archives, sorted inside each archive (run, seq)."""
    names = [f.split()[0] for f in RUN.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RUN.split(", ")])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(*r[:9], i, r[9]) for i, r in enumerate(_run(name.rsplit("/", 1)[-1], content.as_py()))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, RUN)


class LoserTree:
    """Merges k sorted lists: each inner node holds the loser of its match, so the next row costs log2(k) comparisons."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.loser[node] < 0:  # the first to come waits for the other
                self.loser[node] = i
                return
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._replay(w)


class Run:
    """Rows start to stop of a table, sorted, as (urlkey, ts, has an id, id, row); keys are decoded by the stretch."""

    def __init__(self, table: pa.Table, start: int, stop: int):
        self.table, self.start, self.stop, self.at, self.held = table, start, stop, -1, []

    def __len__(self) -> int:
        return self.stop - self.start

    def __getitem__(self, i: int) -> tuple:
        if i // STRETCH != self.at:
            self.at = i // STRETCH
            first = self.start + self.at * STRETCH
            some = self.table.slice(first, min(STRETCH, self.stop - first))
            self.held = [(k, t, p is not None, p or 0, first + j) for j, (k, t, p) in enumerate(zip(*(some.column(c).to_pylist() for c in ("urlkey", "ts", "page_id")), strict=True))]
        return self.held[i % STRETCH]


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs -> captures in one order by (urlkey, ts, page_id): their columns and index_part, index_place.

    Ranges are cut by all three, so one URL with a third of all captures is dealt to
    many parts. A task holds the captures of its part, about PART_CAPTURES, as Arrow
    columns; of the runs that meet there only the stretches that the tree stands at are
    decoded, and rows go out as they win.
    """
    parts = max(1, -(-runs.count() // PART_CAPTURES))
    parts = max(parts, min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * 4))

    def merge(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        name = table.column("run").combine_chunks()
        starts = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1))).to_pylist()), len(name)]
        tree, place = iter(LoserTree([Run(table, a, b) for a, b in zip(starts, starts[1:], strict=False)], lambda x: x[:4])), 0
        while rows := [x[4] for x in itertools.islice(tree, 10_000)]:
            won = table.take(pa.array(rows)).append_column("index_place", pa.array(range(place, place + len(rows)), pa.int64()))
            place += len(rows)
            yield from won.to_batches()

    dealt = runs.repartitionByRange(parts, "urlkey", "ts", "page_id").sortWithinPartitions("run", "seq")
    return dealt.withColumn("index_part", F.spark_partition_id()).mapInArrow(merge, f"{RUN}, index_part int, index_place long")


def capture_index(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back and merges the runs. Null html is an empty payload; an empty table has no capture."""
    spark = pages.sparkSession
    return merge_runs(cut(read_warc(spark, write_warc(pages, new_path(spark, "warc"), min_payload)), "runs"))
