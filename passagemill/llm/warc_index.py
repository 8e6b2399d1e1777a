"""WARC archives and their capture index.

Archives hold a record per page: ``response`` with the payload, or ``revisit`` where another record
has an equal payload. They are written by Spark's text sink, a line each, whose separator is the blank line
that ends every record, so that commits are safe on any file system. They are cut by bytes.

The capture index is built by an external merge. Each archive gives a run of entries sorted by URL
key and timestamp. Runs are cut at common key ranges, and each range is merged from its k runs by a
loser tree, which names the next entry after one comparison a level. The ranges are in order, so the
merged parts are one globally ordered capture history. There are so many ranges that each has about
RANGE_ROWS entries at any size of the archives; a task holds its range's runs as Arrow columns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, stage, trim

END = "\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
MIN_PAYLOAD = 0
#: Bytes in an archive, but for one record that is longer. An archive is read back as one value, of which a task has
#: several copies in the JVM and in Python.
ARCHIVE_BYTES = 32 << 20
#: Pages whose records are made at a time, and entries of all runs of a range that are Python values at a time, about.
AT_ONCE, ENTRIES = 256, 65_536
#: Entries in a range of the merge, about.
RANGE_ROWS = 250_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, in lower case, without scheme, www, port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
    except ValueError:
        return (url or "").lower()
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{query}"


def _header_value(text: str) -> str:
    """A header line can't hold line ends; they are percent-coded, as in URLs."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _record(page: int | None, url: str, html: str, stamp: str, sha1: str, keeper: int | None) -> bytes:
    data = html.encode()
    revisit = keeper is not None and keeper != page
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Date: {_header_value(stamp)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {len(data)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{keeper}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        data = b""
    else:
        data = HTTP.format(len(data)).encode() + data
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(data)}"]
    return "\r\n".join(head).encode() + END.encode() + data


def _archives(most: int):
    """The records of a task, joined to archives of at most ``most`` bytes, or of one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], ["archive"])

        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True):
                    record = _record(*row)
                    if held and size + len(record) + len(END) > most:
                        yield whole()
                        held, size = [], 0
                    held.append(record)
                    size += len(record) + len(END)
        if held:
            yield whole()
        held = []
        trim()

    return run


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, stamp: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record for each row of pages(page_id, url, html) as WARC files in the folder ``path``.

    Of equal payloads of at least ``min_payload`` bytes, that with the largest page_id is the response.
    A null html is an empty payload and a null url an empty one; a null page_id gets an empty name and
    never is what others refer to. Repeated rows get a record each; those that repeat page_id and
    payload are alike, so all of them are responses if their page is the one referred to. ``fetched_at``, where pages has
    it as an ISO string, dates a record; else ``stamp`` does. An empty table gives no records. Other
    columns are not read.
    """
    date = F.coalesce(F.col("fetched_at").cast("string"), F.lit(stamp)) if "fetched_at" in pages.columns else F.lit(stamp)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), date.alias("date"), F.sha1(html).alias("sha1"))
    shared = rows.where(F.octet_length("html") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = stage(shared.where("n > 1").select("sha1", "keeper"), "keepers")
    records = rows.join(keepers, "sha1", "left").select("page_id", "url", "html", "date", "sha1", "keeper")
    archives = records.mapInArrow(_archives(ARCHIVE_BYTES), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)
    return path


def records_of(data: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, payload) of each record of an archive."""
    at, whole = 0, data.obj if isinstance(data.obj, bytes) else bytes(data)
    while at < len(data):
        if whole[at : at + len(VERSION)] != VERSION:
            raise ValueError(f"no record at {at}")
        body = whole.index(END.encode(), at) + len(END)
        lines = whole[at + len(VERSION) : body - len(END)].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines)
        end = body + int(head["Content-Length"])
        yield at, end - at, head, data[body:end]
        at = end + len(END)


ENTRY = "url_key string, date string, page_id long, run string, at long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _named(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _order(entry: tuple) -> tuple:
    """URL key, timestamp, page; a null page comes first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive gives one sorted run; responses are digested anew."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = []
            for at, length, head, payload in records_of(memoryview(content.as_py())):
                size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    payload = payload[bytes(payload).index(END.encode()) + len(END) :]
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                run.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], _named(head["WARC-Record-ID"]), path, at, length, head["WARC-Type"], size, digest, _named(head.get("WARC-Refers-To"))))
            run.sort(key=_order)
            columns = zip(*run, strict=True) if run else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)
    trim()


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterable], key):
        self.k, self.key = max(1, len(runs)), key
        self.runs = [iter(r) for r in runs] or [iter(())]
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _next(self, i: int):
        entry = next(self.runs[i], None)
        return None if entry is None else (self.key(entry), i, entry)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and a[:2] < b[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _entries(batch: pa.RecordBatch, step: int) -> Iterator[tuple]:
    """A run's entries, a few at a time as Python values."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def _run_of(pieces: list[pa.RecordBatch], step: int) -> Iterator[tuple]:
    for piece in pieces:
        yield from _entries(piece, step)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: its rows stand run by run, each run sorted."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        names = batch.column(NAMES.index("run"))
        coded = names.dictionary_encode()
        numbers = coded.indices.to_numpy()
        edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if names[a].as_py() != last:
                runs.append([])
                last = names[a].as_py()
            runs[-1].append(batch.slice(a, b - a))
    out, step = [], max(16, min(1000, ENTRIES // max(1, len(runs))))
    for entry in LoserTree([_run_of(run, step) for run in runs], _order):
        out.append(entry)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, in order of url_key, date and page_id.

    Key ranges also cut the captures of one URL, so a URL that holds a third of all rows is no
    single task's.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("path").contains("/part-")).select("path", "content")
    runs = stage(files.mapInArrow(_runs, ENTRY), "capture-runs")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(usual, -(-runs.count() // RANGE_ROWS))
    ranges = runs.repartitionByRange(n, "url_key", "date", "page_id").sortWithinPartitions("run", "url_key", "date", "page_id", "at")
    return ranges.mapInArrow(_merge, ENTRY)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return capture_index(spark, write_archives(pages, fresh_path(spark, "warc")))
