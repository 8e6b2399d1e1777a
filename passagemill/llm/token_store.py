"""Token-ID output: id arrays with Elias-Fano coded document boundaries.

A store is a folder of segment files in ascending doc_id order and a table of segments. A segment
holds a run of documents:

    magic "TIDS"   4 bytes     version, id width (2 or 4)   2 x u16
    documents n    u64         ids t                         u64
    low bits l     u64         bytes of each part            5 x u64
    doc ids        n x i64, then one byte a document that is 1 where doc_id is null
    low parts      l bits a boundary, packed
    high parts     bit vector of n + (t >> l) bits
    samples        u32 position of every 256th one in the high parts
    ids            t x width, little endian

Boundary i is the end of document i, so n boundaries with universe t take about n * (2 + log2(t/n))
bits. select(i) starts at the sample of i // 256, skips whole 64-bit words by their popcount, and
returns ((position of the i-th one - i) << l) | low[i]; no table of 64-bit offsets is kept.

Files are written by Spark's text sink: one row a segment, and a trailer as the separator of lines,
so the commit protocol of any file system holds. They are read by the binaryFile source.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, stage, trim
from .tokenize import encoded

MAGIC, TRAILER = b"TIDS", "\nSDIT\n"
HEADER = struct.Struct("<4sHH8Q")
SAMPLE = 256
#: Ids gathered before a segment is closed; a document is never parted.
SEGMENT_IDS = 500_000
#: Segments in a file; a file is read as one value, which must stay below 2 GB.
FILE_SEGMENTS = 32


class EliasFano:
    """A sorted sequence of integers below or at ``universe``."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int):
        self.l, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n
        padded = np.zeros(-(-len(high) // 8) * 8, np.uint8)
        padded[: len(high)] = high
        self.words = padded.view("<u8")

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        l = max(0, int(np.floor(np.log2(universe / n)))) if n and universe > n else 0
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        flags = np.zeros(n + (int(universe) >> l) + 1, np.uint8)
        flags[ones] = 1
        return cls(l, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u4"), n)

    def lows(self) -> np.ndarray:
        bits = np.unpackbits(self.low, count=self.n * self.l, bitorder="little").reshape(self.n, self.l)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.l, dtype=np.uint64)) if self.l else np.zeros(self.n, np.uint64)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.l) + self.lows().astype(np.int64)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at // 64
        bits = int(self.words[word]) >> (at % 64) << (at % 64)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        position = word * 64 + (bits & -bits).bit_length() - 1
        low = 0
        for k in range(self.l):
            b = i * self.l + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (position - i) << self.l | low


class Segment:
    def __init__(self, data: memoryview):
        magic, _, self.width, self.n, self.t, l, *sizes = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        ends = np.cumsum([HEADER.size, *sizes])
        part = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.size = int(ends[-1])
        self.doc_ids = np.frombuffer(part[0], "<i8", self.n)
        self.nulls = np.frombuffer(part[0], np.uint8, self.n, 8 * self.n)
        high, samples = np.frombuffer(part[2], np.uint8), np.frombuffer(part[3], "<u4")
        self.ends = EliasFano(l, np.frombuffer(part[1], np.uint8), high, samples, self.n)
        self.ids = np.frombuffer(part[4], f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def offsets(self) -> np.ndarray:
        """Where each document begins, by select(), with the number of all ids behind the last."""
        return np.array([0, *map(self.ends.select, range(self.n))], np.int64)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    ends = np.cumsum(np.array(lengths, np.int64))
    t = int(ends[-1])
    ef = EliasFano.encode(ends, t)
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"an id above {(1 << 8 * width) - 1} doesn't fit in {width} bytes")
    narrow = wide.astype(f"<u{width}").tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    parts = [keys, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), narrow]
    return HEADER.pack(MAGIC, 1, width, len(doc_ids), t, ef.l, *map(len, parts)) + b"".join(parts)


def _segments(path: str, end_id: int, width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        docs: list[int | None] = []
        lengths: list[int] = []
        ids = bytearray()

        def close() -> pa.RecordBatch:
            out = pa.array([pack_segment(docs, lengths, bytes(ids), width)], pa.binary())
            docs.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([out], ["segment"])

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1), end), strict=True):
                docs.append(doc)
                lengths.append(len(own) // 4)
                ids += own
                if len(ids) >= 4 * limit:
                    yield close()
        if docs:
            yield close()
        trim()

    return run


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2, segment_ids: int = SEGMENT_IDS) -> str:
    """Write documents(doc_id, text) as a token store at path, in ascending doc_id order.

    A null text counts as empty; a null doc_id comes first; equal doc_ids stay neighbours in no set
    order; an empty table gives a store without segments. Other columns are not read. ``width`` is
    2 for vocabularies of at most 65,536 ids, else 4; an id that doesn't fit is an error. A file has at
    most FILE_SEGMENTS segments, so that it can be read whole.
    """
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(_segments(tokenizer, end_id, width, segment_ids), "segment binary")
    rows.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", TRAILER).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    return path


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(content.as_buffer())
            at = 0
            while at < len(data):
                segment = Segment(data[at:])
                offsets = segment.offsets()
                starts, ends = offsets[:-1], offsets[1:]
                wide = memoryview(segment.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                docs = pa.array(segment.doc_ids, mask=segment.nulls.astype(bool))
                n = segment.n
                fields = [pa.array([path] * n), pa.array(np.full(n, at)), docs, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(fields, ["file", "at", "doc_id", "local_start", "n_tokens", "ids_crc32"])
                at += segment.size + len(TRAILER)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store, read back from its files: file, doc_id, start, n_tokens, ids_crc32.

    ``start`` adds up the files before, then the segments before in the file; one row a file is
    ordered in one task, not the segments or documents.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("path").contains("/part-")).select("path", "content")
    rows = files.mapInArrow(_documents, "file string, at long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    rows = stage(rows, "token-documents")
    sizes = rows.groupBy("file", "at").agg(F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("first"))
    files = sizes.groupBy("file").agg(F.sum("ids").alias("ids"), F.min("first").alias("first"), F.count_if(F.col("first").isNull()).alias("nulls"))
    before = F.sum("ids").over(Window.orderBy(F.desc(F.col("nulls") > 0), F.asc_nulls_first("first"), "file")) - F.col("ids")
    within = F.sum("ids").over(Window.partitionBy("file").orderBy("at")) - F.col("ids")
    bases = sizes.withColumn("within", within).join(files.select("file", before.alias("before")), "file")
    bases = bases.select("file", "at", (F.col("before") + F.col("within")).alias("base"))
    joined = rows.join(bases, ["file", "at"])
    return joined.select("file", "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(spark: SparkSession, documents: DataFrame, tokenizer: str) -> DataFrame:
    return read_store(spark, write_store(documents, fresh_path(spark, "token-store"), tokenizer))
