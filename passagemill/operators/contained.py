"""Which chunks hold which texts as they are (M8's expected passages), by rolling hashes.

The seed of a text is its first 2^k bytes, 32 at most. Every window of a seed's length in every chunk is
hashed by doubling (windows of 2s bytes from those of s), and windows whose hash is no seed's are dropped by
a bit map of fixed size. What is left meets the texts in an equi-join on scope, length and hash, and is
verified on the whole text. No chunk is compared with a text whose seed it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

SIZES = (1, 2, 4, 8, 16, 32)
BITS = 20
BASE = 0x9E3779B97F4A7C15


def window_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the window of that size at each place where one begins), for each of SIZES."""
    h = data.astype(np.uint64) + np.uint64(1)
    for size in SIZES:
        if size > 1:
            half = size // 2
            if len(h) <= half:
                return
            with np.errstate(over="ignore"):
                h = h[:-half] * np.uint64(pow(BASE, half, 1 << 64)) + h[half:]
        if len(h):
            yield size, h


def _bits(hashes: np.ndarray, wide: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - wide)).astype(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text in the last column gets the length and the hash of its seed."""
    for batch in batches:
        sizes, seeds = [], []
        for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
            data = text.as_py() or b""
            best = (0, 0)
            for size, h in window_hashes(np.frombuffer(data[: SIZES[-1]], np.uint8)):
                best = size, int(h[:1].view(np.int64)[0])
            sizes.append(best[0])
            seeds.append(best[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(seeds, pa.int64())], [*batch.schema.names, "size", "seed"])


def _bit_maps(seeded: DataFrame):
    """A broadcast bit map of the seeds of each length: at most 2^20 / 64 words each come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(1).to_numpy().view(np.uint64), BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits >> 6), pa.array(np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64)).view(np.int64))], ["size", "at", "bits"])

    words = seeded.select("size", "seed").mapInArrow(run, "size int, at long, bits long").groupBy("size", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    maps: dict[int, np.ndarray] = {}
    for size, at, bits in zip(*(c.to_pylist() for c in words.columns), strict=True):
        maps.setdefault(size, np.zeros(1 << (BITS - 6), np.int64))[at] = bits
    return seeded.sparkSession.sparkContext.broadcast({size: m.astype("<i8").tobytes() for size, m in maps.items()})


def containing(items: DataFrame, chunks: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """(query_id, point_id): chunks(scope..., point_id, text) that hold the text of items(query_id, scope..., text).

    An empty text is in every chunk of its scope, a null one in none; repeated rows count once.
    """
    names = list(scope)
    asked = items.where("text is not null").select("query_id", *names, F.col("text").alias("sought"))
    kinds = S.StructType([*asked.schema, S.StructField("size", S.IntegerType()), S.StructField("seed", S.LongType())])
    asked = asked.mapInArrow(_seeds, kinds)
    maps = _bit_maps(asked.where("size > 0"))
    rows = chunks.where("text is not null").select(*names, "point_id", "text")
    schema = S.StructType([*rows.schema, S.StructField("size", S.IntegerType()), S.StructField("seed", S.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: np.frombuffer(m, np.uint8) for size, m in maps.value.items()}
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
            ends = np.cumsum([len(t) for t in texts])
            for size, h in window_hashes(np.frombuffer(b"".join(texts), np.uint8)):
                if size not in known:
                    continue
                bits = _bits(h, BITS)
                at = np.flatnonzero(known[size][bits >> 3] >> (bits & 7) & 1)
                row = np.searchsorted(ends, at, "right")
                inside = at + size <= ends[row]
                found = np.unique(np.stack([row[inside], h[at[inside]].view(np.int64)]), axis=1)
                taken = pa.array(found[0])
                sizes = pa.array(np.full(found.shape[1], size, np.int32))
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns), sizes, pa.array(found[1])], schema.names)

    met = rows.mapInArrow(run, schema).join(asked.where("size > 0"), [*names, "size", "seed"]).where(F.contains("text", "sought"))
    anywhere = rows.join(asked.where("size = 0"), names)
    return met.select("query_id", "point_id").unionByName(anywhere.select("query_id", "point_id")).distinct()
