"""Best-fit packing of token sequences by large-item matching.

Lengths are integers of at most the capacity, so all that a packing depends on is how many pieces
have each length. That histogram is gathered from all pieces; it has at most ``capacity`` rows at
any corpus size. The plan is made on it:

1. Pieces above a third of the capacity (at most two of which share a sequence) are matched
   greedily: from the longest down, each with the longest other one that fits.
2. Shorter pieces, from the longest down, go into the smallest remaining gap that holds them.

Sequences of equal content are planned as one pattern with a multiplicity, so the plan grows with
the capacity and not with the corpus. A piece then finds its place from its number among the pieces
of its length, which comes from counts by block of documents.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, task_id, trim
from .tokenize import encoded

PIECES = "block long, doc_id long, piece int, start long, length int, rank long, ids binary"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, block = struct.pack("<I", end_id), task_id()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1), end), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((block, doc, k, at // 4, length, seen[length], own))
                    seen[length] += 1
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["block", "doc_id", "piece", "start", "length", "rank", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        trim()

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(multiplicity, [(length, copies), ...]), ...] for {length: pieces}."""
    left = {length: n for length, n in histogram.items() if n}
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def put(gap: int, n: int, content: list[tuple[int, int]]) -> None:
        if gap:
            gaps[gap].append((n, content))
        else:
            patterns.append((n, content))

    for x in large:
        while left[x]:
            y = next((y for y in large if y <= capacity - x and (left[y] if y != x else left[x] >= 2)), None)
            if y is None:
                put(capacity - x, left[x], [(x, 1)])
                left[x] = 0
            else:
                n = left[x] // 2 if x == y else min(left[x], left[y])
                put(capacity - x - y, n, [(x, 2)] if x == y else [(x, 1), (y, 1)])
                left[x] -= n * (1 + (x == y))
                left[y] -= n * (x != y)
    open_gaps = sorted(gaps)
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[x]
        while n:
            at = bisect_left(open_gaps, x)
            while at < len(open_gaps) and not gaps[open_gaps[at]]:
                del open_gaps[at]
            if at == len(open_gaps):
                gap, bins, content = capacity, -(-n // (capacity // x)), []
            else:
                gap = open_gaps[at]
                bins, content = gaps[gap].pop()
            k = gap // x
            full = min(bins, n // k)
            rest = n - full * k if full < bins else 0
            for many, copies in ((full, k), (1 if rest else 0, min(rest, k))):
                if many:
                    n -= many * copies
                    bins -= many
                    to = gap - copies * x
                    spot = bisect_left(open_gaps, to)
                    if to and (spot == len(open_gaps) or open_gaps[spot] != to):
                        open_gaps.insert(spot, to)
                    put(to, many, [*content, (x, copies)])
            if bins and gap < capacity:
                gaps[gap].append((bins, content))
    return patterns + [p for rest in gaps.values() for p in rest]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[np.ndarray]]:
    """{length: [first number, first sequence, copies a sequence, offset], ...} in order of number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, content in patterns:
        offset = 0
        for length, copies in content:
            rows[length].append((used[length], sequence, copies, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return {length: list(np.array(r, np.int64).T) for length, r in rows.items()}


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for x in np.unique(length).tolist():
                own = length == x
                first, base, copies, start = table[x]
                n = number[own]
                at = np.searchsorted(first, n, "right") - 1
                sequence[own] = base[at] + (n - first[at]) // copies[at]
                offset[own] = start[at] + (n - first[at]) % copies[at] * x
            keep = [c for c in batch.schema.names if c != "number"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """documents(doc_id, text) as a staged table of pieces of at most ``capacity`` ids.

    A null text counts as empty (its end id alone); null and repeated doc_ids are kept as they are;
    an empty table has no pieces. Other columns are not read.
    """
    return stage(documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Places for the rows of pieces(): sequence_id and offset, with the columns that cut still has.

    cut needs block, length and rank; leave ``ids`` out unless it is to be shuffled along.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    bases = counts.select("block", "length", before.alias("base"))
    # At most ``capacity`` rows, whatever the corpus.
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    numbered = cut.join(bases, ["block", "length"]).withColumn("number", F.col("base") + F.col("rank")).drop("base", "rank", "block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(_placed(slots), f"{schema}, sequence_id long, offset long")


def sequences(cut: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary, little-endian u32), doc_ids and offsets."""
    joined = cut.select("doc_id", "piece", "start", "ids").join(places.select("doc_id", "piece", "start", "sequence_id", "offset"), ["doc_id", "piece", "start"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    joined_ids = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return rows.select("sequence_id", joined_ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def packed_digests(documents: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    cut = pieces(documents, tokenizer, capacity=capacity)
    slim = cut.select("block", "doc_id", "piece", "start", F.col("length"), "rank", F.crc32("ids").alias("ids_crc32"))
    return pack(slim, capacity).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
