"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints within k bits agree within t_i bits on some part i of any partition of the
bits, if the thresholds t_i are at least -1 and add up to k - parts + 1. The plan picks the parts and
thresholds:

* bits whose values are correlated (phi over all distinct fingerprints) go into one part;
* a dynamic programme over parts allocates the thresholds with the least estimated cost, where the
  cost of (part, t) is its probes (all keys within t bits) and its expected candidate pairs;
* this is done for two to k + 1 parts and the cheapest plan is taken.

The plan changes the work only; the links are exact for any plan. Probes of distinct fingerprints
meet by key, candidates are verified on all 64 bits, and a bucket gives links that span its
components instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import null_safe_join, release, stage

BITS = 64
#: Seconds for making, moving and sorting one probe, and for verifying one candidate pair.
PROBE_S, CANDIDATE_S = 1e-6, 5e-9
#: Distinct fingerprints from which candidate rates are estimated; the plan alone depends on them.
SAMPLE = 2048


def simhash(hashes: np.ndarray) -> np.uint64:
    """A bit is set where it is in over half of the hashes (little-endian unsigned 64-bit integers, one at least)."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(batch.column(1)):
                value = text.as_py()
                words = value.encode().lower().split() if value else []
                if not words:
                    continue
                joined = b" ".join(words)
                if len(words) <= width:
                    hashes = [xxh64_intdigest(joined, seed)]
                else:
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1]
                    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
                out[row] = simhash(np.array(hashes, "<u8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    return run


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """documents(doc_id, text) as (doc_id, fp, text_key): the SimHash of ``width``-word shingles as a
    long, and xxhash64(text)."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long, text_key long")


def _bit_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each pair of bits is set together."""
    both = np.zeros((BITS, BITS), np.int64)
    n = 0
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 65536):
            bits = np.unpackbits(fps[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    columns = [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both.ravel(), n))]
    yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of distinct fingerprints and the 64 x 64 counts of common bits, over all of them."""
    rows = distinct.select("fp").mapInArrow(_bit_moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows.collect():  # 4,097 rows at any size
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size: each starts with the freest bit and takes its best correlated ones."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = sorted(range(BITS), key=lambda b: (-spread[b], b)), []
    for k in range(parts):
        part = [left.pop(0)]
        while len(part) < BITS // parts + (k < BITS % parts):
            best = max(left, key=lambda b: (phi[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def within(flips: np.ndarray, t: int) -> float:
    """The chance that at most t of independent bits differ."""
    chance = np.zeros(t + 2)
    chance[0] = 1
    for q in flips:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return float(chance[: t + 1].sum())


def allocate(parts: list[list[int]], k: int, n: int, flips: np.ndarray, sample: np.ndarray) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost that add up to k - parts + 1, by dynamic programming."""
    pairs = n * n / 2
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        mask = np.uint64(sum(1 << b for b in part))
        own = sample & mask
        tries = [np.bitwise_count(own[d:] ^ own[:-d]) for d in range(1, min(len(own), 256))]
        seen = np.concatenate(tries) if tries else np.zeros(0, np.uint8)
        cost = {-1: 0.0}
        for t in range(min(k, len(part)) + 1):
            rate = max(within(flips[part], t), float((seen <= t).mean()) if (seen <= t).sum() >= 10 else 0.0)
            probes = sum(comb(len(part), d) for d in range(t + 1))
            cost[t] = PROBE_S * n * probes + CANDIDATE_S * pairs * rate * (2 if t else 1)
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (price, chosen) in best.items():
            for t, more in cost.items():
                total, key = price + more, used + t + 1
                if key <= k + 1 and (key not in after or total < after[key][0]):
                    after[key] = (total, [*chosen, t])
        best = after
    return best[k + 1]


def make_plan(distinct: DataFrame, k: int) -> list[tuple[list[int], int]]:
    """[(bits of a part, its threshold), ...] for links of at most k bits."""
    n, both = bit_statistics(distinct)
    p = np.diag(both) / max(n, 1)
    flips = np.clip(2 * p * (1 - p), 1e-3, 0.5)
    rows = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    plans = []
    for parts in range(2, k + 2):
        grouped = group_bits(n, both, parts)
        plans.append((*allocate(grouped, k, n, flips, sample), grouped))
    _, thresholds, grouped = min(plans, key=lambda x: x[0])
    return [(part, t) for part, t in zip(grouped, thresholds, strict=True) if t >= 0]


def _masks(part: list[int], t: int) -> np.ndarray:
    flips = [sum(1 << b for b in chosen) for d in range(t + 1) for chosen in combinations(part, d)]
    return np.array(flips, np.uint64)


def _probes(plan: list[tuple[list[int], int]]):
    """A row for each key within the threshold; ``own`` marks the fingerprint's own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (part, t) in enumerate(plan):
                mask = np.uint64(sum(1 << b for b in part))
                flips = _masks(part, t)
                step = max(1, 500_000 // len(flips))
                for at in range(0, len(fps), step):
                    some = fps[at : at + step]
                    keys = ((some.view(np.uint64) & mask)[:, None] ^ flips).ravel().view(np.int64)
                    own = np.tile(np.arange(len(flips)) == 0, len(some))
                    columns = [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(np.repeat(some, len(flips))), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "key", "fp", "own"])

    return run


def _span(fps: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links that join what one bucket joins: a search in which each step compares the next
    fingerprint with all that no step has reached yet. One side of each link holds the key itself."""
    links = []
    x, own = fps.view(np.uint64), own.copy()
    unseen = np.arange(len(x))
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            i = queue.pop()
            near = np.bitwise_count(x[unseen] ^ x[i]) <= k
            if not own[i]:
                near &= own[unseen]
            links += [(int(fps[i]), int(fps[j])) for j in unseen[near]]
            queue += unseen[near].tolist()
            unseen = unseen[~near]
    return links


#: Buckets above this size are searched one by one, smaller ones all at once.
LARGE = 64


def _links(k: int):
    def verified(part: np.ndarray, key: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        a, b = [], []
        for s, n in zip(starts[sizes > LARGE].tolist(), sizes[sizes > LARGE].tolist(), strict=True):
            for x, y in _span(fps[s : s + n], own[s : s + n], k):
                a.append(np.array([x])), b.append(np.array([y]))
        small = np.repeat(sizes <= LARGE, sizes)
        group, x, own = np.repeat(np.arange(len(starts)), sizes)[small], fps[small], own[small]
        for d in range(1, min(LARGE, len(x))):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            near = same & (own[d:] | own[:-d]) & (np.bitwise_count(x.view(np.uint64)[d:] ^ x.view(np.uint64)[:-d]) <= k) & (x[d:] != x[:-d])
            a.append(x[:-d][near]), b.append(x[d:][near])
        columns = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(v) for v in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield verified(*(v[:cut] for v in now))
            held = [v[cut:] for v in now]
        if held is not None:
            yield verified(*held)

    return run


def near_links(distinct: DataFrame, k: int, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints(fp) within k bits that keep all components."""
    plan = plan or make_plan(distinct, k)
    probes = distinct.select("fp").mapInArrow(_probes(plan), "part int, key long, fp long, own boolean")
    met = probes.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return met.mapInArrow(_links(k), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, k: int = 4, width: int = 4, seed: int = 42, keep_key: bool = False) -> DataFrame:
    """documents(doc_id, text) as (doc_id, fp, component_id); component_id is the least doc_id reachable.

    A null or blank text has fingerprint zero, which links like any other. Rows that repeat a doc_id
    keep one row each. A null doc_id takes part; it never is a component_id unless all are null.
    An empty table gives no rows. Other columns are not read. keep_key adds text_key, xxhash64(text),
    and root, a fingerprint that names the component also where component_id is null or repeats.
    """
    spark = documents.sparkSession
    rows = stage(fingerprints(documents, width, seed), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    links = stage(near_links(classes, k), "fingerprint-links")
    release(spark)
    if links.take(1):
        roots = components(links).select(F.col("a").alias("fp"), F.col("b").alias("root"))
        classes = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = stage(classes.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), "components")
    else:
        classes = classes.select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", *["text_key", "root"] * keep_key)


def first_rows(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each root of groups(doc_id, text_key, root), the row of documents with the least doc_id, then text_key."""
    keyed = documents.withColumn("__key", F.xxhash64("text"))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    chosen = first.select("first.doc_id", F.col("first.text_key").alias("__key")).distinct()
    chosen = stage(chosen.withColumn("__kept", F.lit(True)), "kept-documents")
    return null_safe_join(keyed, chosen, ["doc_id", "__key"], "inner").dropDuplicates(["doc_id", "__key"]).select(*documents.columns)


def keep_one(documents: DataFrame, k: int = 4) -> DataFrame:
    """The row of each group with the least doc_id (of rows that share it, that of least text hash)."""
    return first_rows(documents, near_duplicates(documents, k, keep_key=True))
