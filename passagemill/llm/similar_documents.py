"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Words are split at white space, ASCII letters in lower case; a text of fewer words than ``width`` is one
shingle, and all blank texts are alike. Candidates come from SimHash fingerprints of the shingles that differ
in at most BITS bits (found by the generalised pigeonhole of ``simhash_dedup``) and, as fingerprints of texts
near ``least`` differ in more bits than that, from MinHash too (8 bands of three minima). A pair is linked only
if the similarity of its sets of shingles is ``least`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import CHECKED, groups, near_pairs, sketches
from .shared import BoundedCache, pair, release, stage, trim
from .simhash_dedup import first_rows, near_links, simhash

WIDTH, SIMILARITY = 5, 0.8
#: Minima in a band, bands, and how many of the 16 checked minima must agree.
BAND, BANDS, AGREE = 3, 8, 8
#: Bits in which fingerprints of candidates may differ.
BITS = 4


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def jaccard(a: str | None, b: str | None, width: int) -> float:
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        known = BoundedCache(xxh64_intdigest, 200_000)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids, grams = [], []
                for text in batch.column(2):
                    words = (text.as_py() or "").encode().lower().split()
                    ids.append(xxh3_64_intdigest(b" ".join(words)))
                    if len(words) < width:
                        grams.append(np.array([ids[-1]], np.uint64))
                        continue
                    coded = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    n = len(words) - width + 1
                    own = coded[:n]
                    for k in range(1, width):
                        own = pair(own, coded[k : k + n])
                    grams.append(np.unique(own))
                if not ids:
                    continue
                sizes = np.array([len(g) for g in grams], np.int64)
                fps = pa.array(np.array([simhash(g) for g in grams], np.uint64).view(np.int64))
                sketch = sketches((np.concatenate(grams) >> np.uint64(32)).astype(np.uint32), sizes, BAND, BANDS)
                columns = [*batch.columns[:2], pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(sketch, pa.binary()), fps]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "id", "size", "sketch", "fp"])
        trim()

    return run


def fingerprint_pairs(classes: DataFrame, k: int = BITS) -> DataFrame:
    """(a, b), a < b: classes(id, fp) of one fingerprint with the least of them, and those least ones of
    fingerprints that links within k bits join."""
    fps = stage(classes.groupBy("fp").agg(F.min("id").alias("least")), "document-fingerprints")
    same = classes.join(fps, "fp").where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    of = lambda end: fps.select(F.col("fp").alias(end), F.col("least").alias(f"id_{end}"))
    linked = near_links(fps, k).join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return stage(same.unionByName(linked), "fingerprint-pairs")


def similar_groups(documents: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, root) of each row of documents(doc_id, text); rows of one group share root."""
    spark = documents.sparkSession
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = stage(keyed.mapInArrow(_sketches(width), "doc_id long, text_key long, id long, size int, sketch binary, fp long"), "document-sketches")
    classes = rows.groupBy("id").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.min("text_key").alias("text_key"))
    classes = stage(classes, "document-classes")
    pairs, large = near_pairs(classes, BANDS, least, AGREE)
    near = fingerprint_pairs(classes).withColumn("agreed", F.lit(CHECKED).cast("long"))
    pairs = stage(pairs.unionByName(near).groupBy("a", "b").agg(F.max("agreed").alias("agreed")), "document-pairs")
    release(spark)
    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    wanted = classes.select("id", "text_key").join(met, "id")
    texts = stage(keyed.select("text_key", "text").join(wanted, "text_key").select("id", "text").dropDuplicates(["id"]), "documents-compared")
    release(spark)
    roots = groups(pairs, large, texts, lambda a, b: jaccard(a, b, width) >= least, least, AGREE, "document-links")
    release(spark)
    rows = rows.select("doc_id", "text_key", "id")
    if roots is None:
        return rows.withColumnRenamed("id", "root")
    return rows.join(roots, "id", "left").select("doc_id", "text_key", F.coalesce("root", "id").alias("root"))


def keep_one(documents: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The row of each group with the least doc_id (of rows that share it, that of least text hash)."""
    return first_rows(documents, similar_groups(documents, width, least))
