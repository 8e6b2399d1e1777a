"""Quality rules: per-document measures and cross-document line frequency by host.

A line that stands in many distinct documents of one host is boilerplate. Lines are normalised
(ASCII lower case, white space collapsed) and hashed; the distinct texts that hold a line are counted
per host, so that exact copies of a document don't make its lines boilerplate. Lines above the limit
are removed, and a document that keeps less than a fifth of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_lines, null_safe_join, pair, stage

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: A line is above the limit in more distinct texts of its host than this, however large the host is.
LINE_DOCS = 10
#: Percent of a document's words that must be left.
LEFT_PERCENT = 20

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<no:int,hash:bigint,words:int>>"


def repeated_words(words: list[bytes], width: int) -> int:
    """Words inside ``width``-word windows that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    windows = coded[:n]
    for k in range(1, width):
        windows = pair(windows, coded[k : k + n])
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 1, np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + width, -1)
    return int((np.cumsum(twice) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int, int]]]:
    from xxhash import xxh3_64_intdigest

    words = text.encode().split()
    seen: set[bytes] = set()
    lines, repeated = [], 0
    for no, line in enumerate(text.encode().split(b"\n")):
        own = line.lower().split()
        if own:
            repeated += line in seen
            seen.add(line)
            lines.append((no, xxh3_64_intdigest(b" ".join(own)) - (1 << 63), len(own)))
    chars = len(text) - sum(map(text.count, WHITE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words, REPEAT_WINDOW), lines


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("no", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        rows = [measure(text.as_py() or "") for text in batch.column(3)]
        *numbers, lines = zip(*rows, strict=True) if rows else [()] * 6
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        flat = np.array([y for x in lines for y in x], np.int64).reshape(-1, 3).T
        fields = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2].astype(np.int32))], ["no", "hash", "words"])
        column = pa.ListArray.from_arrays(pa.array(offsets), fields).cast(kind)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, pa.int64()) for v in numbers), column], [*batch.schema.names[:3], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def assess(documents: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """One row for each row of documents(doc_id, text, host): measures, verdict, ``removed`` line numbers.

    A null text has no words and fails. A null host is a host of its own; null and repeated doc_ids
    keep one row each. Rows of one text count once for a line. Other columns are not read.
    """
    rows = documents.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("text_key"), "text")
    names = "doc_id long, host string, text_key long"
    rows = rows.withColumn("host", F.col("host").cast("string")).mapInArrow(_measures, f"{names}, {MEASURES}")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "line-measures")
    lines = rows.select("row", "host", "text_key", F.explode("lines").alias("line")).select("row", "host", "text_key", "line.*")
    texts = lines.groupBy("host", "hash").agg(F.count_distinct("text_key").alias("docs")).where(F.col("docs") > line_docs)
    above = stage(texts.select("host", "hash", F.lit(True).alias("above")), "common-lines")
    cut = null_safe_join(lines.drop("text_key"), above, ["host", "hash"], "inner")
    cut = cut.groupBy("row").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("no")).alias("removed"))
    out = rows.drop("lines").join(cut, "row", "left").drop("row")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0))
    depleted = (gone > 0) & (100 * (F.col("n_words") - gone) < left_percent * F.col("n_words"))
    return out.withColumns({"removed_words": gone, "base_failed": failed, "depleted": depleted, "kept": ~failed & ~depleted})


def apply_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of documents, without their common lines; all columns stay."""
    keys = ["doc_id", "__host", "__key"]
    verdicts = assess(documents, host).groupBy(F.col("doc_id"), F.col("host").alias("__host"), F.col("text_key").alias("__key"))
    verdicts = stage(verdicts.agg(F.first("kept").alias("__kept"), F.first("removed").alias("__lines")), "verdicts")
    keyed = documents.withColumns({"__host": F.col(host).cast("string"), "__key": F.xxhash64("text")})
    kept = drop_lines(keyed, verdicts, keys).where("__kept")
    return kept.select(*documents.columns)
