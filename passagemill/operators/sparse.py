"""An inverted index of BM25 weights.

A posting is (scope, token, point, weight). The index is a table of posting blocks, written once: the
postings of one token of one scope in order of falling weight, at most BLOCK of them a row, with their number
and their largest weight. It is partitioned by tenant and sorted by scope and token. The order of its build
has weight and point behind the token, so a token that a third of all points have is spread over tasks.

A search first adds up the leading blocks of each of its tokens (one, for up to 128 hits), which gives a score that the k-th best point
has at least. Then it drops every block none of whose points can come up to that, even with the largest
weights of all other tokens, unread but for its largest weight; what is left holds all of the k best points
with all of their postings that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.shared import written

K1, B, MEAN_LENGTH = 1.2, 0.75, 256
SCOPE = ("tenant_id", "project_id")
BLOCK = 128
#: Tokens of all questions together that are broadcast.
FEW = 100_000
#: Rows that a task hands on at a time.
ROWS = 50_000


class Index(NamedTuple):
    """blocks(scope..., token, n, most, points, weights) and one row with the number n of all points."""

    blocks: DataFrame
    n_points: DataFrame


def postings(points: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """R2: (scope, point_id, token, tf, weight) of each point's text.

    A point is one row, so its tokens are counted where it lies, a batch of points at a time; nothing is shuffled.
    """
    keys = [*scope, "point_id"]
    rows = points.select(*keys, T.tokenize(F.col("text")).alias("tokens"))
    schema = S.StructType([*(rows.schema[k] for k in keys), S.StructField("token", S.StringType()), S.StructField("tf", S.LongType()), S.StructField("length", S.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(len(keys))
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = tokens.flatten().dictionary_encode()
            place = np.repeat(np.arange(len(lengths)), lengths) << 32 | coded.indices.to_numpy()
            pairs, counts = np.unique(place, return_counts=True)
            for at in range(0, len(pairs), ROWS):
                own = pairs[at : at + ROWS]
                row = pa.array(own >> 32)
                columns = [batch.column(k).take(row) for k in range(len(keys))]
                columns += [coded.dictionary.take(pa.array(own & 0xFFFFFFFF)), pa.array(counts[at : at + ROWS]), pa.array(lengths[own >> 32])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    tf = F.col("tf")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / MEAN_LENGTH))
    return rows.mapInArrow(run, schema).select(*keys, "token", "tf", weight.alias("weight"))


def _blocks(scope: tuple[str, ...], schema: S.StructType):
    """Sorted postings to blocks; a token's run may go on in the next batch, and then begins a block there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in range(len(scope) + 1):
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            run_starts = np.flatnonzero(new)
            within = np.arange(batch.num_rows) - run_starts[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % BLOCK == 0)
            held = batch.slice(int(starts[-1]))
            if len(starts) > 1:
                yield cut(batch.slice(0, int(starts[-1])), starts[:-1])
        if held is not None and held.num_rows:
            yield cut(held, np.zeros(1, np.int64))

    def cut(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
        first, weights = pa.array(starts), batch.column(len(scope) + 2)
        columns = [batch.column(k).take(first) for k in range(len(scope) + 1)]
        columns += [pa.array(np.diff(np.append(starts, batch.num_rows)), pa.int32()), weights.take(first)]
        columns += [pa.ListArray.from_arrays(offsets, batch.column(len(scope) + 1)), pa.ListArray.from_arrays(offsets, weights)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def build_index(points: DataFrame, path: str, scope: tuple[str, ...] = SCOPE) -> Index:
    """Write the index of points(scope, point_id, text) to ``path`` and return it; points must have an id."""
    spark = points.sparkSession
    points = points.where("point_id is not null")
    rows = postings(points, scope).select(*scope, "token", "point_id", "weight")
    # Written before it is sorted, as the ranges of a sort are found by reading its input once more.
    rows.write.mode("overwrite").parquet(f"{path}/postings")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    order = [*scope, "token", F.desc("weight"), "point_id"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = {"n": S.IntegerType(), "most": S.DoubleType(), "points": S.ArrayType(rows.schema["point_id"].dataType), "weights": S.ArrayType(S.DoubleType())}
    schema = S.StructType([*(rows.schema[k] for k in [*scope, "token"]), *(S.StructField(n, t) for n, t in names.items())])
    sorted_.mapInArrow(_blocks(scope, schema), schema).write.mode("overwrite").partitionBy(scope[0]).parquet(f"{path}/blocks")
    points.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/count")
    return Index(spark.read.schema(schema).parquet(f"{path}/blocks"), spark.read.schema("n long").parquet(f"{path}/count"))


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/count"))


def token_counts(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What token_idf() takes, without an index: (token, n) of each point's distinct tokens, and the number of points."""
    points = points.where("point_id is not null")
    tokens = points.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"), F.lit(1).alias("n"))
    return tokens, points.agg(F.count("*").alias("n"))


def token_idf(blocks: DataFrame, n_points: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); only tokens and numbers are read."""
    df = blocks.groupBy("token").agg(F.sum("n").alias("df"))
    n, d = F.col("n"), F.col("df")
    return df.crossJoin(F.broadcast(n_points)).select("token", "df", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"))


def query_tokens(questions: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Weight 1 for each distinct token; a question without tokens has no rows."""
    return questions.select("query_id", *scope, F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))


def _added(lists: DataFrame) -> DataFrame:
    """(query_id, point_id, score, common): the sums of the postings in lists(query_id, idf, points, weights)."""
    each = lists.select("query_id", "idf", F.explode(F.arrays_zip("points", "weights")).alias("p"))
    score: Column = F.sum(F.col("p.weights") * F.col("idf"))
    return each.groupBy("query_id", F.col("p.points").alias("point_id")).agg(score.alias("score"), F.count("*").alias("common"))


def asked_lists(questions: DataFrame, index: Index, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """The posting blocks of each question's tokens in its scope, with the tokens' idf.

    They are written down, as a search goes over them three times, the index only once. Up to FEW tokens of
    all questions together are broadcast to the index; beyond that both sides are shuffled.
    """
    tokens = written(query_tokens(questions, scope), "asked-tokens")
    sent = F.broadcast if tokens.count() <= FEW else lambda df: df
    wanted = index.blocks.select("token", "n").join(sent(tokens.select("token").distinct()), "token", "left_semi")
    idf = token_idf(wanted, index.n_points).select("token", "idf")
    return written(index.blocks.join(sent(tokens.join(idf, "token")), [*scope, "token"]), "asked-lists")


def needed_blocks(lists: DataFrame, k: int) -> DataFrame:
    """The blocks in which a point of the k best of its question can be."""
    size = F.col("most") * F.col("idf")
    first = Window.partitionBy("query_id", "token").orderBy(F.desc("most"))
    lead = lists.withColumn("r", F.row_number().over(first)).where(F.col("r") <= -(-k // BLOCK))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    kth = _added(lead).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).where(F.col("r") == k)
    bounds = lists.groupBy("query_id", "token").agg(F.max(size).alias("own"))
    whole = bounds.groupBy("query_id").agg(F.sum("own").alias("whole")).join(kth.select("query_id", F.col("score").alias("least")), "query_id", "left")
    rows = lists.join(bounds, ["query_id", "token"]).join(whole, "query_id")
    # Scores are rounded to six places before they are ranked.
    return rows.where(F.col("least").isNull() | (size + F.col("whole") - F.col("own") >= F.col("least") - 1e-5)).drop("own", "whole", "least")


def scores(lists: DataFrame) -> DataFrame:
    """(query_id, point_id, score, common) from posting blocks: weight times idf, summed over common tokens."""
    return _added(lists).withColumn("score", F.round("score", 6))
