"""Continuous ingestion and flagging (ST1, ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, cleaning, edits
from ..sources import store
from ..sources.shared import written

#: Folders of documents in the stores of chunks and statuses.
BUCKETS = 64
BUCKET = "bucket"
ORDER = ("doc_id", "chunk_seq")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))


def ingest_batch(spark: SparkSession, batch: DataFrame, number: int, types: DataFrame, out: str) -> None:
    """ST1, one batch of pages(doc_id, ord, page, text, n_pages), with the pages that earlier batches left.

    A document is chunked when n_pages of its pages are there; until then its pages are held. Its chunks then
    replace all that it had, and its status (C19) says ready, empty or error, or processing while it is held.
    Of one page the one that came last counts; n_pages is the largest given. A batch that is done again finds
    the pages that the batch before it left, and writes what it wrote before.
    """
    fresh = batch.groupBy("doc_id", "ord").agg(F.max(F.struct("page", "text", "n_pages")).alias("p")).select("doc_id", "ord", "p.*")
    held = store.read_store(spark, f"{out}/held/batch={number - 1}") if number else None
    if held is not None:
        fresh = fresh.unionByName(held.join(fresh.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti"))
    pages = written(fresh, "ingest-pages")
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("there"), F.max("n_pages").alias("needed"))
    complete = written(sizes.withColumn("whole", F.col("there") >= F.coalesce("needed", F.lit(1))), "ingest-sizes")
    whole = complete.where("whole").select("doc_id")
    pages.join(complete.where("not whole").select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{out}/held/batch={number}")
    ready = pages.drop("n_pages").join(whole, "doc_id", "left_semi")
    chunks = written(chunking.chunk_documents(cleaning.clean_pages(ready), types.join(whole, "doc_id", "left_semi")), "ingest-chunks")
    store.replace_rows(spark, f"{out}/chunks", _bucketed(chunks), ["doc_id"], BUCKET, _bucketed(whole), ORDER)
    kinds = whole.join(types, "doc_id", "left").withColumn("type", F.coalesce("type", F.lit("autre")))
    done = chunking.document_outcome(kinds, ready, chunks).withColumns({"batch": F.lit(number).cast("long"), "pages_there": F.lit(None).cast("long")})
    said = {"error": "No text could be extracted", "empty": "No chunks were made of the text"}
    message = F.create_map(*(F.lit(x) for pair in said.items() for x in pair))[F.col("status")]
    waits = complete.where("not whole").select("doc_id", F.lit("processing").alias("status"), F.lit(0).cast("long").alias("chunk_count"), F.lit(number).cast("long").alias("batch"), F.col("there").alias("pages_there"))
    statuses = done.unionByName(waits).withColumn("error_message", message)
    store.replace_rows(spark, f"{out}/status", _bucketed(statuses), ["doc_id"], BUCKET, order=ORDER)


def ingest(pages: DataFrame, types: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST1: a stream of pages to the stores ``out``/chunks and ``out``/status."""

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch.sparkSession, batch, number, types, out)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_chunks(spark: SparkSession, out: str) -> DataFrame | None:
    found = store.read_store(spark, f"{out}/chunks")
    return found if found is None else found.drop(BUCKET)


def ingested_status(spark: SparkSession, out: str) -> DataFrame | None:
    found = store.read_store(spark, f"{out}/status")
    return found if found is None else found.drop(BUCKET)


def flag_stream(points: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST5: new points with injection_suspect; stateless, so a replay gives the same rows."""
    flagged = edits.mark_suspects(points).withColumn("flagged_at", F.current_timestamp())
    return flagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
