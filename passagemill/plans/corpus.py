"""The driver's tables as a corpus: documents, chunks, points, questions.

A chunk is a line of a document that is not blank, so that the same corpus can be had in plain SQL;
operators take any other chunking alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DOCUMENT_TYPES

KINDS = ["description", "specification", "mixed", "admin", "quantity", "heading"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S1."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt to as many tasks as there are cores, where their files have fewer parts than that.

    A file of one row group is one task, however long the work on its texts takes; large corpora have more
    parts than cores and stay as they lie.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def _chosen(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    return rows.select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("t"), (number % 4).cast("string")).alias("tenant_id"),
        F.col("source").alias("project_id"), F.col("lang").alias("lot"), _chosen(DOCUMENT_TYPES, F.col("doc_id")).alias("type"),
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("filename"),
        F.when(F.col("doc_id") % 97 == 0, "error").otherwise("ready").alias("status"),
        F.col("n_chars").alias("size"), (F.lit(1704067200) + F.col("doc_id")).alias("ingested_at"), F.col("text"),
    )


def pages(spark: SparkSession, sf_dir: str, lines: int = 20) -> DataFrame:
    """S3: a document's lines in runs of ``lines``."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    last = F.floor((F.size("lines") - 1) / lines).cast("int")
    cut = rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    return cut.select("doc_id", "ord", (F.col("ord") + 1).alias("page"), F.array_join(F.slice("lines", F.col("ord") * lines + 1, lines), "\n").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).drop("size").select("*", F.posexplode(F.split("text", "\n", -1)).alias("position", "line")).drop("text")
    text = F.col("line")
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{12,}"), F.lit(0))
    point = F.when(F.col("document_id") % 31 != 0, F.col("document_id") * 100000 + F.col("position"))
    return lines.where("line != ''").select(
        "document_id", "tenant_id", "project_id", "lot", "type", "filename", "status", "ingested_at", "position",
        (F.floor(F.col("position") / 20) + 1).cast("int").alias("page"), text.alias("text"), F.length(text).alias("char_count"),
        _chosen(KINDS, F.col("position")).alias("content_type"), F.slice(F.array_sort(F.array_distinct(words)), 1, 10).alias("keywords"),
        point.alias("point_id"), F.array(F.col("lot"), F.concat(F.lit("p"), (F.col("position") % 3).cast("string"))).alias("parent_sections"),
    )


#: The same in SQL; each oracle starts with the part that it needs.
DOCS_SQL = f"""docs AS (SELECT doc_id AS document_id, 't' || CAST(CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4 AS VARCHAR) AS tenant_id,
 source AS project_id, lang AS lot, ({DOCUMENT_TYPES!r})[doc_id % 12 + 1] AS type, source || '_' || doc_id || '.txt' AS filename,
 CASE WHEN doc_id % 97 = 0 THEN 'error' ELSE 'ready' END AS status, n_chars AS size, 1704067200 + doc_id AS ingested_at, text FROM documents)"""
CHUNKS_SQL = f"""{DOCS_SQL}, lined AS (SELECT d.* EXCLUDE (text, size), u.i - 1 AS position, string_split(text, chr(10))[u.i] AS text
 FROM docs d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)),
 chunks AS (SELECT document_id, tenant_id, project_id, lot, type, filename, status, ingested_at, position, position // 20 + 1 AS page, text,
 length(text) AS char_count, ({KINDS!r})[position % 6 + 1] AS content_type,
 list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{{12,}}'))), 1, 10) AS keywords,
 CASE WHEN document_id % 31 <> 0 THEN document_id * 100000 + position END AS point_id, [lot, 'p' || (position % 3)] AS parent_sections
 FROM lined WHERE text <> '')"""
PAGES_SQL = """pages_ AS (SELECT doc_id, u.i AS ord, u.i + 1 AS page, array_to_string(list_slice(l, u.i * 20 + 1, u.i * 20 + 20), chr(10)) AS text
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) s, unnest(range(0, (len(l) - 1) // 20 + 1)) AS u(i))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("point_id"), F.concat(F.lit("t"), (F.col("vec_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("p"), (F.floor(F.col("vec_id") / 4) % 2).cast("string")).alias("project_id"), (F.col("vec_id") % 25).alias("document_id"), (F.col("vec_id") % 50).alias("position"), F.col("label").cast("string").alias("lot"),
        _chosen(DOCUMENT_TYPES, F.col("vec_id") % 25).alias("type"), _chosen(KINDS, F.col("vec_id")).alias("content_type"),
        (F.lit(1704067200) + F.col("vec_id") % 25).alias("ingested_at"), F.col("embedding").cast("array<double>").alias("dense"),
    )


POINTS_SQL = f"""points AS (SELECT vec_id AS point_id, 't' || (vec_id % 4) AS tenant_id, 'p' || (vec_id // 4 % 2) AS project_id, vec_id % 25 AS document_id, vec_id % 50 AS position,
 CAST(label AS VARCHAR) AS lot, ({DOCUMENT_TYPES!r})[(vec_id % 25) % 12 + 1] AS type, ({KINDS!r})[vec_id % 6 + 1] AS content_type,
 1704067200 + vec_id % 25 AS ingested_at, CAST(embedding AS DOUBLE[]) AS dense FROM embeddings)"""


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector asks within one project; two vectors are variants of one question."""
    rows = read_table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    number = F.col("vec_id") / 100
    return rows.select(
        F.floor(number / 2).alias("query_id"), (number % 2).cast("int").alias("variant"),
        F.concat(F.lit("t"), (F.floor(number / 2) % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("p"), (F.floor(number / 8) % 2).cast("string")).alias("project_id"),
        F.concat(F.lit("question on "), F.when(F.floor(number / 2) % 2 == 0, "sondage").otherwise("amiante")).alias("text"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


QUESTIONS_SQL = """questions AS (SELECT vec_id // 200 AS query_id, CAST((vec_id // 100) % 2 AS INTEGER) AS variant, 't' || ((vec_id // 200) % 4) AS tenant_id,
 'p' || (vec_id // 800 % 2) AS project_id, 'question on ' || CASE WHEN (vec_id // 200) % 2 = 0 THEN 'sondage' ELSE 'amiante' END AS text, CAST(embedding AS DOUBLE[]) AS vector
 FROM embeddings WHERE vec_id % 100 = 0)"""
