"""Corpus statistics (A1-A20), scoped reads and listings."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CONTENT_SCORES
from ..functions.text import format_size, size_label


def tenant_scope(chunks: DataFrame, tenant_id: str | None = None, project_id: str | None = None) -> DataFrame:
    """The conditions that every read carries."""
    out = chunks if tenant_id is None else chunks.where(F.col("tenant_id") == tenant_id)
    return out if project_id is None else out.where(F.col("project_id") == project_id)


def list_chunks(chunks: DataFrame, *, document_id=None, lot=None, doc_type=None, content_type=None, min_chars=None, max_chars=None, has_keywords=None, contains=None, orphan=None, section=None) -> DataFrame:
    """Any of ten filters; no keywords means a null or empty list."""
    n = F.coalesce(F.size("keywords"), F.lit(0))
    tests = {
        "document_id": lambda v: F.col("document_id") == v,
        "lot": lambda v: F.col("lot") == v,
        "doc_type": lambda v: F.col("type") == v,
        "content_type": lambda v: F.col("content_type") == v,
        "min_chars": lambda v: F.col("char_count") >= v,
        "max_chars": lambda v: F.col("char_count") <= v,
        "has_keywords": lambda v: (n > 0) == F.lit(v),
        "contains": lambda v: F.contains(F.lower("text"), F.lit(v.lower())),
        "orphan": lambda v: F.col("point_id").isNull() == F.lit(v),
        "section": lambda v: F.exists("parent_sections", lambda s: F.contains(F.lower(s), F.lit(v.lower()))),
    }
    given = {k: v for k, v in locals().items() if k in tests and v is not None}
    return reduce(lambda df, k: df.where(tests[k](given[k])), given, chunks)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """O1: one page in a total order, with total and page count on each row."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return cut.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def quality_score(chars: Column, kind: Column, keywords: Column, title: Column, locations: Column) -> Column:
    """Size band, keywords, type, title and location; at most 1."""
    n = F.coalesce(F.size(keywords), F.lit(0))
    c = F.coalesce(chars, F.lit(0))
    band = F.when(c.between(200, 2000), 0.4).when(c.between(100, 2500), 0.2).otherwise(0.0)
    of_kind = F.coalesce(reduce(lambda w, kv: w.when(kind == kv[0], F.lit(kv[1])), list(CONTENT_SCORES.items())[1:], F.when(kind == "specification", F.lit(0.2))), F.lit(0.1))
    titled = F.when(F.coalesce(title, F.lit("")) != "", 0.1).otherwise(0.0)
    located = F.when(F.coalesce(F.size(locations), F.lit(0)) > 0, 0.1).otherwise(0.0)
    return F.round(F.least(band + F.least(F.lit(0.2), n * F.lit(0.02)) + of_kind + titled + located, F.lit(1.0)), 4)


def scored(chunks: DataFrame) -> DataFrame:
    get = lambda c, kind: F.col(c) if c in chunks.columns else F.lit(None).cast(kind)
    score = quality_score(F.col("char_count"), F.col("content_type"), F.col("keywords"), get("section_title", "string"), get("locations", "array<string>"))
    return chunks.withColumn("quality_score", score)


def totals(chunks: DataFrame) -> DataFrame:
    """A1, A4, A5, A7 in one scan."""
    n = F.count("*")
    few = F.coalesce(F.size("keywords"), F.lit(0)) == 0
    count_if = lambda c: F.sum(c.cast("int")).cast("long")
    c = F.col("char_count")
    return scored(chunks).agg(
        n.alias("chunks"), F.count_distinct("document_id").alias("documents"), count_if(few).alias("no_keywords"),
        count_if(F.col("content_type") == "heading").alias("heading_only"), count_if(c < 100).alias("under_100"),
        count_if((c >= 100) & (c < 500)).alias("under_500"), count_if((c >= 500) & (c < 1500)).alias("under_1500"),
        count_if((c >= 1500) & (c < 2500)).alias("under_2500"), count_if(c >= 2500).alias("from_2500"),
        F.round(F.avg("quality_score"), 6).alias("average_quality"),
    )


def by_document(chunks: DataFrame) -> DataFrame:
    """A2."""
    size = F.coalesce("char_count", F.lit(0))
    out = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.avg(size).alias("mean"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
    return out.withColumn("mean", F.round("mean", 6))


def by_category(chunks: DataFrame) -> DataFrame:
    """A3: one scan for content type, lot and document type; null or empty counts as unknown."""
    kinds = F.array(*(F.struct(F.lit(c).alias("category"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value")) for c in ("content_type", "lot", "type")))
    return chunks.select(F.explode(kinds).alias("k")).groupBy("k.category", "k.value").agg(F.count("*").alias("chunks"))


def size_histogram(chunks: DataFrame) -> DataFrame:
    """A4 as rows."""
    return chunks.groupBy(size_label(F.col("char_count")).alias("band")).agg(F.count("*").alias("chunks"))


def document_report(chunks: DataFrame) -> DataFrame:
    """Sizes, types, keywords, quality and warnings of each document."""
    rows = scored(chunks)
    kinds = rows.groupBy("document_id", "content_type").agg(F.count("*").alias("n"))
    top = kinds.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "content_type", "n"))), ",").alias("types"))
    words = rows.select("document_id", F.explode_outer("keywords").alias("w")).groupBy("document_id").agg(F.count("w").alias("keywords"), F.count_distinct("w").alias("unique_keywords"))
    heads = F.sum((F.col("content_type") == "heading").cast("int"))
    out = rows.groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("char_count").alias("shortest"), F.max("char_count").alias("longest"), F.round(F.avg("quality_score"), 6).alias("quality"), F.sum((F.col("quality_score") < 0.4).cast("int")).cast("long").alias("low_quality"), F.round(heads / F.count("*"), 6).alias("heading_share"))
    out = out.withColumn("many_headings", F.col("heading_share") > 0.3)
    return out.join(top, "document_id").join(words, "document_id")


def project_bar(documents: DataFrame) -> DataFrame:
    """A10: documents, errors and bytes of each project."""
    error = (F.col("status") == "error").cast("int")
    return documents.groupBy("project_id").agg(F.count("*").alias("documents"), F.sum(error).cast("long").alias("errors"), F.sum("size").alias("total_size"))


def quality_alerts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """A5: what is wrong with each project: chunks by kind of fault, documents in error, and their sum.

    chunks(project_id, keywords, content_type, char_count), documents(project_id, status); a chunk with two
    faults counts under both, projects without chunks or documents have 0 there.
    """
    few = F.coalesce(F.size("keywords"), F.lit(0)) == 0
    faults = {"no_keywords": few, "heading_only": F.col("content_type") == "heading", "very_short": F.col("char_count") < 100, "oversized": F.col("char_count") >= 2500}
    counted = chunks.groupBy("project_id").agg(*(F.count_if(c).alias(n) for n, c in faults.items()))
    failed = documents.groupBy("project_id").agg(F.count_if(F.col("status") == "error").alias("error_documents"))
    names = [*faults, "error_documents"]
    rows = counted.join(failed, "project_id", "full_outer").na.fill(0, names)
    return rows.withColumn("alerts", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def tenant_bar(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """A10: projects(tenant_id, project_id, status) and their documents(project_id): how many, and how many are active or archived."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("n"))
    status = F.col("status")
    rows = projects.join(n, "project_id", "left").groupBy("tenant_id")
    return rows.agg(F.count("*").alias("projects"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count_if(status == "active").alias("active"), F.count_if(status == "archived").alias("archived"))


def documents_summary(documents: DataFrame) -> DataFrame:
    """A10: (project_id, summary): documents, those in work and in error where there are any, and their size, as a line."""
    status = F.col("status")
    counts = documents.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(status.isin("processing", "uploading")).alias("busy"), F.count_if(status == "error").alias("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))
    n, busy, errors = F.col("n"), F.col("busy"), F.col("errors")
    parts = [plural(n, "document"), F.when(busy > 0, F.concat(busy.cast("string"), F.lit(" en traitement"))), F.when(errors > 0, plural(errors, "erreur")), format_size(F.col("size"))]
    return counts.select("project_id", F.concat_ws(" — ", *parts).alias("summary"))


def sync_totals(checked: DataFrame) -> DataFrame:
    """One row: chunk rows and index points of all checked documents (sync_check), and whether all are in step."""
    rows = checked.agg(F.coalesce(F.sum("sql_count"), F.lit(0)).alias("sql_total"), F.coalesce(F.sum("index_count"), F.lit(0)).alias("index_total"), F.coalesce(F.bool_and("synced"), F.lit(True)).alias("each"))
    return rows.select("sql_total", "index_total", ((F.col("sql_total") == F.col("index_total")) & F.col("each")).alias("all_synced"))


def section_tree(chunks: DataFrame) -> DataFrame:
    """Each section path with its depth and direct chunks; all ancestors are present."""
    path = F.col("parent_sections")
    prefixes = chunks.where(F.size(path) > 0).select(path.alias("whole"), F.explode(F.sequence(F.lit(1), F.size(path))).alias("depth"))
    at = F.array_join(F.slice("whole", F.lit(1), F.col("depth")), " > ")
    return prefixes.groupBy(at.alias("path"), "depth").agg(F.sum((F.col("depth") == F.size("whole")).cast("int")).cast("long").alias("chunks"))


def sync_check(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Chunk rows against index points of each ready document."""
    rows = chunks.groupBy("document_id").agg(F.count("*").alias("sql_count"))
    index = points.groupBy("document_id").agg(F.count("*").alias("index_count"))
    missing = chunks.where("point_id is not null").join(points.select("point_id"), "point_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("missing"))
    out = documents.where("status = 'ready'").select("document_id")
    for side in (rows, index, missing):
        out = out.join(side, "document_id", "left")
    out = out.na.fill(0, ["sql_count", "index_count", "missing"])
    return out.withColumn("synced", (F.col("sql_count") == F.col("index_count")) & (F.col("missing") == 0))


def folder_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each folder, 0 where none."""
    n = documents.groupBy("folder_id").agg(F.count("*").alias("n"))
    return folders.join(n, "folder_id", "left").select("folder_id", F.coalesce("n", F.lit(0)).alias("documents"))


def adjacent(chunks: DataFrame) -> DataFrame:
    """The neighbours of each chunk by position, as an equi-join on the wanted position."""
    wanted = chunks.select("document_id", "position", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("near"))
    own = chunks.select("document_id", F.col("position").alias("near"), F.col("char_count").alias("near_chars"))
    return wanted.join(own, ["document_id", "near"]).select("document_id", "position", F.col("near").alias("neighbour"), "near_chars")


def heading_expansion(hits: DataFrame, chunks: DataFrame, least: int = 50) -> DataFrame:
    """The three chunks behind each heading hit, long enough, once a text; score 0.45."""
    heads = hits.where("content_type = 'heading'").select("query_id", "document_id", F.explode(F.sequence(F.col("position") + 1, F.col("position") + 3)).alias("position"))
    key = F.substring("text", 1, 200)
    found = heads.join(chunks.select("document_id", "position", "text"), ["document_id", "position"]).where(F.length("text") >= least).withColumn("key", key)
    known = hits.select("query_id", key.alias("key"))
    fresh = found.join(known, ["query_id", "key"], "left_anti")
    first = fresh.groupBy("query_id", "key").agg(F.min(F.struct("document_id", "position")).alias("at"))
    return first.select("query_id", "at.document_id", "at.position", F.lit(0.45).alias("score"))


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """The position or page jumps from the chunk before."""
    w = Window.partitionBy("document_id").orderBy("position")
    jump = (F.col("position") - F.lag("position").over(w) > 1) | (F.col("page") - F.lag("page").over(w) > 1)
    return chunks.select("document_id", "position", F.coalesce(jump, F.lit(False)).alias("gap"))


def longest_overlap(before: str, text: str, least: int, most: int) -> int:
    """The length of the longest end of ``before`` that starts ``text``, from ``least`` to ``most``; else 0.

    Such an end begins with the first ``least`` characters of text, so only their places are tried, first to last.
    """
    tail, seed = before[-most:], text[:least]
    if len(seed) < least:
        return 0
    at = tail.find(seed, max(0, len(tail) - len(text)))
    while at >= 0 and not text.startswith(tail[at:]):
        at = tail.find(seed, at + 1)
    return len(tail) - at if at >= 0 else 0


def chunk_overlap(chunks: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """The longest end of the chunk before that starts this one; least is 1 or more."""

    def overlap(before: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([longest_overlap(a, b, least, most) for a, b in zip(before.to_pylist(), text.to_pylist(), strict=True)], pa.int32())

    w = Window.partitionBy("document_id").orderBy("position")
    # Only the ends that can meet go to Python.
    head = F.coalesce(F.substring("text", 1, most), F.lit(""))
    rows = chunks.select("document_id", "position", head.alias("head"), F.lag(F.right("text", F.lit(most))).over(w).alias("before")).where("before is not null")
    return rows.select("document_id", "position", F.arrow_udf(overlap, "int")("before", "head").alias("overlap"))


def role_reconcile(listed: DataFrame, current: DataFrame) -> DataFrame:
    """Who is promoted, demoted, unknown or kept."""
    a, b = listed.select("user_id", F.lit(True).alias("wanted")), current.select("user_id", "role")
    change = F.when(F.col("role").isNull(), "unknown").when(F.col("wanted").isNotNull() & (F.col("role") != "admin"), "promote")
    change = change.when(F.col("wanted").isNull() & (F.col("role") == "admin"), "demote").otherwise("keep")
    return a.join(b, "user_id", "full_outer").select("user_id", change.alias("change"))
