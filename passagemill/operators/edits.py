"""Corpus edits (X1-X11, S5, S6, P11, W14): edits and tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .sparse import SCOPE, postings


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def copy_hybrid(points: DataFrame) -> DataFrame:
    """Points with a sparse vector of their text; the same input always gives the same rows."""
    keys = [*SCOPE, "point_id"]
    weights = postings(points).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "weight")))).alias("sparse"))
    none = F.create_map().cast("map<string,double>")
    return points.drop("sparse").join(weights, keys, "left").withColumn("sparse", F.coalesce("sparse", none))


def split_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(document_id, position, at): both trimmed parts, later positions shifted; an empty part refuses the edit."""
    rows = chunks.join(edits, ["document_id", "position"], "left")
    parts = [T.strip(F.expr("substring(text, 1, at)")), T.strip(F.expr("substring(text, at + 1)"))]
    cut = F.coalesce((F.col("at") > 0) & (parts[0] != "") & (parts[1] != ""), F.lit(False))
    before = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    shifted = rows.withColumns({"cut": cut, "shift": F.coalesce(F.sum(cut.cast("int")).over(before), F.lit(0))})
    pieces = shifted.select("*", F.posexplode(F.when(F.col("cut"), F.array(*parts)).otherwise(F.array("text"))).alias("k", "piece"))
    return pieces.select("document_id", (F.col("position") + F.col("shift") + F.col("k")).alias("position"), F.col("piece").alias("text"))


def merge_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(document_id, position): the chunk at position joins the one before; later positions move up."""
    rows = chunks.join(edits.withColumn("joins", F.lit(1)), ["document_id", "position"], "left").na.fill(0, ["joins"])
    w = Window.partitionBy("document_id").orderBy("position")
    joins = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("joins"))
    rows = rows.withColumn("j", joins)
    grouped = rows.withColumns({"group": F.sum(1 - F.col("j")).over(w), "moved": F.sum("j").over(w)}).groupBy("document_id", "group")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"])
    return grouped.agg(F.min(F.col("position") - F.col("moved")).alias("position"), F.array_join(texts, "\n\n").alias("text")).drop("group")


def delete_documents(chunks: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and points without the documents of gone(tenant_id, document_id); other tenants' stay."""
    keys = ["tenant_id", "document_id"]
    return chunks.join(gone, keys, "left_anti"), points.join(gone, keys, "left_anti")


def delete_chunks(chunks: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and points without the chunks of gone(tenant_id, document_id, position); later positions move up.

    chunks and points must have these columns and point_id; other tenants' rows stay as they are.
    """
    keys = ["tenant_id", "document_id", "position"]
    marked = chunks.join(gone.select(*keys).distinct().withColumn("__gone", F.lit(1)), keys, "left").na.fill(0, ["__gone"])
    before = Window.partitionBy("tenant_id", "document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("position") - F.coalesce(F.sum("__gone").over(before), F.lit(0))
    lost = marked.where("__gone = 1 and point_id is not null").select("tenant_id", "point_id").distinct()
    kept = marked.withColumn("__new", moved.cast(chunks.schema["position"].dataType)).where("__gone = 0").withColumn("position", F.col("__new"))
    return kept.select(*chunks.columns), points.join(lost, ["tenant_id", "point_id"], "left_anti")


def delete_folders(documents: DataFrame, chunks: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and points without the documents of the folders of gone(tenant_id, folder_id)."""
    within = documents.join(gone.select("tenant_id", "folder_id").distinct(), ["tenant_id", "folder_id"], "left_semi").select("tenant_id", "document_id").distinct()
    return documents.join(within, ["tenant_id", "document_id"], "left_anti"), *delete_documents(chunks, points, within)


def move_documents(documents: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """moves(document_id, folder_id) with a verdict: moved, folder not found, or of another project."""
    rows = moves.join(documents.select("document_id", "project_id"), "document_id", "left").join(folders.select("folder_id", F.col("project_id").alias("__of")), "folder_id", "left")
    verdict = F.when(F.col("project_id").isNull(), "document not found").when(F.col("__of").isNull(), "folder not found").when(F.col("__of") != F.col("project_id"), "forbidden").otherwise("moved")
    return rows.select("document_id", "folder_id", verdict.alias("verdict"))


def replace_documents(chunks: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks of the given documents are replaced by fresh ones."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def rechunk_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Count and average size before and after, for each document."""
    part = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(f"{name}_chunks"), F.round(F.avg("char_count"), 6).alias(f"{name}_mean"))
    return part(old, "old").join(part(new, "new"), "document_id", "full_outer").na.fill(0, ["old_chunks", "new_chunks"])


def enrich_keywords(chunks: DataFrame) -> DataFrame:
    """Keywords and locations for rows that lack keywords, where there are any."""
    lacking = F.coalesce(F.size("keywords"), F.lit(0)) == 0
    found, places = T.keywords(F.col("text")), T.locations(F.col("text"))
    use = lacking & (F.size(found) > 0)
    return chunks.withColumns({"keywords": F.when(use, found).otherwise(F.col("keywords")), "locations": F.when(use, places).otherwise(F.col("locations"))})


def backfill_metadata(chunks: DataFrame) -> DataFrame:
    """Type, keywords and locations of all rows; an empty list becomes null."""
    some = lambda a: F.when(F.size(a) > 0, a)
    text = F.col("text")
    return chunks.withColumns({"content_type": T.content_type(text), "keywords": some(T.keywords(text)), "locations": some(T.locations(text))})


def update_texts(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(document_id, position, new_text): text, size, keywords and locations follow."""
    rows = chunks.join(edits, ["document_id", "position"], "left")
    text = F.coalesce("new_text", "text")
    changed = F.col("new_text").isNotNull()
    out = {"text": text, "char_count": F.length(text), "keywords": F.when(changed, T.keywords(text)).otherwise(F.col("keywords"))}
    if "locations" in chunks.columns:
        out["locations"] = F.when(changed, T.locations(text)).otherwise(F.col("locations"))
    return rows.withColumns(out).drop("new_text")


def mark_suspects(points: DataFrame) -> DataFrame:
    """X11: injection_suspect is true for suspects and null for all others; doing it twice changes nothing."""
    return points.withColumn("injection_suspect", F.when(T.looks_like_injection(F.col("text")), True))


def payload_keywords(kind: Column, keywords: Column) -> Column:
    """Norms only for diagnostic reports, norms and thermal vocabulary for thermal studies."""
    norms = F.filter(keywords, lambda k: k.rlike(P.NORM_KEYWORD))
    thermal = F.filter(keywords, lambda k: k.rlike(P.THERMAL_KEYWORD))
    return F.when(kind.isin("rapport_amiante", "etude_sol"), norms).when(kind == "etude_thermique", thermal).otherwise(keywords)


def build_payloads(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The payload of each chunk; its own lot wins over the document's, nulls become empty."""
    names = ["document_id", "type", "phase", "filename", "lot", "ingested_at"]
    own = documents.select("document_id", *(F.col(n).alias(f"__{n}") for n in names[1:] if n in documents.columns))
    rows = chunks.drop("type", "phase", "filename", "ingested_at").join(own, "document_id")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in rows.columns else F.array().cast("array<string>")
    lot = F.coalesce(F.nullif(text("chunk_lot"), F.lit("")), text("__lot"))
    columns = {"tenant_id": text("tenant_id"), "project_id": text("project_id"), "document_id": F.col("document_id"), "type": text("__type"), "lot": lot, "phase": text("__phase"), "filename": text("__filename"), "page": F.col("page"), "position": F.col("position"), "text": text("text"), "heading_prefix": text("heading_prefix"), "section_title": text("section_title"), "parent_sections": listed("parent_sections"), "content_type": text("content_type"), "keywords": payload_keywords(text("__type"), listed("keywords")), "char_count": F.coalesce("char_count", F.lit(0)), "localisation": listed("locations")}
    if "__ingested_at" in rows.columns:
        columns["ingested_at"] = F.col("__ingested_at")
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def repair_legacy(points: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with doc_type and no type are rebuilt from chunk rows; those without a row stay.

    Returns the points and one row with the counts ``repaired`` and ``orphans``.
    """
    legacy = F.col("doc_type").isNotNull() & F.col("type").isNull()
    fresh = payloads.select("point_id", F.col("type").alias("__type"), F.lit(True).alias("__row"))
    rows = points.join(fresh, "point_id", "left")
    repaired = legacy & F.col("__row").isNotNull()
    counts = rows.agg(F.sum(repaired.cast("int")).cast("long").alias("repaired"), F.sum((legacy & F.col("__row").isNull()).cast("int")).cast("long").alias("orphans"))
    out = rows.withColumns({"type": F.when(repaired, F.col("__type")).otherwise(F.col("type")), "doc_type": F.when(repaired, F.lit(None)).otherwise(F.col("doc_type"))})
    return out.drop("__type", "__row"), counts
