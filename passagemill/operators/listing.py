"""Listings, small reports and rule-based enrichment of questions (P7, P8, P10, P13, A9, A11, A17, A19,
A20, O2, O8, J12, J16, T21-T23, T26, T29, T30, R11, R13, R18-R20, U7, K7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .context import JOINT, add_forced
from .retrieval import search_by_lot, search_merged
from .stats import scored

BROAD = (
    r"(?iuU)quell?e?s?\s+sont|liste[rz]?" + P.STOP + r"|r[ée]sum[ée]|synth[èe]se|vue\s+d.ensemble|tous\s+les|budget|"
    r"ma[iî]tre\s+d.ouvrage|type\s+de\s+construction|combien\s+de|c.est\s+quoi\s+ce\s+projet|"
    r"contraintes?\s+(?:du|de|r[ée]glementaire|projet|chantier)|normes?\s+applicables?|dtu\s+applicables?"
)
SCHEMA = (
    r"(?iu)dallage|terre.plein|plancher|hourdis|solivage|plancher.bois|toiture.terrasse|mur.*doublage|cloison|charpente|"
    r"couverture|voirie|chauss[ée]e|composition.*mur|composition.*plancher|composition.*dallage|coupe.*mur|"
    r"coupe.*plancher|coupe.*toiture|coupe.*dallage"
)
WORKS = r"(?iu)paroi.?ext[ée]rieur|mur.?ext[ée]rieur|mur.?p[ée]riph[ée]rique"
#: Rows of (pattern, related question): fixed values of the question rules.
RELATED = [
    (r"(?iu)soubassement|mur.?enterr[ée]|infrastructure|vide.?sanitaire|paroi.?enterr[ée]", [
        "agglomérés pleins blocs à bancher voile béton soubassement élévation",
        "longrine maçonnerie soubassement mur enterré paroi",
        "enduit imperméabilisation étanchéité drainage parois enterrées",
        "vide sanitaire plancher hourdis sur longrines",
    ]),
    (r"(?iu)mur(?!.*(?:enterr|soubassement))|paroi.?ext[ée]rieur|fa[çc]ade", [
        "enduit extérieur façade monocouche RPE crépi ravalement mortier bâtard",
        "maçonnerie agglo parpaing brique béton banché ossature bois mur porteur",
        "isolation thermique doublage laine de verre laine de roche polyuréthane ITE ITI",
        "plaque de plâtre BA13 parement intérieur finition",
    ]),
]
NO_QUANTITIES = r"(?iu)TERRASSEMENT|GROS.?OEUVRE|GROS.?ŒUVRE|VRD"
FILE_LOT = r"(?i)^(\d{1,2})\s*[-_]\s*(.+?)[-_]\s*(?:DPGF|DPFG|CCTP)"
GOOD_SOIL = r"(?iu)(?:bon\s*sol|sol\s*porteur|terrain\s*naturel\s*porteur|assise)[^.\n]{0,80}?((?:argile|grave|marne|calcaire|sable|roche|limon)[^.\n]{0,30})"
LEAN_CONCRETE = r"(?iu)(?:gros\s*béton|béton\s*de\s*propreté)[^.\n]{0,60}?(\d+[.,]?\d*\s*(?:cm|m)(?![\p{L}\p{N}_]))"


def scope_of(question: Column) -> Column:
    """T21."""
    return F.when(question.rlike(BROAD), "broad").otherwise("specific")


def question_rules(questions: DataFrame) -> DataFrame:
    """Scope, and whether a drawing or the build-up of outer walls is asked for."""
    text = F.col("text")
    return questions.withColumns({"scope": scope_of(text), "forced_schema": text.rlike(SCHEMA), "outer_walls": text.rlike(WORKS)})


def forced_related(questions: DataFrame) -> DataFrame:
    """(query_id, related) for each rule that a question meets, in the order of the rules."""
    none = F.array().cast("array<string>")
    found = F.concat(*(F.when(F.col("text").rlike(p), F.array(*map(F.lit, more))).otherwise(none) for p, more in RELATED))
    return questions.select("query_id", F.posexplode(found).alias("n", "related"))


def schema_values(text: Column) -> Column:
    """The first soil and the first lean-concrete thickness named, null where there is none."""
    of = lambda p: F.nullif(T.strip(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(of(GOOD_SOIL).alias("bon_sol"), of(LEAN_CONCRETE).alias("gros_beton"))


def enrich_schema(schemas: DataFrame, hits: DataFrame) -> DataFrame:
    """schemas(query_id, params): values that are missing are filled from the hits' texts."""
    texts = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), "\n").alias("__text"))
    found = schema_values(F.coalesce("__text", F.lit("")))
    given = F.map_filter(F.create_map(F.lit("bon_sol"), found["bon_sol"], F.lit("gros_beton"), found["gros_beton"]), lambda k, v: v.isNotNull() & ~F.map_contains_key("params", k))
    return schemas.join(texts, "query_id", "left").withColumn("params", F.map_concat("params", given)).drop("__text")


def search_documents_list(documents: DataFrame, needle: str, folder_id=None) -> DataFrame:
    """A substring of file name, type, lot or phase, in any case."""
    rows = documents if folder_id is None else documents.where(F.col("folder_id") == folder_id)
    named = [c for c in ("filename", "type", "lot", "phase") if c in documents.columns]
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in named)))


def filter_projects(projects: DataFrame, needle: str = "", phase: str | None = None, status: str | None = None, favourites: DataFrame | None = None) -> DataFrame:
    """A substring of name or client, a phase, a status; ``favourite`` flags favourites(project_id), where given."""
    low = needle.lower()
    if favourites is not None:
        marked = favourites.select("project_id").distinct().withColumn("favourite", F.lit(True))
        projects = projects.join(marked, "project_id", "left").na.fill(False, ["favourite"])
    rows = projects.where(F.lower("name").contains(low) | F.coalesce(F.lower("client").contains(low), F.lit(False)))
    rows = rows if phase is None else rows.where(F.col("phase") == phase)
    return rows if status is None else rows.where(F.col("status") == status)


def sort_documents(documents: DataFrame, pending: DataFrame, field: str = "filename", descending: bool = False) -> DataFrame:
    """Sorted by one of the fields in French collation; pending rows that aren't stored come last."""
    fresh = pending.join(documents.select("document_id"), "document_id", "left_anti").withColumn("__last", F.lit(1))
    both = documents.withColumn("__last", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    kind = dict(both.dtypes)[field]
    key = F.collate(F.col(field), "fr") if kind == "string" else F.col(field)
    return both.orderBy("__last", key.desc() if descending else key.asc(), "document_id").drop("__last")


def sort_projects(projects: DataFrame, documents: DataFrame, field: str = "name", descending: bool = False) -> DataFrame:
    """O3: projects with ``n_documents`` and ``place``, from 1, by name, n_documents or newest; ties by project_id."""
    counts = documents.groupBy("project_id").agg(F.count("*").alias("n_documents"), F.max("ingested_at").alias("newest"))
    rows = projects.join(counts, "project_id", "left").na.fill(0, ["n_documents"])
    key = F.collate(F.col(field), "fr") if field == "name" else F.col(field)
    # A report of all projects in one order: a row a project.
    order = Window.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "project_id")
    return rows.withColumn("place", F.row_number().over(order))


def newest_first(documents: DataFrame, by: str = "project_id") -> DataFrame:
    """The documents of each project with ``place``, the newest first, ties by document_id."""
    return documents.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("ingested_at"), "document_id")))


def chunk_rows(chunks: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Chunk rows with their document's file name and type and their project's name; orphans are left out."""
    own = documents.select("document_id", "project_id", "filename", "type")
    return chunks.join(own, "document_id").join(projects.select("project_id", F.col("name").alias("project_name")), "project_id")


def validate_classification(rows: DataFrame) -> DataFrame:
    """P10: an unknown type becomes autre, an unknown phase empty."""
    kind, phase = F.coalesce("type", F.lit("")), F.coalesce("phase", F.lit(""))
    return rows.withColumns({"type": F.when((kind == "") | kind.isin(P.DOCUMENT_TYPES), kind).otherwise("autre"), "phase": F.when(phase.isin(P.PHASES), phase).otherwise("")})


def tool_arguments(calls: DataFrame) -> DataFrame:
    """calls(query, lot, phase, type, project_id) with the reason for which one is refused, else null."""
    uuid = r"(?i)^[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12}$"
    reason = F.when(F.coalesce(T.strip(F.col("query")), F.lit("")) == "", "query is blank").when(F.length("query") > 500, "query longer than 500 characters")
    for c in ("lot", "phase", "type"):
        reason = reason.when(F.length(c) > 100, f"{c} longer than 100 characters")
    return calls.withColumn("reject_reason", reason.when(~F.coalesce(F.col("project_id").rlike(uuid), F.lit(False)), "invalid project_id"))


def weighted_mean_size(per_document: DataFrame) -> DataFrame:
    """A9."""
    return per_document.agg(F.round(F.sum(F.col("mean") * F.col("chunks")) / F.sum("chunks"), 6).alias("mean_size"))


def lot_files(chunks: DataFrame) -> DataFrame:
    """(project_id, number, title, files): lots of headings first, then lots whose number only a file name has."""
    heads = chunks.select("project_id", "filename", F.explode(T.lot_headings(F.col("text"))).alias("h")).select("project_id", "filename", "h.number", "h.title")
    named = chunks.select("project_id", "filename").distinct().where(F.col("filename").rlike(FILE_LOT))
    named = named.select("project_id", "filename", T.pad2(F.regexp_extract("filename", FILE_LOT, 1)).alias("number"), T.strip(F.regexp_replace(F.regexp_extract("filename", FILE_LOT, 2), "[-_]+", " ")).alias("title"))
    new = named.join(heads.select("project_id", "number").distinct(), ["project_id", "number"], "left_anti")
    both = heads.unionByName(new.select(heads.columns))
    return both.groupBy("project_id", "number").agg(F.min("title").alias("title"), F.array_sort(F.collect_set("filename")).alias("files"))


def project_context(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """K7: (project_id, block): the lots with their files and the document types with their counts."""
    lots = lot_files(chunks).groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- LOT "), "number", F.lit(" - "), "title", F.lit(" : "), F.array_join("files", ", ")))).alias("lots"))
    kinds = documents.groupBy("project_id", "type").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "type", F.lit(" : "), F.col("n").cast("string")))).alias("kinds"))
    return kinds.join(lots, "project_id", "left").select("project_id", F.array_join(F.concat(F.coalesce("lots", F.array().cast("array<string>")), "kinds"), "\n").alias("block"))


def section_coverage(found: DataFrame, used: DataFrame) -> DataFrame:
    """Passages found and used by section, and their share in percent."""
    n = found.groupBy("query_id").agg(F.count("*").alias("found"))
    m = used.groupBy("query_id").agg(F.count("*").alias("used"))
    return n.join(m, "query_id", "left").na.fill(0, ["used"]).withColumn("percent", F.round(100 * F.col("used") / F.col("found"), 4))


def backfill_report(points: DataFrame) -> DataFrame:
    """Scanned and flagged points."""
    return points.agg(F.count("*").alias("scanned"), F.count_if(F.coalesce("injection_suspect", F.lit(False))).alias("flagged"))


def summary_status(projects: DataFrame, documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Whether a project has documents and a finished summary, and the summary's status."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("n"))
    rows = projects.select("project_id").join(n, "project_id", "left").join(summaries.select("project_id", "status"), "project_id", "left")
    return rows.select("project_id", (F.coalesce("n", F.lit(0)) > 0).alias("has_documents"), F.coalesce(F.col("status") != "generating", F.lit(False)).alias("has_summary"), "status")


def nested_projects(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with their documents, newest first."""
    own = F.sort_array(F.collect_list(F.struct("ingested_at", "document_id", "filename")), asc=False)
    return projects.join(documents.groupBy("project_id").agg(own.alias("documents")), "project_id", "left")


def document_chunks(documents: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks of each wanted document in order with their score; ``found`` tells an empty document from an unknown one."""
    known = wanted.join(documents.select("document_id", F.lit(True).alias("found")), "document_id", "left")
    rows = scored(chunks).select("document_id", "position", "char_count", "quality_score")
    return known.join(rows, "document_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def chunk_details(chunks: DataFrame) -> DataFrame:
    """Each chunk with its score and the positions of its neighbours."""
    w = Window.partitionBy("document_id").orderBy("position")
    near = lambda d: F.when(F.lead("position", d).over(w) == F.col("position") + d, F.col("position") + d)
    return scored(chunks).withColumns({"before": near(-1), "after": near(1)})


def chunk_detail(chunks: DataFrame, points: DataFrame, characters: int = 150) -> DataFrame:
    """Each chunk with its score, the payload of its point (null without one), and its neighbours' previews.

    ``adjacent`` lists the chunks at the positions before and behind, as structs of position and preview.
    """
    payload = points.select("point_id", F.to_json(F.struct(*[c for c in points.columns if c not in ("point_id", "dense", "sparse")])).alias("payload"))
    preview = F.substring(F.coalesce("text", F.lit("")), 1, characters)
    near = chunks.select("document_id", F.struct("position", preview.alias("preview")).alias("near"), F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("__at"))
    listed = near.groupBy("document_id", F.col("__at").alias("position")).agg(F.array_sort(F.collect_list("near")).alias("adjacent"))
    rows = scored(chunks).withColumn("preview", preview).join(listed, ["document_id", "position"], "left")
    none = F.array().cast(listed.schema["adjacent"].dataType)
    return rows.join(payload, "point_id", "left").withColumn("adjacent", F.coalesce("adjacent", none))


def quantity_enrichment(hits: DataFrame, questions: DataFrame, chunks: DataFrame, score: float = 0.5) -> DataFrame:
    """Price-list chunks that belong to a question's topic, behind its hits.

    hits(query_id, tenant_id, project_id, filename, type, lot, text), questions(query_id, text, rewritten),
    chunks(tenant_id, project_id, filename, type, lot, text, position). A price list matches by words of its
    name, by an article prefix of a topical hit, or by a lot of the hits; its chunks match by prefix or topic.
    """
    asked = questions.select("query_id", T.question_words(F.col("text")).alias("own"), T.question_words(F.col("text"), F.coalesce("rewritten", F.lit(""))).alias("words"))
    # A text is lowered, and its number looked for, once and not for each word or prefix.
    topical = lambda text: F.exists(F.array(F.lower(text)), lambda low: F.exists("words", lambda w: F.contains(low, w)))
    scope = ["query_id", "tenant_id", "project_id"]
    rows = hits.join(asked, "query_id")
    lists = F.col("type") == "DPGF"
    prefixes = rows.where(lists & topical(F.col("text"))).groupBy(*scope).agg(F.array_distinct(F.flatten(F.collect_list(T.article_prefixes(F.col("text"))))).alias("prefixes"))
    lots = rows.where("coalesce(lot, '') != ''").groupBy(*scope).agg(F.collect_set("lot").alias("lots"))
    known = rows.select(*scope, "own", "words").dropDuplicates(scope).join(prefixes, scope, "left").join(lots, scope, "left")
    empty = F.array().cast("array<string>")
    known = known.withColumns({"prefixes": F.coalesce("prefixes", empty), "lots": F.coalesce("lots", empty)})
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)+)", 1)
    related = F.exists(F.array(number), lambda x: (x != "") & F.exists("prefixes", lambda p: x.startswith(p) | p.startswith(x)))
    listed = rows.where(lists).select(*scope, "filename", number.alias("number")).join(known.select(*scope, "prefixes"), scope)
    by_hit = listed.where((F.col("number") != "") & F.exists("prefixes", lambda p: F.col("number").startswith(p) | p.startswith(F.col("number")))).select(*scope, "filename").distinct()
    all_files = chunks.where(lists).groupBy("tenant_id", "project_id", "filename").agg(F.max("lot").alias("lot")).where(~F.col("filename").rlike(NO_QUANTITIES))
    by_name = all_files.join(known, ["tenant_id", "project_id"]).where(T.filename_matches(F.col("filename"), F.col("own")) | F.array_contains("lots", F.col("lot"))).select(*scope, "filename")
    matched = by_name.unionByName(by_hit.where(~F.col("filename").rlike(NO_QUANTITIES))).distinct()
    found = chunks.join(matched, ["tenant_id", "project_id", "filename"]).join(known.select(*scope, "words", "prefixes"), scope).where(related | topical(F.col("text")))
    key = F.substring("text", 1, 200)
    fresh = found.withColumn("key", key).join(hits.select("query_id", key.alias("key")), ["query_id", "key"], "left_anti")
    w = Window.partitionBy("query_id", "key").orderBy("filename", "position")
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("query_id", "filename", "position", "text", F.lit(score).alias("score"))


def section_configs(spark: SparkSession, rows: list[tuple[str, str, str, list[str], list[str]]]) -> DataFrame:
    """Sections (key, category, label, types, excluded content types) as a table to join with."""
    return spark.createDataFrame(rows, "section string, category string, label string, types array<string>, excluded array<string>")


def in_section(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """Hits of each section's document types and not of its excluded content types; no types means all."""
    joined = hits.join(configs.select("section", "types", "excluded"), "section")
    return joined.where(((F.size("types") == 0) | F.array_contains("types", F.col("type"))) & ~F.array_contains("excluded", F.col("content_type"))).drop("types", "excluded")


def search_passages(questions: DataFrame, points: DataFrame, limit: int = 8) -> DataFrame:
    """The best passages of each question, with a flag for texts that speak to a model."""
    hits = search_merged(questions, points, limit)
    return hits.withColumn("suspect", T.looks_like_injection(F.col("text")))


def run_search(questions: DataFrame, forced: DataFrame, points: DataFrame, limit: int = 20) -> DataFrame:
    """Broad questions by lot, the others merged over variants; hits of forced questions come behind.

    questions and forced have query_id, variant, tenant_id, text and vector; scope is read from the first
    variant's text.
    """
    scope = questions.where("variant = 0").select("query_id", scope_of(F.col("text")).alias("scope"))
    routed = questions.join(scope, "query_id")
    broad = search_by_lot(routed.where("scope = 'broad'").drop("scope"), points).select("query_id", "point_id", "score")
    narrow = search_merged(routed.where("scope = 'specific'").drop("scope"), points, limit).select("query_id", "point_id", "score")
    more = search_merged(forced, points, limit).select("query_id", "point_id", "score")
    return add_forced(broad.unionByName(narrow), more)


def reorder_for_table(block: Column, most: int = 12000) -> Column:
    """Price-list passages with an amount first, then other price-list passages, then the rest."""
    parts = F.split(block, JOINT)
    listed = lambda p: F.contains(F.upper(F.substring_index(p, "\n", 1)), F.lit("DPGF"))
    amount = lambda p: p.rlike(P.AMOUNT)
    groups = [F.filter(parts, lambda p: listed(p) & amount(p)), F.filter(parts, lambda p: listed(p) & ~amount(p)), F.filter(parts, lambda p: ~listed(p))]
    return F.left(F.array_join(F.concat(*groups), JOINT), F.lit(most))
