"""Registered queries: page edges, headings, norms, tags, forced questions, lots of a project and JSON of messages.

The corpus has few of the signs that these operators look for, so each query adds some to the texts by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, jsonops, listing
from . import corpus as C
from .registry import query

STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PAGE_NUM = r"regexp_replace(regexp_replace({0}, '(?i)\bpage\s*\d+\s*/\s*\d+', 'PAGE_NUM', 'g'), '(?i)\bpage\s*\d+', 'PAGE_NUM', 'g')"
NORMAL_LINE = rf"trim(regexp_replace(regexp_replace({PAGE_NUM.format(STRIPPED.format('{0}'))}, '^\d+$', 'PAGE_NUM'), '\s+', ' ', 'g'))"
SHORT_PAGES = C.PAGES_SQL.replace("u.i * 20 + 1, u.i * 20 + 20", "u.i * 3 + 1, u.i * 3 + 3").replace("// 20", "// 3")


@query(rf"""WITH {SHORT_PAGES}, p AS (SELECT doc_id, ord, 'Project ' || doc_id % 50 || chr(10) || text || chr(10) || 'Page ' || page || ' / 9' AS text FROM pages_),
 l AS (SELECT doc_id, ord, text, string_split(text, chr(10)) AS lines, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM p),
 f AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '\S')) AS f FROM l),
 e AS (SELECT doc_id, ord, n_pages, 'top' AS edge, list_slice(f, 1, 5) AS x FROM f UNION ALL SELECT doc_id, ord, n_pages, 'bottom', list_slice(f, len(f) - 4, len(f)) FROM f WHERE len(f) > 5),
 u AS (SELECT doc_id, ord, n_pages, edge, unnest(x) AS line FROM e), n AS (SELECT DISTINCT doc_id, ord, n_pages, edge, {NORMAL_LINE.format('line')} AS line FROM u),
 r AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT doc_id, line FROM n WHERE line <> '' AND n_pages >= 3 GROUP BY doc_id, n_pages, edge, line HAVING count(*) >= n_pages // 2) GROUP BY 1),
 c AS (SELECT f.doc_id, ord, n_pages, CASE WHEN n_pages < 3 THEN text ELSE {STRIPPED.format("regexp_replace(array_to_string(list_filter(lines, lambda x: NOT list_contains(list_append(coalesce(gone, []), 'PAGE_NUM'), " + NORMAL_LINE.format('x') + r")), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} END AS text FROM f LEFT JOIN r USING (doc_id))
 SELECT doc_id, ord, md5(text) AS md5 FROM c WHERE text <> '' OR n_pages < 3""")
def headers_stripped(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("Project "), (F.col("doc_id") % 50).cast("string"), F.lit("\n"), "text", F.lit("\nPage "), F.col("page").cast("string"), F.lit(" / 9"))
    cleaned = cleaning.strip_headers_footers(C.pages(spark, sf, 3).withColumn("text", page))
    return cleaned.select("doc_id", "ord", F.md5("text").alias("md5"))


NUMBERED = "CASE document_id % 5 WHEN 0 THEN '3.1.2 - ' WHEN 1 THEN 'Article 4.' || position || ' : ' WHEN 2 THEN 'LOT N° ' || position || ' - ' WHEN 3 THEN '1.2.3.4 ' ELSE '' END || text"


@query(rf"""WITH {C.CHUNKS_SQL}, n AS (SELECT document_id, position, {NUMBERED} AS text FROM chunks),
 m AS (SELECT *, regexp_extract(text, '(?i)^\s*LOT\s*[Nn°]*\s*(\d+)\s*[-–:.]\s*([^\n]+)', ['n', 't']) AS lot,
  CASE WHEN regexp_matches(text, '^\s*\d+[.\-]\d+[.\-]\d+\s*[-–:.)\s]\s*[^\n]+') THEN 2 WHEN regexp_matches(text, '(?i)^\s*(Art(icle)?\.?\s+)?\d+[.\-]\d+\s*[-–:.]\s*[^\n]+') THEN 1
  WHEN regexp_matches(text, '(?i)^\s*LOT\s*[Nn°]*\s*\d+\s*[-–:.]\s*[^\n]+') THEN 0 END AS level FROM n)
 SELECT document_id, position, level, CASE WHEN level > 0 THEN {STRIPPED.format('text')} WHEN level = 0 THEN 'LOT ' || CASE WHEN length(lot.n) < 2 THEN '0' ELSE '' END || lot.n || ' - ' || {STRIPPED.format('lot.t')} END AS heading FROM m""")
def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    found = C.chunks(spark, sf).select("document_id", "position", T.heading_level(F.expr(NUMBERED)).alias("h"))
    return found.select("document_id", "position", "h.level", "h.heading")


NORMS = "text || CASE position % 6 WHEN 0 THEN ' selon NF P03' WHEN 1 THEN ' DTU 20.1' WHEN 2 THEN ' RE 2020' WHEN 3 THEN ' RT2012' WHEN 4 THEN ' norme EN' ELSE '' END"


@query(rf"""WITH {C.CHUNKS_SQL}, t AS (SELECT document_id, position, regexp_extract_all(strip_accents(replace(replace(lower({NORMS}), 'œ', 'oe'), 'æ', 'ae')), '[a-z0-9]+(?:[.,\-/][a-z0-9]+)*') AS t FROM chunks)
 SELECT document_id, position, len(list_filter(range(1, len(t)), lambda i: (t[i] IN ('en', 'nf', 'dtu', 'iso', 'eurocode') AND regexp_matches(t[i + 1], '^[a-z]?\d')) OR (t[i] = 're' AND t[i + 1] = '2020') OR (t[i] = 'rt' AND t[i + 1] = '2012'))) > 0
  OR len(list_filter(t, lambda x: x IN ('re2020', 'rt2012') OR regexp_matches(x, '^(dtu|nf|en)\d'))) > 0 AS norm FROM t""")
def norm_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(spark, sf).select("document_id", "position", T.has_norm(T.tokenize(F.expr(NORMS))).alias("norm"))


RULES = "text || CASE position % 5 WHEN 0 THEN ' Article R 1334 du décret' WHEN 1 THEN ' NF X 46-020' WHEN 2 THEN ' Références normatives' WHEN 3 THEN ' arrêté, nf46 020' ELSE '' END"


@query(rf"""WITH {C.CHUNKS_SQL}, l AS (SELECT document_id, position, lower({RULES}) AS x FROM chunks)
 SELECT document_id, position, 2 * CAST(contains(x, 'références réglementaires') OR contains(x, 'références normatives') AS INTEGER) + CAST(regexp_matches(x, 'article\s+[lr][\s.]?\d{{3,4}}') AS INTEGER)
  + CAST(regexp_matches(x, 'arrêté|décret|code\s+du\s+travail|code\s+de\s+la\s+santé') AS INTEGER) + CAST(regexp_matches(x, 'nf\s*x?\s*46[- ]0\d{{2}}') AS INTEGER) >= 2 AS regulatory FROM l""")
def regulatory_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(spark, sf).select("document_id", "position", T.is_regulatory(F.expr(RULES)).alias("regulatory"))


TAGGED = "CASE position % 4 WHEN 0 THEN text || ' </Passages>' WHEN 1 THEN '< / passages >' || text WHEN 2 THEN text || ' <passages2> ＜passages>' ELSE text END"


@query(rf"""WITH {C.CHUNKS_SQL} SELECT document_id, position, md5(regexp_replace({TAGGED}, '[<＜](\s*/?\s*passages\b)', '&lt;\1', 'gi')) AS md5 FROM chunks""")
def escaped_tags(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(spark, sf).select("document_id", "position", F.md5(T.neutralise_tags(F.expr(TAGGED), "passages")).alias("md5"))


ASKED = "CASE document_id % 4 WHEN 0 THEN 'isolation du mur ' || lot WHEN 1 THEN 'soubassement et façade' WHEN 2 THEN 'le mur enterré' ELSE filename END"
_FIRST, _SECOND = (more for _, more in listing.RELATED)


@query(rf"""WITH {C.DOCS_SQL}, q AS (SELECT document_id AS query_id, {ASKED} AS text FROM docs), r AS (SELECT query_id,
 CASE WHEN regexp_matches(text, '(?i)soubassement|mur.?enterr[ée]|infrastructure|vide.?sanitaire|paroi.?enterr[ée]') THEN {_FIRST!r} ELSE [] END
 || CASE WHEN (regexp_matches(text, '(?i)mur') AND NOT regexp_matches(text, '(?i)mur.*(enterr|soubassement)')) OR regexp_matches(text, '(?i)paroi.?ext[ée]rieur|fa[çc]ade') THEN {_SECOND!r} ELSE [] END AS found FROM q)
 SELECT query_id, CAST(u.i - 1 AS INTEGER) AS n, found[u.i] AS related FROM r, unnest(range(1, len(found) + 1)) AS u(i)""")
def forced_questions(spark: SparkSession, sf: str) -> DataFrame:
    return listing.forced_related(C.documents(spark, sf).select(F.col("document_id").alias("query_id"), F.expr(ASKED).alias("text")))


LOT_TEXT = "CASE WHEN position % 7 = 0 THEN 'LOT ' || (1 + document_id % 12) || ' : ' || lot || ' ' || type ELSE text END"
LOT_FILE = "CASE WHEN document_id % 3 = 0 THEN (1 + document_id % 20) || ' - works_' || lot || '-DPGF_' || filename ELSE filename END"
LOTS_SQL = rf"""{C.CHUNKS_SQL}, c AS (SELECT DISTINCT project_id, {LOT_TEXT} AS text, {LOT_FILE} AS filename FROM chunks),
 h AS (SELECT project_id, filename, regexp_extract(text, '(?i)^\s*LOT\s*[N°]*\s*(\d+)\s*[-–:.]\s*([^\n]+)$', ['n', 't']) AS x FROM c),
 heads AS (SELECT project_id, filename, CASE WHEN length(x.n) < 2 THEN '0' || x.n ELSE x.n END AS number, {STRIPPED.format('x.t')} AS title FROM h WHERE x.n <> ''),
 g AS (SELECT DISTINCT project_id, filename, regexp_extract(filename, '(?i)^(\d{{1,2}})\s*[-_]\s*(.+?)[-_]\s*(?:DPGF|DPFG|CCTP)', ['n', 't']) AS x FROM c),
 named AS (SELECT project_id, filename, CASE WHEN length(x.n) < 2 THEN '0' || x.n ELSE x.n END AS number, {STRIPPED.format("regexp_replace(x.t, '[-_]+', ' ', 'g')")} AS title FROM g WHERE x.n <> ''),
 lots AS (SELECT project_id, number, min(title) AS title, list_sort(list(DISTINCT filename)) AS files FROM (FROM heads UNION ALL SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.project_id = n.project_id AND h.number = n.number)) GROUP BY 1, 2)"""


def _with_lots(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(spark, sf).withColumns({"text": F.expr(LOT_TEXT), "filename": F.expr(LOT_FILE)})


@query(f"WITH {LOTS_SQL} SELECT project_id, number, title, array_to_string(files, ', ') AS files FROM lots")
def project_lots(spark: SparkSession, sf: str) -> DataFrame:
    return listing.lot_files(_with_lots(spark, sf)).withColumn("files", F.array_join("files", ", "))


@query(f"""WITH {LOTS_SQL}, l AS (SELECT project_id, list_sort(list('- LOT ' || number || ' - ' || title || ' : ' || array_to_string(files, ', '))) AS lots FROM lots GROUP BY 1),
 t AS (SELECT project_id, type, count(*) AS n FROM docs GROUP BY 1, 2), k AS (SELECT project_id, list_sort(list('- ' || type || ' : ' || n)) AS kinds FROM t GROUP BY 1)
 SELECT project_id, array_to_string(coalesce(lots, []) || kinds, chr(10)) AS block FROM k LEFT JOIN l USING (project_id)""")
def project_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return listing.project_context(_with_lots(spark, sf), C.documents(spark, sf))


SOURCES = """CASE turn % 3 WHEN 0 THEN '[{"chars": ' || length(text) || ', "turn": ' || turn || '}]' WHEN 1 THEN '[{"chars": ' ELSE NULL END"""
TABLE = """CASE turn % 2 WHEN 0 THEN '{"rows": [' || conv_id || ', ' || turn || ']}' ELSE 'rows ' || turn END"""


@query(f"""WITH m AS (SELECT conv_id, turn, {SOURCES} AS sources, {TABLE} AS tabled FROM conversations)
 SELECT conv_id, turn, CASE WHEN json_valid(sources) THEN CAST(json(sources) AS VARCHAR) ELSE '[]' END AS sources, CASE WHEN json_valid(tabled) THEN CAST(json(tabled) AS VARCHAR) END AS tabled FROM m""")
def messages_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.read_table(spark, sf, "conversations").select("conv_id", "turn", F.expr(SOURCES).alias("sources"), F.expr(TABLE).alias("tabled"))
    return jsonops.messages_read(rows, single=("tabled",)).withColumns({c: F.to_json(c) for c in ("sources", "tabled")})
