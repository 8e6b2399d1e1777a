"""Registered queries: statistics, listings, joins and windows over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from . import corpus as C
from .registry import query

QUALITY = """round(least(CASE WHEN char_count BETWEEN 200 AND 2000 THEN 0.4::DOUBLE WHEN char_count BETWEEN 100 AND 2500 THEN 0.2::DOUBLE ELSE 0 END
 + least(0.2::DOUBLE, len(keywords) * 0.02::DOUBLE) + CASE content_type WHEN 'specification' THEN 0.2::DOUBLE WHEN 'description' THEN 0.2::DOUBLE WHEN 'mixed' THEN 0.15::DOUBLE
 WHEN 'quantity' THEN 0.1::DOUBLE WHEN 'admin' THEN 0.1::DOUBLE WHEN 'heading' THEN 0 ELSE 0.1::DOUBLE END, 1), 4)"""


@query(f"""WITH {C.CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, count(*) FILTER (len(keywords) = 0) AS no_keywords,
 count(*) FILTER (content_type = 'heading') AS heading_only, count(*) FILTER (char_count < 100) AS under_100, count(*) FILTER (char_count >= 100 AND char_count < 500) AS under_500,
 count(*) FILTER (char_count >= 500 AND char_count < 1500) AS under_1500, count(*) FILTER (char_count >= 1500 AND char_count < 2500) AS under_2500,
 count(*) FILTER (char_count >= 2500) AS from_2500, round(avg({QUALITY}), 6) AS average_quality FROM chunks""")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.totals(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL} SELECT document_id, count(*) AS chunks, round(avg(char_count), 6) AS mean, min(char_count) AS shortest, max(char_count) AS longest
 FROM chunks GROUP BY document_id""")
def stats_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_document(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL} SELECT category, coalesce(nullif(value, ''), 'unknown') AS value, count(*) AS chunks FROM (
 SELECT 'content_type' AS category, content_type AS value FROM chunks UNION ALL SELECT 'lot', lot FROM chunks UNION ALL SELECT 'type', type FROM chunks) x GROUP BY ALL""")
def stats_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_category(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL} SELECT CASE WHEN char_count < 100 THEN '<100' WHEN char_count < 500 THEN '100-499' WHEN char_count < 1500 THEN '500-1499'
 WHEN char_count < 2500 THEN '1500-2499' ELSE '>=2500' END AS band, count(*) AS chunks FROM chunks GROUP BY 1""")
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return S.size_histogram(C.chunks(spark, sf))


@query(f"WITH {C.CHUNKS_SQL} SELECT document_id, position, {QUALITY} AS quality_score FROM chunks")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.scored(C.chunks(spark, sf)).select("document_id", "position", "quality_score")


@query(f"""WITH {C.CHUNKS_SQL}, scored AS (SELECT *, {QUALITY} AS q FROM chunks), kinds AS (SELECT document_id, array_to_string(list_sort(list(content_type || ':' || n)), ',') AS types
 FROM (SELECT document_id, content_type, count(*) AS n FROM chunks GROUP BY ALL) k GROUP BY document_id),
 words AS (SELECT document_id, sum(len(keywords)) AS keywords, len(list_distinct(flatten(list(keywords)))) AS unique_keywords FROM chunks GROUP BY 1)
 SELECT document_id, count(*) AS chunks, min(char_count) AS shortest, max(char_count) AS longest, round(avg(q), 6) AS quality, count(*) FILTER (q < 0.4) AS low_quality,
 round(count(*) FILTER (content_type = 'heading') / count(*), 6) AS heading_share, round(count(*) FILTER (content_type = 'heading') / count(*), 6) > 0.3 AS many_headings,
 any_value(types) AS types, any_value(w.keywords) AS keywords, any_value(unique_keywords) AS unique_keywords FROM scored JOIN kinds USING (document_id) JOIN words w USING (document_id) GROUP BY document_id""")
def document_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.document_report(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL}, f AS (SELECT document_id, position, char_count, content_type FROM chunks WHERE tenant_id = 't1' AND char_count >= 100 AND len(keywords) > 0
 AND contains(lower(text), 'the') AND point_id IS NOT NULL AND len(list_filter(parent_sections, lambda s: contains(lower(s), 'p1'))) > 0)
 SELECT *, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 50) AS BIGINT) AS pages FROM f ORDER BY char_count DESC, document_id, position LIMIT 50""")
def list_chunks_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.list_chunks(S.tenant_scope(C.chunks(spark, sf), "t1"), min_chars=100, has_keywords=True, contains="The", orphan=False, section="p1")
    rows = rows.select("document_id", "position", "char_count", "content_type")
    return S.page_of(rows, [F.desc("char_count"), F.col("document_id"), F.col("position")], page=1, size=50)


@query(f"WITH {C.DOCS_SQL} SELECT project_id, count(*) AS documents, count(*) FILTER (status = 'error') AS errors, sum(size) AS total_size FROM docs GROUP BY project_id")
def project_bar(spark: SparkSession, sf: str) -> DataFrame:
    return S.project_bar(C.documents(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL}, paths AS (SELECT parent_sections AS p, u.i AS depth FROM chunks, unnest(range(1, len(parent_sections) + 1)) AS u(i))
 SELECT array_to_string(list_slice(p, 1, depth), ' > ') AS path, depth, count(*) FILTER (depth = len(p)) AS chunks FROM paths GROUP BY 1, 2""")
def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    return S.section_tree(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL}, idx AS (SELECT document_id, point_id FROM chunks WHERE point_id IS NOT NULL AND position % 7 <> 3)
 SELECT d.document_id, coalesce(sql_count, 0) AS sql_count, coalesce(index_count, 0) AS index_count, coalesce(missing, 0) AS missing,
 coalesce(sql_count, 0) = coalesce(index_count, 0) AND coalesce(missing, 0) = 0 AS synced FROM docs d
 LEFT JOIN (SELECT document_id, count(*) AS sql_count FROM chunks GROUP BY 1) a USING (document_id)
 LEFT JOIN (SELECT document_id, count(*) AS index_count FROM idx GROUP BY 1) b USING (document_id)
 LEFT JOIN (SELECT document_id, count(*) AS missing FROM chunks WHERE point_id IS NOT NULL AND point_id NOT IN (SELECT point_id FROM idx) GROUP BY 1) c USING (document_id)
 WHERE d.status = 'ready'""")
def sync_check(spark: SparkSession, sf: str) -> DataFrame:
    chunks = C.chunks(spark, sf)
    index = chunks.where("point_id is not null and position % 7 <> 3").select("document_id", "point_id")
    return S.sync_check(C.documents(spark, sf), chunks, index)


@query("""SELECT n_nationkey AS folder_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS documents FROM nation""")
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    folders = C.read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("folder_id"))
    return S.folder_counts(folders, C.read_table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("folder_id")))


@query(f"""WITH {C.CHUNKS_SQL} SELECT a.document_id, a.position, b.position AS neighbour, b.char_count AS near_chars FROM chunks a JOIN chunks b
 ON a.document_id = b.document_id AND abs(a.position - b.position) = 1""")
def adjacent_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.adjacent(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL}, hits AS (SELECT document_id % 10 AS query_id, * FROM chunks WHERE content_type IN ('heading', 'mixed')),
 found AS (SELECT h.query_id, c.document_id, c.position, substring(c.text, 1, 200) AS key FROM hits h JOIN chunks c ON h.document_id = c.document_id AND c.position BETWEEN h.position + 1 AND h.position + 3
 WHERE h.content_type = 'heading' AND length(c.text) >= 50)
 SELECT query_id, document_id, position, 0.45::DOUBLE AS score FROM found f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = f.query_id AND substring(h.text, 1, 200) = f.key)
 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY document_id, position) = 1""")
def heading_expansion(spark: SparkSession, sf: str) -> DataFrame:
    chunks = C.chunks(spark, sf)
    hits = chunks.where("content_type in ('heading', 'mixed')").withColumn("query_id", F.col("document_id") % 10)
    return S.heading_expansion(hits, chunks)


@query(f"""WITH {C.CHUNKS_SQL} SELECT document_id, position, coalesce(position - lag(position) OVER w > 1 OR page - lag(page) OVER w > 1, false) AS gap
 FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY position)""")
def chunk_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_gaps(C.chunks(spark, sf))


@query(f"""WITH {C.CHUNKS_SQL}, b AS (SELECT document_id, position, text, lag(text) OVER (PARTITION BY document_id ORDER BY position) AS before FROM chunks)
 SELECT document_id, position, coalesce(list_max(list_filter(range(20, least(length(text), length(before), 400) + 1), lambda k: right(before, k::INT) = left(text, k::INT))), 0) AS overlap
 FROM b WHERE before IS NOT NULL""")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_overlap(C.chunks(spark, sf))


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN role IS NULL THEN 'unknown' WHEN a.user_id IS NOT NULL AND role <> 'admin' THEN 'promote'
 WHEN a.user_id IS NULL AND role = 'admin' THEN 'demote' ELSE 'keep' END AS change FROM (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_totalprice > 300000
 UNION SELECT -1) a FULL JOIN (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'member' END AS role FROM customer) b ON a.user_id = b.user_id""")
def role_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    listed = C.read_table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("user_id")).union(spark.range(-1, 0)).distinct()
    role = F.when(F.col("c_custkey") % 3 == 0, "admin").otherwise("member")
    return S.role_reconcile(listed, C.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role")))
