"""Registered queries: handling of what a model returned. The JSON is built from the tables; the SQL gives
what each field must become from the fields themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jsonops as J
from . import corpus as C
from .registry import query

PLAIN = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


def _plain() -> Column:
    return F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.documents(spark, sf).where("text is not null").select("document_id", F.col("document_id").alias("i"), "project_id", "lot", _plain().alias("plain"))
    return rows.where("plain != ''")


DOCS = f"""{C.DOCS_SQL}, j AS (SELECT document_id, document_id AS i, project_id, lot, plain, string_split(plain, ' ') AS w FROM (SELECT *, {PLAIN} AS plain FROM docs WHERE text IS NOT NULL) x WHERE plain <> '')"""


@query(f"""WITH {DOCS} SELECT document_id, CASE WHEN i % 5 = 0 THEN plain ELSE array_to_string(list_slice(w, 1, 25), ' ') END AS query,
 CASE WHEN i % 5 = 0 THEN '' ELSE array_to_string(list_slice(w, 1, 15), ' ') || ' / ' || lot END AS related, CASE WHEN i % 5 <> 0 AND i % 3 = 0 THEN 'broad' ELSE 'specific' END AS scope,
 CASE WHEN i % 5 <> 0 AND i % 2 = 0 THEN 'table' ELSE 'none' END AS structured FROM j""")
def rewrites_read(spark: SparkSession, sf: str) -> DataFrame:
    """Y1."""
    i = F.col("i")
    value = F.struct(F.col("plain").alias("query"), F.array("plain", "lot", F.lit("third")).alias("related"), F.when(i % 3 == 0, " BROAD").otherwise("wide").alias("scope"), F.when(i % 2 == 0, "Table").otherwise("x").alias("structured"))
    raw = F.when(i % 5 == 0, F.col("plain")).otherwise(F.concat(F.lit("```json\n"), F.to_json(value), F.lit("\n```")))
    rows = J.parse_rewrite(_docs(spark, sf).withColumn("raw", raw))
    return rows.select("document_id", "query", F.array_join("related", " / ").alias("related"), "scope", "structured")


@query(f"WITH {DOCS} SELECT document_id, i % 3 <> 0 OR i % 4 = 0 AS sufficient, CASE WHEN i % 3 = 0 AND i % 4 <> 0 THEN left(plain, 300) ELSE '' END AS missing FROM j")
def judgments_read(spark: SparkSession, sf: str) -> DataFrame:
    """Y2."""
    i = F.col("i")
    value = F.struct(F.when(i % 3 == 0, " INSUFFISANT ").otherwise("suffisant").alias("verdict"), F.col("plain").alias("manque"))
    raw = F.when(i % 4 == 0, F.substring(F.to_json(value), 2, 1 << 30)).otherwise(F.to_json(value))
    return J.parse_judgment(_docs(spark, sf).withColumn("raw", raw)).select("document_id", "sufficient", "missing")


@query(f"WITH {DOCS} SELECT document_id, CASE WHEN i % 3 = 1 AND plain <> lot THEN array_to_string(list_slice(w, 1, 40), ' ') END AS query FROM j")
def reformulations_read(spark: SparkSession, sf: str) -> DataFrame:
    """A third has another query, a third the first one again, a third none."""
    i = F.col("i")
    asked = F.when(i % 3 == 0, F.upper("lot")).when(i % 3 == 1, F.col("plain")).otherwise("  ")
    rows = _docs(spark, sf).withColumns({"raw": F.to_json(F.struct(asked.alias("query"))), "first_query": F.concat(F.lit(" "), "lot")})
    return J.parse_reformulation(rows).select("document_id", "query")


@query(f"""WITH {DOCS} SELECT document_id, '{{"lot":"' || lot || '","kpis":[]}}' AS repaired FROM j""")
def json_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """An object that ends in an open string; all of that string is lost."""
    raw = F.concat(F.lit('{"lot":"'), "lot", F.lit('","kpis":["'), F.rpad("plain", 190, "x"))
    rows = J.repair_json(_docs(spark, sf).withColumn("raw", raw))
    whole = F.when(F.try_parse_json("repaired").isNotNull(), F.col("repaired"))
    return rows.select("document_id", whole.alias("repaired"))


@query(f"""WITH {DOCS} SELECT document_id, lot || ' ' || w[1] AS description, array_to_string(list_slice(w, 1, 6), ',') AS details FROM j""")
def sections_flattened(spark: SparkSession, sf: str) -> DataFrame:
    """Two nested sections become one."""
    words = F.slice(F.split("plain", " "), 1, 6)
    nested = F.struct(F.array(F.struct(F.col("lot").alias("description"), words.alias("details"))).alias("a"), F.struct(F.get(F.split("plain", " "), 0).alias("description")).alias("b"))
    rows = J.normalize_section(_docs(spark, sf).withColumn("raw", F.to_json(nested)))
    v = F.try_parse_json("section")
    return rows.select("document_id", F.try_variant_get(v, "$.description", "string").alias("description"), F.array_join(F.try_variant_get(v, "$.details", "array<string>"), ",").alias("details"))


@query(f"""WITH {DOCS} SELECT document_id, plain AS description, array_to_string(list_slice(w, 1, 5), ',') AS kpis, lot AS details FROM j""")
def sections_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """What says nothing goes from KPIs and details; a remark in brackets too."""
    kpis = F.concat(F.array(F.lit("N/A"), F.lit("non précisé")), F.slice(F.split("plain", " "), 1, 8))
    details = F.array(F.lit("Non spécifié"), F.concat("lot", F.lit(" (non précisé)")), F.lit("non détaillé"), F.lit("Localisation : hall"))
    rows = _docs(spark, sf).withColumn("section", F.to_json(F.struct(F.col("plain").alias("description"), kpis.alias("kpis"), details.alias("details"))))
    return J.clean_section(rows).select("document_id", "description", F.array_join("kpis", ",").alias("kpis"), F.array_join("details", ",").alias("details"))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    i, none = F.col("i"), F.array().cast("array<string>")
    return _docs(spark, sf).select(
        "project_id", i.alias("ord"), F.when(i % 2 == 0, "constructif").otherwise("contrainte").alias("category"), F.col("lot").alias("label"), F.left("plain", F.lit(20)).alias("description"),
        F.when(i % 3 == 0, none).otherwise(F.array("lot")).alias("kpis"), F.when(i % 6 < 4, none).otherwise(F.array(F.lit("d"), F.col("lot"))).alias("details"), ((F.col("project_id") != "src2") & (i % 11 != 0)).alias("ok"),
    )


@query(f"""WITH {DOCS}, s AS (SELECT *, project_id <> 'src2' AND i % 11 <> 0 AS ok FROM j)
 SELECT project_id, count(*) FILTER (ok AND i % 2 = 0) AS building, count(*) FILTER (ok AND i % 2 <> 0 AND (i % 3 <> 0 OR i % 6 >= 4)) AS constraints,
 CASE WHEN count(*) FILTER (ok) = 0 THEN 'error' WHEN count(*) FILTER (ok) < count(*) THEN 'partial' ELSE 'done' END AS status FROM s GROUP BY project_id""")
def summaries_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Y7, A18."""
    rows = J.assemble_summary(_sections(spark, sf))
    return rows.select("project_id", F.size("building").cast("long").alias("building"), F.size("constraints").cast("long").alias("constraints"), "status")


@query(f"""WITH {DOCS}, l AS (SELECT project_id, i, lot || ' | ' || left(plain, 20) || ' | ' || CASE WHEN i % 3 = 0 THEN '' ELSE lot END || ' | ' || CASE WHEN i % 6 < 4 THEN '' ELSE 'd; ' || lot END AS line FROM j)
 SELECT project_id, left(string_agg(line, chr(10) ORDER BY i), 1500) AS summary FROM l GROUP BY project_id""")
def section_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Y13."""
    return J.section_summaries(_sections(spark, sf))


@query(f"""WITH {DOCS} SELECT document_id, CASE WHEN i % 2 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN i % 2 = 0 THEN '3 m² + 4 m²' ELSE '3 m²' END AS amount,
 CASE WHEN i % 2 = 0 THEN 'RDC, R+1' ELSE 'RDC' END AS place, CASE WHEN i % 2 = 0 THEN 'long ' || lot ELSE lot END AS about FROM j WHERE i % 7 <> 0""")
def tables_merged(spark: SparkSession, sf: str) -> DataFrame:
    """A row without an amount goes, equal elements merge in even documents, sparse tables go."""
    i = F.col("i")
    row = lambda element, about, amount, place: F.create_map(F.lit("element"), element, F.lit("description"), about, F.lit("quantite"), amount, F.lit("localisation"), place)
    wall = F.when(i % 2 == 0, "mûr").otherwise("Toit")
    full = F.array(row(F.lit("Mur"), F.col("lot"), F.lit("3 m²"), F.lit("RDC")), row(wall, F.concat(F.lit("long "), "lot"), F.lit("4 m²"), F.lit("R+1")), row(F.lit("Porte"), F.lit("x"), F.lit("non précisé"), F.lit("")), row(F.lit("Dalle"), F.lit("—"), F.lit("2 U"), F.lit("")))
    sparse = F.array(row(F.lit("Mur"), F.lit(""), F.lit("1"), F.lit("")))
    rows = _docs(spark, sf).select("document_id", F.array(*map(F.lit, ("Élément", "Description", "Quantité", "Localisation"))).alias("columns"), F.when(i % 7 == 0, sparse).otherwise(full).alias("rows"))
    first = F.get("rows", 0)
    return J.table_rows(rows).select("document_id", F.size("rows").cast("int").alias("n"), first["quantite"].alias("amount"), first["localisation"].alias("place"), first["description"].alias("about"))


@query(f"""WITH {DOCS} SELECT document_id, CASE WHEN i % 3 <> 0 THEN 'mur=' || plain || ';' ELSE '' END || CASE i % 2 WHEN 0 THEN '1' ELSE '' END AS kept FROM j""")
def params_stripped(spark: SparkSession, sf: str) -> DataFrame:
    """A value that says nothing goes, and layers without a thickness."""
    i = F.col("i")
    layers = F.when(i % 2 == 0, '[{"nom":"a","epaisseur":"5 cm"},{"nom":"b","epaisseur":"N/A"}]').otherwise('[{"nom":"b","epaisseur":"non précisé"}]')
    params = F.create_map(F.lit("mur"), F.when(i % 3 == 0, "Non précisée ").otherwise(F.col("plain")), F.lit("couches"), layers)
    rows = _docs(spark, sf).where("true").select("document_id", J.strip_non_precise(params).alias("p"))
    mur = F.coalesce(F.concat(F.lit("mur="), F.try_element_at("p", F.lit("mur")), F.lit(";")), F.lit(""))
    n = F.size(F.from_json(F.try_element_at("p", F.lit("couches")), "array<map<string,string>>"))
    return rows.select("document_id", F.concat(mur, F.when(n > 0, n.cast("string")).otherwise("")).alias("kept"))


@query(f"""WITH {DOCS} SELECT document_id, CASE i % 3 WHEN 0 THEN 'partial' ELSE 'done' END AS status, CASE WHEN i % 2 = 0 THEN '' ELSE plain END AS description, CASE WHEN i % 4 = 0 THEN 0 ELSE 1 END AS building, 0 AS constraints FROM j""")
def summaries_read(spark: SparkSession, sf: str) -> DataFrame:
    """Null lists are empty, an unknown status is done."""
    i = F.col("i")
    part = F.array(F.struct(F.col("lot").alias("label")))
    value = F.struct(F.when(i % 3 == 0, "partial").when(i % 3 == 1, "odd").alias("status"), F.when(i % 2 != 0, F.col("plain")).alias("description"), F.when(i % 4 != 0, part).alias("systeme_constructif"))
    rows = J.to_project_summary(_docs(spark, sf).withColumn("raw", F.to_json(value)))
    return rows.select("document_id", "status", "description", F.size("building").alias("building"), F.size("constraints").alias("constraints"))
