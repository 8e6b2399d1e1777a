"""Question rules, routing and small listings."""

from pyspark.sql import functions as F

from passagemill.operators import listing


def test_rules_and_related(spark):
    rows = spark.createDataFrame([(1, "Quels sont les lots ?"), (2, "épaisseur du mur de façade"), (3, "mur enterré"), (4, "couleur")], "query_id long, text string")
    got = {r.query_id: r.scope for r in listing.question_rules(rows).collect()}
    assert got == {1: "broad", 2: "specific", 3: "specific", 4: "specific"}
    related = listing.forced_related(rows).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in related} == {2: 4, 3: 4}


def test_routing_keeps_tenants(spark):
    points = spark.createDataFrame([(k, "ab"[k % 2], "p", k, k, "L", "CR", "mixed", None, "mur", [1.0, k / 10]) for k in range(8)], "point_id long, tenant_id string, project_id string, document_id long, position long, lot string, type string, content_type string, ingested_at long, text string, dense array<double>")
    asked = spark.createDataFrame([(1, 0, "a", "p", "Quels sont les murs", [1.0, 0.0]), (2, 0, "b", "p", "mur", [1.0, 0.0])], "query_id long, variant int, tenant_id string, project_id string, text string, vector array<double>")
    hits = listing.run_search(asked, asked.where("query_id = 2"), points).collect()
    assert {h.query_id for h in hits} == {1, 2} and all(h.point_id % 2 == h.query_id - 1 for h in hits)
    assert not any(r.suspect for r in listing.search_passages(asked, points).collect())


def test_arguments_and_classes(spark):
    good = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    calls = spark.createDataFrame([("q", None, None, None, good), (" ", None, None, None, good), ("q" * 501, None, None, None, good), ("q", "l" * 101, None, None, good), ("q", None, None, None, "x")], "query string, lot string, phase string, type string, project_id string")
    assert [r.reject_reason is None for r in listing.tool_arguments(calls).collect()] == [True, False, False, False, False]
    text = "[DPGF.pdf, p.1]\nMur\n---\n[cctp, p.2]\ntexte\n---\n[DPGF.pdf, p.3]\n25 m² de mur"
    got = spark.createDataFrame([(text,)], "t string").select(listing.reorder_for_table(F.col("t")).alias("t")).first().t
    assert [p.split("\n")[0] for p in got.split("\n---\n")] == ["[DPGF.pdf, p.3]", "[DPGF.pdf, p.1]", "[cctp, p.2]"]


def test_lots_of_headings_and_file_names(spark):
    rows = spark.createDataFrame([("p", "03-Gros_oeuvre-CCTP.pdf", "LOT 3 - Maçonnerie\ntexte"), ("p", "07-Peinture-DPGF.pdf", "texte")], "project_id string, filename string, text string")
    got = {r.number: (r.title, r.files) for r in listing.lot_files(rows).collect()}
    assert got == {"03": ("Maçonnerie", ["03-Gros_oeuvre-CCTP.pdf"]), "07": ("Peinture", ["07-Peinture-DPGF.pdf"])}
