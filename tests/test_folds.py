"""Ordered work on single texts and questions: pages of chunks, overlaps, exact budgets, text for display."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill.functions import display
from passagemill.operators import chunking, context, pages, stats


def test_pages_of_snippets_match_looking_at_each(monkeypatch):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    for many in (4000, 3):
        monkeypatch.setattr(pages, "MANY", many)
        for _ in range(60):
            texts = [text(rng.randint(0, 40)) for _ in range(rng.randint(1, 6))]
            snippets = [rng.choice(texts)[rng.randint(0, 5) :][: rng.randint(0, 9)] for _ in range(12)] + ["", "absent", text(3)]
            expected = {s: next(k for k, t in enumerate(texts) if s in t) for s in snippets if any(s in t for t in texts)}
            assert pages.first_places(snippets, texts) == expected


def test_the_first_page_of_each_chunk(spark):
    own = spark.createDataFrame([(1, 5, 9, "x" * 150 + "end"), (1, 2, 7, "start " + "y" * 200), (1, 3, 8, None), (2, 0, 1, "z")], "doc_id long, ord int, page int, text string")
    rows = [(1, 0, "x" * 120 + "other"), (1, 1, "y" * 30), (1, 2, "nowhere"), (1, 3, ""), (1, 4, "end"), (2, 0, "z"), (3, 0, "no pages"), (1, 5, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_seq int, text string").withColumn("page", F.lit(-1))
    got = {(r.doc_id, r.chunk_seq): r.page for r in chunking.find_page(chunks, own).collect()}
    assert got == {(1, 0): 9, (1, 1): 7, (1, 2): 7, (1, 3): 7, (1, 4): 9, (1, 5): 7, (2, 0): 1}
    whole = chunking.find_page(chunks, own)
    assert sorted(whole.columns) == sorted(chunks.columns)


def test_no_chunk_meets_all_pages(spark):
    """One row a document: what is joined are lists, by document alone."""
    own = spark.createDataFrame([(1, 0, 1, "a")], "doc_id long, ord int, page int, text string")
    plan = chunking.find_page(spark.createDataFrame([(1, 0, "a")], "doc_id long, chunk_seq int, text string"), own)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("collect_list")


def test_overlaps_match_trying_all_lengths(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [text(rng.randint(0, 60)) for _ in range(200)]
    for k in range(1, 200, 3):
        texts[k] = texts[k - 1][-rng.randint(1, 30) :] + texts[k][:20]
    texts[100:103] = ["ab" * 300, "ab" * 300, None]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "document_id long, position int, text string")
    for least, most in ((1, 400), (5, 40)):
        expected = {}
        for k in range(1, len(texts)):
            a, b = texts[k - 1], texts[k] or ""
            if a is not None:
                expected[k] = max([n for n in range(least, min(len(a), len(b), most) + 1) if a[-n:] == b[:n]], default=0)
        assert {r.position: r.overlap for r in stats.chunk_overlap(rows, least, most).collect()} == expected


def plain_selection(passages, budget):
    """Rendering anew for each passage."""
    lots = {p["lot"] or "unknown" for p in passages}

    def rendered(kept):
        kept = sorted(kept, key=lambda p: (p["lot"] or "unknown", p["filename"], p["position"], p["seq"]))

        def block(entries):
            out, before = [], None
            for head, body, lot in entries:
                out.append((f"\n=== {lot} ===\n{context.JOINT}" if len(lots) > 1 and lot != before else "") + f"{head}\n{body}")
                before = lot
            return len(context.JOINT.join(out))

        name = lambda p: f"{p['filename']}, p.{p['page']}"
        groups = {}
        for p in kept:
            groups.setdefault(p["text"].lower(), []).append(p)
        merged = []
        for own in groups.values():
            best = max(own, key=lambda p: (p["score"], -kept.index(p)))
            places = list(dict.fromkeys([name(best), *map(name, own)]))
            head = f"[{places[0]}]" if len(places) == 1 else f"[{places[0]} ; aussi : {' ; '.join(places[1:])}]"
            merged.append((kept.index(best), (head, best["text"], best["lot"] or "unknown")))
        plain = [(f"[{name(p)}]", p["text"], p["lot"] or "unknown") for p in kept]
        return max(block(plain), block([e for _, e in sorted(merged)]))

    kept = []
    for p in sorted(passages, key=lambda p: (-p["score"], p["seq"])):
        if rendered([*kept, p]) > budget:
            break
        kept.append(p)
    return {p["seq"] for p in kept}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = []
    for q in range(25):
        for seq in range(rng.randint(1, 14)):
            text = rng.choice(["mur", "Mur", "dalle " * rng.randint(1, 9), "toit", "x" * rng.randint(1, 80)]).strip()
            rows.append((q, seq, text, rng.choice([0.9, 0.5, 0.5, 0.1]), rng.choice(["f", "a longer name"]), rng.randint(1, 3), rng.choice(["L1", "L2", "", None] if q % 2 else ["L1"]), rng.randint(0, 3)))
    names = ["query_id", "seq", "text", "score", "filename", "page", "lot", "position"]
    df = spark.createDataFrame(rows, "query_id long, seq long, text string, score double, filename string, page int, lot string, position int")
    for budget in (40, 150, 400):
        found = {}
        for r in context.select_by_score(df, budget).collect():
            found.setdefault(r.query_id, set()).add(r.seq)
        for q in range(25):
            own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == q]
            assert found.get(q, set()) == plain_selection(own, budget), (q, budget)


def test_contexts_of_fused_hits(spark):
    rows = [(1, 0, "mur", 0.5, "f", 1, "x", 0), (1, 1, "1.1.1 Mur", 0.33, "g", 2, "x", 5), (1, 2, "toit", 0.2, "f", 3, "x", 9), (1, 3, "d" * 500, 0.1, "f", 4, "x", 1)]
    df = spark.createDataFrame(rows, "query_id long, seq long, text string, score double, filename string, page int, lot string, position int").withColumn("type", F.lit("CR"))
    block, sources = context.build_context(df, budget=120, hybrid=True)
    assert block.first().block == "[f, p.1 ; aussi : g, p.2]\nmur\n---\n[f, p.3]\ntoit"
    assert {(r.filename, r.page) for r in sources.collect()} == {("f", 1), ("g", 2), ("f", 3)}
    assert context.build_context(df, budget=120)[0].first().block == "[f, p.1]\nmur"


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("2f4,60\n=\n9,200", "2f4,60 = 9,200"),
        ("2f4,60\n =  \n 9,200 ..... 3", "2f4,60 = 9,200"),
        ("Total\n\n=\n12,5", "Total\n\n= 12,5"),
        ("a\nb\n=\n5\n=\n6", "a\nb = 5  →  6"),
        ("=\n5\n=\n6", "= 5  →  6"),
        ("=\n=\n7", "= = 7"),
        ("Page 3 / 9\nMur\nPAGE 12\nPage de garde", "Mur\nPage de garde"),
        ("x\nPage 1\n=\n4", "x  →  4"),
        ("Mur ........ 12\n a    b \n..", "Mur 12\na  b\n.."),
        ("\n\n\na\n\n \n\nb\n\n", "a\n\nb"),
        ("a\n=\nb", "a\n=\nb"),
        ("=", "="),
        ("", ""),
    ],
)
def test_text_for_display(raw, shown):
    assert display.display_text(raw) == shown


def test_a_column_for_display(spark):
    df = spark.createDataFrame([(1, "1\n=\n2"), (2, None), (3, "")], "k int, text string")
    assert [r.shown for r in df.select("k", display.displayed(F.col("text")).alias("shown")).orderBy("k").collect()] == ["1 = 2", None, ""]
