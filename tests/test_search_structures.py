"""Blocked dense scoring, the inverted index, hybrid hits, duplicates of projects, texts within texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import contained, dense, retrieval, scan, sparse
from passagemill.plans import retrieval_queries

POINT = "point_id long, tenant_id string, project_id string, text string, dense array<double>"
ASKED = "query_id long, variant int, tenant_id string, project_id string, text string, vector array<double>"
SCOPE = ("tenant_id", "project_id")


def unit(v):
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else 0.0 for x in v]


def cosine(a, b):
    return round(sum(x * y for x, y in zip(unit(a), unit(b), strict=True)), 6)


def vectors(n, dims=4, seed=1, hot="t0"):
    """Points of which a half lie in one scope, with ties, zeros, nulls and a vector of another length."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        tenant = hot if k % 2 else rng.choice(["t1", "t2"])
        v = [float(rng.randint(-3, 3)) for _ in range(dims)]
        rows.append((k, tenant, "p", f"w{k % 7} common w{rng.randint(0, 40)}", v))
    return rows + [(n, hot, "p", None, None), (n + 1, hot, "p", "", []), (n + 2, hot, "p", "x", [1.0]), (n + 3, hot, "p", "x", [0.0] * dims), (n + 4, None, "p", "common", [1.0] * dims)]


def plain_hits(asked, points, threshold, k):
    out = {}
    for q, variant, tenant, project, _, v in asked:
        found = [(-cosine(v, p[4]), p[0]) for p in points if p[1] == tenant and p[2] == project and p[4] and len(p[4]) == len(v)]
        out[q, variant] = [(p, -s) for s, p in sorted(found) if -s >= threshold][:k]
    return {key: hits for key, hits in out.items() if hits}


def questions(seed=2, dims=4, n=5):
    rng = random.Random(seed)
    return [(q, variant, ["t0", "t1", "t9"][q % 3], "p", f"w{q} common none", [float(rng.randint(-3, 3)) for _ in range(dims)]) for q in range(n) for variant in (0, 1)]


@pytest.mark.parametrize(("block", "least"), [(1024, 50_000), (3, 10)])
def test_blocks_give_the_hits_of_all_pairs(spark, monkeypatch, block, least):
    """Also where blocks are small and the hot scope is dealt into parts."""
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "HOT_LEAST", least)
    monkeypatch.setattr(dense, "HOT_SHARE", 4)
    rows, asked = vectors(120), questions()
    own = spark.createDataFrame(rows, POINT).repartition(3)
    found = defaultdict(list)
    for r in retrieval.dense_topk(spark.createDataFrame(asked, ASKED), own, 7, 0.1).orderBy("query_id", "variant", "rank").collect():
        assert r.tenant_id and r.text is not None
        found[r.query_id, r.variant].append((r.point_id, r.score))
    assert dict(found) == plain_hits(asked, rows, 0.1, 7)
    everything = retrieval.dense_scores(spark.createDataFrame(asked, ASKED), own, -1.0)
    assert everything.count() == sum(map(len, plain_hits(asked, rows, -1.0, 10**6).values()))


def test_a_hot_scope_is_spread(spark, monkeypatch):
    monkeypatch.setattr(dense, "HOT_LEAST", 10)
    monkeypatch.setattr(dense, "HOT_SHARE", 8)
    own = spark.createDataFrame([r for r in vectors(200)], POINT)
    parts = {r.tenant_id: r["__parts"] for r in dense._parts(own, list(SCOPE)).collect()}
    assert parts["t0"] >= 4 and sum(parts.values()) <= 2 * 8


def test_pairs_of_a_scope_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 5)
    rows = vectors(60)
    found = sorted((r.a, r.b, r.score) for r in dense.near_pairs(spark.createDataFrame(rows, POINT).repartition(2), 0.8, list(SCOPE)).collect())
    alike = [(a[0], b[0], cosine(a[4], b[4])) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1:3] == b[1:3] and a[4] and b[4] and len(a[4]) == len(b[4])]
    assert found == sorted(p for p in alike if p[2] >= 0.8)


def test_duplicates_of_a_project_recall(spark):
    """Measured against all pairs at 0.92, in small buckets and, with a small limit, block against block."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    rows = []
    for k, v in enumerate(base):
        rows.append((k, "t", "p", f"text {k}", v.tolist()))
        turned = rng.standard_normal(16)
        turned -= turned @ v / (v @ v) * v
        cos = rng.uniform(0.9, 1.0)
        near = cos * v / np.linalg.norm(v) + math.sqrt(1 - cos * cos) * turned / np.linalg.norm(turned)
        rows.append((1000 + k, "t", "p", None, near.tolist()))
    rows += [(2000 + k, "t", "p", "copy", base[0].tolist()) for k in range(30)] + [(3000, "u", "p", "other", base[0].tolist())]
    own = spark.createDataFrame(rows, POINT).repartition(3)
    distinct = [r for r in rows if r[0] < 2000]
    wanted = {(a[0], b[0]) for a in distinct for b in distinct if a[0] < b[0] and cosine(a[4], b[4]) >= 0.92}
    for small in (64, 1):
        found = {(r.a, r.b): r.score for r in dense.project_duplicates(own, small=small).collect()}
        assert {p for p in found if p[1] >= 2000} == {(0, 2000 + k) for k in range(30)}
        got = {p for p in found if p[1] < 2000}
        assert got <= wanted and len(got) >= 0.95 * len(wanted) and len(wanted) > 80
    shown = dense.with_previews(dense.project_duplicates(own), own.withColumns({"page": F.lit(1), "position": F.col("point_id")}), SCOPE)
    row = shown.where("a = 0 and b = 2000").first()
    assert (row.a_preview, row.b_preview, row.b_position, row.score) == ("text 0", "copy", 2000, 1.0)


def test_whole_duplicates_are_those_of_all_pairs_in_a_grid_of_cells(spark, monkeypatch):
    """Copies meet each other and the near points of each other, also where a scope is dealt into many cells."""
    monkeypatch.setattr(dense, "BLOCK", 4)
    monkeypatch.setattr(dense, "CELL", 10)
    rng = np.random.default_rng(5)
    base = [(rng.standard_normal(6) + 2).tolist() for _ in range(20)]
    rows = [(100 * k + n, "t", "p", "x", v if n < 3 else [x * (1.0 + 0.05 * (j % 2)) for j, x in enumerate(v)]) for k, v in enumerate(base) for n in range(4)]
    rows += [(5000 + k, "u", "p", "x", v) for k, v in enumerate(base)]
    found = sorted((r.a, r.b) for r in dense.project_duplicates(spark.createDataFrame(rows, POINT).repartition(3), whole=True).collect())
    assert found == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cosine(a[4], b[4]) >= 0.92)
    assert {(0, 1), (1, 2), (1, 3), (2, 3)} <= set(found)


# The inverted index


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(k, "t0" if k % 3 else "t1", "p", " ".join(rng.choices(words, weights, k=rng.randint(0, 40))), None) for k in range(n)]
    return rows + [(n, "t0", "p", None, None), (None, "t0", "p", "w1 w1", None), (n + 1, "t0", "p", "w1", None), (n + 2, "t0", "p", "w1", None)]


def plain_bm25(rows, asked, k):
    rows = [r for r in rows if r[0] is not None]
    texts = {r[0]: Counter((r[3] or "").split()) for r in rows}
    df = Counter(t for c in texts.values() for t in c)
    out = {}
    for q, tenant, text in asked:
        scores = {}
        for p, own, _, _, _ in rows:
            c, length = texts[p], sum(texts[p].values())
            common = [t for t in set(text.split()) if t in c]
            if own == tenant and common:
                weight = lambda t: c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / 256))  # noqa: B023, E731
                scores[p] = round(sum(weight(t) * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in common), 6)
        out[q] = sorted(((-s, p) for p, s in scores.items()))[:k]
    return {q: [p for _, p in hits] for q, hits in out.items() if hits}


@pytest.mark.parametrize("block", [128, 4])
def test_the_index_gives_the_best_of_all_points(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sparse, "BLOCK", block)
    rows = corpus()
    sparse.build_index(spark.createDataFrame(rows, POINT).repartition(4), str(tmp_path))
    index = sparse.load_index(spark, str(tmp_path))
    asked = [(1, "t0", "w0 w3 w40"), (2, "t1", "w55 w2"), (3, "t1", "nothing"), (4, "t0", "w1"), (5, "t9", "w1"), (6, "t0", "w0 w1 w2 w3 w59")]
    items = spark.createDataFrame([(q, t, "p", x) for q, t, x in asked], "query_id long, tenant_id string, project_id string, text string")
    found = defaultdict(list)
    for r in retrieval.sparse_topk(items, index, 6).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.point_id)
    assert dict(found) == plain_bm25(rows, asked, 6)
    blocks = index.blocks.collect()
    assert all(len(b.points) == len(b.weights) == b.n <= block and b.most == max(b.weights) for b in blocks)
    if block == 4:
        lists = sparse.asked_lists(items, index)
        assert 0 < sparse.needed_blocks(lists, 6).count() < lists.count()


def test_an_index_is_read_by_tenant(spark, tmp_path):
    index = sparse.build_index(spark.createDataFrame(corpus(), POINT), str(tmp_path))
    plan = index.blocks.where("tenant_id = 't1'").select("token", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "points" not in plan.split("ReadSchema")[1]


def test_fused_hits_and_the_second_threshold(spark, tmp_path):
    rows = [(1, "t", "p", "mur porteur", [1.0, 0.0]), (2, "t", "p", "dalle", [0.9, 0.1]), (3, "t", "p", "mur", [0.0, 1.0]), (4, "t", "p", "toit", [0.6, 0.8])]
    own = spark.createDataFrame(rows, POINT)
    index = sparse.build_index(own, str(tmp_path))
    asked = spark.createDataFrame([(1, 0, "t", "p", "mur", [1.0, 0.0]), (2, 0, "t", "p", "rien", [-0.6, 0.8]), (3, 0, "t", "p", "rien", [0.5, 0.86])], ASKED)
    hits = defaultdict(dict)
    for r in retrieval.ranked_hits(asked, own, (0.9, 3), (0.25, 3), index).collect():
        hits[r.query_id][r.point_id] = r.score
    # 1: both branches; first in one and second in the other, or in one alone. 3: no branch at 0.9 but vectors.
    assert hits[1] == {1: pytest.approx(0.5 + 1 / 3, abs=1e-5), 2: pytest.approx(1 / 3, abs=1e-5), 3: pytest.approx(0.5)}
    assert hits[2] == {3: 0.5, 4: pytest.approx(1 / 3, abs=1e-5)}
    assert set(hits[3]) == {4} and retrieval.ranked_hits(asked, own, (0.999, 3), (0.25, 3)).where("query_id = 3").count() == 3


# One pass for one batch of questions


@pytest.mark.parametrize("limits", [{}, {"HELD": 50, "CELLS": 30, "MET": 40, "ASKED": 2}, {"FEW": 0, "SENT": 0, "PARTS": 3, "HELD": 200}])
def test_one_pass_gives_the_best_of_all_points(spark, monkeypatch, limits):
    """Also where little is held at a time, and where nothing is broadcast; no index is built."""
    for name, value in limits.items():
        monkeypatch.setattr(scan, name, value)
    monkeypatch.setattr(sparse, "build_index", None)
    rows = [*corpus(), (None, None, "p", "w1", None), (900, None, "p", "w0", None)]
    asked = [(1, "t0", "w0 w3 w40"), (2, "t1", "w55 w2"), (3, "t1", "nothing"), (4, "t0", "w1"), (5, "t9", "w1"), (6, "t0", "w0 w1 w2 w3 w59"), (7, "t0", "")]
    items = spark.createDataFrame([(q, t, "p", x) for q, t, x in asked], "query_id long, tenant_id string, project_id string, text string")
    own = spark.createDataFrame(rows, POINT).repartition(4)
    found, common = defaultdict(list), defaultdict(list)
    for r in retrieval.sparse_topk(items, own, 6).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.point_id)
    assert dict(found) == plain_bm25(rows, asked, 6)
    for r in retrieval.top(scan.best(scan.scan(items, own), 6, plain=True), 6).orderBy("query_id", "rank").collect():
        common[r.query_id].append((-r.score, r.point_id))
    texts = {q: (t, set(x.split())) for q, t, x in asked}
    counts = {q: sorted((-len(words & set((r[3] or "").split())), r[0]) for r in rows if r[0] is not None and r[1] == t) for q, (t, words) in texts.items()}
    assert dict(common) == {q: kept for q, c in counts.items() if (kept := [x for x in c if x[0] < 0][:6])}


def test_one_pass_shuffles_no_postings(spark):
    """A block hands on k points of a question at most, however many share a token with it."""
    rows = [(k, "t", "p", "common word", None) for k in range(5000)]
    items = spark.createDataFrame([(q, "t", "p", "common word") for q in range(20)], "query_id long, tenant_id string, project_id string, text string")
    scanned = scan.scan(items, spark.createDataFrame(rows, POINT).coalesce(1))
    assert scan.best(scanned, 3).count() <= 20 * 3 * scanned.blocks.count() and scanned.blocks.count() <= 2


@pytest.mark.parametrize("held", [1 << 21, 5])
def test_a_task_hands_on_k_hits_of_a_question_over_all_its_blocks(spark, monkeypatch, held):
    """blocks of a few points gave nearly every pair as a row; also where a task holds few hits at a time."""
    monkeypatch.setattr(dense, "BLOCK", 4)
    monkeypatch.setattr(scan, "HELD", 8)
    monkeypatch.setattr(dense, "HELD_HITS", held)
    rows = [(k, "t", "p", f"common word w{k % 9}", [1.0, k % 13 + 1.0]) for k in range(400)]
    asked = [(q, v, "t", "p", f"common w{q}", [1.0, float(q)]) for q in range(6) for v in (0, 1)]
    own, items = spark.createDataFrame(rows, POINT).coalesce(1), spark.createDataFrame(asked, ASKED).coalesce(1)
    near = dense.hits(items, own, 0.1, SCOPE, 3)
    words = scan.best(scan.scan(items.where("variant = 0").drop("variant", "vector"), own), 3)
    tasks = 4  # of a shuffle in these tests
    assert held == 5 or (near.count() <= 12 * 3 * tasks and words.count() <= 6 * 3 * tasks)
    found = defaultdict(list)
    for r in retrieval.top(near, 3, ("query_id", "variant")).orderBy("query_id", "variant", "rank").collect():
        found[r.query_id, r.variant].append((r.point_id, r.score))
    assert dict(found) == plain_hits(asked, rows, 0.1, 3)
    listed = defaultdict(list)
    for r in retrieval.top(words, 3).orderBy("query_id", "rank").collect():
        listed[r.query_id].append(r.point_id)
    assert dict(listed) == plain_bm25(rows, [(q, "t", text) for q, v, _, _, text, _ in asked if not v], 3)


def test_hybrid_hits_are_found_once_and_questions_shuffle_no_texts(spark, tmp_path):
    """what follows the fused hits read all points again, and a question's text was cut behind its join."""
    text = "mur porteur " * 40
    spark.createDataFrame([(k, text, "fr", "src1", len(text)) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, float(k)], 1) for k in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = retrieval_queries.hybrid_questions(spark, str(tmp_path))
    assert sorted(r.text for r in asked.collect()) == sorted(w + text[:120] for w in ("sondage ", "sondage ", "amiante "))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring(") and "% 100) = 0" in plan
    plan = retrieval_queries.hybrid_merged(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


# Texts within texts


def test_texts_within_texts(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé 日") for _ in range(n))
    chunks = [(k, rng.choice("st"), text(rng.randint(0, 90))) for k in range(200)] + [(900, "s", None), (901, "s", ""), (902, "t", "x" * 300_000 + "end")]
    items = [(k, rng.choice("st"), (c[2] or "")[3 : 3 + rng.choice([1, 2, 5, 31, 32, 33, 60])]) for k, c in enumerate(chunks[:80])]
    items += [(300, "s", ""), (301, "s", None), (302, "t", "xxxend"), (303, "t", "x" * 40), (303, "t", "x" * 40), (304, "s", text(40))]
    kinds = "point_id long, tenant_id string, text string"
    expected = sorted({(q, p) for q, own, sought in items for p, tenant, t in chunks if own == tenant and sought is not None and t is not None and sought in t})
    for bits in (20, 6):
        monkeypatch.setattr(contained, "BITS", bits)
        asked = spark.createDataFrame(items, "query_id long, tenant_id string, text string")
        found = contained.containing(asked, spark.createDataFrame(chunks, kinds).repartition(3), ("tenant_id",))
        assert sorted(map(tuple, found.collect())) == expected


def test_token_counts_give_the_idf_of_an_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "p", "mur mur béton"), (2, "u", "p", "Béton acier"), (None, "t", "p", "mur"), (3, "t", "p", None)], "point_id long, tenant_id string, project_id string, text string")
    index = sparse.build_index(rows, str(tmp_path))
    listed = lambda df: sorted((r.token, r.df, r.idf) for r in df.collect())
    got = listed(sparse.token_idf(*sparse.token_counts(rows)))
    assert got == listed(sparse.token_idf(*index)) and [x[:2] for x in got] == [("acier", 1), ("beton", 2), ("mur", 1)]
