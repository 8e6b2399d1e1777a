"""Retrieval over a table of questions.

points(point_id, tenant_id, project_id, ..., dense), questions(query_id, variant, tenant_id, project_id,
text, vector). Every operator that matches questions to points joins on tenant and project, so that no
question sees another project's points; filters stand below the ranking windows. Ids may be numbers or
strings. Scores are rounded to six places and ties end with point_id, so orders are total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import CONTENT_PRIORITY, DIAGNOSTIC_TERMS, VERSIONED_TYPES
from ..sources.shared import written
from . import dense, scan, sparse
from .stats import scored

SCOPE = sparse.SCOPE


def top(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), order: list[Column] | None = None) -> DataFrame:
    """The k best of each group, with their rank from 1; Spark cuts each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*(order or [F.desc("score"), F.col("point_id")]))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_points(hits: DataFrame, points: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Hits with the other columns of their points; vectors are not read again."""
    return points.drop("dense").join(hits, [*scope, "point_id"])


def dense_scores(questions: DataFrame, points: DataFrame, threshold: float, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Cosine of each question variant and point of its scope, at ``threshold`` or more."""
    return with_points(dense.hits(questions, points, threshold, scope), points, scope)


def dense_topk(questions: DataFrame, points: DataFrame, k: int, threshold: float, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """The k best of each question variant; only these are joined with their points' columns."""
    best = top(dense.hits(questions, points, threshold, scope, k), k, ("query_id", "variant"))
    return with_points(best, points, scope)


def filtered(points: DataFrame, lot: str | None = None, phase: str | None = None, kind: str | None = None) -> DataFrame:
    """Points of one lot, phase and document type, where these are given; applied before any ranking."""
    for name, value in (("lot", lot), ("phase", phase), ("type", kind)):
        points = points if value is None else points.where(F.col(name) == value)
    return points


def sparse_topk(questions: DataFrame, index: sparse.Index | DataFrame, k: int, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """The k best points of the question's scope by BM25; blocks that can't reach them are not added up.

    In place of an index, the points(scope..., point_id, text): one pass answers all questions, see ``scan``.
    """
    if isinstance(index, DataFrame):
        found = scan.best(scan.scan(questions, index, scope), k, scope)
        return top(found.select("query_id", "point_id", "score"), k)
    lists = sparse.asked_lists(questions, index, scope)
    return top(sparse.scores(sparse.needed_blocks(lists, k)), k).drop("common")


def rrf_fuse(branches: list[DataFrame], limit: int) -> DataFrame:
    """branches(query_id, point_id, rank from 1) cut to limit; the sum of 1 / (1 + rank)."""
    both = reduce(DataFrame.unionByName, [b.where(F.col("rank") <= limit).select("query_id", "point_id", "rank") for b in branches])
    fused = both.groupBy("query_id", "point_id").agg(F.round(F.sum(1 / (1.0 + F.col("rank"))), 6).alias("score"))
    return top(fused, limit)


def latest_version(hits: DataFrame, by: tuple[str, ...] = ("query_id",), case_sensitive: bool = True) -> DataFrame:
    """Of each versioned type, the newest dated document, if two or more are dated.

    Undated hits of such a type go with the older ones. Ties of date go to the best ranked document.
    """
    kind = F.col("type") if case_sensitive else F.lower("type")
    versioned = kind.isin(VERSIONED_TYPES) & F.col("ingested_at").isNotNull()
    newest = hits.where(versioned).groupBy(*by, "type", "document_id").agg(F.max("ingested_at").alias("at"), F.max("score").alias("best"))
    w = Window.partitionBy(*by, "type")
    order = w.orderBy(F.desc("at"), F.desc("best"), F.asc("document_id"))
    chosen = newest.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(order)})
    chosen = chosen.where("n > 1 and place = 1").select(*by, "type", F.col("document_id").alias("__newest"))
    joined = hits.join(chosen, [*by, "type"], "left")
    return joined.where(F.col("__newest").isNull() | (F.col("document_id") == F.col("__newest"))).drop("__newest")


def penalised(hits: DataFrame, questions: DataFrame, admin: bool = True) -> DataFrame:
    """Diagnostic types count 0.85 unless the question has one of their terms, admin chunks 0.8."""
    asked = questions.groupBy("query_id").agg(F.min_by("text", "variant").alias("__text"))
    low, factor = F.lower("__text"), F.lit(1.0)
    for kind, terms in DIAGNOSTIC_TERMS.items():
        named = reduce(lambda a, b: a | b, (low.contains(t) for t in terms))
        factor = factor * F.when((F.col("type") == kind) & ~named, 0.85).otherwise(1.0)
    if admin:
        factor = factor * F.when(F.col("content_type") == "admin", 0.8).otherwise(1.0)
    return hits.join(asked, "query_id").withColumn("score", F.round(F.col("score") * factor, 6)).drop("__text")


def ranked_hits(questions: DataFrame, points: DataFrame, first: tuple[float, int], second: tuple[float, int] | None = None, index: sparse.Index | DataFrame | None = None) -> DataFrame:
    """The hits of each question variant at the first (threshold, limit), with their points' columns and ranks.

    Questions that have none at all, in any variant, get those at the second. With an index, hits are those of
    the vectors and those of BM25, fused (R5): the threshold admits vectors' hits only, the limit holds for
    both branches and for what they give together, and a score is 1 at best. Those of each branch and the fused
    ones are written down, as they are read more than once and take all points to find; they are limit a question.
    """
    second = second or first
    (high, many), (low, few) = first, second
    most = max(many, few)
    by = ("query_id", "variant")
    near = top(dense.hits(questions, points, min(high, low), SCOPE, most), most, by)
    if index is None:
        over = Window.partitionBy("query_id")
        near = near.withColumn("__found", F.max((F.col("score") >= high).cast("int")).over(over) == 1)
    else:
        near = written(near, "near-hits")
        both = questions.withColumn("query_id", F.struct("query_id", "variant"))
        words = sparse_topk(both, index, most).select("query_id.query_id", "query_id.variant", "point_id", "score", "rank")
        words = written(words, "word-hits")
        scoped = words.join(questions.select("query_id", "variant", *SCOPE), list(by))
        some = near.where(F.col("score") >= high).select("query_id").unionByName(words.select("query_id")).distinct()
        near = near.join(some.withColumn("__found", F.lit(True)), "query_id", "left").na.fill(False, ["__found"])
        scoped = scoped.select(*near.drop("__found").columns).withColumn("__found", F.lit(True))
    limit = F.when(F.col("__found"), many).otherwise(few)
    kept = near.where((F.col("score") >= F.when(F.col("__found"), high).otherwise(low)) & (F.col("rank") <= limit))
    if index is not None:
        fused = kept.unionByName(scoped.where(F.col("rank") <= limit)).groupBy(*SCOPE, *by, "point_id", "__found")
        kept = top(fused.agg(F.round(F.sum(1 / (1.0 + F.col("rank"))), 6).alias("score")), most, by).where(F.col("rank") <= limit)
        kept = written(kept, "fused-hits")
    return with_points(kept.drop("__found"), points)


def search_documents(questions: DataFrame, points: DataFrame, limit: int = 10, high: float = 0.55, low: float = 0.35, index: sparse.Index | DataFrame | None = None) -> DataFrame:
    """Up to 3 x limit hits a question, newest versions, penalties; ranked, not cut to limit."""
    hits = ranked_hits(questions.where("variant = 0"), points, (high, 3 * limit), (low, max(3 * limit, 20)), index)
    scored = penalised(latest_version(hits), questions)
    return top(scored, 3 * max(limit, 7))


def search_diverse(questions: DataFrame, points: DataFrame, limit: int = 10, pool: int = 100, threshold: float = 0.35, per_document: int = 2) -> DataFrame:
    """At most two hits a document (W2) out of a pool, newest versions, penalties, limit."""
    hits = latest_version(dense_topk(questions.where("variant = 0"), points, pool, threshold))
    few = top(hits, per_document, ("query_id", "document_id"))
    return top(penalised(few, questions), limit)


def _priority(kind: Column) -> Column:
    listed = F.array_position(F.array(*map(F.lit, CONTENT_PRIORITY)), F.coalesce(kind, F.lit("mixed")))
    return F.when(listed > 0, listed - 1).otherwise(2)


def search_by_lot(questions: DataFrame, points: DataFrame, pool: int = 250, threshold: float = 0.3, cover: int = 5, relevant: int = 8, index: sparse.Index | DataFrame | None = None) -> DataFrame:
    """Of each lot the first five chunks by content and position, then the eight most relevant others."""
    lot = F.coalesce(F.nullif("lot", F.lit("")), F.lit("unknown"))
    asked = questions.select("query_id", *SCOPE).distinct()
    rows = points.drop("dense").withColumns({"lot": lot, "priority": _priority(F.col("content_type")), "score": F.lit(0.5)})
    # The first chunks of a lot are the same for all questions of a scope: ranked once, then joined.
    covered = latest_version(rows, SCOPE).where("priority < 3")
    ranked = top(covered, cover, (*SCOPE, "lot"), [F.col("priority"), F.col("position"), F.col("point_id")])
    first = ranked.join(asked, list(SCOPE))
    hits = latest_version(ranked_hits(questions, points, (threshold, pool), index=index), ("query_id", "variant"))
    best = top(hits, 1, ("query_id", "point_id"), [F.desc("score"), F.col("variant")]).withColumns({"lot": lot, "priority": _priority(F.col("content_type"))})
    others = penalised(best, questions, admin=False).join(first.select("query_id", "point_id"), ["query_id", "point_id"], "left_anti")
    second = top(others, relevant, ("query_id", "lot"), [F.col("priority"), F.desc("score"), F.col("point_id")])
    columns = ["query_id", "lot", "point_id", "score", "rank"]
    return first.select(*columns, F.lit("coverage").alias("part")).unionByName(second.select(*columns, F.lit("relevance").alias("part")))


def search_merged(questions: DataFrame, points: DataFrame, limit: int = 10, threshold: float = 0.4, low: float = 0.35, index: sparse.Index | DataFrame | None = None) -> DataFrame:
    """Variants merged: best score a point (W6), each variant's best hit first (W5), limit, penalties."""
    hits = ranked_hits(questions, points, (threshold, 3 * limit), (low, max(3 * limit, 20)), index)
    hits = latest_version(hits, ("query_id", "variant"))
    lead = top(hits, 1, ("query_id", "variant")).select("query_id", "point_id").distinct().withColumn("reserved", F.lit(1))
    best = top(hits, 1, ("query_id", "point_id"), [F.desc("score"), F.col("variant")])
    flagged = best.join(lead, ["query_id", "point_id"], "left").na.fill(0, ["reserved"])
    kept = top(flagged, limit, order=[F.desc("reserved"), F.desc("score"), F.col("point_id")])
    return top(penalised(kept, questions), limit)


def find_similar(chosen: DataFrame, points: DataFrame, k: int = 5, threshold: float = 0.25) -> DataFrame:
    """The k nearest other points of each chosen(point_id) in its scope."""
    asked = points.join(chosen.select("point_id"), "point_id", "left_semi").select(F.col("point_id").alias("query_id"), F.lit(0).alias("variant"), *SCOPE, F.col("dense").alias("vector"))
    return top(dense_topk(asked, points, k + 1, threshold).where("point_id != query_id"), k)


def duplicate_pairs(points: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs of one document with a cosine of threshold or more."""
    return dense.near_pairs(points, threshold, ["document_id"])


def query_limits(questions: DataFrame, limit: int) -> DataFrame:
    """How many passages the main and the forced queries of a question may bring together.

    questions(query_id, forced boolean), a row a query. Each query adds a quarter of limit, one at least;
    together they never have less than limit.
    """
    each = max(1, limit // 4)
    many = lambda forced: F.greatest(F.lit(limit), F.count_if(F.col("forced") == forced) * each).cast("long")
    return questions.groupBy("query_id").agg(many(False).alias("main_limit"), many(True).alias("forced_limit"))


def semantic_search(questions: DataFrame, points: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.25) -> DataFrame:
    """The best points of each question with their chunk rows and quality scores, in order of rank.

    Hits without a chunk row are left out; ranks stay those of the hits.
    """
    hits = dense_topk(questions, points, k, threshold).select("query_id", "variant", "point_id", "score", "rank")
    return hits.join(scored(chunks.where("point_id is not null")), "point_id")


def expected_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """M8: the best rank of an expected point of each question, from 0; null where none is found."""
    found = expected.join(hits, ["query_id", "point_id"]).groupBy("query_id").agg((F.min("rank") - 1).alias("rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left")


def section_search(sections: DataFrame, points: DataFrame, budget: int = 20000, threshold: float = 0.35, sizes: tuple[int, int] = (100, 500)) -> DataFrame:
    """sections(query_id, tenant_id, project_id, variant, vector): each query's best, 10, 15 or 20 by the size of
    its scope, once a point, kept by score while the running length fits (W9)."""
    n = points.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    each = F.when(F.col("n") < sizes[0], 10).when(F.col("n") < sizes[1], 15).otherwise(20)
    hits = dense_topk(sections, points, 20, threshold).join(n, list(SCOPE)).where(F.col("rank") <= each)
    once = top(hits, 1, ("query_id", "point_id"), [F.desc("score"), F.col("variant")])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    used = F.sum(F.col("char_count") + 7).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 7
    return once.withColumn("used", used).where(F.col("used") <= budget)
