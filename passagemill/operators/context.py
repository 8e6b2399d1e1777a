"""Context assembly.

passages(query_id, seq, text, score, filename, page, lot, position): seq is the input order.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

JOINT = "\n---\n"


def without_thermal(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """P5: thermal reports only for questions with a thermal term."""
    asked = questions.groupBy("query_id").agg(F.max(F.col("text").rlike(P.THERMAL_QUESTION)).alias("__thermal"))
    report = F.coalesce(F.col("type").rlike(P.THERMAL_TYPE), F.lit(False)) | F.coalesce(F.col("filename").rlike(P.THERMAL_FILE), F.lit(False))
    return hits.join(asked, "query_id").where(F.col("__thermal") | ~report).drop("__thermal")


def context_cutoff(hits: DataFrame, cutoff: float, hybrid: bool = False) -> DataFrame:
    """Scores below cutoff go, unless of a DPGF; fused scores have no cutoff."""
    return hits if hybrid else hits.where((F.col("score") >= cutoff) | (F.col("type") == "DPGF"))


def first_by(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_results(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first rows, then unseen second ones; one for each query, document, page, position and text."""
    both = first.withColumn("__part", F.lit(0)).unionByName(second.withColumn("__part", F.lit(1)))
    keys = ["query_id", "document_id", "page", "position", F.substring("text", 1, 200)]
    return first_by(both, keys, ["__part", "seq"]).drop("__part")


def add_forced(hits: DataFrame, forced: DataFrame, floor: float = 0.45) -> DataFrame:
    """Forced hits that are no hits yet, with a score of floor at least."""
    more = forced.join(hits.select("query_id", "point_id"), ["query_id", "point_id"], "left_anti")
    return hits.unionByName(more.withColumn("score", F.greatest("score", F.lit(floor))))


def union_calls(calls: DataFrame) -> DataFrame:
    """U8: passages of the first three calls of a question, up to the first invalid call, once each."""
    so_far = Window.partitionBy("query_id").orderBy("call").rangeBetween(Window.unboundedPreceding, 0)
    valid = calls.withColumn("__ok", F.min(F.col("valid").cast("int")).over(so_far)).where("__ok = 1 and call < 3")
    key = F.coalesce(F.col("point_id").cast("string"), F.concat_ws("/", "document_id", "position"))
    return first_by(valid, ["query_id", key], ["call", "seq"]).drop("__ok")


def running_budget(rows: DataFrame, order: list[str | Column], budget: int, gap: int, by: str = "query_id") -> DataFrame:
    """Rows in order while the running length with separators fits; the first that does not ends it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.col("length") + gap).over(w) - gap
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def last_messages(messages: DataFrame, n: int = 7) -> DataFrame:
    """The last n of each conversation, numbered in their own order."""
    w = Window.partitionBy("conversation_id")
    last = messages.withColumn("__n", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("__n") <= n).drop("__n")
    return last.withColumn("place", F.row_number().over(w.orderBy("turn")))


def merge_article_copies(passages: DataFrame, key_of: Callable[[Column], Column] = T.article_dedup_key) -> DataFrame:
    """K1: a row for each paragraph: the best copy (the first of equals) and all copies in input order.

    Texts of one ``key_of`` are copies.
    """
    key = key_of(F.col("text"))
    copy = F.struct("seq", "filename", "page")
    best = F.max_by(F.struct("seq", "text", "score", "filename", "page", "lot", "position"), F.struct("score", -F.col("seq")))
    merged = passages.groupBy("query_id", key.alias("key")).agg(best.alias("kept"), F.array_sort(F.collect_list(copy)).alias("copies"))
    return merged.select("query_id", "kept.*", "copies")


def passage_header(merged: DataFrame) -> DataFrame:
    """K2: one line that names each distinct place, the kept one first."""
    named = lambda name, page: F.concat(name, F.lit(", p."), page.cast("string"))
    own = named(F.col("filename"), F.col("page"))
    others = F.array_except(F.transform("copies", lambda c: named(c["filename"], c["page"])), F.array(own))
    tail = F.when(F.size(others) > 0, F.concat(F.lit(" ; aussi : "), F.array_join(others, " ; "))).otherwise("")
    return merged.withColumn("header", F.concat(F.lit("["), own, tail, F.lit("]")))


def document_order(prefix: str = "") -> list[Column]:
    """Lot or unknown, file, position, input order."""
    return [F.coalesce(F.nullif(F.col("lot"), F.lit("")), F.lit("unknown")), F.coalesce("filename", F.lit("")), F.col("position"), F.col("seq")]


def context_block(entries: DataFrame) -> DataFrame:
    """K3: (query_id, block) of entries with a header, in document order; a part opens each lot if there are several."""
    lot = F.coalesce(F.nullif(F.col("lot"), F.lit("")), F.lit("unknown"))
    w = Window.partitionBy("query_id").orderBy(*document_order())
    numbered = entries.withColumns({"__n": F.row_number().over(w), "__lot": lot, "__before": F.lag(lot).over(w)})
    several = F.size(F.collect_set("__lot").over(Window.partitionBy("query_id"))) > 1
    opening = F.when(several & ((F.col("__n") == 1) | (F.col("__lot") != F.col("__before"))), F.concat(F.lit("\n=== "), "__lot", F.lit(f" ===\n{JOINT}"))).otherwise("")
    part = F.concat(opening, "header", F.lit("\n"), "text")
    parts = numbered.withColumn("__part", part).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("__n", "__part"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["__part"]), JOINT).alias("block"))


class RenderedSize:
    """The length of a block under insertion: the plain one, or that with merged copies if it is longer.

    A block's length is a sum over its passages, over the lots that it opens and, with copies merged, over its
    groups of equal keys; so a passage changes the terms of its own lot and its own group, and no other.
    """

    def __init__(self, several_lots: bool):
        self.several = several_lots
        self.plain = self.merged = 0
        self.lots: dict[str, int] = {}
        self.merged_lots: dict[str, int] = {}
        self.groups: dict[str, dict] = {}

    def _opened(self, lots: dict[str, int], lot: str, change: int) -> int:
        """What the length gains when a passage of a lot comes or goes."""
        before = lots.get(lot, 0)
        lots[lot] = before + change
        if not self.several or (before > 0) == (lots[lot] > 0):
            return 0
        return change * len(f"\n=== {lot} ===\n{JOINT}")

    @staticmethod
    def _head(places: dict[str, None]) -> int:
        """``[a]``, or ``[a ; aussi : b ; c]``: the length does not depend on the order."""
        more = len(places) - 1
        return 2 + sum(map(len, places)) + (len(" ; aussi : ") + len(" ; ") * (more - 1) if more else 0)

    def add(self, order: int, score: float, key: str, lot: str, place: str, text: int) -> int:
        """The length with one more passage; order is its place in the document order."""
        self.plain += 2 + len(place) + 1 + text + len(JOINT) + self._opened(self.lots, lot, 1)
        group = self.groups.get(key)
        if group is None:
            group = self.groups[key] = {"places": {}, "best": None, "size": 0}
        else:
            self.merged -= group["size"] + self._opened_back(group)
        group["places"][place] = None
        if group["best"] is None or (score, -order) > group["best"][:2]:
            group["best"] = (score, -order, lot, text)
        group["size"] = self._head(group["places"]) + 1 + group["best"][3] + len(JOINT)
        self.merged += group["size"] + self._opened(self.merged_lots, group["best"][2], 1)
        return max(self.plain, self.merged) - len(JOINT)

    def _opened_back(self, group: dict) -> int:
        return -self._opened(self.merged_lots, group["best"][2], -1)


def select_by_score(passages: DataFrame, budget: int) -> DataFrame:
    """K4: passages by falling score while their exact rendering fits; the first that does not ends it.

    A block is never shorter than the texts in it, so passages behind a running sum of lengths above the
    budget can't be kept; they are dropped natively, and no question's fold has more than fit by their texts.
    Lots are opened if the passages, kept or not, are of several. Texts stay where they are: what is folded is their lengths, keys and places, question by question in
    sorted order, and the fold says how many passages of each question stay.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    lot = F.coalesce(F.nullif(F.col("lot"), F.lit("")), F.lit("unknown"))
    few = passages.withColumns({"__length": F.length("text"), "__lot": lot})
    few = few.withColumn("__several", F.size(F.collect_set("__lot").over(Window.partitionBy("query_id"))) > 1)
    few = few.withColumns({"__sum": F.sum("__length").over(by_score.rowsBetween(Window.unboundedPreceding, 0)), "__rank": F.row_number().over(by_score)}).where(F.col("__sum") <= budget)
    in_order = Window.partitionBy("query_id").orderBy(*document_order())
    few = few.withColumn("__order", F.row_number().over(in_order))
    place = F.concat("filename", F.lit(", p."), F.col("page").cast("string"))
    listed = F.struct("__rank", "__order", "score", F.md5(T.article_dedup_key(F.col("text"))).alias("key"), F.col("__lot").alias("lot"), place.alias("place"), F.col("__length").alias("length"))
    folded = few.groupBy("query_id").agg(F.first("__several").alias("several"), F.array_sort(F.collect_list(listed)).alias("p"))
    kept = folded.select("query_id", _kept(budget)("several", "p").alias("__kept"))
    return few.join(kept, "query_id").where("__rank <= __kept").select(*passages.columns)


def _kept(budget: int):
    def kept(several: pa.Array, passages: pa.Array) -> pa.Array:
        out = []
        for at in range(len(passages)):  # one question's passages as Python objects at a time
            lots, rows = several[at].as_py(), passages[at].as_py()
            size, n = RenderedSize(lots), 0
            for r in rows:
                if size.add(r["__order"], r["score"], r["key"], r["lot"], r["place"] or "None, p.None", r["length"]) > budget:
                    break
                n += 1
            out.append(n)
        return pa.array(out, pa.int32())

    return F.arrow_udf(kept, "int")


def context_policy(questions: DataFrame, hybrid: bool = False) -> DataFrame:
    """K6: pool, characters, cutoff and sources by scope."""
    broad = F.col("scope") == "broad"
    return questions.withColumns(
        {"search_limit": F.when(broad, 20).otherwise(15 if hybrid else 20), "context_max": F.when(broad, 48000).otherwise(20000), "cutoff": F.when(broad, 0.30).otherwise(0.40), "max_sources": F.when(broad, 10).otherwise(5)}
    )


def sources(passages: DataFrame, most: int = 5) -> DataFrame:
    """K5, last part: one source for each document and page, texts joined by position, the first ``most``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "seq", "text"))), lambda p: p["text"]), "\n\n")
    grouped = passages.groupBy("query_id", "filename", "page").agg(text.alias("text"), F.min("seq").alias("seq"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("seq")
    return grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def build_context(passages: DataFrame, budget: int = 20000, cutoff: float = 0.4, most: int = 5, hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
    """K5: (query_id, block) and sources: cutoff, one of equal texts, budget, near copies.

    Fused scores are no cosines, so with ``hybrid`` there is no cutoff; passages are taken by falling score (K4)
    and copies are merged under one header, in place of a budget in document order and near copies left out.
    """
    rows = first_by(context_cutoff(passages, 0.0 if hybrid else cutoff), ["query_id", "text"], ["seq"])
    if hybrid:
        rows = select_by_score(rows, budget)
        return context_block(passage_header(merge_article_copies(rows))), sources(rows, most)
    rows = rows.withColumn("length", F.length("text"))
    rows = running_budget(rows, document_order(), budget, len(JOINT))
    rows = first_by(rows.withColumn("__key", T.dedup_key(F.col("text"))), ["query_id", "__key"], ["seq"]).drop("__key")
    named = rows.withColumn("header", F.concat(F.lit("["), "filename", F.lit(", p."), F.col("page").cast("string"), F.lit("]")))
    return context_block(named), sources(rows, most)


def suspect_headers(blocks: DataFrame) -> DataFrame:
    """(query_id, header) of the passages of each block that speak to a model."""
    parts = blocks.select("query_id", F.posexplode(F.split("block", JOINT)).alias("n", "part")).withColumn("part", F.regexp_replace("part", r"(?U)^\s+", ""))
    parts = parts.where("part != ''").where(~F.col("part").rlike(r"(?s)^===.*===\s*$"))
    line = F.substring_index("part", "\n", 1)
    header = F.when(line.rlike(r"^\[[^\n]*, p\.[^\n]*\]$"), line)
    w = Window.partitionBy("query_id").orderBy("n")
    rows = parts.withColumns({"header": F.last(header, ignorenulls=True).over(w), "body": F.when(header.isNotNull(), F.expr("substring(part, length(substring_index(part, '\n', 1)) + 2)")).otherwise(F.col("part"))})
    return rows.where(F.col("header").isNotNull() & T.looks_like_injection(F.col("body"))).groupBy("query_id", "header").agg(F.min("n").alias("n"))


def frame_context(blocks: DataFrame, warning: str, tag: str = "documents") -> DataFrame:
    """Blocks in a frame that they can't close, with a warning that names suspects."""
    listed = F.array_sort(F.collect_list(F.struct("n", "header")))
    named = suspect_headers(blocks).groupBy("query_id").agg(F.array_join(F.transform(listed, lambda h: F.substring(T.neutralise_tags(h["header"], tag), 1, 200)), " ; ").alias("named"))
    framed = F.concat(F.lit(f"<{tag}>\n"), T.neutralise_tags(F.col("block"), tag), F.lit(f"\n</{tag}>"))
    tail = F.when(F.col("named").isNotNull(), F.concat(F.lit("\n"), F.format_string(warning, "named"))).otherwise("")
    return blocks.join(named, "query_id", "left").select("query_id", F.concat(framed, tail).alias("framed"))


def build_messages(questions: DataFrame, history: DataFrame, framed: DataFrame, system: str) -> DataFrame:
    """K8: (query_id, messages): the system text, the last messages, the framed context with the question."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    past = history.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda m: message(m["role"], m["text"])).alias("past"))
    rows = questions.join(past, "conversation_id", "left").join(framed, "query_id", "left")
    own = F.concat_ws("\n\n", "framed", "text")
    parts = [F.array(message(F.lit("system"), F.lit(system))), F.coalesce("past", F.array().cast("array<struct<role:string,text:string>>")), F.array(message(F.lit("user"), own))]
    return rows.select("query_id", F.concat(*parts).alias("messages"))
