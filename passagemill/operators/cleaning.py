"""Pages to clean pages (C1-C5). pages(doc_id, ord, page, text): one row a page, ord from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SCAN_LINES, MIN_PAGES, MIN_PAGE_CHARS, TOC_SHARE = 5, 3, 50, 0.6


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def _squeezed(lines: Column) -> Column:
    return T.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def strip_toc_pages(pages: DataFrame, share: float = TOC_SHARE) -> DataFrame:
    """Without empty pages, pages of mostly contents lines, and such lines elsewhere."""
    lines = _lines(F.col("text"))
    filled = _filled(lines)
    n, toc = F.size(filled), F.size(F.filter(filled, T.is_toc_line))
    rest = _squeezed(F.filter(lines, lambda x: ~T.is_toc_line(x)))
    cleaned = F.when(toc > 0, rest).otherwise(F.col("text"))
    return pages.where((n > 0) & (toc < share * n)).withColumn("text", cleaned).where("text != ''")


def edge_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, edge, line, n): on how many pages each normalised line is among the first or last five."""
    filled = _filled(_lines(F.col("text")))
    bottom = F.when(F.size(filled) > SCAN_LINES, F.slice(filled, F.size(filled) - SCAN_LINES + 1, SCAN_LINES))
    edges = pages.select("doc_id", F.explode(F.array(F.struct(F.lit("top").alias("edge"), F.slice(filled, 1, SCAN_LINES).alias("lines")), F.struct(F.lit("bottom").alias("edge"), bottom.alias("lines")))).alias("e"))
    lines = edges.select("doc_id", "e.edge", F.explode(F.array_distinct(F.transform("e.lines", T.normalise_line))).alias("line"))
    return lines.where("line != ''").groupBy("doc_id", "edge", "line").agg(F.count("*").alias("n"))


def strip_headers_footers(pages: DataFrame, min_repeats: int | None = None) -> DataFrame:
    """Lines that repeat at page edges of a document of three pages or more go from all its pages.

    A line repeats from int(pages / 2) pages on, or ``min_repeats``; page numbers always go.
    """
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    limit = F.floor(F.col("n_pages") / 2) if min_repeats is None else F.lit(min_repeats)
    repeated = edge_lines(pages).join(sizes, "doc_id").where((F.col("n_pages") >= MIN_PAGES) & (F.col("n") >= limit))
    per_document = repeated.groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    joined = pages.join(sizes, "doc_id").join(per_document, "doc_id", "left")
    gone = F.array_append(F.coalesce("repeated", F.array().cast("array<string>")), F.lit("PAGE_NUM"))
    rest = _squeezed(F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(gone, T.normalise_line(x))))
    cleaned = joined.withColumn("text", F.when(F.col("n_pages") >= MIN_PAGES, rest).otherwise(F.col("text")))
    return cleaned.where((F.col("text") != "") | (F.col("n_pages") < MIN_PAGES)).select(*pages.columns)


def strip_sparse_pages(pages: DataFrame, least: int = MIN_PAGE_CHARS) -> DataFrame:
    """C3."""
    return pages.where(F.length(T.strip(F.col("text"))) >= least)


def clean_pages(pages: DataFrame) -> DataFrame:
    """C4."""
    return strip_sparse_pages(strip_headers_footers(strip_toc_pages(pages)))


def sparse_page_plan(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, chars, action) on uncleaned pages: keep, ocr, or skip the whole document."""
    chars = F.length(T.strip(F.col("text")))
    rows = pages.select("doc_id", "ord", chars.alias("chars"), (chars < MIN_PAGE_CHARS).alias("sparse"))
    per = rows.groupBy("doc_id").agg(F.avg(F.col("sparse").cast("int")).alias("share"), F.avg("chars").alias("mean"))
    action = F.when(~F.col("sparse"), "keep").when((F.col("share") > 0.8) & (F.col("mean") < 10), "skip").otherwise("ocr")
    return rows.join(per, "doc_id").select("doc_id", "ord", "chars", action.alias("action"))
