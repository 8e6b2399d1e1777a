"""Pages to chunks.

A document's pages are joined to one text; splitting it is an ordered fold over that text, so the
splitters are small Arrow functions over a column of texts. All metadata is added afterwards by
column functions inside the JVM. Every chunk has ``chunk_seq``, its number in the document, beside
``position``, which sub-pieces of different sections can share.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.shared import written
from . import pages

SIZE, OVERLAP, TINY = 2500, 300, 250
OPEN, CLOSE = "<!-- TABLE -->", "<!-- /TABLE -->"
_BLANK, _SENTENCE = re.compile(r"(?=\n\n)"), re.compile(r"\. ")
_TABLE = re.compile(rf"{OPEN}\n(.*?)\n{CLOSE}", re.DOTALL)


def pieces_schema(texts: DataFrame) -> str:
    """The rows that splitters give; ids keep the type that they have."""
    return f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, chunk_seq int, position int, section int, text string"


def _windows(text: str, size: int, overlap: int) -> Iterator[slice]:
    """Windows of ``size``; one ends at its last blank line, or without any at its last sentence, if
    that lies in its second half. All places to end at are found once and looked up by bisection."""
    blanks, sentences = ([m.start() for m in pattern.finditer(text)] for pattern in (_BLANK, _SENTENCE))

    def last_of(places: list[int], low: int, high: int) -> int | None:
        at = bisect_right(places, high) - 1
        return places[at] if at >= 0 and places[at] >= low else None

    begin = 0
    while begin < len(text):
        stop = begin + size
        if stop < len(text):
            place = last_of(blanks, begin, stop - 2)
            place = last_of(sentences, begin, stop - 2) if place is None else place
            stop = place + 1 if place is not None and place - begin > size // 2 else stop
        yield slice(begin, stop)
        begin = stop - overlap


def overlapping(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return list(filter(None, (text[window].strip() for window in _windows(text, size, overlap))))


def table_parts(table: str, size: int = SIZE) -> list[str]:
    """Groups of rows, each under the table's header."""
    wrap = lambda rows: "\n".join([OPEN, *rows, CLOSE])
    head, rows = table.split("\n")[:2], table.split("\n")[2:]
    if not rows:
        return [wrap(head)]
    fixed = len("\n".join(head)) + len(OPEN) + len(CLOSE) + 4
    groups: list[list[str]] = []
    room = 0
    for row in rows:
        if not groups or room < len(row) + 1:
            groups.append([])
            room = size - fixed
        groups[-1].append(row)
        room -= len(row) + 1
    return [wrap([*head, *group]) for group in groups]


def _table_pieces(table: str) -> list[str]:
    framed = f"{OPEN}\n{table}\n{CLOSE}"
    return table_parts(table) if len(framed) > SIZE else [framed]


def _prose_pieces(prose: str) -> list[str]:
    return overlapping(prose) if len(prose) > SIZE else [prose]


def pieces_of(text: str) -> list[str]:
    """Tables stay whole or are cut by rows; what is between them overlaps."""
    tables = list(_TABLE.finditer(text))
    if OPEN not in text:
        return overlapping(text)
    prose = [text[a:b] for a, b in zip([0, *(t.end() for t in tables)], [*(t.start() for t in tables), len(text)], strict=True)]
    parts = [(_prose_pieces, prose[0]), *(x for t, after in zip(tables, prose[1:], strict=True) for x in ((_table_pieces, t[1]), (_prose_pieces, after)))]
    return [piece for cut, part in parts if part.strip() for piece in cut(part.strip())]


def merge_small(sections: list[str], least: int = TINY) -> list[str]:
    """C11: a run of sections ends where it reaches ``least`` characters; what is left joins the last run.

    With reach[k] the length of the first k sections and their joints, the end of a run is found by bisection.
    """
    reach = list(accumulate((len(x) + 2 for x in sections), initial=0))
    edges = [0]
    while (end := bisect_left(reach, reach[edges[-1]] + least + 2, edges[-1] + 1)) < len(reach):
        edges.append(end)
    edges[-1:] = [len(sections)] if len(edges) > 1 else [0, len(sections)]
    return ["\n\n".join(sections[a:b]) for a, b in pairwise(edges) if a < b]


def _python(pattern: str) -> re.Pattern:
    flags, body = re.match(r"(?:\(\?([a-zA-Z]+)\))?(.*)", pattern, re.DOTALL).groups()
    return re.compile(body, re.MULTILINE if "m" in (flags or "") else 0)


def _sections(cut: re.Pattern, merge: bool, text: str) -> list[str]:
    sections = [s for s in map(str.strip, cut.split(text)) if s]
    return merge_small(sections) if merge else sections


def _one_or_none(cut: Callable[[str], list[str]], text: str) -> list[str]:
    sections = cut(text)
    return sections if len(sections) > 1 else []


ARTICLES, SHEETS, POINTS, REPORTS = ["CCTP", "DPGF", "etude_thermique"], ["fiche_technique"], ["CR"], ["rapport_amiante", "etude_sol"]


def _cut(text: str, way: Callable[[str], list[str]] | None) -> Iterator[tuple[int, int, str]]:
    """(position, section, piece) of a text.

    A section of at most SIZE characters stays whole; a text without sections goes by paragraphs.
    """
    sections = way(text) if way else []
    for i, section in enumerate(sections or ([text] if text.strip() else [])):
        parts = [section] if sections and len(section) <= SIZE else pieces_of(section)
        for j, part in enumerate(parts):
            yield i + j, i, part


def _splitter(ways: dict[str | None, Callable[[str], list[str]]]):
    """Rows of pieces_schema() for (doc_id, text, type): the way of the type cuts sections, else there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += [(doc, seq, *cut) for seq, cut in enumerate(_cut(text, ways.get(kind)))]
            if rows:
                kinds = [batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "chunk_seq", "position", "section", "text"])

    return run


def _paged_splitter(ways: dict[str | None, Callable[[str], list[str]]]):
    """_splitter for (doc_id, type, pages as structs of ord, page, text), whose rows bear type and page (C18) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.schema.types
            names = ["doc_id", "chunk_seq", "position", "section", "text", "type", "page"]
            types = [kinds[0], pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), kinds[2].value_type.field("page").type]
            for doc, kind, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                texts = [p["text"] or "" for p in own]
                cuts = list(_cut("\n\n".join(p["text"] for p in own if p["text"] is not None), ways.get(kind)))
                if not cuts:
                    continue
                found = pages.first_places((piece[: pages.SNIPPET] for *_, piece in cuts), texts)
                rows = [(doc, seq, *cut, kind, own[found.get(cut[2][: pages.SNIPPET], 0)]["page"]) for seq, cut in enumerate(cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def document_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def _described(pieces: DataFrame) -> DataFrame:
    text = F.col("text")
    more = {"content_type": T.content_type(text), "keywords": T.keywords(text), "locations": T.locations(text), "char_count": F.length(text)}
    for name, kind in (("section_title", "string"), ("heading_prefix", "string"), ("chunk_lot", "string")):
        if name not in pieces.columns:
            more[name] = F.lit("").cast(kind)
    if "parent_sections" not in pieces.columns:
        more["parent_sections"] = F.array().cast("array<string>")
    return pieces.withColumns(more).drop("section")


def _pieces(texts: DataFrame, way: Callable[[str], list[str]] | None = None) -> DataFrame:
    rows = texts.select("doc_id", "text", F.lit("any").alias("type"))
    return rows.mapInArrow(_splitter({"any": way} if way else {}), pieces_schema(texts))


_SHEET_WAY = partial(_one_or_none, partial(_sections, _python(P.SHEET_CUT), False))
_POINT_WAY = partial(_sections, _python(P.POINT_CUT), True)
_ARTICLE_WAY = partial(_sections, _python(P.ARTICLE_CUT), False)
WAYS = dict.fromkeys(SHEETS, _SHEET_WAY) | dict.fromkeys(POINTS, _POINT_WAY) | dict.fromkeys(ARTICLES, _ARTICLE_WAY)


def by_paragraphs(texts: DataFrame) -> DataFrame:
    """C8."""
    return _described(_pieces(texts))


def by_sheet_sections(texts: DataFrame) -> DataFrame:
    """At ``## `` lines; a text of one section goes by paragraphs."""
    return _described(_pieces(texts, _SHEET_WAY))


def _point_title() -> Column:
    """The title of a numbered point holds until the next."""
    first = T.strip(F.substring_index("text", "\n", 1))
    titled = F.when((F.col("position") == F.col("section")) & first.rlike(P.POINT_HEADING), first)
    return F.coalesce(F.last(titled, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("chunk_seq")), F.lit(""))


def by_points(texts: DataFrame) -> DataFrame:
    """Numbered points."""
    return _described(_pieces(texts, _POINT_WAY).withColumn("section_title", _point_title()))


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heading stack at each section of a document: the first ``level`` entries, then the heading."""
    for batch in batches:
        out = []
        for headings in batch.column(1).to_pylist():
            stack: list[str] = []
            for h in headings:
                if h["heading"] is not None:
                    stack = [*stack[: h["level"]], h["heading"]]
                out.append(stack)
        lengths = [len(h) for h in batch.column(1).to_pylist()]
        docs = [d for d, n in zip(batch.column(0).to_pylist(), lengths, strict=True) for _ in range(n)]
        sections = [h["section"] for hs in batch.column(1).to_pylist() for h in hs]
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.types[0]), pa.array(sections, pa.int32()), pa.array(out, pa.list_(pa.string()))], ["doc_id", "section", "parent_sections"])


def _headings(pieces: DataFrame) -> DataFrame:
    """(doc_id, section, parent_sections, chunk_lot): the stack and the lot carry on."""
    found = T.heading_level(F.substring_index("text", "\n", 1))
    heads = pieces.where("position = section").select("doc_id", "section", found.alias("found"))
    listed = F.array_sort(F.collect_list(F.struct("section", F.col("found.level").alias("level"), F.col("found.heading").alias("heading"))))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    stacks = heads.groupBy("doc_id").agg(listed.alias("headings")).mapInArrow(_stacks, f"doc_id {kind}, section int, parent_sections array<string>")
    lot = F.when(F.col("found.level") == 0, F.substring(F.col("found.heading"), 5, 1 << 20))
    so_far = Window.partitionBy("doc_id").orderBy("section")
    lots = heads.select("doc_id", "section", F.coalesce(F.last(lot, ignorenulls=True).over(so_far), F.lit("")).alias("chunk_lot"))
    return stacks.join(lots, ["doc_id", "section"])


def _last(stack: str) -> Column:
    return F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))


def by_articles(texts: DataFrame) -> DataFrame:
    """Before Article, LOT and numbered headings."""
    pieces = _pieces(texts, _ARTICLE_WAY)
    joined = pieces.join(_headings(pieces), ["doc_id", "section"])
    return _described(joined.withColumns({"section_title": _last("parent_sections"), "heading_prefix": F.array_join("parent_sections", " > ")}))


def plan_pages(pages: DataFrame) -> DataFrame:
    """A chunk for each page that is not blank."""
    rows = pages.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", F.col("ord").alias("chunk_seq"), F.col("ord").alias("position"), "page", "text")
    return _described(rows)


def diagnostic_report(texts: DataFrame) -> DataFrame:
    """C16."""
    text = F.col("text")
    return by_paragraphs(texts).withColumns({"section_title": T.diagnostic_section(text), "content_type": T.diagnostic_content(text)})


def find_page(chunks: DataFrame, of: DataFrame) -> DataFrame:
    """The first of the pages ``of`` a document that holds the chunk's first 100 characters, else its first page.

    Chunks and pages of a document meet as one row; chunks of a document without pages are left out.
    """
    names = [c for c in chunks.columns if c not in ("doc_id", "page")]
    listed = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("rows"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "page", F.coalesce("text", F.lit("")).alias("text"))))
    both = listed.join(of.groupBy("doc_id").agg(ordered.alias("pages")), "doc_id")
    sought = F.transform("rows", lambda r: F.coalesce(pages.snippet(r["text"]), F.lit("")))
    place = pages.places_of(sought, F.transform("pages", lambda p: p["text"])).alias("places")
    each = both.select("doc_id", "pages", F.arrays_zip("rows", place).alias("zipped")).select("doc_id", "pages", F.explode("zipped").alias("z"))
    page = F.get("pages", F.coalesce("z.places", F.lit(0)))["page"]
    return each.select("doc_id", *(F.col(f"z.rows.{n}").alias(n) for n in names), page.alias("page"))


def merge_tiny_chunks(chunks: DataFrame, least: int = TINY) -> DataFrame:
    """C14: a chunk below ``least`` joins the one before; keywords are sorted before they are cut to ten."""
    order = Window.partitionBy("doc_id").orderBy("chunk_seq")
    starts = F.when((F.row_number().over(order) == 1) | (F.col("char_count") >= least), 1).otherwise(0)
    keep = [c for c in chunks.columns if c not in ("doc_id", "chunk_seq", "text", "keywords", "locations", "char_count", "content_type", "n")]
    grouped = chunks.withColumn("group", F.sum(starts).over(order)).groupBy("doc_id", "group")
    parts = F.array_sort(F.collect_list(F.struct("chunk_seq", "text", "keywords", "locations", "content_type")))
    merged = grouped.agg(parts.alias("parts"), F.min("chunk_seq").alias("chunk_seq"), *(F.min_by(c, "chunk_seq").alias(c) for c in keep))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    several = F.size("parts") > 1
    every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p[name]))))
    merged = merged.withColumn("text", text).withColumns(
        {
            "keywords": F.when(several, F.slice(every("keywords"), 1, 10)).otherwise(F.get("parts", 0)["keywords"]),
            "locations": every("locations"),
            "content_type": F.when(several, T.content_type(F.when(several, F.col("text")))).otherwise(F.get("parts", 0)["content_type"]),
            "char_count": F.length("text"),
        }
    )
    return merged.select(*chunks.columns)


def remove_empty_chunks(chunks: DataFrame) -> DataFrame:
    """C15."""
    return chunks.where(~T.is_empty_chunk(F.col("text"), F.col("content_type")))


def chunk_documents(of: DataFrame, types: DataFrame) -> DataFrame:
    """C17: pages ``of`` documents and types(doc_id, type) to chunks, by the way that suits each type.

    One pass splits all texts and finds each piece's page; what else depends on the type is chosen by column
    expressions after it.
    """
    typed = of.join(types, "doc_id", "left").withColumn("type", F.coalesce("type", F.lit("autre")))
    flat = typed.where("type != 'plan'")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "page", "text")))
    texts = flat.groupBy("doc_id").agg(F.first("type").alias("type"), ordered.alias("pages"))
    schema = f"{pieces_schema(texts)}, type string, page {of.schema['page'].dataType.simpleString()}"
    # Written once: headings and rows both read the pieces.
    pieces = written(texts.select("doc_id", "type", "pages").mapInArrow(_paged_splitter(WAYS), schema), "pieces")
    stacks = _headings(pieces.where(F.col("type").isin(ARTICLES)))
    text, none = F.col("text"), F.array().cast("array<string>")
    title = F.when(F.col("type").isin(ARTICLES), _last("parent_sections")).when(F.col("type").isin(POINTS), F.col("point_title"))
    report = F.col("type").isin(REPORTS)
    rows = pieces.withColumn("point_title", _point_title()).join(stacks, ["doc_id", "section"], "left")
    rows = rows.withColumns({"parent_sections": F.coalesce("parent_sections", none), "chunk_lot": F.coalesce("chunk_lot", F.lit(""))})
    rows = rows.withColumns({"heading_prefix": F.array_join("parent_sections", " > "), "section_title": F.coalesce(title.when(report, T.diagnostic_section(text)), F.lit(""))})
    kind = F.when(report, T.diagnostic_content(text)).otherwise(F.col("content_type"))
    chunks = _described(rows).withColumn("content_type", kind).drop("type", "point_title")
    return remove_empty_chunks(merge_tiny_chunks(plan_pages(typed.where("type = 'plan'")).unionByName(chunks)))


def document_outcome(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, status, chunk_count) for documents(doc_id, type)."""
    seen = pages.groupBy("doc_id").agg(F.max(F.col("text").rlike(r"(?U)\S")).alias("has_text"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    n, text = F.coalesce("n", F.lit(0)), F.coalesce("has_text", F.lit(False))
    status = F.when((F.col("type") == "plan") & (n == 0), "ready").when(~text, "error").when(n == 0, "empty").otherwise("ready")
    return documents.join(seen, "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", status.alias("status"), n.alias("chunk_count"))


def classification_input(pages: DataFrame, most: int = 3000, per_page: int = 30) -> DataFrame:
    """(doc_id, excerpt, route): vision for scans, default for blank documents, else text."""
    texts = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), "\n").alias("text"))
    chars = F.length(T.strip(F.col("text")))
    route = F.when(chars < per_page * F.col("n_pages"), "vision").otherwise("text")
    return texts.select("doc_id", F.substring("text", 1, most).alias("excerpt"), F.when(chars == 0, "default").otherwise(route).alias("route"))


def embedding_text(chunks: DataFrame) -> Column:
    """What is embedded: the chunk's text under its heading prefix, where it has one."""
    prefix = F.coalesce("heading_prefix", F.lit("")) if "heading_prefix" in chunks.columns else F.lit("")
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), "text")).otherwise(F.col("text"))


def embed(chunks: DataFrame, function: Callable[[list[str]], list[list[float]]], batch: int = 10) -> DataFrame:
    """C20: a ``dense`` vector for each chunk from a function over lists of at most ``batch`` embedding texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.num_columns - 1).to_pylist()
            vectors = [v for at in range(0, len(texts), batch) for v in function(texts[at : at + batch])]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], [*rows.schema.names[:-1], "dense"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.withColumn("__embedded", embedding_text(chunks)).mapInArrow(run, f"{schema}, dense array<float>")
