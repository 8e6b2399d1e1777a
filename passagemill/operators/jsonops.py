"""Handling of what a model returned (Y1-Y13): JSON inside columns.

Parsing, repair, flattening, filtering, merging and defaults are column functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

UNSAID = r"(?iu)^(?:—|-|non\s+chiffr[ée]e?|non\s+quantifi[ée]e?|non\s+pr[ée]cis[ée]e?|non\s+mentionn[ée]e?|n/?a|inconnue?|sans|aucune?|)$"
NOT_PRECISE = r"(?iu)^(?:non\s+pr[ée]cis[ée]e?|non\s+mentionn[ée]e?|non\s+d[ée]taill[ée]e?|non\s+disponible|inconnue?|n/?a)(?![\p{L}\p{N}_])|^[—-](?=[\p{L}\p{N}_])"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def _field(variant: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, f"$.{name}", kind)


def _text(variant: Column, name: str) -> Column:
    """A string field; other kinds of values count as missing."""
    is_text = F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")) == "STRING"
    return F.when(is_text, _field(variant, name))


def first_words(text: Column, n: int) -> Column:
    # An empty part may come first, and the last part is what is left unsplit.
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+", n + 2), lambda w: w != ""), 1, n), " ")


def parse_rewrite(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Query (25 words), related (two of 15 words), scope, structured, schema; the raw text if unreadable."""
    none = F.array().cast("array<string>")

    def read(v: Column) -> Column:
        def listed(name: str, usual: str, values: list[str]) -> Column:
            said = F.lower(T.strip(_text(v, name)))
            return F.when(said.isin(values), said).otherwise(usual)

        usable = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
        query = T.strip(F.coalesce(_text(v, "query"), F.lit("")))
        related = F.slice(F.coalesce(F.try_variant_get(v, "$.related", "array<string>"), none), 1, 2)
        related = F.filter(F.transform(related, lambda r: first_words(r, 15)), lambda r: r != "")
        return F.struct(
            F.when(usable & (query != ""), first_words(query, 25)).otherwise(F.col(column)).alias("query"),
            F.when(usable, related).otherwise(none).alias("related"),
            F.when(usable, listed("scope", "specific", ["broad", "specific"])).otherwise("specific").alias("scope"),
            F.when(usable, listed("structured", "none", ["table", "none"])).otherwise("none").alias("structured"),
            F.when(usable, listed("schema", "none", ["schema", "none"])).otherwise("none").alias("schema"),
        )

    # As a variable of a lambda, a reply is parsed once and not for each of its fields.
    parsed = F.get(F.transform(F.array(F.try_parse_json(unfenced(F.col(column)))), read), 0)
    rows = rows.withColumn("__read", parsed)
    return rows.withColumns({n: F.col(f"__read.{n}") for n in ("query", "related", "scope", "structured", "schema")}).drop("__read")


def parse_judgment(rows: DataFrame, column: str = "raw", most: int = 300) -> DataFrame:
    """Y2: (sufficient, missing); whatever can't be read is sufficient."""
    v = F.try_parse_json(unfenced(F.col(column)))
    lacking = F.coalesce(F.lower(T.strip(_text(v, "verdict"))) == "insuffisant", F.lit(False))
    missing = F.when(lacking, F.substring(T.strip(F.coalesce(_text(v, "manque"), F.lit(""))), 1, most)).otherwise("")
    return rows.withColumns({"sufficient": ~lacking, "missing": missing})


def parse_reformulation(rows: DataFrame, column: str = "raw", first: str = "first_query", words: int = 40) -> DataFrame:
    """The new query, null where it is blank, unreadable or the first one again."""
    query = first_words(F.coalesce(_text(F.try_parse_json(unfenced(F.col(column))), "query"), F.lit("")), words)
    again = F.lower(T.collapse(query)) == F.lower(T.collapse(F.col(first)))
    return rows.withColumn("query", F.when((query != "") & ~again, query))


def flat_section(raw: Column) -> Column:
    """An answer of nested sections as one object of description, kpis (five at most), details and schema.

    The sections are the objects among the answer's values and in lists there, in the order of the text, which
    a map keeps and a variant does not. Answers with a description of their own, or without anything said
    below, stay as they are; what is no JSON is null. Nulls in lists are dropped.
    """
    none = F.array().cast("array<string>")
    of_kind = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))
    whole = F.try_parse_json(raw)
    values = F.filter(F.map_values(F.from_json(raw, "map<string,string>")), lambda x: x.isNotNull())
    items = F.flatten(F.transform(values, lambda x: F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), none)).otherwise(F.array(x))))
    sections = F.filter(F.transform(items, F.try_parse_json), lambda v: of_kind(v, "OBJECT"))

    def joined(found: Column) -> Column:
        listed = lambda name: F.array_compact(F.flatten(F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), none))))
        said = F.filter(F.transform(found, lambda v: _text(v, "description")), lambda d: d != "")
        drawn = F.filter(F.transform(found, lambda v: F.try_variant_get(v, "$.schema", "variant")), lambda v: of_kind(v, "OBJECT"))
        flat = F.struct(F.array_join(said, " ").alias("description"), F.slice(listed("kpis"), 1, 5).alias("kpis"), listed("details").alias("details"), F.get(drawn, 0).alias("schema"))
        some = F.size(said) + F.size(listed("kpis")) + F.size(listed("details")) > 0
        return F.when(some, F.to_json(flat, {"ignoreNullFields": "false"}))

    # As a variable of a lambda, the sections are parsed once.
    flat = F.get(F.transform(F.array(sections), joined), 0)
    nested = of_kind(whole, "OBJECT") & _text(whole, "description").isNull()
    return F.when(nested, F.coalesce(flat, raw)).when(whole.isNotNull(), raw)


#: What may close a JSON text that was cut off, in the order of trial: fixed values.
CLOSINGS = ("]}", '"]}', '"}')


def repair_json(rows: DataFrame, column: str = "raw", most: int = 200) -> DataFrame:
    """``repaired``, the text with 1 to ``most`` characters cut off and closed again: of all such texts
    that are JSON objects the one that loses most; null where there is none."""
    raw = F.coalesce(F.col(column), F.lit(""))
    lost = F.sequence(F.least(F.length(raw), F.lit(most)), F.lit(1), F.lit(-1))

    def tried(n: Column) -> list[Column]:
        texts = [F.concat(F.left(raw, F.length(raw) - n), F.lit(end)) for end in CLOSINGS]
        return [F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False)), t) for t in texts]

    # coalesce() parses nothing more once a text is readable.
    found = F.aggregate(lost, F.lit(None).cast("string"), lambda found, n: F.coalesce(found, *tried(n)))
    return rows.withColumn("repaired", F.when(F.length(raw) > 0, found))


def normalize_section(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Y5."""
    return rows.withColumn("section", flat_section(F.col(column)))


def clean_section(rows: DataFrame, column: str = "section") -> DataFrame:
    """Kpis (five at most) and details without what says nothing."""
    v = F.try_parse_json(F.col(column))
    strings = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    kpis = F.slice(F.filter(strings("kpis"), lambda k: ~F.lower(k).rlike("non spécifié|non précisé|n/a")), 1, 5)
    vague = r"non\s+d[ée]taill[ée]|non\s+disponible|non\s+(?:sp[ée]cifi|pr[ée]cis)[ée]?[es]?\s+dans|à\s+(?:confirmer|valider)|selon\s+étude"
    said = lambda d: ~F.lower(T.strip(d)).isin("non spécifié", "non précisé", "n/a", "non précisée", "non spécifiée") & ~F.lower(d).rlike(vague) & ~F.lower(T.strip(d)).startswith("localisation")
    inner = r"(?iu)\s*\([^)]*(?:non\s+(?:précis|spécifi)[ée]?[es]?|à\s+(?:confirmer|valider)|selon\s+étude)[^)]*\)"
    details = F.filter(F.transform(F.filter(strings("details"), said), lambda d: T.strip(F.regexp_replace(d, inner, ""))), lambda d: d != "")
    return rows.withColumns({"description": F.coalesce(_text(v, "description"), F.lit("")), "kpis": kpis, "details": details})


def assemble_summary(sections: DataFrame) -> DataFrame:
    """sections(project_id, ord, category, label, description, kpis, details, ok) a row a project."""
    item = F.struct("ord", "label", "description", "kpis", "details")
    of = lambda kind, keep: F.array_sort(F.filter(F.collect_list(F.when(F.col("ok") & (F.col("category") == kind) & keep, item)), lambda x: x.isNotNull()))
    some = (F.size("kpis") > 0) | (F.size("details") > 0)
    good, n = F.sum(F.col("ok").cast("int")), F.count("*")
    status = F.when(good == 0, "error").when(good < n, "partial").otherwise("done")
    return sections.groupBy("project_id").agg(of("constructif", F.lit(True)).alias("building"), of("contrainte", some).alias("constraints"), status.alias("status"))


def _plain_name(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit("é"), F.lit("e")), F.lit(" "), F.lit("_"))


def _said(row: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(row, name), F.lit(""))


def merge_elements(rows: Column, names: Column) -> Column:
    """Rows that name the same element become one: amounts that differ are added as text, new places are
    appended, the longest description wins. Elements keep the order in which they first appear.

    names are the plain column names: the first holds the element, the second its description; amounts and
    places stand in the last columns so called.
    """
    last = lambda part: F.try_element_at(F.filter(names, lambda n: n.contains(part)), F.lit(-1))
    amount, place, about = last("quantite"), last("localisation"), F.get(names, 1)
    keyed = F.transform(rows, lambda r: F.struct(T.normalise_key(_said(r, F.get(names, 0))).alias("key"), r.alias("row")))

    def joined(kept: Column, more: Column) -> Column:
        def value(name: Column, old: Column) -> Column:
            new = _said(more, name)
            both = (F.coalesce(old, F.lit("")) != "") & (new != "")
            out = F.when((name == amount) & both & (old != new), F.concat(old, F.lit(" + "), new))
            out = out.when((name == place) & both & ~F.contains(T.normalise_key(old), T.normalise_key(new)), F.concat(old, F.lit(", "), new))
            return out.when((name == about) & (F.length(new) > F.length(F.coalesce(old, F.lit("")))), new).otherwise(old)

        whole = F.when(F.map_contains_key(kept, about), kept).otherwise(F.map_concat(kept, F.create_map(about, F.lit(""))))
        return F.transform_values(F.when(_said(more, about) != "", whole).otherwise(kept), value)

    def folded(key: Column) -> Column:
        own = F.transform(F.filter(keyed, lambda x: x["key"] == key), lambda x: x["row"])
        return F.aggregate(F.slice(own, 2, 1 << 30), F.get(own, 0), joined)

    merged = F.transform(F.array_distinct(F.transform(keyed, lambda x: x["key"])), folded)
    return F.when((F.size(rows) < 2) | (F.size(names) < 2), rows).otherwise(merged)


def table_rows(tables: DataFrame, most: int = 8) -> DataFrame:
    """tables(columns, rows): rows without an amount go, rows of one element merge, sparse tables go."""
    name = F.element_at(F.filter(F.transform("columns", lambda c: F.replace(F.lower(c), F.lit("é"), F.lit("e"))), lambda c: c == "quantite"), 1)
    name = F.when(F.exists("columns", lambda c: F.replace(F.lower(c), F.lit("é"), F.lit("e")) == "quantite"), name)
    kept = F.filter(F.slice("rows", 1, most), lambda r: name.isNull() | ~T.strip(F.coalesce(F.try_element_at(r, name), F.lit(""))).rlike(UNSAID))
    rows = tables.withColumns({"rows": kept, "__names": F.transform("columns", _plain_name)})
    rows = rows.withColumn("rows", merge_elements(F.col("rows"), F.col("__names"))).drop("__names")
    filled = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(F.filter(F.map_values(r), lambda x: ~T.strip(x).isin("", "—"))))
    return rows.where((filled >= 3) & (filled >= 0.4 * F.size("rows") * F.size("columns")))


def strip_non_precise(params: Column) -> Column:
    """Parameters that say nothing go, and layers without a thickness."""
    layers = F.from_json(F.try_element_at(params, F.lit("couches")), "array<map<string,string>>")
    precise = F.filter(layers, lambda c: ~T.strip(F.coalesce(F.try_element_at(c, F.lit("epaisseur")), F.lit(""))).rlike(NOT_PRECISE))
    others = F.map_filter(params, lambda k, v: (k != "couches") & ~T.strip(v).rlike(NOT_PRECISE))
    raw = F.try_element_at(params, F.lit("couches"))
    kept = F.when(raw.isNull(), F.lit(None)).when(layers.isNull(), raw).when(F.size(precise) > 0, F.to_json(precise))
    return F.when(kept.isNotNull(), F.map_concat(others, F.create_map(F.lit("couches"), kept))).otherwise(others)


SUMMARY = "status string, description string, systeme_constructif array<struct<label:string,description:string,kpis:array<string>,details:array<string>>>, contraintes array<struct<label:string,kpis:array<string>,details:array<string>>>"


def to_project_summary(rows: DataFrame, column: str = "raw") -> DataFrame:
    """A tolerant reading; null lists are empty and an unknown status is done."""
    s = F.from_json(F.col(column), SUMMARY)
    status = F.when(s["status"].isin("pending", "processing", "done", "partial", "error"), s["status"]).otherwise("done")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(s.alias("s")).schema["s"].dataType.fields}
    return rows.withColumns({"status": status, "description": F.coalesce(s["description"], F.lit("")), "building": empty(s["systeme_constructif"], kinds["systeme_constructif"]), "constraints": empty(s["contraintes"], kinds["contraintes"])})


def section_summaries(sections: DataFrame, most: int = 1500) -> DataFrame:
    """Label, description, KPIs and details of each project's sections as one text, cut to ``most``."""
    text = F.concat_ws(" | ", F.col("label"), "description", F.array_join("kpis", ", "), F.array_join("details", "; "))
    parts = F.array_sort(F.collect_list(F.struct("ord", text.alias("text"))))
    return sections.groupBy("project_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, most).alias("summary"))


def messages_read(messages: DataFrame, columns: tuple[str, ...] = ("sources",), single: tuple[str, ...] = ("table",)) -> DataFrame:
    """JSON columns of messages as variants; bad JSON is an empty list, or null for single values."""
    out = {c: F.coalesce(F.try_parse_json(F.col(c)), F.parse_json(F.lit("[]"))) for c in columns} | {c: F.try_parse_json(F.col(c)) for c in single}
    return messages.withColumns(out)


def model_column(df: DataFrame, prompt: str, function: Callable[[list[str]], list[str]], out: str = "reply") -> DataFrame:
    """A column of replies from a function over lists of prompts; stands for every model call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: function(batch[prompt].tolist())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, `{out}` string")
