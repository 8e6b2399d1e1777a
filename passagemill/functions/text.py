"""Scalar text functions: Column -> Column, inside the JVM but for hints() of what to look for there."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Latin letters with marks and their base letters.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def fold(text: Column) -> Column:
    """Lower case, ligatures opened, marks of Latin letters dropped, precomposed or combining."""
    low = F.lower(text)
    for ligature, letters in (("œ", "oe"), ("æ", "ae")):
        low = F.replace(low, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(F.translate(low, MARKED, BASE), r"\p{M}+", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: Letters that Java's patterns take for i, s and k in any case, unlike lower().
_ODD_CASE = dict(zip("\u0131\u0130\u017f\u212a", "iisk", strict=True))
#: The patterns that hints() tells about, each a bit.
_REPORTS = [P.BOILERPLATE, P.RESULT_TABLE, P.CHECKLIST, P.CHECKLIST_SECTION, P.RESULT_COLUMN, P.MISSION, *P.REGULATORY]
_HINTED = {p: 1 << k for k, p in enumerate([P.QUANTITY, P.ADMIN, P.SPECIFICATION, P.DESCRIPTION, P.LOCATION, *_REPORTS, *P.KEYWORDS])}


@cache
def _seeker() -> tuple:
    """An automaton over the literals that the patterns need, and quick forms of those that need none."""
    import ahocorasick

    needs: dict[str, int] = {}
    rough = P.ROUGHLY | P.ROUGHLY_WITH_DIGIT
    untold = 0
    for pattern, bit in _HINTED.items():
        own = P.WITHOUT_DIGIT.get(pattern, []) if pattern in rough else P.needed(pattern)
        untold |= bit if not own and pattern not in rough else 0
        for need in own:
            needs[need] = needs.get(need, 0) | bit
    automaton = ahocorasick.Automaton()
    for need, bits in needs.items():
        automaton.add_word(need, bits)
    automaton.make_automaton()
    return automaton, *([(re.compile(r), _HINTED[p]) for p, r in table.items()] for table in (P.ROUGHLY, P.ROUGHLY_WITH_DIGIT)), untold


def _hints(texts: pa.Array) -> pa.Array:
    automaton, rough, with_digit, untold = _seeker()
    digit = re.compile(r"\d")
    out = []
    for text in texts.to_pylist():
        low, found = text or "", untold
        for odd, plain in _ODD_CASE.items():
            low = low.replace(odd, plain)
        low = low.lower()
        for _, bits in automaton.iter(low):
            found |= bits
        for pattern, bit in [*rough, *with_digit] if digit.search(low) else rough:
            found |= bit if pattern.search(low) else 0
        out.append(found)
    return pa.array(out, pa.int64())


def hints(text: Column) -> Column:
    """A bit for each pattern of _HINTED that can be in a text, found in one pass; Java's patterns take their time
    at every letter, and most texts hold none of the words."""
    return F.arrow_udf(_hints, "long")(text)


def _where_hinted(text: Column, match: Callable[[Column, str], Column], pattern: str, none: Column) -> Column:
    """match(text, pattern), or none where the pattern can't be in the text."""
    can_be = hints(text).bitwiseAND(F.lit(_HINTED[pattern])) != 0
    return F.when(can_be, match(text, pattern)).when(text.isNotNull(), none)


def _count(text: Column, pattern: str) -> Column:
    return _where_hinted(text, lambda t, p: F.regexp_count(t, F.lit(p)), pattern, F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    return _where_hinted(text, lambda t, p: t.rlike(p), pattern, F.lit(False))


def tokenize(text: Column) -> Column:
    """Tokens; references such as 20.1 and p10-201-1 stay whole."""
    return all_matches(fold(text), r"[a-z0-9]+(?:[.,\-/][a-z0-9]+)*")


def normalise_key(text: Column) -> Column:
    """T2."""
    return collapse(fold(text))


def article_dedup_key(text: Column) -> Column:
    """Without a leading article number of two levels or more; a quantity is none."""
    return F.lower(collapse(F.regexp_replace(text, P.LEADING_ARTICLE, "")))


def plain_key(text: Column) -> Column:
    """Lower case letter by letter, runs of ASCII white space as one space: T3 without the cut, for texts whose
    first number is no article (an address, a date)."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3")), r"[\t\n\f\r ]+", " "))


def dedup_key(text: Column) -> Column:
    """T4: without localisation tails and quantities."""
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(text, P.LOCALISATION_TAIL, ""), P.AMOUNT, "")))


def summary_key(text: Column) -> Column:
    """T5."""
    return F.substring(strip(F.lower(F.regexp_replace(text, r"^\s*[\d.]+\s*[-–:.)]?\s*", ""))), 1, 200)


def normalise_line(line: Column) -> Column:
    """Page numbers become PAGE_NUM."""
    s = F.regexp_replace(strip(line), r"(?iuU)\bpage\s*\d+\s*/\s*\d+", "PAGE_NUM")
    s = F.regexp_replace(F.regexp_replace(s, r"(?iuU)\bpage\s*\d+", "PAGE_NUM"), r"^\d+$", "PAGE_NUM")
    return collapse(s)


def is_toc_line(line: Column) -> Column:
    """T7."""
    return line.rlike(P.TOC_LINE)


def heading_level(line: Column) -> Column:
    """struct(level, heading), null where line is no heading."""
    lot = F.concat(F.lit("LOT "), pad2(F.regexp_extract(line, P.LOT, 1)), F.lit(" - "), strip(F.regexp_extract(line, P.LOT, 2)))
    named = lambda level, heading: F.struct(F.lit(level).alias("level"), heading.alias("heading"))
    return F.when(line.rlike(P.SUBARTICLE), named(2, strip(line))).when(line.rlike(P.ARTICLE), named(1, strip(line))).when(line.rlike(P.LOT), named(0, lot))


def pad2(number: Column) -> Column:
    return F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)


def content_type(text: Column) -> Column:
    """Table, heading, the signal with more than 0.6 of all, or mixed."""
    signals = {"quantity": P.QUANTITY, "admin": P.ADMIN, "specification": P.SPECIFICATION, "description": P.DESCRIPTION}
    counted = F.struct(*(_count(text, p).alias(name) for name, p in signals.items()))

    def strongest(n: Column) -> Column:
        total = reduce(lambda a, b: a + b, (n[name] for name in signals))
        return reduce(lambda out, name: out.when(n[name] > 0.6 * total, name), signals, F.when(F.lit(False), "")).otherwise("mixed")

    heading = (F.length(text) < 100) & (text.rlike(P.LOT) | text.rlike(P.ARTICLE) | text.rlike(P.SUBARTICLE))
    # A lambda over one struct counts each signal once.
    other = F.get(F.transform(F.array(counted), strongest), 0)
    return F.when(text.contains("<!-- TABLE -->"), "table").when(heading, "heading").otherwise(other)


def _mentions(text: Column, families: list[str]) -> Column:
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*(_where_hinted(text, all_matches, p, none) for p in families)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.lower(strip(m)))))


def keywords(text: Column) -> Column:
    """At most ten, sorted."""
    return F.slice(_mentions(text, P.KEYWORDS), 1, 10)


def locations(text: Column) -> Column:
    """T11."""
    return _mentions(text, [P.LOCATION])


def is_regulatory(text: Column) -> Column:
    """Weighted signals of two or more."""
    low = F.lower(text)
    flags = [
        (low.contains("références réglementaires") | low.contains("références normatives"), 2),
        *((_where_hinted(text, lambda t, p: F.lower(t).rlike(p), pattern, F.lit(False)), 1) for pattern in P.REGULATORY),
    ]
    return reduce(lambda a, b: a + b, (flag.cast("int") * n for flag, n in flags)) >= 2


def is_checklist(text: Column) -> Column:
    """T14."""
    listed = _found(text, P.CHECKLIST_SECTION) & ~_found(text, P.RESULT_COLUMN)
    return text.contains("<!-- TABLE -->") & (_found(text, P.CHECKLIST) | listed)


def diagnostic_section(text: Column) -> Column:
    """Ordered rules; an empty title where none holds."""
    low = F.lower(text)
    result = F.when(low.contains("analyse") | low.contains("laboratoire"), "Résultats d'analyses").otherwise("Conclusions / Résultats de repérage")
    rules = F.when(low.contains("recommandation"), "Recommandations générales")
    rules = rules.when(low.contains("références réglementaires") | low.contains("références normatives"), "Références réglementaires").otherwise("")
    mission = F.when(low.contains("adresse"), "Identification du bâtiment").when(low.contains("opérateur") | low.contains("certifi"), "Opérateur de repérage")
    mission = mission.when(low.contains("périmètre"), "Périmètre de repérage").otherwise("Contexte de la mission")
    out = F.when(_found(text, P.RESULT_TABLE), result).when(is_checklist(text), "Programme de repérage (normatif)")
    out = out.when(is_regulatory(text) | _found(text, P.BOILERPLATE), rules).when(_found(text, P.MISSION), mission)
    return out.when(low.contains("programme de repérage"), "Programme de repérage").otherwise("")


def diagnostic_content(text: Column) -> Column:
    """Results win over checklists, these over rules and boilerplate."""
    hits, base = _count(text, P.BOILERPLATE), content_type(text)
    out = F.when(_found(text, P.RESULT_TABLE), F.when(text.contains("<!-- TABLE -->"), "table").otherwise("description"))
    out = out.when(is_checklist(text) | is_regulatory(text) | (hits >= 2), "admin")
    return out.when(base.isin("mixed", "admin") & (hits >= 1) & (F.length(text) > 500), "admin").otherwise(base)


def is_empty_chunk(text: Column, kind: Column) -> Column:
    """Boilerplate, tables without values, texts that only say that there is nothing."""
    rows = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"(?U)^\s*\|"))
    data = F.slice(rows, 3, 1 << 30)
    no_value = text.contains("<!-- TABLE -->") & (F.size(rows) > 2) & F.forall(data, lambda row: row.rlike(P.EMPTY_ROW))
    said = text.rlike(P.EMPTY_START) & F.lower(collapse(text)).isin(P.EMPTY_TEXTS)
    admin = F.when(F.coalesce(kind == "admin", F.lit(True)), text)
    return ((kind == "admin") & (_count(admin, P.BOILERPLATE) >= 2)) | strip(text).rlike(P.EMPTY_TABLE) | no_value | said


def looks_like_injection(text: Column) -> Column:
    """T17."""
    plain = F.regexp_replace(fold(text), P.FORMAT_CHARS, "")
    return reduce(lambda a, b: a | b, (plain.rlike(p) for p in P.INJECTION))


def neutralise_tags(text: Column, tag: str) -> Column:
    """An opening bracket before the tag is escaped, also over zero-width characters."""
    gap = r"[\s​-‍⁠﻿]*"
    return F.regexp_replace(text, rf"(?iu)[<＜](?={gap}/?{gap}\Q{tag}\E\b)", "&lt;")


def has_norm(tokens: Column) -> Column:
    """A norm family followed by a number, or the energy rule of 2020 in one word or two."""
    after = F.slice(tokens, 2, 1 << 30)
    pairs = F.zip_with(tokens, after, lambda a, b: ((a.isin("en", "nf", "dtu", "iso", "eurocode") & b.rlike(r"^[a-z]?\d")) | ((a == "re") & (b == "2020")) | ((a == "rt") & (b == "2012"))) & b.isNotNull())
    single = F.exists(tokens, lambda t: t.isin("re2020", "rt2012") | t.rlike(r"^(?:dtu|nf|en)\d"))
    return single | F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))


def article_prefixes(text: Column) -> Column:
    """All prefixes of the leading dotted number from level min(3, n) to n."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)+)", 1)
    levels = F.split(number, r"\.")
    n = F.size(levels)
    built = F.transform(F.sequence(F.least(F.lit(3), n), n), lambda k: F.array_join(F.slice(levels, 1, k), "."))
    return F.when(number == "", F.array().cast("array<string>")).otherwise(built)


def filename_matches(filename: Column, words: Column) -> Column:
    """A common word of three letters or more, or a question word of four inside the name."""
    low = F.lower(filename)
    own = F.filter(all_matches(low, r"[\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    return F.arrays_overlap(own, F.filter(words, lambda w: F.length(w) >= 3)) | F.exists(words, lambda w: (F.length(w) >= 4) & F.contains(low, w))


def lot_headings(text: Column) -> Column:
    """Array of struct(number, title) of the lot headings in a text."""
    p = F.lit(r"(?im)^\s*LOT\s*[N°]*\s*(\d+)\s*[-–:.]\s*([^\n]+)$")
    pairs = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("number"), F.regexp_extract_all(text, p, F.lit(2)).alias("title"))
    return F.transform(pairs, lambda x: F.struct(pad2(x["number"]).alias("number"), strip(x["title"]).alias("title")))


def sanitize_filename(name: Column) -> Column:
    """ASCII, spaces to _, other characters dropped, a default stem."""
    plain = F.regexp_replace(F.translate(F.translate(name, MARKED, BASE), MARKED.upper(), BASE.upper()), r"[^\x00-\x7F]", "")
    safe = F.regexp_replace(F.regexp_replace(strip(plain), r"\s+", "_"), r"[^A-Za-z0-9._-]", "")
    stem, ending = F.regexp_extract(safe, r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(safe, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.when(F.regexp_replace(stem, r"[._-]", "") == "", "document").otherwise(stem), ending)


def condense(block: Column, n: int = 150, joint: str = "\n---\n") -> Column:
    """The first n characters of every passage of a block."""
    return F.array_join(F.transform(F.split(block, joint), lambda p: F.substring(p, 1, n)), joint)


def format_size(n: Column) -> Column:
    """Bytes, whole KB, or MB with one decimal."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%d KB", F.floor(n / 1024 + 0.5))).otherwise(F.format_string("%.1f MB", n / 1024**2))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit: minutes, hours, days, months of 30 days, years of 12 months."""
    seconds = F.unix_seconds(now) - F.unix_seconds(then)
    minutes, hours, days = (F.floor(seconds / k) for k in (60, 3600, 86400))
    months = F.floor(days / 30)
    years = F.floor(months / 12)
    ago = lambda n, unit: F.concat(F.lit("il y a "), n.cast("string"), F.lit(unit))
    shown = F.when(seconds < 60, "à l'instant").when(minutes < 60, ago(minutes, " min")).when(hours < 24, ago(hours, "h")).when(days < 30, ago(days, "j"))
    return shown.when(months < 12, ago(months, " mois")).otherwise(F.concat(ago(years, " an"), F.when(years > 1, "s").otherwise("")))


def question_words(*texts: Column) -> Column:
    """Words of four letters or more of all texts."""
    found = [F.filter(all_matches(F.lower(t), r"[\p{L}\p{N}]+"), lambda w: F.length(w) >= 4) for t in texts]
    return F.array_distinct(F.concat(*found))


def size_label(chars: Column) -> Column:
    """The band of the size histogram."""
    return F.when(chars < 100, "<100").when(chars < 500, "100-499").when(chars < 1500, "500-1499").when(chars < 2500, "1500-2499").otherwise(">=2500")
