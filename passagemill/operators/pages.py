"""On which page a chunk begins (C18): all snippets of a document are sought in one pass over its pages."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of a chunk that are sought, and the snippets of an automaton, whose size this bounds.
SNIPPET, MANY = 100, 4000
#: Up to so many snippets are sought one by one, which takes less time than to build an automaton.
FEW = 64


def first_places(snippets: Iterable[str], texts: list[str]) -> dict[str, int]:
    """The number of the first text that holds each snippet; an empty one is in the first. Others are left out."""
    import ahocorasick

    distinct = [s for s in dict.fromkeys(snippets) if s]
    found = {"": 0}
    if len(distinct) <= FEW:
        places = ((s, next((number for number, text in enumerate(texts) if s in text), None)) for s in distinct)
        return found | {s: number for s, number in places if number is not None}
    for begun in range(0, len(distinct), MANY):
        automaton = ahocorasick.Automaton()
        for snippet in distinct[begun : begun + MANY]:
            automaton.add_word(snippet, snippet)
        automaton.make_automaton()
        for number, text in enumerate(texts):
            for _, snippet in automaton.iter(text):
                found.setdefault(snippet, number)
    return found


def _places(snippets: pa.Array, texts: pa.Array) -> pa.Array:
    rows = []
    for own, within in zip(snippets.to_pylist(), texts.to_pylist(), strict=True):
        found = first_places(own, within)
        rows.append([found.get(s) for s in own])
    return pa.array(rows, pa.list_(pa.int32()))


def places_of(snippets: Column, texts: Column) -> Column:
    """The number from 0 of the first of a row's texts that holds each of its snippets; null where none does."""
    return F.arrow_udf(_places, "array<int>")(snippets, texts)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)
