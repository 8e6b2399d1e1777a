"""Benchmark decontamination by a generalised suffix automaton over item words.

The automaton holds every word sequence that stands in some item. A document's words are streamed
through it; at each word it gives the longest run that ends there and stands in an item. Where that
run reaches ``window`` words, its last ``window`` words are a window of an item (length limit); where
it ends a whole item of fewer words, that item is covered (coverage limit). Words under any such
occurrence are hits, and the hit spans can be cut out of the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

WINDOW = 10
#: Item words in one automaton. A larger benchmark is taken in several, one pass each.
AUTOMATON_WORDS = 400_000
#: Bytes that are not part of a word become spaces and A-Z is lowered, so that split() gives words.
_WORD = [b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)]
NORMAL = bytes(_WORD)
RUN = re.compile(rb"[^ ]+")


#: Columns that a search adds.
FOUND = ["n_words", "spans", "items"]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """States of the generalised automaton: transitions, suffix link and longest length."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of q that p reaches by c."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def stream(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state, length = 0, 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def of_length(self, state: int, n: int) -> int:
        """The state of the last n words of a match at ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


class ItemIndex:
    """The automaton of some items, with the items by window and by whole short item."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.automaton = SuffixAutomaton()
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for c in words:
                last = self.automaton.extend(last, c)
        self.by_window: dict[int, set[int]] = defaultdict(set)
        self.by_short: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item, words in coded:
            n = min(window, len(words))
            for k, (state, length) in enumerate(self.automaton.stream(words)):
                if len(words) >= window and length >= window:
                    self.by_window[self.automaton.of_length(state, window)].add(item)
                elif k == len(words) - 1 < window - 1:
                    self.by_short[self.automaton.of_length(state, n), n].add(item)
        self.shortest = min([min(window, len(words)) for _, words in coded], default=window)
        self.shorts = sorted({n for _, n in self.by_short})

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans (first word, behind the last) and the items whose windows occur."""
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known >= 0, [0]])))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            for at, (state, length) in enumerate(self.automaton.stream(known[a:b].tolist()), a + 1):
                n = 0
                for short in self.shorts:
                    if short > length:
                        break
                    if found := self.by_short.get((self.automaton.of_length(state, short), short)):
                        items |= found
                        n = short
                if length >= self.window:
                    items |= self.by_window[self.automaton.of_length(state, self.window)]
                    n = self.window
                if n:
                    first = at - n
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        return spans, items


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each span."""
    data = text.encode()
    places = [m.span() for m in RUN.finditer(data.translate(NORMAL))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def _matches(index, column: str):
    """The batch with n_words, spans and items; those of an earlier pass are joined with this one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            earlier = "spans" in batch.schema.names
            counts, spans, items = [], [], []
            for row, text in enumerate(batch.column(batch.schema.get_field_index(column))):
                words = words_of(text.as_py())
                found, of = own.match(words)
                if earlier:
                    found = merge_spans([*batch.column("spans")[row].as_py(), *found])
                    of = of.union(batch.column("items")[row].as_py())
                counts.append(len(words)), spans.append([[*s] for s in found]), items.append(sorted(of))
            more = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.int64()))]
            kept = [c for c in batch.schema.names if c not in FOUND]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, *FOUND])

    return run


def _cut(index):
    """The batch with its texts cut, in the pass that finds the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                spans = own.match(words_of(text))[0]
                texts.append(cut_spans(text, spans) if spans else text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of about ``most`` words, one block at a time on the driver."""
    block, n = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        words = words_of(r.text)
        if block and n + len(words) > most:
            yield block
            block, n = [], 0
        block.append((r.item_id, words))
        n += len(words)
    yield block


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _contaminated(documents: DataFrame, blocks: Iterator[list[tuple[int, list[bytes]]]], window: int) -> DataFrame:
    out = documents.drop(*FOUND)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    schema = f"{names}, n_words long, spans array<array<long>>, items array<long>".removeprefix(", ")
    block = next(blocks)
    while block is not None:
        more = next(blocks, None)
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex(block, window))
        out = out.mapInArrow(_matches(index, "text"), schema)
        if more is not None:
            out = stage(out, "contamination")
            index.unpersist()
        block = more
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """documents with n_words, spans (array of [first word, behind the last]) and items (item_ids).

    benchmark(item_id, text) is read in blocks of at most ``automaton_words`` words, the driver holding one
    block. Each block's automaton goes over all documents in a pass that is written down before the next
    one, and adds its spans and items to those before; so a worker holds one automaton at a time. A null
    text has no words; a null item_id is left out; an empty benchmark hits nothing; null and repeated
    doc_ids and repeated rows keep a row each. Other columns pass through; clashing names are replaced.
    """
    return _contaminated(documents, _blocks(benchmark, automaton_words), window)


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [cut_spans(t.as_py(), s) if (s := spans.as_py()) else t.as_py() for t, spans in zip(batch.column(at), batch.column("spans"), strict=True)]
        own = batch.set_column(at, "text", pa.array(texts, pa.string()))
        yield own.select([c for c in own.schema.names if c not in ("n_words", "spans", "items")])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """documents without their hit spans; n_chars, where there is one, follows. No row is dropped.

    Columns that are called n_words, spans or items are given up.
    """
    names = [c for c in documents.columns if c not in ("n_words", "spans", "items")]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    blocks = _blocks(benchmark, automaton_words)
    first, *more = islice(blocks, 2)
    if more:
        found = _contaminated(documents, chain([first, *more], blocks), window)
        out = found.mapInArrow(_without_spans, schema)
    else:
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex(first, window))
        out = documents.select(*names).mapInArrow(_cut(index), schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def digests(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = contamination(documents.select("doc_id", "text"), benchmark, window).drop("text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
