"""Grouping of spelling variants by permuterm rotations.

A word w is marked with a terminator, and all rotations of w$ are sorted. A rotation that ends in letter i of
w is what stands behind that letter, $, what stands before it, and the letter itself:

* words that differ in letter i alone share such a rotation but for its last character, so they are one
  prefix range that skips the edited character;
* a word with one letter more has, as the skipped prefix of the rotation that ends in the added letter, a
  whole rotation of the shorter word; a whole rotation stands first in its range.

So each rotation is a row under its skipped prefix and a row under itself; rows are dealt by that key, sorted
and scanned range by range. A range holds one word for each character of the alphabet at most, and the one
shorter word. Of a run of equal letters only the first counts as the added one, so each pair of near words
meets in just one range. A range gives each of its words a count and its best neighbour, not its pairs; the
sums over a word's rotations are its near words in all.

Words are numbered in code-point order once, and rows carry numbers. Keys of more than LONG characters are
replaced by their polynomial hash modulo the prime 2^127 - 1, found in constant time a rotation: a word of n
letters costs n short rows, however long it is. Two different keys of n characters among m share a hash with a
chance of about n m^2 / 2^128.

Handling: a null text has no words; a null doc_id counts as empty in h. Repeated rows count again. Ties of n
go to the word that is first in code-point order. An empty table gives no rows. Of the documents' further
columns none is read, so their names may clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_text, stage

END = "$"
#: Characters of a key that is kept as text.
LONG = 64
PRIME, BASE = (1 << 127) - 1, 0x1B873593CC9E2D51A3D1F4E5B7C60927
#: Distinct words that a task counts, and rows that it gathers, before it hands them on.
COUNTED, ROWS = 300_000, 50_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def typed_words(documents: DataFrame, shortest: int = 6, least: int = 5, modulus: int = 199) -> DataFrame:
    """(word, n) of the words of the texts, some of which lost a letter in typing.

    A run of letters of which ``modulus`` divides h, the crc32 of ``<doc_id>:<run>``, loses code point
    h % length. Words of fewer than ``shortest`` code points or ``least`` occurrences are left out.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                own = Counter(runs.findall(text.as_py().translate(LOWER).decode()))
                begun = zlib.crc32(f"{as_text(doc)}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), begun)
                    if not h % modulus:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield counted()
        yield counted()

    parts = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(word: str) -> Iterator[tuple[str, bool]]:
    """Each rotation but w$ as the skipped prefix, and the whole rotation before each letter and behind the last.

    The flag tells the skipped prefixes (of a letter that may have been added) from whole rotations.
    """
    n = len(word)
    if n < LONG - 1:
        for i in range(n):
            yield word[i + 1 :] + END + word[:i], True
            yield word[i:] + END + word[:i], False
        yield END + word, False
        return
    head, power = [0], [1]
    for c in word:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)

    def key(a: int, b: int) -> str:
        """The hash of word[a:], the terminator and word[:b]."""
        rest = (head[n] - head[a] * power[n - a]) % PRIME
        value = ((rest * BASE + ord(END)) * power[b] + head[b]) % PRIME
        return f"{END}{END}{n - a + 1 + b}:{value:x}" if n - a + 1 + b > LONG else word[a:] + END + word[:b]

    for i in range(n):
        yield key(i + 1, i), True
        yield key(i, i), False
    yield key(n, n), False


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "longer", "added", "n", "id"]
    keys, longer, added, counts, ids = [], [], [], [], []

    def handed() -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((keys, longer, added, counts, ids), kinds, strict=True)], names)
        for column in (keys, longer, added, counts, ids):
            column.clear()
        return out

    for batch in batches:
        for id_, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            i = 0
            for key, skipped in _keys(word):
                keys.append(key)
                longer.append(skipped)
                added.append(skipped and (i == 0 or word[i] != word[i - 1]))
                counts.append(n)
                ids.append(id_)
                i += not skipped
                if len(keys) >= ROWS:
                    yield handed()
    yield handed()


class _Neighbours:
    """What the ranges of a task say about each word: how many are near, and the best of them."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int]] = []

    def scan(self, members: list[tuple[bool, bool, int, int]]) -> None:
        """members of one range, (longer, added, n, id); the shorter word has longer = False."""
        same = sorted((-n, id_, added) for longer, added, n, id_ in members if longer)
        short = [(-n, id_) for longer, _, n, id_ in members if not longer]
        for place, (_, id_, added) in enumerate(same):
            best = [x[:2] for x in same[:2] if x[1] != id_][:1] + (short if added else [])
            if best:
                least = min(best)
                self.rows.append((id_, len(same) - 1 + len(short) * added, *least))
        grown = [x for x in same if x[2]]
        for _, id_ in short:
            if grown:
                self.rows.append((id_, len(grown), *grown[0][:2]))

    def handed(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 4
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n_near", "minus_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their key: ranges of two words or more are scanned."""
    found, open_key, open_rows = _Neighbours(), None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        new = np.ones(len(keys), bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), len(keys))
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)]
        several = np.diff(starts) > 1
        several[[0, -1]] = True  # ranges at the ends of a batch may go on in others
        last = len(starts) - 2
        for number in np.flatnonzero(several).tolist():
            a, b = starts[number], starts[number + 1]
            own = list(zip(*(column[a:b].tolist() for column in rows), strict=True))
            if number == 0 and keys[0].as_py() == open_key:
                own = open_rows + own
            elif number == 0:
                found.scan(open_rows)
            if number == last:
                open_key, open_rows = keys[int(a)].as_py(), own
            else:
                found.scan(own)
        if len(found.rows) >= ROWS:
            yield found.handed()
    found.scan(open_rows)
    yield found.handed()


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best, best_n) of the words(id, word, n) that have a near one; ids in order of the words."""
    rows = words.select("id", "word", "n").mapInArrow(_rotations, "key string, longer boolean, added boolean, n long, id long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "longer")
    found = dealt.mapInArrow(_scan, "id long, n_near long, minus_n long, best long")
    each = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("b"))
    return each.select("id", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus_n")).alias("best_n"))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) of forms(id, form): the last word on the way; each round doubles the steps taken.

    Counts grow along a way, by a factor, so ways are short and have no loops.
    """
    now = stage(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        if not now.join(ahead, "root", "left_semi").take(1):
            return now
        now = stage(now.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")
    raise RuntimeError("the forms run in a circle")


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), each word once.

    A word's form is its near word of largest n, where that is ``factor`` times its own n or more.
    """
    ordered = stage(words, "words").orderBy("word").withColumn("id", F.monotonically_increasing_id())
    words = stage(ordered, "word-ids")
    near = stage(near_words(words), "near-words")
    held = words.join(near, "id", "left")
    form = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    held = held.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    last = roots(held.where("form is not null").select("id", "form"))
    name = lambda key, out: words.select(F.col("id").alias(key), F.col("word").alias(out))
    named = held.join(last, "id", "left").join(name("form", "form_word"), "form", "left").join(name("root", "root_word"), "root", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(documents: DataFrame) -> DataFrame:
    return group_variants(typed_words(documents))
