"""Phrase collocation mining with stripes.

A stripe is a prefix of words with an associative counter of the words that come next. A task fills the
stripes of a block of texts; stripes of equal prefixes are then merged elementwise. One merged stripe tells
the frequent extensions of its prefix and how often the most frequent one stands (its maximum), by which
shorter phrases are dropped. Stripes of the empty prefix count the words of each language, which their total
adds up; their frequent extensions are the prefixes of the next level, with these counts as their totals, and
so on up to the longest phrase. A phrase can only be frequent if its first and its last
words but one are, so a level passes over all other places: the frequent phrases of the level below are
broadcast as a bit map of BITS bits, whatever their number. It may let others through, which are counted then
and dropped by their count, so nothing is lost.

Stripes of hot prefixes (above 1/HOT_SHARE of all words, so fewer than HOT_SHARE of them) are cut into parts
by hash of the next word; a part holds about as much as the largest other stripe. Their counts, known from
the level below, are broadcast: they are the totals of their parts.

Handling: null lang counts as ``und``, null text as empty, doc_id is not read. Repeated rows count again. Ties
of score go to the larger count, then to the phrase's bytes. A text is one task's work and is held once; an
empty table gives no rows. Of further columns none is read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mix, pair, stage, trim

#: Words gathered into a block of stripes.
BLOCK_WORDS = 1_500_000
#: Hot prefixes: their share of all words, and the least count.
HOT_SHARE, HOT_LEAST = 16_384, 200_000
#: Bits of the map of frequent phrases.
BITS = 27
BREAK = b"\xff"
#: Lower-case A-Z; the characters that end a piece become a byte that no UTF-8 text has.
TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
STRIPE = "lang string, prefix string, part int, nexts array<string>, counts array<long>"
NAMES = ["lang", "prefix", "part", "nexts", "counts"]


def _hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seeds = {lang: xxh64_intdigest(lang.encode()) >> 1 for lang in set(langs)}
    return np.array([xxh64_intdigest(word, seeds[lang]) for lang, word in zip(langs, words, strict=True)], np.uint64)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class _Words(dict):
    """Numbers of a language's words from a count that all languages share; 0 for the end of a piece."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes]):
        super().__init__({BREAK: 0})
        self.lang, self.langs, self.words = lang, langs, words

    def __missing__(self, word: bytes) -> int:
        self.langs.append(self.lang)
        self.words.append(word)
        value = self[word] = len(self.words) - 1
        return value


class Block:
    """The word numbers of some texts, 0 behind each piece."""

    def __init__(self):
        self.langs, self.words = [""], [b""]
        self.known: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = text.translate(TABLE).replace(BREAK, b" \xff ").split()
        words = self.known.get(lang)
        if words is None:
            words = self.known[lang] = _Words(lang, self.langs, self.words)
        self.parts += [np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)), np.zeros(1, np.int64)]
        self.size += len(tokens) + 1

    def stripes(self, level: int, frequent: np.ndarray | None, hot: dict[tuple[str, str], int], parts: int) -> pa.RecordBatch:
        """The stripes of prefixes of level - 1 words; parts: into how many the empty one is cut."""
        ids = np.concatenate(self.parts)
        n, hashes = len(ids), _hashes(self.langs, self.words)
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        langs = pa.array(self.langs, pa.string())
        deal = (hashes >> np.uint64(16)).astype(np.int64)
        if level == 1:
            # One prefix a language; its parts are told apart by the words' hashes.
            distinct, counts = np.unique(ids[ids > 0], return_counts=True)
            part = deal[distinct] % parts
            lang = langs.dictionary_encode().indices.to_numpy()[distinct]
            order = np.lexsort((part, lang))
            distinct, counts, part, lang = distinct[order], counts[order], part[order], lang[order]
            new = np.flatnonzero(np.diff(lang, prepend=-1) | np.diff(part, prepend=-1))
            prefix = pa.array([""] * len(new), pa.string())
            return _batch(langs.take(pa.array(distinct[new])), prefix, part[new], new, words.take(pa.array(distinct)), counts)
        # Where a phrase of level - 1 words begins that may be frequent, and another one a word behind it.
        whole, marks = ids > 0, hashes[ids]
        for k in range(1, level - 1):
            behind = np.append(ids[k:], np.zeros(k, np.int64))
            whole &= behind > 0
            marks = pair(marks, hashes[behind])
        bits = _places(marks, len(frequent).bit_length() + 2)
        may = whole & (frequent[bits >> 3] >> (bits & 7) & 1).astype(bool)
        behind = np.append(ids[level - 1 :], np.zeros(level - 1, np.int64))
        at = np.flatnonzero(may & (behind > 0) & np.append(may[1:], False))
        # Phrases are numbered word by word; the values of each step spell them out again.
        grams, steps, low = ids[at], [], 0xFFFFFFFF
        for k in range(1, level - 1):
            values, grams = np.unique(grams << 32 | ids[at + k], return_inverse=True)
            steps.append(values)
        keys, counts = np.unique(grams << 32 | behind[at], return_counts=True)
        nexts, gram = keys & low, keys >> 32
        new = np.flatnonzero(np.diff(gram, prepend=-1))
        first, rest = gram[new], []
        for values in reversed(steps):
            packed = values[first]
            first, rest = packed >> 32, [packed & low, *rest]
        prefix, lang = words.take(pa.array(first)), langs.take(pa.array(first))
        for word in rest:
            prefix = pc.binary_join_element_wise(prefix, words.take(pa.array(word)), " ")
        part = np.zeros(len(keys), np.int64)
        if hot:
            cut = np.array([hot.get(key, 1) for key in zip(lang.to_pylist(), prefix.to_pylist(), strict=True)], np.int64)
            stripe = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
            part = deal[nexts] % cut[stripe]
            order = np.lexsort((part, stripe))
            nexts, counts, part, stripe = nexts[order], counts[order], part[order], stripe[order]
            new = np.flatnonzero(np.diff(stripe, prepend=-1) | np.diff(part, prepend=-1))
            lang, prefix = lang.take(pa.array(stripe[new])), prefix.take(pa.array(stripe[new]))
        return _batch(lang, prefix, part[new], new, words.take(pa.array(nexts)), counts)


def _batch(lang: pa.Array, prefix: pa.Array, part: np.ndarray, starts: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.append(starts, len(counts)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([lang, prefix, pa.array(part, pa.int32()), *lists], NAMES)


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal (lang, prefix, part), which follow one another, as one: counts of equal words are added."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(3):
        column = batch.column(k)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(new)
    lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
    stripe = np.repeat(np.cumsum(new) - 1, lengths)
    coded = batch.column(3).flatten().dictionary_encode()
    keys, inverse = np.unique(stripe << 32 | coded.indices.to_numpy(), return_inverse=True)
    sums = np.bincount(inverse, weights=batch.column(4).flatten().to_numpy(), minlength=len(keys)).astype(np.int64)
    starts = np.searchsorted(keys >> 32, np.arange(len(rows)))
    lang, prefix, part = (batch.column(k).take(pa.array(rows)) for k in range(3))
    return _batch(lang, prefix, part.to_numpy(), starts, coded.dictionary.take(pa.array(keys & 0xFFFFFFFF)), sums)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0] if whole.num_rows else parts[0]


def _merge(least: int):
    """Stripes in order of their key to merged ones: total, maximum, and the extensions of ``least`` or more."""

    def done(stripes: pa.RecordBatch) -> pa.RecordBatch:
        counts, nexts = stripes.column(4).flatten().to_numpy(), stripes.column(3).flatten()
        offsets = stripes.column(3).offsets.to_numpy() - stripes.column(3).offsets[0].as_py()
        stripe = np.repeat(np.arange(stripes.num_rows), np.diff(offsets))
        totals = np.bincount(stripe, weights=counts, minlength=stripes.num_rows).astype(np.int64)
        kept = np.flatnonzero(counts >= least)
        most = np.zeros(stripes.num_rows, np.int64)
        np.maximum.at(most, stripe[kept], counts[kept])
        starts = np.searchsorted(stripe[kept], np.arange(stripes.num_rows))
        out = _batch(stripes.column(0), stripes.column(1), stripes.column(2).to_numpy(), starts, nexts.take(pa.array(kept)), counts[kept])
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(totals), pa.array(most)], [*NAMES, "total", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            stripes = _merged(batch if held is None else _joined([held, batch]))
            yield done(stripes.slice(0, stripes.num_rows - 1)) if stripes.num_rows > 1 else done(stripes.slice(0, 0))
            held = _joined([stripes.slice(stripes.num_rows - 1)])
        if held is not None:
            yield done(held)
        trim()

    return run


def merged_stripes(documents: DataFrame, level: int, least: int, frequent, hot: dict[tuple[str, str], int]) -> DataFrame:
    """(lang, prefix, part, nexts, counts, total, most): stripes of prefixes of level - 1 words.

    frequent: a broadcast bit map of the phrases of level - 1 words that may be frequent (None at level 1).
    """
    known = documents.sparkSession.sparkContext.broadcast(hot)
    parts = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)

        def cut(block: Block) -> Iterator[pa.RecordBatch]:
            whole = block.stripes(level, bits, known.value, parts)
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)
            trim()

        block = Block()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if text.is_valid:
                    block.add("und" if lang is None else lang, text.as_py())
                if block.size >= BLOCK_WORDS:
                    yield from cut(block)
                    block = Block()
        if block.size:
            yield from cut(block)

    rows = documents.select("lang", "text").mapInArrow(run, STRIPE)
    key = ["lang", "prefix", "part"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge(least), f"{STRIPE}, total long, most long")


def phrases(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, f): the frequent extensions of merged stripes."""
    each = stripes.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    word = F.col("e.nexts")
    phrase = F.when(F.col("prefix") == "", word).otherwise(F.concat_ws(" ", "prefix", word))
    return each.select("lang", phrase.alias("phrase"), F.col("e.counts").alias("f"))


def _bit_map(frequent: DataFrame):
    """The broadcast bit map of phrases: at most 2^21 words of 64 bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            if not rows:
                continue
            marks = _hashes(langs, [row[0] for row in rows])
            for k in range(1, len(rows[0])):
                marks = pair(marks, _hashes(langs, [row[k] for row in rows]))
            bits = _places(marks, BITS)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << (BITS - 6), np.int64)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(held.astype("<i8").tobytes())


def with_count(rows: DataFrame, phrase: Column, counts: DataFrame, name: str, hot_above: int) -> DataFrame:
    """rows with the count of a phrase; counts(lang, phrase, f) of hot phrases are broadcast, the rest joined."""
    hot = counts.where(F.col("f") > hot_above).select("lang", F.col("phrase").alias("__phrase"), F.col("f").alias("__hot"))
    rows = rows.withColumn("__phrase", phrase).join(F.broadcast(hot), ["lang", "__phrase"], "left")
    # A hot phrase needs no partner, so its rows are dealt anywhere: no phrase has a space at its end.
    anywhere = F.concat(F.xxhash64(*[c for c in rows.columns if not c.startswith("__")]).cast("string"), F.lit(" "))
    rows = rows.withColumn("__phrase", F.when(F.col("__hot").isNull(), F.col("__phrase")).otherwise(anywhere))
    rest = counts.where(F.col("f") <= hot_above).select("lang", F.col("phrase").alias("__phrase"), F.col("f").alias("__f"))
    return rows.join(rest, ["lang", "__phrase"], "left").withColumn(name, F.coalesce("__hot", "__f")).drop("__phrase", "__hot", "__f")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a^2 / (l r)) in decimals, exact for counts below 10^15."""
    return F.expr(f"(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * 1000000BD) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))").cast("long")


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language.

    Phrases of ``least`` occurrences or more are candidates; one goes if a longer candidate around it has
    ``covered`` per cent of its count or more. The score is floor(1,000,000 a^2 / (l r)) of the worst cut.
    """
    stripes = {1: stage(merged_stripes(documents, 1, least, None, {}), "stripes-1")}
    per_lang = stage(stripes[1].groupBy("lang").agg(F.sum("total").alias("n")), "words-of-languages")
    words = per_lang.agg(F.sum("n")).first()[0] or 0
    above = max(words // HOT_SHARE, HOT_LEAST)
    counts = {1: phrases(stripes[1])}
    for level in range(2, longest + 1):
        hot = {(r["lang"], r["phrase"]): -(-r["f"] // above) for r in counts[level - 1].where(F.col("f") > above).collect()}
        stripes[level] = stage(merged_stripes(documents, level, least, _bit_map(counts[level - 1]), hot), f"stripes-{level}")
        counts[level] = phrases(stripes[level])

    def cut(size: int) -> tuple[Column, Column]:
        parts = F.split("phrase", " ")
        return F.array_join(F.slice(parts, 1, size), " "), F.array_join(F.slice(parts, size + 1, longest), " ")

    found = []
    for level in range(2, longest + 1):
        rows = counts[level].withColumnRenamed("f", "a")
        worst = []
        for size in range(1, level):
            first, rest = cut(size)
            rows = with_count(rows, first, counts[size], f"l{size}", above)
            rows = with_count(rows, rest, counts[level - size], f"r{size}", above)
            worst.append(F.struct(score_of("a", f"l{size}", f"r{size}").alias("score"), F.lit(size).alias("size"), F.col(f"l{size}").alias("l"), F.col(f"r{size}").alias("r")))
        rows = rows.withColumn("w", F.array_min(F.array(*worst))).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
        if level < longest:
            # A phrase inside a longer candidate is inside one with a word more, at its start or at its end.
            ahead = stripes[level + 1].where("most > 0").select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("around"))
            behind = counts[level + 1].select("lang", cut(1)[1].alias("phrase"), F.col("f").alias("around"))
            around = ahead.unionByName(behind).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
            rows = rows.join(around, ["lang", "phrase"], "left").where(F.expr(f"around is null or 100 * around < {covered} * a")).drop("around")
        found.append(rows)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of each 64th of a language first, so that no task sorts a whole language.
    some = Window.partitionBy("lang", "__deal").orderBy(*order)
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
