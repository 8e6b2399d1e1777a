"""Phrases, spelling variants and BPE against brute-force versions, with nulls, blanks, ties, repeats and hot keys."""

import hashlib
import random
import re
import string
import struct
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from passagemill.llm import bpe, collocations, spelling  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Columns that bear the names of the operators' own.
SCHEMA = "doc_id long, text string, lang string, prefix string, nexts long, n long, key string, ids binary, word int, part int, total int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "k", b"", 3, 4, 5) for i, t, lang in rows], SCHEMA).repartition(parts)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Phrases


def plain_collocations(rows, longest=3, least=10, covered=50, top=2000):
    totals, counts = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    around = Counter()
    for p, a in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i : i + k])
                around[inner] = max(around[inner], a)
    out = {}
    for p, a in candidates.items():
        if p in around and 100 * around[p] >= covered * a:
            continue
        cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[:1] + p[k:]]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), counts[p[:k]], counts[p[:1] + p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["Of", "the", "mill", "WHEEL", "river", "Été", "a-b", "x y", "old", "stone"]
    weights = [30, 40, 8, 8, 8, 4, 4, 4, 4, 4]
    text = lambda n: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for w in rng.choices(words, weights, k=n))
    rows = [(i, text(rng.randint(0, 80)), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, " \t ", "de"), (102, " \t ", "de"), (None, text(30), "en"), (103, text(4000), "fr")]
    return rows + [(104, "grind stone mill. " * 12, "de"), (105, "ties here, ties there; " * 11, "de")]


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 5, 80, 2000)])
def test_phrases_match_counting(spark, longest, least, covered, top):
    rows = phrase_rows()
    out = collocations.collocations(frame(spark, rows), longest, least, covered, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, longest, least, covered, top)


def test_phrases_with_hot_prefixes_and_many_blocks(spark, monkeypatch):
    """Hot stripes are cut into parts and blocks are small; the rows stay the same."""
    monkeypatch.setattr(collocations, "HOT_LEAST", 40)
    monkeypatch.setattr(collocations, "HOT_SHARE", 100)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 50)
    rows = phrase_rows(4)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows, 5)).collect())) == plain_collocations(rows)


def test_a_full_bit_map_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 7)
    rows = phrase_rows(5)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == plain_collocations(rows)


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(frame(spark, [], 1)).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "one two", "en")])).collect() == []


def test_scores_of_large_counts_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.randint(10**11, 10**13) + rng.randint(0, 9), rng.randint(10**13, 10**14), rng.randint(10**13, 10**14)) for _ in range(500)]
    out = spark.createDataFrame(rows, "a long, l1 long, r1 long").select(collocations.score_of("a", "l1", "r1").alias("s")).collect()
    assert [r.s for r in out] == [10**6 * a * a // (x * y) for a, x, y in rows]


# Spelling


def edits(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet} | {a + c + b[1:] for a, b in cuts if b for c in alphabet}
    return found - {word}


def plain_groups(counts, factor=5):
    alphabet = set("".join(counts))
    near = {w: [v for v in edits(w, alphabet) if v in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def random_counts(seed, size=400, letters="abéz"):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([5, 5, 6, 30, 200, 5000]) for _ in range(size)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_match_brute_force(spark, seed):
    counts = random_counts(seed)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert in_order(spelling.group_variants(rows).collect()) == plain_groups(counts)


def test_near_words_about_the_length_at_which_keys_are_hashed(spark):
    rng = random.Random(4)
    counts = {}
    for n in [*range(spelling.LONG - 5, spelling.LONG + 5), 500, 20_000]:
        word = "".join(rng.choice("ab") for _ in range(n))
        for at in (0, n // 2, n - 1):
            for other in (word[:at] + word[at + 1 :], word[:at] + "c" + word[at + 1 :], word[:at] + "a" + word[at:]):
                counts[other] = rng.choice([5, 25, 130])
        counts[word] = 700
    held = {w: n for w, n in counts.items() if len(w) < 1000}
    long = {w: n for w, n in counts.items() if len(w) >= 1000}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = in_order(spelling.group_variants(rows).collect())
    assert [r for r in found if len(r[0]) < 1000] == plain_groups(held)
    assert {r[0]: r[1] for r in found if r[0] in long and r[3] < 140} == {w: next(v for v, n in long.items() if n == 700) for w, n in long.items() if n < 140}


def test_ranges_may_cross_batches(spark):
    counts = {f"{a}{b}bcdef": 5 + ord(a) for a in string.ascii_lowercase for b in "xyz"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert in_order(spelling.group_variants(rows).collect()) == plain_groups(counts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_lose_letters_as_asked(spark):
    rng = random.Random(8)
    words = ["Grinding", "grinding", "MÜHLE×rad", "wheelwright", "ÀÉÎÕÜß", "short", "sluices", "x9sluices"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + rng.choice([".", "1", "_", "日本"]), "en") for i in range(300)]
    rows += [(None, "sluices " * 9, "en"), (7, None, "en"), (8, "", "en"), (9, "wheelwright " * 300_000, "en")]
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = frame(spark, rows)
    assert {r.word: r.n for r in spelling.typed_words(docs).collect()} == counts
    assert in_order(spelling.spelling_groups(docs).collect()) == plain_groups(counts)
    assert spelling.spelling_groups(frame(spark, [], 1)).collect() == []


def test_ways_lead_to_the_last_form(spark):
    ways = [(i, i + 1) for i in range(20)] + [(100 + i, 7) for i in range(50)]
    found = {r.id: r.root for r in spelling.roots(spark.createDataFrame(ways, "id long, form long")).collect()}
    assert found == {i: 20 for i, _ in ways}
    with pytest.raises(RuntimeError):
        spelling.roots(spark.createDataFrame([(1, 2), (2, 1)], "id long, form long"), 5)


# BPE


def odd_texts():
    rng = random.Random(2)
    pool = ["the ", "don't", "I'LL ", "été", "é", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "<|endof", "  ", "\n", "\t", "123", "日本語", "🙂", "👩‍👩‍👧", " ", "ﬁ", "x", "Zz", "---", "\x00", "aaaaa", "क्षि", "</w>"]
    return [None, "", " ", *("".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(400)), "mill" * 30_000, "a " * 600_000]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_and_texts_are_those_of_the_library(spark, path):
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    texts = odd_texts()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (None, "no id", "en")]
    decoded = bpe.decode(bpe.encode(frame(spark, rows), path), path)
    found = sorted(map(tuple, bpe.digests(decoded).collect()), key=str)
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert bpe.encode(frame(spark, [], 1), path).collect() == []


def plain_merges(merges, word):
    """Merge the leftmost pair of lowest rank until there is none, looking at every pair each time."""
    symbols = merges.symbols(word)
    while True:
        ranked = [(merges.rules[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.rules]  # noqa: B905
        if not ranked:
            return symbols
        i = min(ranked)[1]
        symbols[i : i + 2] = [merges.rules[symbols[i], symbols[i + 1]][1]]


def test_trees_merge_the_leftmost_lowest_rank():
    rng = random.Random(6)
    merges = bpe.Merges(WORD)
    words = ["".join(rng.choice("aehinrstou") for _ in range(rng.randint(1, 90))) for _ in range(600)] + ["", "a", "ab", "aaaa" * 16, "a" * 65]
    expected = [plain_merges(merges, w) if w else [] for w in words]
    assert merges.encode_all(words) == expected
    assert [merges.encode(w) if w else [] for w in words] == expected


def test_the_root_is_the_least_key():
    rng = random.Random(7)
    for n in (1, 2, 3, 8, 13):
        keys = [rng.randrange(50) for _ in range(n)]
        tree = bpe.PairTree(list(keys))
        for _ in range(60):
            assert tree.least() == min(keys)
            at, key = rng.randrange(n), rng.choice([rng.randrange(50), bpe.NONE])
            keys[at] = key
            tree.put(at, key)
