"""Each operator against a brute-force version on hand-made rows with nulls, blanks, ties and repeats."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from passagemill.llm import chat_format, decontaminate, line_dedup, lm_score, packing, quality, simhash_dedup, token_store, tokenize, toxicity, warc_index  # noqa: E402
from passagemill.llm.components import components  # noqa: E402
from passagemill.llm.shared import fresh_path  # noqa: E402
from passagemill.llm.tokenize import PieceEncoder  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, fp int, block int, hash int"


def frame(spark, rows, source="s1"):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, "en", source, len(t or ""), "x", 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sample_rows():
    rng = random.Random(5)
    words = "the of and river stone Mill wheel été große water turns, slowly. under 12 old-bridge near town's gate".split(" ")
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, t.replace("slowly.", "slowly.\n")) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, "   "), (103, rows[0][1]), (104, rows[0][1]), (104, rows[0][1]), (None, "a text without an id"), (105, " ".join(rng.choice(words) for _ in range(6000)))]
    return rows


EMPTY = []


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    alphabet = ["a", "b", ".", "'", " ", "\n", "\t", "\x1c", "\x85", "1", "é", "\u0308", "<", "|", "Σ", "word", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(50)) for _ in range(300)]
    texts += ["", " ", "  a  b \n\n", "<|endoftext|> x", "it's 12 3.4 don't", "ΑΣ'α e\u0301. <\u0338", "x" * 5000]
    for path in (BYTE, WORD):
        own, whole = PieceEncoder(path, memo=50), Tokenizer.from_file(path)
        for t in texts:
            assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_with_marks_and_letters_of_odd_normal_form():
    rng = random.Random(3)
    alphabet = ["a", "B", "\u0130", "\u01c5", "\u0308", "\u0301", "-", ".", "_", " ", "\n", "\n\n", "1", "\u00bd", "\u03a3", "\u0958", "\u05d0", "\u05b0", "\ud55c", "'s", "<|endoftext|>", "word", " the", "\u2126", "\u212a", "\ufb01", "\u00a0", "\u3000", "\u2009", "\x00", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    texts += [f"{c}{p}" for c in "\u0130\u01c5\u0958" for p in "-._, \n"]
    for path in (BYTE, WORD):
        own, whole = PieceEncoder(path, memo=60), Tokenizer.from_file(path)
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            for t, ids in zip(some, own.slice_ids([t.encode() for t in some]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_parted_without_a_trace(monkeypatch):
    monkeypatch.setattr(tokenize, "SLICE", 50)
    text = "It's a long text of words, numbers 12 and\nlines; " * 40 + "x" * 200 + " the end"
    for path in (BYTE, WORD):
        assert len(tokenize.parts(text.encode())) > 10
        ids = next(tokenize.encoded(path, pa.array([text]), b""))
        assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_that_need_more_bytes_are_refused():
    ids = struct.pack("<2I", 70_000, 1)
    with pytest.raises(ValueError):
        token_store.pack_segment([1], [2], ids, 2)
    assert token_store.Segment(memoryview(token_store.pack_segment([1], [2], ids, 4))).document(0).tolist() == [70_000, 1]


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (5, 5), (700, 900), (3000, 10**6)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_store.EliasFano.encode(values, top)
        assert ef.all().tolist() == values.tolist()
        assert [ef.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    with pytest.raises(IndexError):
        ef.select(n)


def test_token_store_round_trip(spark):
    rows = [r for r in sample_rows() if r[0] is not None] + [(None, "nul id")]
    got = {}
    for r in token_store.encode_corpus(spark, frame(spark, rows), BYTE).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    whole = Tokenizer.from_file(BYTE)
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        assert (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) in got[doc]
        start += len(ids)
    path = token_store.write_store(frame(spark, rows), fresh_path(spark, "small-segments"), BYTE, width=4, segment_ids=300)
    again = {}
    for r in token_store.read_store(spark, path).collect():
        again.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(x[1:] for x in v) for k, v in again.items()} == {k: sorted(x[1:] for x in v) for k, v in got.items()}
    assert sorted(x[0] for v in again.values() for x in v)[-1] == sorted(x[0] for v in got.values() for x in v)[-1]
    assert token_store.encode_corpus(spark, frame(spark, EMPTY), BYTE).count() == 0


def test_packing_is_whole_and_tight(spark):
    cap = 64
    cut = packing.pieces(frame(spark, sample_rows()), WORD, capacity=cap)
    places = packing.pack(cut.drop("ids"), cap).collect()
    whole, wanted = Tokenizer.from_file(WORD), Counter()
    for doc, text in sample_rows():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), cap)):
            own = ids[at : at + cap]
            wanted[doc, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    digests = packing.packed_digests(frame(spark, sample_rows()), WORD, cap).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in digests) == wanted
    assert len(places) == cut.count()
    by = defaultdict(list)
    for p in places:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(by) <= math.ceil(sum(p.length for p in places) / cap * 1.15) + 1
    assert packing.packed_digests(frame(spark, EMPTY), WORD).count() == 0


def test_packing_plan_keeps_every_piece():
    rng = random.Random(2)
    for _ in range(50):
        cap = rng.choice([7, 30, 100])
        histogram = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 300)))
        plan = packing.plan(dict(histogram), cap)
        used = Counter()
        for n, content in plan:
            assert sum(x * c for x, c in content) <= cap
            for x, c in content:
                used[x] += n * c
        assert used == +histogram


def test_sequences_hold_the_ids(spark):
    cut = packing.pieces(frame(spark, sample_rows()[:20]), WORD, capacity=64)
    places = packing.pack(cut.drop("ids"), 64)
    total = sum(len(r.ids) // 4 for r in packing.sequences(cut, places).collect())
    assert total == sum(len(r.ids) // 4 for r in cut.collect())


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    rows = [r for r in sample_rows() if r[0] is not None]
    got = simhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    assert all(r.fp % 2**64 == fp[r.doc_id] for r in got)
    ids = sorted(fp)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash_dedup.near_duplicates(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("plan", [None, [(list(range(0, 32)), 2), (list(range(32, 64)), 1)], [(list(range(0, 20)), 0), (list(range(20, 42)), 1), (list(range(42, 64)), 1)]])
def test_links_keep_all_components(spark, plan):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {0} | set(centres)
    for c in centres[:5]:
        for _ in range(150):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash_dedup.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, plan)
    pairs = [(r.a, r.b) for r in links.collect()]
    u = lambda x: x % 2**64
    assert all((u(a) ^ u(b)).bit_count() <= 4 for a, b in pairs)
    want = brute_components(signed, [(a, b) for a in signed for b in signed if a < b and (u(a) ^ u(b)).bit_count() <= 4])
    assert brute_components(signed, pairs) == want


def test_thresholds_add_up():
    flips, sample = np.full(64, 0.5), np.arange(50, dtype=np.uint64)
    for parts in range(2, 6):
        grouped = simhash_dedup.group_bits(50, np.full((64, 64), 25.0), parts)
        assert sorted(b for p in grouped for b in p) == list(range(64))
        for n in (10, 10**6, 10**10):
            _, t = simhash_dedup.allocate(grouped, 4, n, flips, sample)
            assert sum(t) == 4 - parts + 1 and min(t) >= -1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert {n: got.get(n, n) for n in nodes} == want


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}x" for k in range(200)]
    common = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(30):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(4)]
        lines.append(rng.choice(common).replace("w5x", "w6x", rng.randint(0, 1)).upper() + " " * (i % 3))
        words = rng.choice(common).split()
        words[rng.randrange(40)] = "changed"
        lines += [" ".join(words), "", "| | | | | a", "short line"]
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, rows[0][1])]
    found = {r.doc_id: r.removed for r in line_dedup.digests(frame(spark, rows)).collect()}
    keys, places = {}, []
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            words = line.encode().lower().split()
            if words:
                places.append((i, no, keys.setdefault(b" ".join(words).decode(), len(keys))))
    lines = list(keys)
    linked = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if line_dedup.similar(lines[a], lines[b], 0.8)]
    assert linked
    group, seen, gone = brute_components(range(len(lines)), linked), set(), defaultdict(list)
    for i, no, k in sorted(places):
        if group[k] in seen:
            gone[i].append(str(no))
        seen.add(group[k])
    assert found == {i: ",".join(gone[i]) for i, _ in rows}
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert kept[50].text is None and len(kept) == len(rows) and kept[5].n_chars == len(kept[5].text)
    assert line_dedup.digests(frame(spark, EMPTY)).count() == 0


def test_edit_distance():
    rng = random.Random(7)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most, want = rng.randint(0, 12), plain(a, b)
        got = line_dedup.edit_distance(a, b, most)
        assert line_dedup.may_be_similar(a, b, want) and line_dedup.may_be_similar(a, b, want + 1)
        assert got == want if want <= most else got > most


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(6)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([14, 12, 25, 3, 1, 10])] + [(9, None), (10, "!!"), (11, None)]
    items[4] = (4, "solitary")
    rows = [(i, " ".join(rng.choice([*vocabulary, "solitary", "other", "Beta-Gamma"]) for _ in range(60)) + " " + rng.choice(items[:6])[1].title() + ". end") for i in range(30)]
    rows += [(40, None), (41, "..."), (42, items[2][1] + " " + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: decontaminate.words_of(t)
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(k)
    want = {}
    for i, t in rows:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    ids |= windows[tuple(w[a : a + n])]
                    hit[a : a + n] = [True] * n
        want[i] = (len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest())
    for size in (10**6, 20):  # one automaton, and several
        found = decontaminate.contamination(frame(spark, rows), benchmark, automaton_words=size).collect()
        got = {r.doc_id: (r.n_words, sum(b - a for a, b in r.spans), len(set(r["items"]))) for r in found}
        assert got == {i: v[:3] for i, v in want.items()}
    digest = {r.doc_id: r.items_sha256 for r in decontaminate.digests(frame(spark, rows), benchmark).collect()}
    assert digest == {i: v[3] for i, v in want.items()}
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, rows), benchmark).collect()}
    assert clean == {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, rows), benchmark, automaton_words=20).collect()}
    assert len(clean) == len(rows) and clean[40] is None and "solitary" not in "".join(t or "" for t in clean.values())
    assert decontaminate.digests(frame(spark, EMPTY), benchmark).count() == 0
    none = decontaminate.digests(frame(spark, rows), benchmark.limit(0)).collect()
    assert not any(r.contaminated for r in none)


def test_quality_measures_and_common_lines(spark):
    rng = random.Random(10)
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    banner = "Accept all cookies to go on reading"
    rows = [(i, f"{own(30)}\n{banner}\n{own(12)}") for i in range(40)] + [(50, f"{banner}\n{banner.upper()} \n{banner}\ngo on"), (51, None), (52, "a b"), (53, "one two three four five six " * 20)]
    rows += [(60 + k, "a copied text of more than ten words that stands here " + "many times over") for k in range(30)]
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows)).collect()}
    assert all(got[i].kept and got[i].removed == [1] for i in range(40))
    assert got[50].depleted and not got[50].kept
    assert got[51].base_failed and got[51].n_words == 0
    assert got[52].base_failed and got[53].n_repeat_words == 120 and got[53].base_failed
    assert all(got[60 + k].kept for k in range(30)), "copies of one text are one document"
    kept = {r.doc_id: r for r in quality.apply_rules(frame(spark, rows)).collect()}
    assert set(kept) == {*range(40), *range(60, 90)} and banner not in kept[3].text and kept[3].n_chars == len(kept[3].text)
    assert quality.assess(frame(spark, EMPTY)).count() == 0


def test_repeated_words_against_counting():
    rng = random.Random(11)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert quality.repeated_words(words, 5) == len(hit)


def counted_model(texts: list[list[bytes]], order: int):
    """p(word, context) by plain counting."""
    grams = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    after, kinds, discount = Counter(), Counter(), {}
    for g, n in grams.items():
        after[g[:-1]] += n
        kinds[g[:-1]] += 1
    for k in range(2, order + 1):
        ones, twos = (sum(len(g) == k and n == m for g, n in grams.items()) for m in (1, 2))
        discount[k] = ones / (ones + 2 * twos) if ones else 0.5

    def p(word, context):
        if not context:
            return (grams[(word,)] + 1) / (after[()] + kinds[()] + 1)
        lower = p(word, context[1:])
        if not after[context]:
            return lower
        d = discount[len(context) + 1]
        return max(grams[*context, word] - d, 0) / after[context] + d * kinds[context] / after[context] * lower

    return p, grams


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("share", [1000, 20])
def test_language_model_matches_counting(spark, monkeypatch, order, share):
    """With a share of 20, many words and n-grams are hot."""
    rows = sample_rows()
    monkeypatch.setattr(lm_score, "HOT_SHARE", share)
    got = defaultdict(list)
    for r in lm_score.score(frame(spark, rows), block_words=150, bucket_words=100, order=order).collect():
        got[r.doc_id].append(r)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    texts = [lm_tokens(t) for i, t in rows if not held(i)]
    p, grams = counted_model(texts, order)
    for i, t in rows:
        w = lm_tokens(t)
        base = sum(math.log10(p(x, ())) for x in w)
        score = sum(math.log10(p(x, tuple(w[max(0, k - order + 1) : k]))) for k, x in enumerate(w))
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(grams[(x,)] > 0 for x in w), sum(map(len, texts)))
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert sum(map(len, got.values())) == len(rows)
    assert lm_score.score(frame(spark, EMPTY), order=order).count() == 0


def test_language_model_adds_up_to_one():
    """The arcs and the failure arcs of each state share all of its mass, over all words and an unknown one."""
    rng = random.Random(8)
    texts = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 12))] + [b"\n"] for _ in range(30)]
    p, _ = counted_model(texts, 3)
    for context in [(), (b"a",), (b"a", b"b"), (b"z", b"c"), (b"d", b"d")]:
        assert sum(p(w, context) for w in (b"a", b"b", b"c", b"d", b"\n", b"unseen")) == pytest.approx(1)


@pytest.mark.parametrize("segment", [1, 3, 7, 512])
def test_segments_are_entered_in_the_state_of_the_whole_text(segment):
    """A block that learns from all of its texts, walked in segments of any length, against counting."""
    rng = random.Random(9)
    lengths = np.array([1, 2, 3, 40, 300, 1, 9])
    ids = np.concatenate([[*(rng.randint(1, 5) for _ in range(n - 1)), lm_score.END] for n in lengths]).astype(np.uint32)
    hashes = np.arange(1, 7, dtype=np.uint64)
    flags = np.array([True, True, True, True, False, True, False])
    levels = lm_score._levels(ids, lengths, flags, hashes, 4)
    ends = np.cumsum(lengths)
    texts = [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
    p, grams = counted_model([t for t, f in zip(texts, flags) if f], 4)
    kinds = [np.bincount(x.context, x.counts > 0, minlength=len(below.key)).astype(np.int64) for below, x in zip(levels, levels[1:])]
    rates = [((x.counts == 1).sum(), (x.counts == 2).sum()) for x in levels[1:]]
    discounts = [a / (a + 2 * b) if a else 0.5 for a, b in rates]
    model = lm_score.Model(int(levels[0].counts.sum()), int((levels[0].counts > 0).sum()), discounts, [], [])
    arcs = lm_score.automaton(levels, [x.counts for x in levels], kinds, model)
    want = [math.log10(p(x, tuple(t[max(0, k - 3) : k]))) for t in texts for k, x in enumerate(t)]
    assert lm_score.traverse(arcs, ids, lengths, segment) == pytest.approx(want)


def test_base_counts_of_quality_against_counting(spark):
    rng = random.Random(14)
    parts = ["word", "#tag", "a*b", "$5", "100%", "x&y", "<b>", "|", "été", "\u00a0x", "\t", "\n", "\n\n", " ", "same line\n", "\x0b", "\x85y"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (None, "a b"), (7, "again")]
    import re

    want = []
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines))))
    got = quality.assess(frame(spark, rows, source=None)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_ftrl_against_a_plain_version():
    rng = random.Random(15)
    rows = [(np.unique([0, *(rng.randrange(1, 40) for _ in range(8))]), rng.randint(0, 1)) for _ in range(300)]
    model, z, n = toxicity.Ftrl(), defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == 0 else model.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for at, label in rows:
        model.learn(at, label)
        w = {i: weight(i) for i in at.tolist()}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at.tolist():
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    at, w = model.sparse()
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx({i: weight(i) for i in sorted(z) if i == 0 or abs(z[i]) > model.l1})


def test_toxicity_learns_and_is_blind_to_held_out_labels(spark):
    rng = random.Random(12)
    calm, harsh = [f"calm{k}" for k in range(80)], ["nasty", "vile", "awful"]
    rows = [(i, " ".join(rng.choice(calm) for _ in range(20)) + (" " + rng.choice(harsh) + "!" if i % 4 == 0 else "")) for i in range(600)] + [(700, None), (701, "")]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(600)] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, rows), labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert 0 <= got[700].score <= 1 and got[700].score == got[701].score
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(toxicity.held_out()).unionByName(labels.where(~toxicity.held_out()))
    again = {r.doc_id: r.score for r in toxicity.classify(frame(spark, rows), flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert toxicity.classify(frame(spark, EMPTY), labels).count() == 0
    assert {r.score for r in toxicity.classify(frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.5}


def test_warc_round_trip(spark):
    rows = [(1, "http://A.example.org/x?b=2&a=1", "<p>one</p>"), (2, "https://www.a.example.org/x?a=1&b=2#f", "<p>one</p>"), (3, "http://b.org", None), (4, None, ""), (5, "http://b.org/\r\nX: y", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (6, "http://c.org/é%0A", "é" * 5000), (None, "http://d.org", "<p>one</p>"), (1, "http://d.org", "<p>one</p>")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    got = warc_index.archive(spark, pages).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.url_key, r.date, r.page_id is not None, r.page_id or 0)
    assert [key(r) for r in got] == sorted(map(key, got))
    one = hashlib.sha1(b"<p>one</p>").digest()
    import base64

    for r in got:
        if r.payload_digest == base64.b32encode(one).decode():
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 2 else ("revisit", 2))
            assert r.payload_bytes == 10
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0} == {(3, "revisit", 4), (4, "response", None)}
    assert len({r.url_key for r in got if r.page_id in (1, 2)}) == 2
    keys = {r.page_id: r.url_key for r in got}
    assert keys[6] == warc_index.url_key("http://c.org/é%0A") and keys[5] == warc_index.url_key("http://b.org/%0D%0AX: y")
    kept = warc_index.capture_index(spark, warc_index.write_archives(pages, fresh_path(spark, "w"), min_payload=1)).collect()
    assert [r.record_type for r in kept if r.payload_bytes == 0] == ["response", "response"]
    assert warc_index.archive(spark, pages.limit(0)).count() == 0


def test_warc_digests_match_a_plain_version(spark):
    import base64

    rng = random.Random(40)
    bodies = ["", "<p>a</p>", "b" * 70_000, "é\r\n\r\nWARC/1.1\r\n", "<html>"]
    rows = [(k, f"http://h{k % 3}.org/{k}%20x", rng.choice(bodies) if k % 7 else f"own {k}") for k in range(120)]
    keeper = {}
    for k, _, html in rows:
        keeper[html] = max(k, keeper.get(html, -1))
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {(k, len(h.encode()), sha(h), "response" if keeper[h] == k else "revisit", None if keeper[h] == k else keeper[h]) for k, _, h in rows}
    path = warc_index.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), fresh_path(spark, "w"))
    got = warc_index.capture_index(spark, path)
    assert {tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want
    text = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert text.count(b"WARC-Target-URI: http://h1.org/1%20x\r\n") == 1


def test_archives_are_cut_by_bytes_and_not_by_the_mean_of_pages(spark, monkeypatch):
    """The large pages come one behind the other, so as many pages as go into an archive on average would be too many."""
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 20_000)
    rows = [(k, f"http://a.org/{k}", f"{k} " + "x" * (50 if k < 300 else 50_000 if k == 330 else 6000)) for k in range(340)]
    path = warc_index.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_path(spark, "w"))
    archives = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("path like '%/part-%'").collect()]
    assert sum(len(x) > 20_000 for x in archives) == 1 and max(map(len, archives)) < 51_000
    assert sum(x.count(b"WARC-Target-URI: ") for x in archives) == 340 and len(archives) < 40
    assert sorted(r.page_id for r in warc_index.capture_index(spark, path).collect()) == list(range(340))


def test_loser_tree_merges():
    rng = random.Random(13)
    for k in (0, 1, 2, 5, 33):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_chat_formatting(spark):
    says = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be: brief"), (1, 1, "user", None), (1, 2, "assistant", says), (1, 3, "assistant", "\\n#<:\n\n"), (2, 0, "user", says), (2, 1, "assistant", ""), (3, 5, None, "x"), (None, 0, "assistant", "é𝄞"), (1, 2, "assistant", says)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(table)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_the_loss_mask_stands_on_the_text_itself():
    says = ["turn", "n", "u", " ", ">", "", "</turn>", "assistant", "### ", ": ", "ok", "0", "1", "\n"]
    turns = [t for k, x in enumerate(says) for t in (("user", x), ("assistant", x), *[("assistant", "again")] * (k % 2))]
    for escaped in (chat_format.escape, None):
        out = chat_format.render(turns, chat_format.turn_template)
        spans, lost = chat_format.loss_spans(out, turns, "assistant", chat_format.turn_template, escaped)
        want, at = [], 0
        for role, text in turns:
            start = at + len(f"### {role}: ")
            at = start + len(chat_format.escape(text)) + len(" </turn>\n")
            if role == "assistant":
                want.append((start, start + len(chat_format.escape(text))))
        assert spans == want and not lost


def test_very_long_conversations_and_texts(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(600)] + [(2, 0, "assistant", "x#\n" * 200_000)]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1].formatted[a:b] for a, b in zip(got[1].loss_starts, got[1].loss_ends)] == [f"turn {k}" for k in range(1, 600, 2)]
    assert chat_format.unescape(got[2].formatted[got[2].loss_starts[0] : got[2].loss_ends[0]]) == rows[-1][3]
    assert not got[1].rewrites and not got[1].unmasked


def test_rewriting_templates_are_found():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 or r != 'assistant' else '(cut)'}\n" for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "long thought"), ("user", "b")]
    out = chat_format.render(turns, last_only)
    assert out.rewrites == [2] and out.text == last_only(turns)
    assert chat_format.loss_spans(out, turns, "assistant", last_only, lambda t: t) == ([], [1])
    plain = chat_format.render(turns, chat_format.turn_template)
    assert plain.rewrites == [] and plain.spans[-1][1] == len(plain.text)
    assert chat_format.parse(plain.text) == turns
