"""Similar lines and documents against all pairs, without any fingerprint in between."""

import random

import numpy as np
import pytest

pytest.importorskip("xxhash")
from passagemill.llm import line_dedup, minhash, quality, similar_documents, simhash_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_lines_of_similarity_are_found_without_a_fingerprint_gate(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, near = [], 0
    for i in range(300):
        base = [rng.choice(words) for _ in range(rng.randint(8, 30))]
        other = list(base)
        for k in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice((0.06, 0.12, 0.18))))):
            other[k] = rng.choice(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    lines = [t for _, t in rows]
    pairs = {(a, b) for a in range(600) for b in range(a + 1, 600) if line_dedup.similar(lines[a], lines[b], 0.8)}
    gone = {r.doc_id for r in line_dedup.digests(frame(spark, rows)).collect() if r.n_removed}
    assert len(pairs) > 200 and gone <= {b for _, b in pairs}
    near = sum(b in gone for _, b in pairs)
    print("recall", near, "of", len(pairs))
    assert near >= 0.95 * len(pairs)


@pytest.mark.parametrize("length", [29, 30, 31, 32, 36])
def test_lines_on_both_sides_of_the_border_of_gram_widths_meet(spark, length):
    """A line and the same one with letters added, each side of 32 characters, in letters of one or two bytes."""
    rng = random.Random(length)
    rows = []
    for i in range(60):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(length))
        at = rng.randrange(length)
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "x" * rng.randint(1, 3) + line[at:])]
    assert all(line_dedup.similar(a, b, 0.8) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    gone = {r.doc_id for r in line_dedup.digests(frame(spark, rows)).collect() if r.n_removed}
    assert gone <= {i for i, _ in rows if i % 2} and len(gone) >= 0.95 * 60


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", "aé漢\U0001f600"])
def test_many_lines_side_by_side_are_as_similar_as_one_by_one(letters):
    rng = random.Random(5)
    a, b = ["", "", "x"], ["", "x", ""]
    for k in range(3000):
        line = [rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 31, 62, 63, 64, 65, 127, 128, 129, 200, 300, 600]) if k % 3 else rng.randrange(1, 140))]
        other = list(line) if k % 4 else [rng.choice(letters) for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(0, len(line) // 3 + 2)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        a.append("".join(line)), b.append("".join(other))
    expected = [line_dedup.similar(x, y, 0.8) for x, y in zip(a, b, strict=True)]
    assert 300 < sum(expected) < 2900
    assert line_dedup.all_similar(a, b, 0.8) == expected


def test_long_lines_of_the_same_words_are_told_apart_by_their_segments(monkeypatch):
    """Lines that share most of their grams of three letters, so these don't tell them apart, are not compared whole."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinsrlu") for _ in range(rng.randrange(2, 9))) for _ in range(30)]
    a = [" ".join(rng.choices(words, k=150)) for _ in range(60)]
    b = [" ".join(rng.choices(words, k=150)) if k % 3 else x[:200] + "x" * (k // 2) + x[230:] for k, x in enumerate(a)]
    expected = [line_dedup.similar(x, y, 0.8) for x, y in zip(a, b, strict=True)]
    compared, whole = [], line_dedup.edit_distance
    monkeypatch.setattr(line_dedup, "edit_distance", lambda x, y, most: compared.append(x) or whole(x, y, most))
    monkeypatch.setattr(line_dedup, "LANES", 100)
    assert line_dedup.all_similar(a, b, 0.8) == expected and expected == [k % 3 == 0 for k in range(60)]
    assert len(compared) <= 30
    most = np.array([whole(x, y, 10**6) for x, y in zip(a, b, strict=True)])
    assert line_dedup.may_be_near(a, b, most).all()


def test_unlike_lines_are_settled_by_their_first_letters(monkeypatch):
    """Pairs of which more than the limit differs before their ends, as most candidates of a large bucket, are not read on."""
    rng = random.Random(61)
    words = ["".join(rng.choice("etaoinsrlu") for _ in range(rng.randrange(2, 9))) for _ in range(30)]
    line = lambda: " ".join(rng.choices(words, k=80))[:400]
    a, b = [line() for _ in range(300)], [line() for _ in range(300)]
    letters, packed = [], np.packbits
    monkeypatch.setattr(np, "packbits", lambda x, *args, **more: letters.append(len(x)) or packed(x, *args, **more))
    assert not any(line_dedup.all_similar(a, b, 0.8))
    assert 0 < sum(letters) < 0.5 * 300 * 400 * (64 + 128)


def test_lines_in_narrow_and_whole_bands_are_as_far_apart_as_they_are():
    """Letters that move by more than the first band has diagonals, in lines of one word to eight."""
    rng = random.Random(62)
    a, b = [], []
    for k in range(200):
        x = [rng.choice("abcdefghijkl\u00ff"[: 12 + k % 2]) for _ in range(rng.choice([40, 300, 330, 700, 1200, 2000]))]
        moved = rng.randrange(0, max(2, len(x) // 9))
        y = x[moved:] + [rng.choice("abc") for _ in range(moved + rng.randrange(3))]
        for _ in range(rng.randrange(0, len(x) // 40 + 1)):
            y[rng.randrange(len(y))] = "z"
        a.append("".join(x)), b.append("".join(y))
    for least in (0.7, 0.8, 0.9):
        most = np.array([int(max(len(x), len(y)) * (1 - least) + 1e-9) for x, y in zip(a, b, strict=True)])
        expected = [line_dedup.edit_distance(x, y, int(t)) <= t for x, y, t in zip(a, b, most, strict=True)]
        assert 20 < sum(expected) and line_dedup.all_similar(a, b, least) == expected


def test_links_among_large_buckets_join_the_groups_of_small_ones(spark):
    """80 items of one sketch, linked in twos by another and across by the large bucket; the least id is the root."""
    other = [bytes([i // 2] * (4 * 12)) + bytes(8) for i in range(100)]
    items = [(i, 100, bytes(4 * 12 + 8)) for i in range(10, 90)] + [(i, 100, other[i]) for i in range(100)]
    texts = spark.createDataFrame([(i, str(i)) for i in range(100)], "id long, text string")
    near = lambda a, b: int(a) // 2 == int(b) // 2 or int(a) % 20 == int(b) % 20 == 15
    table = spark.createDataFrame(items, "id long, size int, sketch binary").repartition(3)
    for many in (None, lambda a, b: [near(x, y) for x, y in zip(a, b, strict=True)]):
        pairs, large = minhash.near_pairs(table, 12, 0.8, 5)
        found = {r.id: r.root for r in minhash.groups(pairs, large, texts, near, 0.8, 5, "groups", many).collect()}
        want = {i: 14 if i % 20 in (14, 15) and 10 <= i < 90 else i // 2 * 2 for i in range(100)}
        assert {i: found.get(i, i) for i in range(100)} == want


def test_a_large_group_of_different_near_lines_is_one(spark):
    rng = random.Random(32)
    base = [f"{rng.choice('bcdfg')}{rng.getrandbits(20):x}" for _ in range(40)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(40)] = f"n{i}"
        rows.append((i, " ".join(own)))
    gone = sum(r.n_removed for r in line_dedup.digests(frame(spark, rows)).collect())
    assert gone == 399


def test_documents_of_similarity_are_linked_and_no_others(spark):
    import corpus_pipeline

    rng = random.Random(33)
    words = [f"v{k}" for k in range(5000)]
    rows = []
    for i in range(80):
        base = [rng.choice(words) for _ in range(rng.randint(60, 500))]
        other = list(base)
        for k in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice((0.005, 0.01, 0.02, 0.03))))):
            other[k] = rng.choice(words)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    near = {b for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if similar_documents.jaccard(x, y, 5) >= 0.8}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    gone = {i for i, _ in rows} - kept
    print("recall", len(gone & near), "of", len(near), "other", len(gone - near))
    assert 20 < len(near) < 80 and gone <= near and len(gone) >= 0.97 * len(near)


@pytest.mark.parametrize("keep_one", [simhash_dedup.keep_one, similar_documents.keep_one])
def test_unlike_texts_without_an_id_or_under_one_id_all_stay(spark, keep_one):
    rng = random.Random(34)
    text = lambda: " ".join(f"u{rng.getrandbits(24)}" for _ in range(40))
    rows = [(None, text()), (None, text()), (7, text()), (7, text())]
    assert sorted(r.text for r in keep_one(frame(spark, rows)).collect()) == sorted(t for _, t in rows)


def test_a_common_line_of_a_large_host_is_found(spark):
    rng = random.Random(35)
    own = lambda: " ".join(f"t{rng.getrandbits(24)}" for _ in range(15))
    banner = "subscribe to our letter to read on"
    rows = [(i, f"{own()}\n{banner}\n{own()}" if i < 30 else own()) for i in range(600)]
    rows[30] = (30, "\n".join([banner, banner, "go on now please"]))
    got = {r.doc_id: r for r in quality.assess(frame(spark, rows)).collect()}
    assert all(got[i].removed == [1] for i in range(30)) and all(not got[i].removed for i in range(31, 600))
    assert got[30].depleted or got[30].removed == [0, 1]


@pytest.mark.parametrize("cell", [7, 8192])
def test_a_large_bucket_loses_no_link_that_no_pivot_has(spark, monkeypatch, cell):
    """200 items of one sketch, of which only each two neighbours pass the test."""
    monkeypatch.setattr(minhash, "CELL", cell)
    sketch = bytes(4 * 12 + 8)
    items = spark.createDataFrame([(i, 100, sketch) for i in range(200)], "id long, size int, sketch binary").repartition(3)
    texts = spark.createDataFrame([(i, str(i // 2)) for i in range(200)], "id long, text string")
    pairs, large = minhash.near_pairs(items, 12, 0.8, 5)
    found = minhash.links(pairs, large, texts, lambda a, b: a == b, 0.8, 5, "neighbours")
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, i + 1) for i in range(0, 200, 2)]


def test_documents_of_near_fingerprints_are_candidates(spark):
    """The near-dedup stage goes through SimHash: equal fingerprints, and those within 4 bits, meet."""
    a, b, c = 0b1011, 0b1011 ^ 0b11110000, 0x7FFF << 40
    classes = spark.createDataFrame([(5, a), (3, a), (9, b), (7, c)], "id long, fp long")
    assert sorted(tuple(r) for r in similar_documents.fingerprint_pairs(classes).collect()) == [(3, 5), (3, 9)]


@pytest.mark.parametrize("passing, links", [(True, 199), (False, 0)])
def test_a_cell_hands_on_links_and_not_all_its_pairs(passing, links):
    import pyarrow as pa

    n = 200
    columns = [[7] * n, [0] * n, [0] * n, list(range(n)), [9] * n, [5] * n, list(range(n)), [False] * n, [False] * n, [[7]] * n, ["text"] * n]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.string()]
    names = ["key", "low", "high", "id", "size", "check", "root", "other", "pivot", "keys", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    for many in (None, lambda a, b: [passing] * len(a)):
        out = list(minhash._cells(0.8, 5, lambda a, b: passing, many)(iter([batch.slice(0, 90), batch.slice(90)])))
        assert sum(b.num_rows for b in out) == links
