"""The pipeline against a plain version of its five stages on a small corpus."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tokenizers import Tokenizer  # noqa: E402

from passagemill.llm import decontaminate, line_dedup, quality, similar_documents  # noqa: E402
from passagemill.llm.queries import tokenizer_path  # noqa: E402


def corpus():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "e", "io", "ou", "an", "ent", "ar", "il", "os", "um")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = [line(25), line(12)]
    banner = line(8)
    docs = []
    for i in range(60):
        own = [line(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
        own.insert(1, banner)
        if i % 9 == 0:
            own[0] += " " + item[i % 2] + " " + line(3)
        docs.append([i, "\n".join(own), "en", f"host{i % 2}", 0])
    near = docs[3][1].split("\n")
    docs += [[100 + k, "\n".join([*near[:-1], near[-1] + " " + line(1)]), "en", "host0", 0] for k in range(4)]
    docs += [[200, None, "en", "host0", 0], [201, "", "en", "host1", 0], [202, "too short", "en", "host1", 0], [203, docs[7][1], "en", None, 0], [204, "same words here " * 30, "fr", "host0", 0]]
    for d in docs:
        d[4] = len(d[1] or "")
    return [tuple(d) for d in docs], list(enumerate(item))


def groups(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {k: find(k) for k in keys}


def plain(docs, items):
    # 8: rules and common lines of a host
    seen = defaultdict(set)
    split = lambda t: [(no, b" ".join(line.lower().split())) for no, line in enumerate((t or "").encode().split(b"\n"))]
    for _, t, _, host, _ in docs:
        for _, line in split(t):
            seen[host, line].add(t)
    out = []
    for i, t, _, host, _ in docs:
        words = (t or "").split()
        if len(words) < 10 or 100 * quality.repeated_words([w.encode() for w in words], 5) > 20 * len(words):
            continue
        gone = {no for no, line in split(t) if line and len(seen[host, line]) > 10}
        left = [line for no, line in enumerate(t.split("\n")) if no not in gone]
        if gone and 100 * len(" ".join(left).split()) < 20 * len(words):
            continue
        out.append((i, "\n".join(left)))
    # 9: similar lines
    keys, places = {}, []
    for i, t in out:
        for no, line in split(t):
            if line:
                places.append((i, no, keys.setdefault(line.decode(), len(keys))))
    lines = list(keys)
    linked = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if line_dedup.similar(lines[a], lines[b], 0.8)]
    group, first, gone = groups(range(len(lines)), linked), set(), defaultdict(set)
    for i, no, k in sorted(places):
        if group[k] in first:
            gone[i].add(no)
        first.add(group[k])
    out = [(i, "\n".join(line for no, line in enumerate(t.split("\n")) if no not in gone[i])) for i, t in out]
    # 10: near-duplicate documents
    texts = dict(out)
    ids = sorted(texts)
    group = groups(ids, [(a, b) for a in ids for b in ids if a < b and similar_documents.jaccard(texts[a], texts[b], 5) >= 0.8])
    out = [(i, t) for i, t in out if group[i] == i]
    # 6: benchmark passages
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [decontaminate.words_of(t)] for k in range(len(w) - 9)}
    cut = []
    for i, t in out:
        w, hit = decontaminate.words_of(t), set()
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in windows:
                hit |= set(range(k, k + 10))
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k, k + 1))
        cut.append((i, decontaminate.cut_spans(t, spans) if spans else t))
    return cut


def test_pipeline_gives_what_the_plain_version_gives(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    kept = plain(docs, items)
    for i, t in kept:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        for piece, start in enumerate(range(0, n, 4096)):
            want[i, piece, start, min(4096, n - start)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert len(kept) < len(docs)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 4096 for parts in by.values())


def test_stages_keep_the_columns_of_documents(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
