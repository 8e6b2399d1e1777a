"""Language-model scoring with a weighted backoff automaton of n-grams (order 3 as default).

Model. For each length k from 2 on, with D the discount n1 / (n1 + 2 n2) of the n-grams of that length,
c(hw) the count of one, c(h) that of its context h, T(h) the number of distinct words after h, and h'
the context without its first word, all over training texts:

    p(w | h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) * p(w | h'),    p(w) = (c(w) + 1) / (N + V + 1)

which adds up to 1 over the known words and one unknown word. Every training n-gram below the order is a
state, the n-grams that it begins are its arcs, and its failure arc leads to its longest proper suffix
with weight D T(h) / c(h). A text is scored in one left-to-right traversal that carries the state: along
an arc where there is one, else over failure arcs until there is one; the root has an arc for each word.
A state depends on the last words alone (order - 1 of them), so a long text is cut into segments, each
entered that many words early, and the segments of a block are walked side by side.

Jobs. The corpus is written once as blocks of a few MB: word ids local to the block and the words'
64-bit hashes. A block sends its distinct n-grams to buckets by hash; a bucket adds up equal ones of all
blocks and answers each block with totals in the order asked. An n-gram goes to the bucket of its
context, where it names it by its place, so only hashes of words are sent. Nothing of the size of the
vocabulary or the model is broadcast or collected: a block builds the part of the automaton that its
texts can reach from the answers to its own questions. Contexts that hold over a thousandth of all words
would swell one bucket; what they begin is dealt by n-gram, and their sums (a thousand rows a length at
most) are joined on the driver.

Hashes have 64 bits. Among a hundred million distinct words the chance that any two share one is
about 3 in 10,000; such two would share a count. The words after one context are told apart by 48 of
the bits: for a context with a million of them, any two agree with a chance of 2 in 1,000.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, pair, release, stage, task_id, trim

#: Words gathered into a block, and the share of all words above which a context is hot.
BLOCK_WORDS, HOT_SHARE = 2_000_000, 1000
#: Words in a bucket, on average.
BUCKET_WORDS = 2_000_000
END, ORDER = 0, 3
#: Words of a segment, of which many are walked side by side.
SEGMENT = 512
#: The end of a text, as a word of the vocabulary.
END_HASH = np.uint64(0x2545F4914F6CDD1D)


def _squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _wide(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _six(hashes: np.ndarray) -> bytes:
    """Six of the eight bytes of each: enough to tell the words after one context apart."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1
        return value


def _blocks(modulus: int, held: int, limit: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        docs: list[int | None] = []
        lengths: list[int] = []
        train: list[bool] = []
        parts: list[np.ndarray] = []
        words, size = _Vocabulary(), 0

        def close() -> pa.RecordBatch:
            hashes = np.array([int(END_HASH), *(xxh64_intdigest(w) for w in words)], np.uint64)
            ids = np.concatenate(parts)
            flags = np.array(train, bool)
            levels = _levels(ids, np.array(lengths), flags, hashes, max(1, order - 1))
            learnt, busy = int(levels[0].counts.sum()), []
            for k, level in enumerate(levels):
                at = np.flatnonzero(level.counts * HOT_SHARE >= max(1, learnt))
                busy += zip([k] * len(at), level.key[at].view(np.int64).tolist(), level.counts[at].tolist(), strict=True)
            row = [[task_id()], [docs], [lengths], [flags.tobytes()], [_squeezed(ids)], [hashes.tobytes()], [learnt], *([[b[j] for b in busy]] for j in range(3))]
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), longs, longs, pa.binary(), pa.binary(), pa.binary(), pa.int64(), longs, longs, longs]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = (text.as_py() or "").encode().lower().split()
                parts.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
                parts.append(np.zeros(1, np.uint32))
                docs.append(doc)
                lengths.append(len(own) + 1)
                train.append(zlib.crc32(str("" if doc is None else doc).encode()) % modulus != held)
                size += len(own) + 1
                if size >= limit:
                    yield close()
                    for x in (docs, lengths, train, parts, words):
                        x.clear()
                    size = 0
        if docs:
            yield close()

    return run


BLOCK = "block long, docs array<long>, lengths array<long>, train binary, ids binary, hashes binary, n_train long, busy_level array<long>, busy array<long>, busy_n array<long>"


@dataclass
class Level:
    """The distinct n-grams of one length in a block, by context and last word.

    Contexts and suffixes (without the first word) are numbers in the level below; place[i] is the number
    of the n-gram that ends at position i, -1 where the text has too few words before it.
    """

    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    key: np.ndarray
    counts: np.ndarray
    place: np.ndarray


def _levels(ids: np.ndarray, lengths: np.ndarray, flags: np.ndarray, hashes: np.ndarray, order: int) -> list[Level]:
    learnt = np.repeat(flags, lengths)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    none = np.zeros(0, np.int32)
    words = np.arange(len(hashes), dtype=np.int32)
    levels = [Level(none, words, none, hashes, np.bincount(ids[learnt], minlength=len(hashes)), ids.astype(np.int32))]
    while len(levels) < order:
        below = levels[-1]
        at = 1 + np.flatnonzero(~first[1:] & (below.place[:-1] >= 0))
        distinct, inverse = np.unique(below.place[at - 1].astype(np.uint64) << np.uint64(32) | ids[at], return_inverse=True)
        context, word = (distinct >> np.uint64(32)).astype(np.int32), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int32)
        suffix, place = np.empty(len(distinct), np.int32), np.full(len(ids), -1, np.int32)
        suffix[inverse], place[at] = below.place[at], inverse
        counts = np.bincount(inverse[learnt[at]], minlength=len(distinct))
        levels.append(Level(context, word, suffix, pair(below.key[context], hashes[word]), counts, place))
    return levels


@dataclass
class Deal:
    """How a level's questions are dealt to buckets; made alike when asking and when scoring.

    order: the n-grams by bucket, context and word; bucket: of each of them; starts: where the runs of one
    context begin; name: a run's context as its place among the bucket's questions of the level below, or
    -1 - its place among the hot ones.
    """

    order: np.ndarray
    bucket: np.ndarray
    starts: np.ndarray
    name: np.ndarray


def _heat(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted hot ones, -1 where it is not among them."""
    if not len(hot):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return np.where(hot[at] == keys, at, -1)


def _deals(levels: list[Level], hot: list[np.ndarray], buckets: int) -> list[Deal]:
    deals, home, rank = [], np.zeros(0, np.int32), np.zeros(0, np.int32)
    for k, level in enumerate(levels):
        away = ((level.key if k else mix(level.key)) % np.uint64(buckets)).astype(np.int32)
        heat = _heat(levels[k - 1].key, hot[k - 1])[level.context] if k else None
        to = np.where(heat >= 0, away, home[level.context]) if k else away
        order = np.argsort(to, kind="stable")
        bucket = to[order]
        starts = name = np.zeros(0, np.int64)
        if k and len(order):
            context = level.context[order]
            starts = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])]))
            own = heat[order[starts]]
            name = np.where(own >= 0, -1 - own, rank[context[starts]])
        deals.append(Deal(order, bucket, starts, name))
        home, rank = to, np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order)) - np.searchsorted(bucket, bucket)
    return deals


def _of_block(row: dict) -> tuple[np.ndarray, ...]:
    lengths = np.array(row["lengths"], np.int64)
    return _wide(row["ids"], np.uint32), lengths, np.frombuffer(row["train"], bool), np.frombuffer(row["hashes"], np.uint64)


def _buckets_of(deals: list[Deal]) -> list[int]:
    return np.unique(np.concatenate([d.bucket for d in deals])).tolist()


#: The arrays hold a value for each length of n-grams from 2 on; counts holds one for words too. Places of
#: contexts rise, so their differences are stored.
QUESTION = "bucket int, block long, words binary, counts array<binary>, contexts array<binary>, runs array<binary>, followers array<binary>"


def _questions(hot: list[np.ndarray], buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = pa.list_(pa.binary())
        kinds = [pa.int32(), pa.int64(), pa.binary(), *[several] * 4]
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, flags, hashes = _of_block(row)
                levels = _levels(ids, lengths, flags, hashes, order)
                deals, out = _deals(levels, hot, buckets), []
                for b in _buckets_of(deals):
                    words, counts, contexts, runs, followers = b"", [], [], [], []
                    for k, (level, deal) in enumerate(zip(levels, deals, strict=True)):
                        low, high = np.searchsorted(deal.bucket, [b, b + 1])
                        own = deal.order[low:high]
                        counts.append(_squeezed(level.counts[own].astype(np.uint32)))
                        if not k:
                            words = hashes[own].tobytes()
                            continue
                        some = slice(*np.searchsorted(deal.starts, [low, high]))
                        contexts.append(_squeezed(np.diff(deal.name[some], prepend=0).astype(np.int32)))
                        runs.append(_squeezed(np.diff(np.append(deal.starts[some], high)).astype(np.uint32)))
                        followers.append(_six(hashes[level.word[own]]))
                    out.append((b, row["block"], words, counts, contexts, runs, followers))
                for at in range(0, len(out), 64):
                    columns = zip(*out[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in QUESTION.split(", ")])
        trim()

    return run


ANSWER = "block long, bucket int, totals array<binary>, kinds array<binary>, hot array<long>, hot_t array<long>, known long, ones array<long>, twos array<long>"


def _sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of rows that agree in all keys, and the sum of each group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group, counts, minlength=int(new.sum())).astype(np.int64)


def _answers(hot: list[np.ndarray]):
    """Hot contexts are numbered through all levels in ``hot`` of an answer."""

    def run(key, held):
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        split = lambda values, parts: np.split(values, np.cumsum([len(x) for x in parts])[:-1])
        told = {c: held[c].to_pylist() for c in ("counts", "contexts", "runs", "followers")}
        u4 = lambda c, k: [_wide(x[k], np.uint32).astype(np.int64) for x in told[c]]
        words = [np.frombuffer(x, np.uint64) for x in held["words"].to_pylist()]
        group, total = _sums([join(words)], join(u4("counts", 0)))
        known, asked = int((total > 0).sum()), words
        totals = [[_squeezed(x.astype(np.uint64)) for x in split(total[group], asked)]]
        kinds, ones, twos, hot_at, hot_t = [], [], [], [], []
        for k, busy in enumerate(hot):
            begin = np.cumsum([0, *map(len, asked)])[:-1]
            names = [np.cumsum(_wide(x[k], np.int32), dtype=np.int64) for x in told["contexts"]]
            lengths = u4("runs", k)
            at = join([np.where(n >= 0, n + b, n) for n, b in zip(names, begin, strict=True)])
            context = len(total) - 1 - at
            context[at >= 0] = group[at[at >= 0]]
            asked = [_eight(x[k]) for x in told["followers"]]
            left = np.repeat(context, join(lengths))
            below, (group, total) = len(total), _sums([left, join(asked)], join(u4("counts", k + 1)))
            of = np.zeros(len(total), np.int64)
            of[group] = left
            t = np.bincount(of, total > 0, minlength=below + len(busy)).astype(np.int64)
            totals.append([_squeezed(x.astype(np.uint32)) for x in split(total[group], asked)])
            kinds.append([_squeezed(x.astype(np.uint32)) for x in split(t[context], names)])
            ones.append(int((total == 1).sum())), twos.append(int((total == 2).sum()))
            warm = np.flatnonzero(t[below:])
            hot_at += (warm + sum(map(len, hot[:k]))).tolist()
            hot_t += t[below:][warm].tolist()
        rows, none = [], [0] * len(hot)
        for k, block in enumerate(held["block"].to_pylist()):
            sums = ([], [], 0, none, none) if k else (hot_at, hot_t, known, ones, twos)
            rows.append((block, held["bucket"][0].as_py(), [x[k] for x in totals], [x[k] for x in kinds], *sums))
        longs, several = pa.list_(pa.int64()), pa.list_(pa.binary())
        types = [pa.int64(), pa.int32(), several, several, longs, longs, pa.int64(), longs, longs]
        trim()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in ANSWER.split(", ")])

    return run


@dataclass
class Model:
    """What is global and small: training words, distinct ones, discounts, hot contexts and their T."""

    words: int
    known: int
    discounts: list[float]
    hot: list[np.ndarray]
    hot_t: list[np.ndarray]


@dataclass
class Arcs:
    """The automaton's n-grams of one length: weights (log10) of the arcs that they are and of their failure
    arcs as states, their suffixes, and at each position the arc that ends there, -1 where there is none."""

    weight: np.ndarray
    failure: np.ndarray
    suffix: np.ndarray
    ending: np.ndarray


def automaton(levels: list[Level], totals: list[np.ndarray], kinds: list[np.ndarray], model: Model) -> list[Arcs]:
    """The part of the automaton that the block's texts can reach; kinds are T of each level's n-grams."""
    out, prob = [], (totals[0] + 1.0) / (model.words + model.known + 1)
    for k, (level, total) in enumerate(zip(levels, totals, strict=True)):
        if k:
            context = np.maximum(totals[k - 1], 1)[level.context]
            prob = np.maximum(total - model.discounts[k - 1], 0) / context + share[level.context] * prob[level.suffix]
        there = total > 0
        if k < len(kinds):
            # A state without a successor is the end of a text, which nothing follows.
            share = np.where(there & (kinds[k] > 0), model.discounts[k] * kinds[k] / np.maximum(total, 1), 1.0)
        failure = np.log10(share) if k < len(kinds) else np.zeros(0)
        ending = np.where((level.place >= 0) & there[level.place], level.place, -1) if len(total) else level.place
        # Of the words, unknown ones too have an arc of the root.
        out.append(Arcs(np.log10(np.where(there, prob, 1.0) if k else prob), failure, level.suffix, ending))
    return out


def traverse(arcs: list[Arcs], words: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The weight of each position of the texts, walked left to right with the state carried along."""
    deepest = len(arcs) - 1
    pieces = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), pieces)
    begin = np.cumsum(lengths) - lengths
    low = begin[text] + segment * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    high = np.minimum(low + segment, begin[text] + lengths[text])
    enter = np.maximum(low - deepest, begin[text])
    longest = np.argsort(enter - high, kind="stable")
    low, high, enter = low[longest], high[longest], enter[longest]
    out = np.zeros(len(words))
    state, depth = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    left = len(low)
    for step in range(int((high - enter).max(initial=0))):
        left = int(np.searchsorted(enter[:left] - high[:left], -step, "left"))
        at = enter[:left] + step
        now, deep, weight = state[:left], depth[:left], np.zeros(left)
        open_, to, to_depth = np.ones(left, bool), np.zeros(left, np.int64), np.zeros(left, np.int64)
        for k in range(deepest, 0, -1):
            here = np.flatnonzero(open_ & (deep == k))
            arc = arcs[k].ending[at[here]]
            some, arc = here[arc >= 0], arc[arc >= 0]
            weight[some] += arcs[k].weight[arc]
            to[some] = arcs[k].suffix[arc] if k == deepest else arc
            to_depth[some] = min(k + 1, deepest)
            open_[some] = False
            failed = here[open_[here]]
            weight[failed] += arcs[k - 1].failure[now[failed]]
            if k > 1:
                now[failed] = arcs[k - 1].suffix[now[failed]]
            deep[failed] = k - 1
        root = np.flatnonzero(open_)
        word = words[at[root]]
        weight[root] += arcs[0].weight[word]
        known = (arcs[0].ending[at[root]] >= 0) & (word != END) & (deepest > 0)
        to[root], to_depth[root] = np.where(known, word, 0), known
        state[:left], depth[:left] = to, to_depth
        own = at >= low[:left]
        out[at[own]] = weight[own]
    return out


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model, buckets: int, order: int):
    def run(key, own, answers):
        row = own.to_pylist()[0]
        ids, lengths, flags, hashes = _of_block(row)
        levels = _levels(ids, lengths, flags, hashes, order)
        deals = _deals(levels, model.hot, buckets)
        told = {a["bucket"]: a for a in answers.to_pylist()}
        all_of = lambda c, k, kind: np.concatenate([_wide(told[b][c][k], kind) for b in _buckets_of(deals)]).astype(np.int64)
        totals, kinds = [], []
        for k, (level, deal) in enumerate(zip(levels, deals, strict=True)):
            total = np.zeros(len(level.key), np.int64)
            total[deal.order] = all_of("totals", k, np.uint32 if k else np.uint64)
            totals.append(total)
            if k:
                t = np.zeros(len(levels[k - 1].key), np.int64)
                t[level.context[deal.order[deal.starts]]] = all_of("kinds", k - 1, np.uint32)
                heat = _heat(levels[k - 1].key, model.hot[k - 1])
                t[heat >= 0] = model.hot_t[k - 1][heat[heat >= 0]]
                kinds.append(t)
        arcs = automaton(levels, totals, kinds, model)
        begin = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, begin)
        known, base = add((totals[0] > 0)[ids].astype(np.int64)), add(arcs[0].weight[ids])
        columns = [pa.array(row["docs"], pa.int64()), pa.array(~flags), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model.words)), pa.array(base), pa.array(add(traverse(arcs, ids, lengths)))]
        trim()
        return pa.Table.from_arrays(columns, [c.split()[0] for c in SCORE.split(", ")])

    return run


def score(documents: DataFrame, modulus: int = 7, held: int = 2, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS, order: int = ORDER) -> DataFrame:
    """documents(doc_id, text) scored by the model of those whose crc32(doc_id) % modulus is not held.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). A null text
    is empty and has its end alone; a null doc_id hashes as the empty text; repeated rows are learnt
    and scored one by one; an empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    blocks = stage(documents.select("doc_id", "text").mapInArrow(_blocks(modulus, held, block_words, order), BLOCK), "lm-blocks")
    words = blocks.agg(F.sum("n_train").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all")).first()
    n = words["n"] or 0
    busy = blocks.select(F.explode(F.arrays_zip("busy_level", "busy", "busy_n")).alias("b")).groupBy(F.col("b.busy_level").alias("level"), F.col("b.busy").alias("key"))
    # At most HOT_SHARE n-grams of a length can each be a share of 1 / HOT_SHARE of all.
    busy = busy.agg(F.sum("b.busy_n").alias("n")).where(F.col("n") * HOT_SHARE >= n).collect()
    hot = [np.sort(np.array([r.key for r in busy if r.level == k], np.int64).view(np.uint64)) for k in range(order - 1)]
    buckets = max(1, -(-(words["all"] or 0) // bucket_words))
    questions = blocks.mapInArrow(_questions(hot, buckets, order), QUESTION)
    answers = stage(questions.groupBy("bucket").applyInArrow(_answers(hot), ANSWER), "lm-answers")
    release(spark)
    sums = answers.agg(F.sum("known").alias("known"), *(F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in ("ones", "twos") for k in range(order - 1))).first()
    zipped = answers.select(F.explode(F.arrays_zip("hot", "hot_t")).alias("h")).groupBy(F.col("h.hot").alias("at"))
    hot_t = np.zeros(sum(map(len, hot)), np.int64)
    for r in zipped.agg(F.sum("h.hot_t").alias("t")).collect():
        hot_t[r["at"]] = r.t
    rates = [(sums[f"ones{k}"] or 0, sums[f"twos{k}"] or 0) for k in range(order - 1)]
    discounts = [ones / (ones + 2 * twos) if ones else 0.5 for ones, twos in rates]
    model = Model(n, sums["known"] or 0, discounts, hot, np.split(hot_t, np.cumsum([len(h) for h in hot])[:-1]))
    return blocks.groupBy("block").cogroup(answers.select("block", "bucket", "totals", "kinds").groupBy("block")).applyInArrow(_scores(model, buckets, order), SCORE)
