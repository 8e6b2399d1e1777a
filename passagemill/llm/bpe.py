"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A pre-token is a row of symbols. Leaf i of its tree holds the merge rank of the pair that begins at symbol
i, with i behind it, so the root is the least rank and, among equals, the leftmost place. A merge changes
three leaves (the pair itself, the one before it and the one that its right symbol began), each in
logarithmic time; the word is done when the root holds no rank. Words of up to WIDE symbols are merged many
at a time, one merge of each word's tree a step, with the trees as rows of an array; longer ones and a few
words alone one by one.

Everything about a vocabulary (merges, end-of-word mark, added tokens, normal form, splitting rule) is read
from its file; normal forms and splitting are the tokenizers library's own parts. Equal pieces of text have
equal ids, so each task keeps a bounded memo of pieces (see tokenize).

Nulls: a null text counts as empty and has no ids; a null doc_id stays null. Repeated rows give repeated
rows; an empty table gives an empty one. Of further columns none is read or kept, so their names may clash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenize import SLICE, PieceEncoder, parts

#: No pair.
NONE = 1 << 62
#: Symbols of a word up to which trees are rows of an array.
WIDE = 64
#: Bytes of results that a task holds before it hands them on.
HELD = 4_000_000


class PairTree:
    """The least of ``keys`` at the root, with changes of single ones."""

    def __init__(self, keys: list[int]):
        self.width = width = 1 << max(0, (len(keys) - 1).bit_length())
        tree = [NONE] * width + keys + [NONE] * (width - len(keys))
        for at in range(width - 1, 0, -1):
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
        self.tree = tree

    def least(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        tree, at = self.tree, at + self.width
        tree[at] = key
        while at > 1:
            other = tree[at ^ 1]
            if other < key:
                key = other
            at >>= 1
            if tree[at] == key:
                return
            tree[at] = key


class Merges:
    """The merge rules of a vocabulary file."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only BPE without byte fallback, continuation marks or whole-word look-up")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.unknown = model.get("unk_token")
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, rule in enumerate(model["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.rules[self.ids[left], self.ids[right]] = rank, self.ids[left + right]

        # The same rules for arrays: pairs in order, with a pair above all others at the end.
        pairs = sorted((left << 32 | right, *rule) for (left, right), rule in self.rules.items())
        self.pairs, self.ranks, self.merged = (np.array([*column, last], np.int64) for column, last in zip(zip(*pairs, strict=True), (NONE, 0, 0), strict=True))

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's characters; the last one bears the end-of-word mark."""
        ids = self.ids
        try:
            return [*map(ids.__getitem__, word[:-1]), ids[word[-1] + self.suffix]]
        except KeyError:
            if self.unknown is not None:
                raise ValueError("characters outside the vocabulary with an unknown token are not supported") from None
        return [ids[c] for c in [*word[:-1], word[-1] + self.suffix] if c in ids]

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        symbols = self.symbols(word)
        n, rules = len(symbols), self.rules
        if n < 2:
            return symbols
        shift = n.bit_length()
        mask = (1 << shift) - 1

        def key(at: int, after: int) -> int:
            rule = rules.get((symbols[at], symbols[after]))
            return NONE if rule is None else rule[0] << shift | at

        tree = PairTree([key(at, at + 1) for at in range(n - 1)])
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        while (best := tree.least()) != NONE:
            at = best & mask
            gone = behind[at]
            symbols[at] = rules[symbols[at], symbols[gone]][1]
            symbols[gone] = -1
            after = behind[at] = behind[gone]
            if gone < n - 1:
                tree.put(gone, NONE)
            if after < n:
                before[after] = at
                tree.put(at, key(at, after))
            else:
                tree.put(at, NONE)
            if before[at] >= 0:
                tree.put(before[at], key(before[at], at))
        return [s for s in symbols if s >= 0]


    def encode_all(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for number, word in enumerate(words):
            if 2 <= len(word) <= WIDE:
                classes.setdefault(1 << (len(word) - 1).bit_length(), []).append(number)
            elif word:
                out[number] = self.encode(word)
        for width, numbers in classes.items():
            own = [words[n] for n in numbers]
            found = self.encode_rows(own, width) if len(own) > width else map(self.encode, own)
            for number, ids in zip(numbers, found, strict=True):
                out[number] = ids
        return out

    def encode_rows(self, words: list[str], width: int) -> list[list[int]]:
        """The ids of words of at most ``width`` symbols, a power of two; row by row a tree of pairs."""
        rows = [self.symbols(word) for word in words]
        symbols = np.full((len(rows), width + 1), -1, np.int64)
        for row, own in zip(symbols, rows, strict=True):
            row[: len(own)] = own
        symbols = symbols.ravel()
        behind = np.tile(np.arange(1, width + 2), len(rows))
        before = np.tile(np.arange(-1, width), len(rows))
        trees = np.full((len(rows), 2 * width), NONE, np.int64)

        def keys(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            pair = np.where(right < 0, NONE - 1, symbols[left] << 32 | right)
            place = np.searchsorted(self.pairs, pair)
            return np.where(self.pairs[place] == pair, self.ranks[place] * width + at, NONE)

        def put(row: np.ndarray, at: np.ndarray, key: np.ndarray | int) -> None:
            node = row * (2 * width) + width + at
            flat[node] = key
            base, at = row * (2 * width), width + at
            for _ in range(width.bit_length() - 1):
                at = at >> 1
                flat[base + at] = np.minimum(flat[base + 2 * at], flat[base + 2 * at + 1])

        at = np.arange(len(rows) * (width + 1)).reshape(-1, width + 1)[:, :-1]
        trees[:, width:] = keys(at, symbols[at + 1], np.arange(width))
        for level in range(width.bit_length() - 2, -1, -1):
            first = 1 << level
            trees[:, first : 2 * first] = np.minimum(trees[:, 2 * first : 4 * first : 2], trees[:, 2 * first + 1 : 4 * first : 2])
        flat, live = trees.ravel(), np.arange(len(rows))
        while True:
            best = flat[live * (2 * width) + 1]
            live, best = live[best != NONE], best[best != NONE]
            if not len(live):
                break
            base, at = live * (width + 1), best % width
            gone = behind[base + at]
            symbols[base + at] = self.merged[np.searchsorted(self.pairs, symbols[base + at] << 32 | symbols[base + gone])]
            symbols[base + gone] = -1
            after = behind[base + at] = behind[base + gone]
            put(live, np.minimum(gone, width - 1), NONE)
            # Behind the last symbol of a row stands -1, in its place ``width`` at the latest.
            held = np.minimum(after, width)
            before[base + held] = at
            put(live, at, keys(base + at, np.where(after > width, -1, symbols[base + held]), at))
            some = np.flatnonzero(before[base + at] >= 0)
            row, base, at = live[some], base[some], at[some]
            first = before[base + at]
            put(row, first, keys(base + first, symbols[base + at], first))
        return [row[row >= 0].tolist() for row in symbols.reshape(-1, width + 1)]


class TreeEncoder(PieceEncoder):
    """PieceEncoder, whose pieces get their ids from segment trees."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        super().__init__(path)

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of pieces in the memo; the words of all pieces are merged together."""
        words: list[str] = []
        held: list[list[int | None]] = []
        for piece in pieces:
            word = piece[1:] if piece[:1] == b" " else piece
            form = None
            if self.direct and word.isalpha():
                form = word.lower().decode() if self.lowers else piece.decode().replace(" ", self.letters[32])
            elif self.direct and word[:1].isalpha() | (word[:1] >= b"\xc3"):
                form = self.form(piece.decode())
            own = [form] if form else self.split(piece.decode())
            held.append([w if isinstance(w, int) else None for w in own])
            words += [w for w in own if isinstance(w, str)]
        found = iter(self.merges.encode_all(words))
        for piece, own in zip(pieces, held, strict=True):
            self.known[piece] = b"".join(array("I", next(found) if w is None else [w]).tobytes() for w in own)

    def split(self, text: str) -> list[int | str]:
        """The ids of added tokens, and between them the pre-tokens that the library's parts make."""
        out: list[int | str] = []
        for part in self.added_pattern().split(text):
            if part in self.added_ids:
                out.append(self.added_ids[part])
            elif part:
                normal = part if self.normalizer is None else self.normalizer.normalize_str(part)
                out += [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def added_pattern(self) -> re.Pattern:
        if not hasattr(self, "added_ids"):
            found = self.tokenizer.get_added_tokens_decoder()
            if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in found.values()):
                raise ValueError("added tokens that take white space in or are normalised are not supported")
            self.added_ids = {t.content: id_ for id_, t in found.items()}
            longest_first = sorted(map(re.escape, self.added_ids), key=len, reverse=True)
            self._added_pattern = re.compile(f"({'|'.join(longest_first) or '(?!)'})")
        return self._added_pattern


class Decoder:
    """Ids back to text: tokens set apart by spaces, or the bytes that byte-level tokens stand for."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text())
        kind = (file.get("decoder") or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of the kind {kind}")
        tokens = {id_: token for token, id_ in file["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"] for t in file["added_tokens"]}
        self.between = b" " if kind is None else b""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}

        def spelt(token: str) -> bytes:
            return bytes(byte[c] for c in token) if kind and all(c in byte for c in token) else token.encode()

        self.tokens = [spelt(tokens.get(id_, "")) for id_ in range(max(tokens) + 1)]

    def text(self, ids) -> str:
        return self.between.join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TreeEncoder:
    """One encoder a Python worker, whose memo stays warm from task to task."""
    return TreeEncoder(path)


@lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _ids(path: str, text: bytes) -> bytes:
    encoder = encoder_of(path)
    return b"".join(ids for part in parts(text) for ids in encoder.slice_ids([part]))


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in runs of about SLICE bytes, so that the distinct pieces of a run are looked up once."""
    held, size = [], 0
    for value in texts.cast(pa.binary()):
        text = value.as_py() or b""
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                if len(texts) == 1:
                    found = [_ids(path, texts[0])]
                else:
                    found = list(encoder.slice_ids(texts))
                many = pa.array([len(ids) // 4 for ids in found], pa.int64())
                docs = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([docs, many, pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])
                at += len(texts)

    rows = documents.select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the text of each row of ids, special tokens written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(path)

        def handed(at: int, texts: list[str]) -> pa.RecordBatch:
            own = batch.slice(at, len(texts))
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], [*own.schema.names, "decoded"])

        for batch in batches:
            texts, begun, size = [], 0, 0
            for value in batch.column(2):
                texts.append(decoder.text(memoryview(value.as_buffer()).cast("B").cast("I") if value.is_valid else ()))
                size += len(texts[-1])
                if size >= HELD:
                    yield handed(begun, texts)
                    begun, texts, size = begun + len(texts), [], 0
            if texts:
                yield handed(begun, texts)

    rows = encoded.select("doc_id", "n_tokens", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode's and decode's results."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
