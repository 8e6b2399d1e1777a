"""Exact token ids at the price of one library call for many distinct pieces of text.

Both pre-tokenisers end a token wherever a non-space meets a space, wherever letters or digits meet
ASCII punctuation, and behind a single line end; neither looks at what stands before a token. A text
may therefore be cut there, and equal pieces have equal ids wherever they stand. The cuts of a few MB
of text are found on its bytes, its distinct pieces are looked up in a memo, those that it lacks are
encoded together, and the ids of all pieces are gathered.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Letters from here on are not cut off before punctuation, nor given to the BPE model directly.
LAST_LETTER = 0x500
#: Bytes of text that are cut together; a longer text is parted behind an ASCII letter or digit.
SLICE = 1_000_000
_PART = re.compile(rb"(?<=[0-9A-Za-z])(?= )")


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_WHITE = _table(lambda b: 9 <= b <= 13 or b == 32)
_ALNUM = _table(lambda b: b < 128 and chr(b).isalnum())
_PUNCTUATION = _table(lambda b: b == 10 or 32 < b < 127 and not chr(b).isalnum())
#: Code points that are letters or digits and end in one in the normal form (not so ``İ``).
_ENDS = np.array([chr(c).isalnum() and unicodedata.normalize("NFC", chr(c)).lower()[-1].isalnum() for c in range(LAST_LETTER)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 text may be cut before each byte.

    Where more than one byte must be looked at, a doubtful place is left uncut: characters that can be
    white space beyond ASCII, combining marks, and letters whose normal form ends in a mark.
    """
    b = np.concatenate([np.zeros(3, np.uint8), data])

    def white(at: np.ndarray) -> np.ndarray:
        """Whether the character that ends before ``at`` may be white space."""
        x, y, z = b[at - 3], b[at - 2], b[at - 1]
        wide = (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & ((y == 0x80) | (y == 0x81)) | (x == 0xE3) & (y == 0x80)
        return _WHITE[z] | (z >= 0x80) & ((y == 0xC2) | wide)

    def letter(at: np.ndarray) -> np.ndarray:
        """Whether the character that ends before ``at`` is a letter or digit also in the normal form."""
        y, z = b[at - 2].astype(np.int64), b[at - 1]
        point = (y & 0x1F) << 6 | z & 0x3F
        return _ALNUM[z] | (z >= 0x80) & (y >= 0xC2) & (y <= 0xD3) & _ENDS[np.minimum(point, LAST_LETTER - 1)]

    out = np.zeros(len(b), bool)
    now, last = b[3:], b[2:-1]
    at = np.flatnonzero((now == 32) & ~_WHITE[last]) + 3
    out[at[~white(at)]] = True
    at = np.flatnonzero(_PUNCTUATION[now] & (_ALNUM[last] | (last >= 0x80))) + 3
    out[at[letter(at)]] = True
    at = np.flatnonzero((last == 10) & (_ALNUM[now] | (now >= 0xC3) & (now <= 0xCB))) + 3
    out[at[~white(at - 1)]] = True
    return out[3:]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies have for each byte: itself where it is
    printable in Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes, with a memo of two generations of pieces.

    A word of letters, with or without a space before it, is one pre-token, so the library's BPE model
    can be given many of them at once; this is taken up only if it agrees with the whole tokenizer on
    the words of PROBES. Only speed depends on that and on the memo's size.
    """

    PROBES = ("the", "The", "Zebra", "unbelievably", "été", "Größe", "ñandú", "ÀÉ", "слово", "x")

    def __init__(self, path: str, memo: int = 120_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer, self.limit = Tokenizer.from_file(path), memo
        self.normalizer = self.tokenizer.normalizer
        self.letters = byte_letters()
        # The strings of added tokens are found in the raw text, so they must not be cut.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The letter of the line end, which no word holds, is an id of its own between words.
        self.line_end = self.letters[10]
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = Split(self.line_end, "isolated")
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str(" AbZ") == " abz"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        probes = [space + w.encode() for w in self.PROBES for space in (b" ", b"")]
        self.direct = True
        self.learn(probes)
        self.direct = all(self.known[p] == self.whole([p])[0] for p in probes)
        self.known.clear()

    def whole(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def form(self, word: str) -> str | None:
        """What the BPE model is given for a word of letters with others than ASCII ones; None if it can't."""
        if not word.strip(" ").isalpha() or ord(max(word)) >= LAST_LETTER:
            return None
        if self.normalizer is not None:
            word = self.normalizer.normalize_str(word).strip(" ")
            if not word.isalpha():
                return None
        return word.encode().decode("latin-1").translate(self.letters)

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of pieces in the memo, those with a direct form in one call."""
        plain, wide, forms, others = [], [], [], []
        for piece in pieces:
            word = piece[1:] if piece[:1] == b" " else piece
            if self.direct and word.isalpha():
                plain.append(piece)
            elif self.direct and word[:1].isalpha() | (word[:1] >= b"\xc3") and (form := self.form(piece.decode())) is not None:
                wide.append(piece), forms.append(form)
            else:
                others.append(piece)
        self.known.update(zip(others, self.whole(others), strict=True))
        text = b"\n".join([b"", *plain, b""])
        text = text.lower().replace(b" ", b"") if self.lowers else text.replace(b" ", self.letters[32].encode())
        text = text.decode().replace("\n", self.line_end) + "".join(form + self.line_end for form in forms)
        ids = np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        data, ends = ids.tobytes(), (np.flatnonzero(ids == ids[0]) * 4).tolist()
        for piece, a, b in zip(plain + wide, ends[:-1], ends[1:], strict=True):
            self.known[piece] = data[a + 4 : b]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = []
        for piece in pieces:
            if piece not in known:
                if piece in older:
                    known[piece] = older[piece]
                else:
                    missing.append(piece)
        for at in range(0, len(missing), 8192):
            self.learn(missing[at : at + 8192])
        return [known[piece] for piece in pieces]

    def slice_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        joined = b"".join(texts)
        at = np.zeros(len(joined) + 1, bool)
        at[:-1] = cuts(np.frombuffer(joined, np.uint8))
        for token in self.added:
            place = joined.find(token)
            while place >= 0:
                at[place + 1 : place + len(token)] = False
                place = joined.find(token, place + 1)
        at[ends - sizes] = True
        at[-1] = True
        places = np.flatnonzero(at).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(joined)])
        coded = pieces.dictionary_encode()
        found = self.ids_of(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(length) - length
        own = coded.indices.to_numpy()
        many = length[own]
        behind = np.cumsum(many)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[own] - (behind - many), many) + np.arange(int(behind[-1]) if len(behind) else 0)]
        counts = np.concatenate([[0], behind])
        data = memoryview(ids).cast("B")
        starts, stops = (counts[np.searchsorted(places, x)] * 4 for x in (ends - sizes, ends))
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            yield bytes(data[a:b])

    def ids(self, text: str) -> bytes:
        return b"".join(self.slice_ids(parts(text.encode())))


def parts(text: bytes) -> list[bytes]:
    """A text in parts of about SLICE bytes, cut where a space follows an ASCII letter or digit."""
    out, at = [], 0
    while len(text) - at > SLICE and (place := _PART.search(text, at + SLICE)):
        out.append(text[at : place.start()])
        at = place.start()
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder a Python worker, whose memo stays warm from task to task."""
    return PieceEncoder(path)


def encoded(path: str, texts: pa.Array, end: bytes) -> Iterator[bytes]:
    """The ids of each text (null: empty) with ``end`` behind them, about SLICE bytes of texts at a time."""
    encoder = encoder_of(path)
    held: list[bytes] = []
    size = 0
    for value in texts.cast(pa.binary()):
        text = value.as_py() or b""
        if size + len(text) > SLICE and held:
            yield from (ids + end for ids in encoder.slice_ids(held))
            held, size = [], 0
        if len(text) > SLICE:
            yield b"".join(ids for part in parts(text) for ids in encoder.slice_ids([part])) + end
        else:
            held.append(text)
            size += len(text)
    if held:
        yield from (ids + end for ids in encoder.slice_ids(held))
