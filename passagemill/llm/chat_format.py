"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a text. Successive prefixes of a conversation are rendered
and each output is compared with the one before: if the new output starts with the old one, what was
added is the new turn's span; if not, the template has rewritten history, and the turn is marked so.
Nothing is asked of the template but its output. The loss mask is found in the same way: the turn is
rendered with each of two probes for its text, and the two outputs differ just where the text stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

#: Control strings of the template; none can occur where #, < and line ends are escaped.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
ESCAPED = {"\\": "\\\\", "#": "\\h", "<": "\\l", "\n": "\\n", ":": "\\c"}
PLAIN = {v[1]: k for k, v in ESCAPED.items()}


def escape(text: str) -> str:
    r"""Reversible: the five characters of ESCAPED are spelled as a backslash and a letter or backslash."""
    return re.sub(r"[\\#<\n:]", lambda m: ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def turn_template(turns: list[Turn]) -> str:
    """A line ``### role: text </turn>`` for each turn."""
    return "".join(f"{HEAD}{escape(role)}{MIDDLE}{escape(text)}{TAIL}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns that turn_template() was given."""
    lines = (line[len(HEAD) : 1 - len(TAIL)].split(MIDDLE, 1) for line in formatted.split("\n")[:-1])
    return [(unescape(role), unescape(text)) for role, text in lines]


@dataclass
class Rendered:
    """A conversation's output, with (start, end) of each turn and which turns changed earlier output."""

    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def common_prefix(a: str, b: str) -> int:
    """The length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def render(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendered:
    """Render every prefix of turns. After a rewrite, earlier spans are cut at what is still in place."""
    out, before = Rendered(), template([])
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if now.startswith(before):
            out.spans.append((len(before), len(now)))
        else:
            same = common_prefix(before, now)
            out.rewrites.append(k)
            out.spans = [(min(a, same), min(b, same)) for a, b in out.spans] + [(same, len(now))]
        before = now
    out.text = before
    return out


#: Two one-letter texts that no template escapes.
PROBES = ("0", "1")


def text_place(turns: list[Turn], k: int, template: Callable[[list[Turn]], str]) -> tuple[str, str]:
    """What the template puts before and behind the text of turn k, the last one rendered."""
    one, other = (template([*turns[:k], (turns[k][0], probe)]) for probe in PROBES)
    start = common_prefix(one, other)
    return one[:start], one[start + 1 :]


def loss_spans(out: Rendered, turns: list[Turn], role: str, template: Callable[[list[Turn]], str], escaped: Callable[[str], str] | None) -> tuple[list[tuple[int, int]], list[int]]:
    """Where the texts of ``role`` stand, and the turns of that role whose text has no place in the output.

    The frame of a text (how much of its turn's span stands before and behind it) is found by probes. It
    is taken for the next turn of the role too if the text's escaped form then stands just there;
    otherwise, or where ``escaped`` is not known, the turn is probed itself.
    """
    spans, lost, frame = [], [], None
    for k, ((a, b), (who, text)) in enumerate(zip(out.spans, turns, strict=True)):
        if who != role:
            continue
        if frame and escaped and out.text[a + frame[0] : b - frame[1]] == escaped(text) and b - a >= sum(frame):
            spans.append((a + frame[0], b - frame[1]))
            continue
        before, behind = text_place(turns, k, template)
        start, end = len(before), b - len(behind)
        if a <= start <= end <= b and out.text.startswith(before) and out.text[end:b] == behind:
            spans.append((start, end))
            frame = start - a, b - end
        else:
            lost.append(k)
    return spans, lost


FORMATTED = "conv_id long, n_turns long, formatted string, turn_starts array<int>, turn_ends array<int>, loss_starts array<int>, loss_ends array<int>, rewrites array<int>, unmasked array<int>"


def _formatted(template, role: str, escaped):
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
        key, turns, begun = None, [], False
        for batch in batches:
            for conv, who, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if begun and conv != key:
                    yield key, turns
                    turns = []
                key, begun = conv, True
                turns.append((who, text))
        if begun:
            yield key, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, names = pa.list_(pa.int32()), [c.split()[0] for c in FORMATTED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), ints, ints, ints, ints, ints, ints]
        rows, size = [], 0
        for conv, turns in conversations(batches):
            out = render(turns, template)
            masks, lost = loss_spans(out, turns, role, template, escaped)
            rows.append((conv, len(turns), out.text, [a for a, _ in out.spans], [b for _, b in out.spans], [a for a, _ in masks], [b for _, b in masks], out.rewrites, lost))
            size += len(out.text)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def format_chats(conversations: DataFrame, template: Callable[[list[Turn]], str] = turn_template, role: str = "assistant", escaped: Callable[[str], str] | None = escape) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a row a conversation: text, turn spans, loss spans, rewrites.

    ``rewrites`` and ``unmasked`` number the turns that changed earlier output, and those of ``role``
    whose text no longer stands in the output. ``escaped`` is the template's way with a text, where known.

    Turns are ordered by turn, then role and text, nulls first. A null role or text counts as empty;
    rows of a null conv_id are one conversation; repeated rows are turns of their own; an empty table
    gives no rows. Other columns are not read. Offsets count code points. One task holds one
    conversation at a time, however many it has; a conversation is never parted, and rendering all
    its prefixes takes time in proportion to the square of its length.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(template, role, escaped), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for conv, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output alone: turns by parsing it, the loss text by its mask."""
    columns = formatted.select("conv_id", "formatted", "loss_starts", "loss_ends")
    return columns.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
