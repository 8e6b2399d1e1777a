"""Text of a page made ready for display.

Each line is of one class: blank, page header, an equals sign alone, beginning like a number, or other. The
classes of a text's lines, one letter each, are a word, which a regular expression cuts into what belongs
together: a calculation over three lines, an equals sign with its subtotal, or a single line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a page header and a number begin with, where a value ends, what leaders and gaps are.
HEADER, NUMBER = re.compile(r"Page\s+\d+", re.IGNORECASE), re.compile(r"[\d,.]+")
VALUE_END, LEADERS, GAP = re.compile(r"\s*\.{2,}.*$"), re.compile(r"\s*\.{3,}\s*"), re.compile(r"\s{3,}")
ARROW = "  →  "

#: b blank, h header, e equals sign, n number, o other.
_UNITS = re.compile("(?P<blank>b)|(?P<header>h)|(?P<sum>[eno]en)|(?P<subtotal>en)|(?P<line>[eno])")


def _class(line: str) -> str:
    if not line:
        return "b"
    if HEADER.match(line):
        return "h"
    return "e" if line == "=" else "n" if NUMBER.match(line) else "o"


def display_text(raw: str) -> str:
    """Without page headers, with calculations on one line, subtotals behind an arrow, leaders and gaps collapsed."""
    lines = [line.strip() for line in raw.split("\n")]
    out: list[str] = []
    for unit in _UNITS.finditer("".join(map(_class, lines))):
        first, last = lines[unit.start()], lines[unit.end() - 1]
        open_line = bool(out) and out[-1] != ""
        match unit.lastgroup:
            case "blank" if open_line:
                out.append("")
            case "sum":
                out.append(f"{first} = {VALUE_END.sub('', last)}")
            case "subtotal" if open_line:
                out[-1] += ARROW + VALUE_END.sub("", last)
            case "subtotal":
                out.append(f"= {VALUE_END.sub('', last)}")
            case "line":
                out.append(GAP.sub("  ", LEADERS.sub(" ", first)).rstrip())
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip()


def _displayed(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else display_text(t) for t in text.to_pylist()], pa.string())


def displayed(text: Column) -> Column:
    """T31 of a column; null stays null."""
    return F.arrow_udf(_displayed, "string")(text)
