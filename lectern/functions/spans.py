"""Regex matches as spans of code points, with lines and relative positions.

Finding spans is one kernel per step that gives rows: Spark has no find-all with offsets, and array expressions that add up the
lengths of pieces proved some fifty times slower. Which spans touch is found in the kernels too, by bisection: arrays of all spans of a
text carried along with each of its issues grow with the square of the text. Everything after it is native.
"""

from __future__ import annotations

from bisect import bisect_right

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import bin_label, ratio_or_null
from .types import row

_BREAK = regex.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
SPAN = row("tag string, start int, end int, htr_text string, line int, char_start int, char_end int, line_length int")


def python_pattern(java: str) -> str:
    """A rule's pattern for the regex library: Unicode classes are its default, and only \\n ends a line there."""
    flags, body = regex.match(r"(?:\(\?([a-zA-Z]+)\))?(.*)", java, regex.S).groups()
    keep = "".join(f for f in flags or "" if f in "im")
    return (f"(?{keep})" if keep else "") + body.replace("IsLatin", "Latin")


class Lines:
    """Where the lines of a text begin, and their lengths without line ends."""

    def __init__(self, text: str):
        ends = [m.end() for m in _BREAK.finditer(text)]
        self.begin = [0, *(e for e in ends if e < len(text))]
        stops = [*self.begin[1:], len(text)]
        self.length = [len(text[a:b].rstrip("\r\n")) for a, b in zip(self.begin, stops, strict=True)]

    def place(self, start: int, end: int, wide_end: bool = False) -> tuple[int, int, int, int]:
        """line, char_start, char_end, line_length (from 1). wide_end: the end is measured on the start's line."""
        k = bisect_right(self.begin, start) - 1
        first = start - self.begin[k] + 1
        if wide_end:
            return k + 1, first, max(first, end - self.begin[k]), self.length[k]
        last = max(end - 1, start)
        return k + 1, first, last - self.begin[bisect_right(self.begin, last) - 1] + 1, self.length[k]


def spans_of(text: str, rules: list[tuple[str, regex.Pattern]], lines: Lines | None = None) -> list[dict]:
    lines = lines or Lines(text)
    out = []
    for tag, pattern in rules:
        for m in pattern.finditer(text):
            line, first, last, length = lines.place(m.start(), m.end())
            out.append({"tag": tag, "start": m.start(), "end": m.end(), "text": m[0], "line": line, "char_start": first, "char_end": last, "line_length": length})
    return out


def compiled(rules: dict[str, str], step: str) -> list[tuple[str, regex.Pattern]]:
    return [(step + code, regex.compile(python_pattern(p))) for code, p in rules.items()]


def rule_spans(rules: dict[str, str], step: str):
    """A kernel: all matches of all rules of a text; rules are independent and may overlap."""

    def kernel():
        ready = compiled(rules, step)
        return lambda text: (tuple(s.values()) for s in spans_of(text, ready))

    return kernel


class Touching:
    """Groups of spans, each in order and without overlaps, to be asked which share a character with [start, end)."""

    def __init__(self):
        self.groups: list[tuple[list[str], list[int], list[int]]] = []

    def add(self, spans) -> None:
        """A group of tags with start and end; empty spans touch nothing."""
        spans = [s for s in spans if s[1] < s[2]]
        if spans:
            self.groups.append(tuple(map(list, zip(*spans, strict=True))))

    def add_matches(self, text: str, rules: list[tuple[str, regex.Pattern]]) -> list[tuple[str, int, int]]:
        """A group of each rule's matches, and all of them."""
        out = []
        for tag, pattern in rules:
            found = [(tag, *m.span()) for m in pattern.finditer(text)]
            self.add(found)
            out += found
        return out

    def tags(self, start: int, end: int) -> list[str]:
        """The tags of the spans that touch, one per span."""
        out = []
        for tags, starts, ends in self.groups if start < end else ():
            k = bisect_right(ends, start)
            while k < len(starts) and starts[k] < end:
                out.append(tags[k])
                k += 1
        return out


def with_positions(df: DataFrame, start: str = "start", end: str = "end", length: str = "document_length") -> DataFrame:
    """Adds where in its line and document the middle of a span lies, from 0 to 1, and the tenth it falls in."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    mid = F.when(e > s, s + (e - s) / 2).otherwise(s)
    a, b = F.col("char_start").cast("double"), F.col("char_end").cast("double")
    char_mid = F.when(b > a, a + (b - a) / 2).otherwise(a)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    df = df.withColumns(
        {
            "relative_line_position": clamp(ratio_or_null(F.greatest(char_mid - 0.5, F.lit(0.0)), F.col("line_length"))),
            "relative_document_position": clamp(ratio_or_null(F.greatest(mid, F.lit(0.0)), F.col(length))),
        }
    )
    tenth = lambda k: F.least(F.floor(F.col(f"relative_{k}_position") * 10), F.lit(9)).cast("int")
    df = df.withColumns({f"{k}_bin": tenth(k) for k in ("line", "document")})
    return df.withColumns({f"{k}_position_bin": bin_label(F.col(f"{k}_bin")) for k in ("line", "document")})


def touches(spans: Column, start: Column, end: Column) -> Column:
    """Tags of the spans that share a character with [start, end), one per span."""
    return F.transform(F.filter(spans, lambda s: F.greatest(s["start"], start) < F.least(s["end"], end)), lambda s: s["tag"])
