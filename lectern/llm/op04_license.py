"""Licence scan: exact phrases, and fuzzy search for short notices by the pigeonhole principle.

A text is read as its words, A-Z lower-cased, joined by single spaces. A notice with room for k edits is cut into k + 1
pieces; at least one of them stands unedited in any match, so one Aho-Corasick pass over the text for all pieces of all
notices finds every candidate. The regex library's bounded-error matching then verifies the notice around each seed
and counts its edits; only digits (version numbers) must be exact, all other words share the edits. Each seed's window is searched
for itself, also left and right of its best match.

Each row is handled alone: no shuffle, memory bounded by one batch and one text.
Nulls: a null text counts as empty (no words, no labels, score 0); a null id is carried through.
Of overlapping matches the one with fewest edits, then the longest, then the earliest, is kept. Repeated rows each get their
row, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, slices

#: Exact phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Short notices, as words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright": "cc0",
    "all rights reserved": "all-rights-reserved",
}
CHARS_PER_EDIT = 12
_WORD_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in LOWER)
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SEPARATORS = re.compile(rb" +")
LONG = 4 << 20


class Notice:
    """A notice: its fuzzy pattern, and its pieces with their places."""

    def __init__(self, words: str, label: str):
        self.label, self.words, self.size = label, words, len(words)
        runs = re.findall(r"[0-9 ]*[0-9][0-9 ]*|[^0-9]+", words)
        self.edits = max(1, sum(len(r) for r in runs if not re.search("[0-9]", r)) // CHARS_PER_EDIT)
        longest = max((r for r in runs if not re.search("[0-9]", r)), key=len)
        self.pattern = regex.compile("(?b)" + "".join(regex.escape(r) if re.search("[0-9]", r) else f"(?:{regex.escape(r)}){{e<={self.edits}}}" for r in runs))
        # all runs share the edits, so of one more pieces of a single run one stands unedited wherever the edits are
        at, n = words.index(longest), self.edits + 1
        cuts = [len(longest) * i // n for i in range(n + 1)]
        self.least = self.size - self.edits
        self.pieces = [(longest[a:b], at + a) for a, b in zip(cuts, cuts[1:], strict=False)]


def automaton(notices: dict[str, str]) -> ahocorasick.Automaton:
    seeds: dict[str, list] = {}
    for words, label in notices.items():
        notice = Notice(words, label)
        for piece, at in notice.pieces:
            seeds.setdefault(piece, []).append((notice, at, len(piece)))
    out = ahocorasick.Automaton()
    for piece, where in seeds.items():
        out.add_word(piece, where)
    out.make_automaton()
    return out


def normalise(text: bytes) -> bytes:
    """Words, lower-cased, with one space between them."""
    spaced = text.translate(_WORD_BYTES)
    return _SEPARATORS.sub(b" ", spaced).strip(b" ") if len(spaced) > LONG else b" ".join(spaced.split())


def phrase_places(norm: bytes, phrases: list[tuple[bytes, str]]) -> list[tuple[str, int]]:
    """Label and first word of each place, in time linear in the text for each phrase."""
    found, padded = [], b""
    for phrase, label in phrases:
        if norm.find(phrase) < 0:
            continue
        padded = padded or b" " + norm + b" "
        at, word, last = padded.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            word += padded.count(b" ", last, at)
            found.append((label, word))
            last, at = at, padded.find(b" " + phrase + b" ", at + 1)
    return sorted(found, key=lambda x: (x[1], x[0]))


def notice_matches(norm: bytes, seeds: ahocorasick.Automaton) -> list[tuple[Notice, int, int, int]]:
    """Notice, start and end in the normalised bytes, and edits of each verified match."""
    begins: set[tuple[Notice, int]] = set()
    for end, where in seeds.iter(norm.decode("latin-1")):
        begins.update((notice, end + 1 - size - at) for notice, at, size in where)
    out = set()
    for notice, begin in begins:
        spare = 4 * notice.edits + 2  # an inserted character may take up to four bytes
        lo, hi = max(0, begin - spare), min(len(norm), begin + notice.size + spare)
        while lo > 0 and norm[lo] & 0xC0 == 0x80:
            lo -= 1
        window = norm[lo:hi].decode("utf-8", "ignore")
        parts = [(0, len(window))]  # what is left and right of the best match is searched too
        while parts:
            at, to = parts.pop()
            m = notice.pattern.search(window, at, to)
            if m and m.end() > m.start() and sum(m.fuzzy_counts) <= notice.edits:
                a, b = lo + len(window[: m.start()].encode()), lo + len(window[: m.end()].encode())
                out.add((notice, a, b, sum(m.fuzzy_counts)))
                parts += [(x, y) for x, y in ((at, m.start()), (m.end(), to)) if y - x >= notice.least]
    # spans that stay never overlap, so in order of their starts only the neighbours of a new one can touch it
    starts, best = [], []
    for x in sorted(out, key=lambda x: (x[3], x[1] - x[2], x[1], x[0].label)):
        k = bisect_left(starts, x[1])
        if (k == 0 or best[k - 1][2] <= x[1]) and (k == len(best) or x[2] <= best[k][1]):
            starts.insert(k, x[1])
            best.insert(k, x)
    return best


def _spans(raw: bytes, norm: bytes, matches: list) -> list[dict]:
    """Matches, in order and apart from each other, as spans of code points of the original text, whole words. Each text is read once."""
    edges, done, word = [], 0, 0
    for _, a, b, _ in matches:
        for at in (a + (norm[a : a + 1] == b" "), max(b - 1, a)):
            word += norm.count(b" ", done, at) if at >= done else -norm.count(b" ", at, done)
            done = at
            edges.append(word)
    wanted, places = set(edges), {}
    top = max(wanted)
    for i, m in enumerate(_RAW_WORD.finditer(raw)):
        if i in wanted:
            places[i] = m.span()
        if i >= top:
            break
    out, seen, before = [], 0, 0
    for (notice, *_, edits), f, last in zip(matches, edges[::2], edges[1::2], strict=True):
        a, b = places[f][0], places[max(f, last)][1]
        before += len(raw[seen:a].decode("utf-8", "ignore")) if a >= seen else -len(raw[a:seen].decode("utf-8", "ignore"))
        seen = a
        text = raw[a:b].decode("utf-8", "ignore")
        out.append({"label": notice.label, "start": before, "end": before + len(text), "word": f, "edits": edits, "confidence": 1 - edits / notice.size, "text": text})
    return sorted(out, key=lambda x: (x["start"], x["label"], x["end"]))


SPAN = "struct<label:string,start:bigint,end:bigint,word:bigint,edits:int,confidence:double,text:string>"
_SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("edits", pa.int32()), ("confidence", pa.float64()), ("text", pa.string())]))
_PLACE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (of exact phrases), notices (verified fuzzy spans in the original text) of each row."""
    phrases, notices = BASE_PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        seeds = automaton(notices)
        exact = [(p.encode(), x) for p, x in phrases.items()]
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                count, places, spans = [], [], []
                for text in part.column("text"):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    norm = normalise(raw)
                    count.append(norm.count(b" ") + 1 if norm else 0)
                    places.append([{"label": x, "word": w} for x, w in phrase_places(norm, exact)])
                    found = notice_matches(norm, seeds)
                    spans.append(_spans(raw, norm, found) if found else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(places, _PLACE_TYPE), pa.array(spans, _SPAN_TYPE)], names=["doc_id", "n_words", "places", "notices"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, places array<struct<label:string,word:bigint>>, notices array<{SPAN}>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score per row: the best notice's confidence, 0.5 where only exact phrases stand, else 0."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("notices.label"))))
    best = F.greatest(F.coalesce(F.array_max("notices.confidence"), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        best.alias("score"),
        F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"])).alias("spans"),
    )
