"""HTML main text by structure and a host suffix array.

A page's stream is the tokens of its article or main element; where it names none, those outside menus, headers, footers, sidebars, notices,
adverts, forms, scripts and comments, which never stay. A suffix array of each host's streams, sorted to a depth of ``DEPTH`` tokens,
is built in buckets: every suffix is dealt to a bucket by a code of its host and its first ``DEPTH`` tokens, so equal ones of the whole host
meet whatever the partitions, and a bucket is sorted by code. The number of buckets rises with the bytes of HTML. Pages of a host with the same
stream are one page, so whole copies don't cover each other.

A run of equal suffixes is boilerplate of an article if ``least_pages`` pages and ``least_share`` of the host's distinct pages have it: what fewer pages
share are quotations and copies, which stay. On a page without article it is boilerplate if any other page of the host has it. The tokens
that boilerplate runs cover are removed, as are blocks of fewer than ``DEPTH`` tokens that are repeated as often; unique runs stay.
``n_repeated`` tells how many tokens were removed.

The boilerplate codes are broadcast if they are at most ``broadcast_codes`` (nine bytes each, counted first); else each page gets
its own by a join on the key of its stream. HTML is read twice and, with a broadcast, never shuffled.

Nulls: null html is empty (text empty, 0 characters); a null url is a host of its own name ''. Repeated rows each get
their row, an empty table gives an empty result, other columns are ignored. A cut tag, comment or reference at the end
of a page is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import forget, mix, shingles, slices, words, written

DEPTH = 8
#: A run in an article is boilerplate, not a quotation, where so many pages and this share of the host's pages have it.
LEAST_PAGES, LEAST_SHARE = 5, 0.5
#: Bytes of HTML read at a time, and to a bucket of suffixes.
SLICE, BUCKET = 8 << 20, 32 << 20
BROADCAST_CODES = 1 << 20
#: Codes have 48 bits: they need to tell the windows of one host apart, as runs are told apart by host too.
KEPT = np.uint64(0xFFFFFFFFFFFF0000)

#: Elements and attribute words.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "audio", "video", "canvas", "select")
CHROME = frozenset(("head", "title", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu"))
OWN = frozenset(("article", "main"))
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CHROME_WORDS = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search", "alert"))
CHROME_PARTS = ("p", "li", "span", "ul", "ol", "table", "div", "section", "figure", "details", "blockquote", "dl", "center")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRS = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile("[a-z]+")


def _marked(attrs: str) -> bool:
    for name, a, b, c in _ATTRS.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name in ("class", "id", "role") and not CHROME_WORDS.isdisjoint(_PART.findall(value)):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; zone: own (in an article or main), chrome or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    zone, parts, at = "open", [], 0

    def close():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((zone, text))
            parts.clear()

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and not (name == "span" and m[4] and not m[2]):
            if name == "br":
                parts.append(" ")
            elif name == "span" and any(x == "span" for x, _ in stack):
                pass
            else:
                continue
            if name == "br":
                continue
        if m[2]:
            close() if name != "span" else None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name == "span":
                        close()
                    del stack[k:]
                    zone = stack[-1][1] if stack else "open"
                    break
            continue
        if name == "span" and not _marked(m[4]):
            if any(x == "span" for x, _ in stack):
                stack.append((name, zone))
            continue
        close()
        if name in VOID or m[4].endswith("/"):
            continue
        if stack and stack[-1][0] == "p":  # a block closes a paragraph
            stack.pop()
            zone = stack[-1][1] if stack else "open"
        if zone != "chrome":
            if name in CHROME or name in CHROME_PARTS and m[4] and _marked(m[4]):
                zone = "chrome"
            elif name in OWN:
                zone = "own"
        if name not in ("p", "li", "tr", "td", "th", "dt", "dd", "html", "body") or zone == "chrome" and name in CHROME_PARTS and (not stack or stack[-1][1] != "chrome"):
            stack.append((name, zone))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return out


def covered(tokens: np.ndarray, page: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which tokens lie in a substring of at least ``depth`` tokens that two distinct pages have.

    tokens: hashes, page by page; page: the page of each token, ascending. depth: a power of two.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, bool)
    last = np.flatnonzero(np.diff(page, append=page[-1] + 1))
    stream = np.insert(np.unique(tokens, return_inverse=True)[1].astype(np.int64) + len(last), last + 1, np.arange(len(last)))
    owner = np.insert(page, last + 1, page[last])
    rank, order, reach = stream, None, 1
    while reach < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-reach] = rank[reach:]
        key = rank * (len(rank) + len(last) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(key), np.int64)
        rank[order] = new
        reach *= 2
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    pages = owner[order]
    shared = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts)
    hit = np.zeros(len(rank), bool)
    hit[order] = np.repeat(shared, np.diff(np.append(starts, len(rank))))
    step = np.zeros(len(rank) + depth + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + depth, -1)
    inside = np.cumsum(step)[: len(rank)] > 0
    inside[last + 1 + np.arange(len(last))] = False
    return np.delete(inside, last + 1 + np.arange(len(last)))


def content(page: str) -> tuple[list[str], bool]:
    """The blocks of a page's stream, and whether it names no article or main element."""
    found = blocks(page)
    named = any(zone == "own" for zone, _ in found)
    return [text for zone, text in found if zone == ("own" if named else "open")], not named


def _code(text: str, site: int) -> int:
    """A code of a short block on a host."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=int(site).to_bytes(8, "little")).digest(), "little")


@dataclass
class Streams:
    """Some pages: their blocks, and the codes of their windows of ``DEPTH`` tokens and of their shorter blocks. Codes and keys hold the host."""

    texts: list[str]
    first_block: np.ndarray
    open: np.ndarray
    site: np.ndarray
    key: np.ndarray
    #: token offsets of the blocks
    per_block: np.ndarray
    #: code, page and first token of each window; code, page and block of each short block
    windows: tuple[np.ndarray, np.ndarray, np.ndarray]
    short: tuple[np.ndarray, np.ndarray, np.ndarray]


def streams(pages: list[str], site: np.ndarray) -> Streams:
    """site: a code of each page's host. A page's key is that of its tokens, so copies of a page on its host count as one."""
    parsed = [content(p) for p in pages]
    texts = [t for bs, _ in parsed for t in bs]
    joined = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    off = np.concatenate([[0], np.cumsum(np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64))])
    if len(texts):
        off[-1] -= 1
    tokens, _, _, per_block = words(joined, off) if len(joined) else (np.zeros(0, np.uint64), None, None, np.zeros(len(off), np.int64))
    first_block = np.concatenate([[0], np.cumsum([len(bs) for bs, _ in parsed])]).astype(np.int64)
    per_page = per_block[first_block]
    size = np.diff(per_page)
    place = np.arange(len(tokens)) - np.repeat(per_page[:-1], size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + mix(place.astype(np.uint64))), dtype=np.uint64)])
        key = mix(mix(sums[per_page[1:]] - sums[per_page[:-1]] + size.astype(np.uint64)) ^ site)
        run, first = shingles(tokens, per_page, DEPTH)
        of = np.repeat(np.arange(len(pages)), np.diff(first))
        whole = (size >= DEPTH)[of]
        at = np.arange(len(run)) - first[of] + per_page[of]
        code = mix(mix(run) ^ site[of]) & KEPT
    block = np.flatnonzero(np.diff(per_block) < DEPTH)
    owner = np.searchsorted(first_block, block, "right") - 1
    short = np.array([_code(texts[k], site[p]) for k, p in zip(block.tolist(), owner.tolist(), strict=True)], np.uint64) & KEPT
    return Streams(texts, first_block, np.array([o for _, o in parsed], bool), site, key, per_block, (code[whole], of[whole], at[whole]), (short, owner, block))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def suffixes(s: Streams, buckets: int):
    """bucket and blob: the distinct codes of each page, sorted, with the pages' keys, hosts and kinds, dealt to buckets by code.

    A host's own code, which all its pages have, counts its pages.
    """
    code = np.concatenate([s.windows[0], s.short[0], s.site])
    page = np.concatenate([s.windows[1], s.short[1], np.arange(len(s.site))])
    order = np.lexsort((page, code))
    code, page = code[order], page[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (page[1:] != page[:-1])
    code, page = code[new], page[new]
    bucket = ((code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(code)), strict=True):
        own, number = np.unique(page[a:b], return_inverse=True)
        raw = struct.pack("<QQ", b - a, len(own)) + _planes(np.diff(code[a:b], prepend=np.uint64(0))) + _planes(number.astype(np.uint32)) + s.key[own].tobytes() + s.site[own].tobytes() + s.open[own].astype(np.uint8).tobytes()
        yield int(bucket[a]), zstandard.ZstdCompressor(1).compress(raw)


def _sorted_suffixes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's distinct (code, key), sorted, with hosts and kinds."""
    parts = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, k = struct.unpack("<QQ", raw[:16])
        number, at = _whole(raw, np.uint32, n, 16 + 8 * n), 16 + 12 * n
        key, site, kind = np.frombuffer(raw, np.uint64, k, at), np.frombuffer(raw, np.uint64, k, at + 8 * k), np.frombuffer(raw, np.uint8, k, at + 16 * k)
        parts.append((np.cumsum(_whole(raw, np.uint64, n, 16), dtype=np.uint64), key[number], site[number], kind[number].astype(bool)))
    code, key, site, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((kind, key, site, code))
    code, key, site, kind = code[order], key[order], site[order], kind[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
    return code[new], key[new], site[new], kind[new]


def runs(code: np.ndarray, site: np.ndarray, kind: np.ndarray, least_pages: int):
    """code, host, number of pages and whether one has no article, of each run that may be boilerplate or counts a host's pages."""
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (site[1:] != site[:-1])])) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(code)))
    any_open = np.add.reduceat(kind.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    code, site = code[first], site[first]
    keep = (n >= least_pages) | (any_open & (n > 1)) | (code == site)
    return code[keep], site[keep], n[keep], any_open[keep]


def _covered_by(at: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + DEPTH + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + DEPTH, -1)
    return np.cumsum(step)[:n] > 0


def decide(s: Streams, codes: np.ndarray, in_articles: np.ndarray) -> list[tuple[str, int]]:
    """Main text and number of removed tokens of each page; codes: sorted, and whether they are boilerplate of articles too."""

    def hit(code, page):
        if not len(codes):
            return np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return (codes[at] == code) & (in_articles[at] | s.open[page])

    flags = _covered_by(s.windows[2][hit(*s.windows[:2])], int(s.per_block[-1]))
    gone = np.zeros(len(s.texts), bool)
    gone[s.short[2][hit(*s.short[:2])]] = True
    upto = np.concatenate([[0], np.cumsum(flags)])
    some, out = np.diff(upto[s.per_block]), []
    for a, b in zip(s.first_block.tolist(), s.first_block[1:].tolist(), strict=False):
        kept, total = [], 0
        for k in range(a, b):
            x, y = int(s.per_block[k]), int(s.per_block[k + 1])
            if gone[k]:
                total += y - x
            elif some[k]:
                total += int(some[k])
                unique = " ".join(w for w, f in zip(s.texts[k].split(" "), flags[x:y], strict=False) if not f)
                kept += [unique] * bool(unique)
            else:
                kept.append(s.texts[k])
        out.append(("\n".join(kept), total))
    return out


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_codes: int = BROADCAST_CODES
) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.xxhash64(host).alias("site"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET))

    def parts(batches):
        for batch in batches:
            for part in slices(batch, "html", SLICE):
                yield part, streams(part.column("html").to_pylist(), part.column("site").to_numpy().view(np.uint64))

    def deal(batches):
        for _, s in parts(batches):
            found = list(suffixes(s, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

    def count(table):
        code, _, site, some_open = _sorted_suffixes(table.column("blob").to_pylist())
        code, site, n, some_open = runs(code, site, some_open, least_pages)
        return pa.table([pa.array(code.view(np.int64)), pa.array(site.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(some_open)], names=["code", "site", "n", "open"])

    def result(part, found):
        texts = pa.array([t for t, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated"])

    schema = f"page_id {kind}, url string, text string, n_chars bigint, n_repeated bigint"
    dealt = rows.select("html", "site").mapInArrow(deal, "bucket long, blob binary")
    dealt = dealt.repartition(partitions, "bucket") if partitions else dealt
    every = written(dealt.groupBy("bucket").applyInArrow(count, "code long, site long, n long, open boolean"), "runs")
    hosts = every.filter("code = site").select("site", F.col("n").alias("pages"))
    common = F.col("n") >= F.greatest(F.lit(least_pages), F.col("pages") * least_share)
    boilerplate = every.filter("code <> site").join(hosts, "site").select("code", common.alias("common"), "open").filter("common or open")
    boilerplate = written(boilerplate.select("code", "common"), "boilerplate")
    forget(every)

    if boilerplate.count() <= broadcast_codes:
        table = boilerplate.toArrow()
        code = table.column("code").to_numpy().view(np.uint64)
        order = np.argsort(code)
        shared = pages.sparkSession.sparkContext.broadcast((code[order], table.column("common").to_numpy().astype(bool)[order]))

        def run(batches):
            for part, s in parts(batches):
                yield result(part, decide(s, *shared.value))

        return rows.mapInArrow(run, schema)

    def owned(left, right):
        code, key, _, _ = _sorted_suffixes(left.column("blob").to_pylist()) if left.num_rows else (np.zeros(0, np.uint64),) * 4
        names, common_ = right.column("code").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64), right.column("common").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(names)
        names, common_ = names[order], common_[order]
        at = np.minimum(np.searchsorted(names, code), max(len(names) - 1, 0))
        own = np.flatnonzero(names[at] == code) if len(names) else np.zeros(0, np.int64)
        own = own[np.argsort(key[own], kind="stable")]
        first = np.flatnonzero(np.diff(key[own].view(np.int64), prepend=key[own][0].view(np.int64) + 1)) if len(own) else own
        ends = np.append(first[1:], len(own))
        columns = [[int(key[own[a]].view(np.int64)) for a in first], [code[own[a:b]].tobytes() for a, b in zip(first, ends, strict=False)], [common_[at[own[a:b]]].tobytes() for a, b in zip(first, ends, strict=False)]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "codes", "common"])

    def key_of(batches):
        for part, s in parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.key.view(np.int64))], names=[*part.schema.names, "key"])

    def run_joined(batches):
        for part, s in parts(batches):
            codes = np.frombuffer(b"".join(x for c in part.column("codes").to_pylist() for x in c or ()), np.uint64)
            flags = np.frombuffer(b"".join(x for c in part.column("common").to_pylist() for x in c or ()), np.uint8).astype(bool)
            codes, first = np.unique(codes, return_index=True)  # a code holds its host: one list serves all pages
            yield result(part, decide(s, codes, flags[first]))

    unsigned = F.shiftrightunsigned("code", 32)
    marked = boilerplate.withColumn("bucket", F.shiftright(unsigned * buckets, 32))
    shared_ = dealt.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(owned, "key long, codes binary, common binary")
    shared_ = shared_.groupBy("key").agg(F.collect_list("codes").alias("codes"), F.collect_list("common").alias("common"))
    keyed = rows.mapInArrow(key_of, f"page_id {kind}, url string, html string, site long, key long")
    return keyed.join(shared_, "key", "left").select("page_id", "url", "html", "site", "codes", "common").mapInArrow(run_joined, schema)
