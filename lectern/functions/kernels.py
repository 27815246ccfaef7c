"""Sequential kernels over one pair of texts, in plain Python.

One bit-parallel edit-distance kernel (vertical and horizontal differences of the distance table kept as big integers, one
pair of columns per character) serves the character alignment of words and of whole documents, and tokens.
Alignments are read back from the end, preferring the diagonal, then a deletion, then an insertion.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

#: Words that never anchor a match on their own.
UNANCHORED = frozenset(("de", "la", "el", "del", "y", "en", "a", "por", "que", "los", "las", "un", "una"))
WINDOW, LONGEST_RUN, LEAST_LENGTH, LEAST_SCORE = 80, 4, 4, 90
BOUNDARY_SPAN = 4
CELLS = 30_000_000
_WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")
_TOKEN = re.compile(_WORD.pattern + r"|\S")
_KEY = re.compile("[^0-9a-z]+")
_NOT_LATIN = regex.compile(r"[^\p{Latin}]+")
_LATIN = regex.compile(r"\p{Latin}+")
_ASCII = re.compile("[a-z]+")


def latin(text: str) -> str:
    """Case-folded, composed, only Latin letters."""
    return _NOT_LATIN.sub("", unicodedata.normalize("NFC", text.casefold()))


def latin_words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _LATIN.findall(unicodedata.normalize("NFC", text.casefold()))


def tokens(text: str, punctuation: bool = False) -> list[tuple[str, int, int]]:
    """Words with their spans; if asked for, every other character that is no white space too."""
    return [(m[0], m.start(), m.end()) for m in (_TOKEN if punctuation else _WORD).finditer(text)]


@lru_cache(1 << 16)
def match_key(word: str) -> str:
    """Lower case, without diacritics, only ASCII letters and digits."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
    return _KEY.sub("", bare)


def _masks(a: Sequence[Hashable]) -> dict[Hashable, int]:
    out: dict[Hashable, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(1 << 18)
def similarity(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths; 0 if a side is empty."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _letter_masks(a: str) -> dict[str, int]:
    """``_masks`` of a long text with few letters."""
    places = _codes(a)
    return {c: int.from_bytes(np.packbits(places == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}


def _band(a: Sequence[Hashable], b: Sequence[Hashable], bound: int, keep: list | None = None, whole: int | None = None) -> tuple[int, list[int]]:
    """The distance table of a (down) and b (across) along the diagonals that a path of at most ``bound`` edits can reach, as bit columns.

    Returns a row and the distances of the prefixes of a from that row on to the whole of b. What no such path reaches may be too large; what
    lies on a cheapest path is right if the distance is at most the bound. keep: collects for each column the row above its first bit, and its
    up, down, right and left steps. whole: the length of the text that b begins, if b is not all of it.
    """
    n, m = len(a), len(b)
    apart = (m if whole is None else whole) - n
    low, high = (bound - apart) // 2, (bound + apart) // 2
    step = max(64, low + high + 1)
    every = _letter_masks(a) if n > 512 and isinstance(a, str) else None
    top = bottom = base = at = 0
    plus = minus = 0
    while at < m:
        stop = min(m, at + step)
        first, last = max(top, at - high), min(n, stop + low)
        if first > top:
            shift = first - top
            gone = (1 << shift) - 1
            base += (plus & gone).bit_count() - (minus & gone).bit_count()
            plus, minus, top = plus >> shift, minus >> shift, first
        if last > bottom:
            plus |= ((1 << (last - bottom)) - 1) << (bottom - top)
            bottom = last
        full = (1 << (bottom - top)) - 1
        masks = _masks(a[top:bottom]) if every is None else {c: x >> top & full for c, x in every.items()}
        get = masks.get
        if keep is None:
            for c in b[at:stop]:
                eq = get(c, 0)
                diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
                up = (minus | (full ^ (diag | plus))) << 1 | 1
                plus, minus = ((plus & diag) << 1 | (full & ~(diag | up))) & full, up & diag
        else:
            for c in b[at:stop]:
                eq = get(c, 0)
                diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
                right, left = minus | (full ^ (diag | plus)), plus & diag
                up = right << 1 | 1
                plus, minus = (left << 1 | (full & ~(diag | up))) & full, up & diag
                keep.append((top, plus, minus, right, left))
        base += stop - at
        at = stop
    out = [base]
    for i in range(bottom - top):
        base += (plus >> i & 1) - (minus >> i & 1)
        out.append(base)
    return top, out


def _trim(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """How many elements both begin with, and how many of the rest both end with."""
    most = min(len(a), len(b))
    start = _same(a, b, most)
    return start, _same(a, b, most - start, -1)


def _same(a: Sequence[Hashable], b: Sequence[Hashable], most: int, way: int = 1) -> int:
    """How many elements (``most`` at most) are the same from the start on, or from the end back."""
    if way > 0:
        if a[:most] == b[:most]:
            return most
        equal = lambda k, size: a[k : k + size] == b[k : k + size]
    else:
        n, m = len(a), len(b)
        if a[n - most :] == b[m - most :]:
            return most
        equal = lambda k, size: a[n - k - size : n - k] == b[m - k - size : m - k]
    size = 1 << (most.bit_length() - 1)
    done = 0
    while size:
        if done + size <= most and equal(done, size):
            done += size
        else:
            size >>= 1
    return done


def _ahead(x: Sequence[Hashable], which: list[Hashable]) -> list[int]:
    """How many of these elements are before each place, and in all."""
    if isinstance(x, str) and len(x) > 64:
        places = _codes(x)
        there = np.zeros(int(places.max()) + 1, dtype=np.int32)
        there[[c for c in map(ord, which) if c < len(there)]] = 1
        return [0, *np.cumsum(there[places]).tolist()]
    return list(accumulate(map(set(which).__contains__, x), initial=0))


class _Lack:
    """What the rest of two texts must at least cost from any place on: one has elements that the other lacks, and an edit makes up for one."""

    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]):
        counts = Counter(b)
        counts.subtract(Counter(a))
        more, less = [c for c, v in counts.items() if v > 0], [c for c, v in counts.items() if v < 0]
        #: elements before each place of those that b has more of, and of those that a has more of
        self.more_a, self.more_b, self.less_a, self.less_b = _ahead(a, more), _ahead(b, more), _ahead(a, less), _ahead(b, less)
        self.more, self.less = self.more_b[-1] - self.more_a[-1], self.less_a[-1] - self.less_b[-1]
        self.least = max(self.more, self.less)


def _waves(a: Sequence[Hashable], b: Sequence[Hashable], bound: int, lack: _Lack) -> list[tuple[int, list[int]]] | None:
    """For each number of edits the first diagonal (place in b less place in a) and, for it and those after it, the furthest row with at most
    so many; None if more than ``bound`` edits are needed. Places from which the end is out of reach are left out.

    What lies on a cheapest path is right, as in ``_band``: if a place on a diagonal does, so does the furthest one there with as many edits.
    The cost grows with the edits, and with how many of them go beyond what the texts lack.
    """
    n, m = len(a), len(b)
    apart = m - n
    more_a, more_b, less_a, less_b = lack.more_a, lack.more_b, lack.less_a, lack.less_b
    out, before, first = [], [], 0
    for s in range(bound + 1):
        stop = len(before)
        low, high = max(first - 1, -n, apart - bound + s), min(first + stop, m, apart + bound - s)
        if not s:
            low = high = 0
        most_more, most_less = s + lack.more - bound, s + lack.less - bound
        row, begun = [], 0
        for k in range(low, high + 1):
            if s:
                x = k - first
                i = before[x] + 1 if 0 <= x < stop and before[x] >= 0 else -1
                if 0 <= x + 1 < stop and before[x + 1] >= i and before[x + 1] >= 0:
                    i = before[x + 1] + 1
                if 0 < x <= stop and before[x - 1] > i:
                    i = before[x - 1]
                most = n if n + k <= m else m - k
                if i > most:
                    i = most
            else:
                i, most = 0, min(n, m)
            if i >= 0 and i + k >= 0:
                if i < most and a[i] == b[i + k]:
                    i += 1
                    size = 16
                    while i < most and a[i] == b[i + k]:
                        if a[i : i + size] == b[i + k : i + k + size] and i + size <= most:
                            i += size
                            size <<= 1
                        else:
                            i += 1
                            size = 16 if size == 16 else size >> 1
                if more_b[i + k] - more_a[i] < most_more or less_a[i] - less_b[i + k] < most_less:
                    i = -1
            else:
                i = -1
            if i >= 0 or row:
                row.append(i)
            else:
                begun += 1
        while row and row[-1] < 0:
            row.pop()
        if not row:
            return None
        before, first = row, low + begun
        out.append((first, row))
        if 0 <= apart - first < len(row) and row[apart - first] >= n:
            return out
    return None


def _few(cells: int, size: int) -> bool:
    """Whether waves of so many places cost less than the columns of a band."""
    return cells <= 2 * size


def _edits(a: Sequence[Hashable], b: Sequence[Hashable], bound: int | None = None) -> tuple[int, list | None]:
    """The distance and the waves if they are cheap; else a first bound for a band. bound: no less than the distance, if it is known."""
    lack = _Lack(a, b)
    least, size = max(lack.least, abs(len(a) - len(b))), len(a) + len(b)
    for spare in [0, *(4 << 2 * k for k in range(size.bit_length()))] if bound is None else [bound - least]:
        if not _few((least + spare) * (2 * spare + 3), size):
            break
        waves = _waves(a, b, least + spare, lack)
        if waves is not None:
            return len(waves) - 1, waves
    return least * 5 // 4 + abs(len(a) - len(b)) + 12 if bound is None else bound, None


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance with unit costs."""
    start, end = _trim(a, b)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    found, waves = _edits(a, b)
    bound = found if waves else 0
    while found > bound:
        bound = found
        found = _band(a, b, bound)[1][-1]
    return found


Run = tuple[str, int, int, int]


def _matches(a, b, i: int, j: int) -> int:
    """How many elements before the places i and j are the same."""
    k, most = 0, min(i, j)
    while k < most and a[i - k - 1] == b[j - k - 1]:
        k += 1
        if not k & 7:
            while k + 32 <= most and a[i - k - 32 : i - k] == b[j - k - 32 : j - k]:
                k += 32
    return k


def _reached(waves: list[tuple[int, list[int]]], s: int, k: int, i: int) -> bool:
    """Whether at most s edits reach row i of diagonal k."""
    if s < 0:
        return False
    low, row = waves[s]
    return 0 <= k - low < len(row) and row[k - low] >= i


def _trace(a, b, i0: int, j0: int, bound: int | None = None) -> list[Run]:
    """The alignment read back over the whole table."""
    n, m = len(a), len(b)
    start, end = _trim(a, b)
    out: list[Run] = [("M", i0 + n - end, j0 + m - end, end)] if end else []
    i, j, cols, waves, s = n - end, m - end, [], None, 0
    if i > start and j > start:
        s, waves = _edits(a[start:i], b[start:j], bound)
        found, bound = s, s if waves else -1
        while found > bound:
            bound, cols = found, []
            found = _band(a[start:i], b[start:j], bound, cols)[1][-1]
    while i and j:
        k = _matches(a, b, i, j)
        if k:
            i, j = i - k, j - k
            out.append(("M", i0 + i, j0 + j, k))
            continue
        if i <= start or j <= start:
            # along the common start the table is the distance from the diagonal
            op = "I" if j > i else "D"
        elif waves:
            s -= 1
            op = "S" if _reached(waves, s, j - i, i - start - 1) else "D" if _reached(waves, s, j - i + 1, i - start - 1) else "I"
        else:
            top, plus, minus, right, left = cols[j - start - 1]
            at = i - start - 1 - top
            down = (plus >> at & 1) - (minus >> at & 1)
            across = (right >> at - 1 & 1) - (left >> at - 1 & 1) if at else 1
            op = "S" if down + across == 1 else "D" if down == 1 else "I"
        i, j = i - (op != "I"), j - (op != "D")
        out.append((op, i0 + i, j0 + j, 1))
    if i:
        out.append(("D", i0, j0, i))
    if j:
        out.append(("I", i0, j0, j))
    return out[::-1]


def _cut(a, b, half: int, waves: list[tuple[int, list[int]]]) -> tuple[int, int]:
    """The first row at which a cheapest path crosses a column, and the edits before it: the path that goes up wherever it can."""
    i, j, s = len(a), len(b), len(waves) - 1
    while j > half or i:
        if i and _reached(waves, s - 1, j - i + 1, i - 1):
            i, s = i - 1, s - 1
        elif j == half:
            break
        elif i and a[i - 1] == b[j - 1]:
            # down the diagonal as far as it matches, the column is not passed, and no step up is open
            low, row = waves[s - 1] if s else (0, [])
            x = j - i + 1 - low
            open_ = row[x] + 1 if 0 <= x < len(row) else 0
            k = min(_matches(a, b, i, j), j - half, i - open_)
            i, j = i - k, j - k
        elif i and _reached(waves, s - 1, j - i, i - 1):
            i, j, s = i - 1, j - 1, s - 1
        else:
            j, s = j - 1, s - 1
    return i, s


def runs(a: Sequence[Hashable], b: Sequence[Hashable], i0: int = 0, j0: int = 0, bound: int | None = None) -> list[Run]:
    """M, S, D, I with the places in a and b where each run of them begins, and its length; runs of one kind may follow each other.

    Large tables are halved (Hirschberg), so memory stays linear. bound: no less than the distance, if it is known.
    """
    if len(a) * len(b) <= CELLS or len(b) < 2:
        return _trace(a, b, i0, j0, bound)
    start, end = _trim(a, b)
    head = [("M", i0, j0, start)] if start else []
    tail = [("M", i0 + len(a) - end, j0 + len(b) - end, end)] if end else []
    a, b, i0, j0 = a[start : len(a) - end], b[start : len(b) - end], i0 + start, j0 + start
    if len(a) * len(b) <= CELLS or len(b) < 2:
        return head + _trace(a, b, i0, j0, bound) + tail
    half, n = len(b) // 2, len(a)
    found, waves = _edits(a, b, bound)
    if waves:
        cut, before = _cut(a, b, half, waves)
        after = found - before
    else:
        bound = -1
        while found > bound:
            bound = found
            (t, left), (u, right) = _band(a, b[:half], bound, whole=len(b)), _band(a[::-1], b[half:][::-1], bound, whole=len(b))
            found, cut = min((left[k - t] + right[n - k - u], k) for k in range(max(t, n - u - len(right) + 1), min(t + len(left) - 1, n - u) + 1))
        before, after = left[cut - t], right[n - cut - u]
    return head + runs(a[:cut], b[:half], i0, j0, before) + runs(a[cut:], b[half:], i0 + cut, j0 + half, after) + tail


def operations(a: Sequence[Hashable], b: Sequence[Hashable], i0: int = 0, j0: int = 0) -> list[tuple[str, int, int]]:
    """M, S, D, I with the places in a and b where each stands."""
    return [(op, i + k * (op != "I"), j + k * (op != "D")) for op, i, j, size in runs(a, b, i0, j0) for k in range(size)]


def char_issues(gt: str, htr: str, at: int) -> list[tuple[str, int, int, str, str]]:
    """Runs of equal kind among the edits of two words: tag, start and end in the transcription, both texts."""
    out: list[list] = []
    before = "M"
    for op, i, j in operations(gt, htr):
        tag = {"S": "X"}.get(op, op)
        if op != "M":
            if op != before:
                out.append([tag, at + j, at + j, "", ""])
            run = out[-1]
            if op != "D":
                run[2] += 1
                run[4] += htr[j]
            if op != "I":
                run[3] += gt[i]
        before = op
    return [tuple(x) for x in out]


class _Words:
    """The words of a transcription by their keys, for the search of runs of them that fit a word."""

    def __init__(self, htr: list[tuple[str, int, int]]):
        self.keys = [match_key(w) for w, _, _ in htr]
        self.joined = "".join(self.keys)
        self.ends, at = [0], 0
        self.places: dict[str, list[int]] = {}
        for j, k in enumerate(self.keys):
            self.places.setdefault(k, []).append(j)
            at += len(k)
            self.ends.append(at)
        #: the word that begins at a place of the joined keys; only without words that have an empty key
        self.at = {p: j for j, p in enumerate(self.ends)} if "" not in self.places else None

    def best(self, word: str, own: str, cursor: int) -> tuple[int, int] | None:
        """Start and length of the run of words that fits the word best, near the cursor."""
        stop = min(len(self.keys), cursor + WINDOW)
        numeric = word.isdigit()
        runs = LONGEST_RUN if numeric or len(word) >= LEAST_LENGTH and word.lower() not in UNANCHORED else 1
        if not own or cursor >= stop:
            return None
        ends, joined, n = self.ends, self.joined, len(own)
        starts = range(cursor, stop)
        # the share of differing letters that a score of 90 allows, at the greatest length it allows
        apart = (n + n * 11 // 9) // 10
        if self.at is not None:
            at = self.at
            if runs == 1:
                found = self.places.get(own, ())
                x = bisect_left(found, cursor)
                if x < len(found) and found[x] < stop:
                    return found[x], 1
            else:
                begin, end = ends[cursor], ends[stop]
                p = joined.find(own, begin, end)
                while p >= 0:
                    j, k = at.get(p), at.get(p + n)
                    if j is not None and k is not None and k - j <= runs:
                        return j, k - j
                    p = joined.find(own, p + 1, end)
            if numeric or not apart:
                return None
            if n >= 2 * (apart + 1):
                # with at most ``apart`` letters lost or gained one of so many pieces and one more stays whole, about where it was
                begin, end, near, size = ends[cursor], ends[stop], set(), n // (apart + 1)
                for x in range(0, size * (apart + 1), size):
                    piece = own[x : x + size] if x < size * apart else own[x:]
                    p = joined.find(piece, begin, end)
                    while p >= 0:
                        near.update(range(p - x - apart, p - x + apart + 1))
                        p = joined.find(piece, p + 1, end)
                starts = sorted(j for j in map(at.get, near) if j is not None and cursor <= j < stop)
        best, place = 0.0, None
        for j in starts:
            begin = ends[j]
            for k in range(1, min(runs, stop - j) + 1):
                size = ends[j + k] - begin
                if size == n and joined.startswith(own, begin):
                    return j, k
                # a score of 90 needs lengths within a tenth of their sum
                if numeric or not size or 10 * abs(size - n) > size + n:
                    continue
                score = similarity(own, joined[begin : begin + size])
                if score > best or score == best and place and k < place[1]:
                    best, place = score, (j, k)
        return place if best >= LEAST_SCORE else None


def align_words(gt: list[tuple[str, int, int]], htr: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """op, index of the reference word or -1, index of the first transcription word or -1, words in the run."""
    words = _Words(htr)
    keys, count = words.keys, len(htr)
    out, cursor = [], 0
    for i, (word, _, _) in enumerate(gt):
        own = match_key(word)
        if own and cursor < count and keys[cursor] == own:
            j, k = cursor, 1
        else:
            found = words.best(word, own, cursor)
            if found is None:
                out.append(("delete", i, -1, 0))
                continue
            j, k = found
            out += [("insert", -1, x, 1) for x in range(cursor, j)]
        out.append(("equal" if k == 1 and htr[j][0] == word else "replace", i, j, k))
        out += [("insert", -1, x, 1) for x in range(j + 1, j + k)]
        cursor = j + k
    return out + [("insert", -1, x, 1) for x in range(cursor, count)]


def word_issues(gt_text: str, htr_text: str) -> list[dict]:
    """Substitutions, insertions and deletions as spans of the transcription, words first, characters within replaced words."""
    gt, htr = tokens(gt_text), tokens(htr_text)
    ops = align_words(gt, htr)
    # where a missing word belongs: the next transcription word's start, else the last one's end, else 0
    following, nxt = [None] * len(ops), None
    for x in range(len(ops) - 1, -1, -1):
        following[x] = nxt
        if ops[x][2] >= 0:
            nxt = htr[ops[x][2]][1]
    out, last = [], None
    for x, (op, i, j, _) in enumerate(ops):
        if j >= 0:
            last = htr[j][2]
        word_gt, word_htr = (gt[i] if i >= 0 else None), (htr[j] if j >= 0 else None)
        if op == "insert":
            found = [("I", word_htr[1], word_htr[2], "", word_htr[0])]
        elif op == "delete":
            at = following[x] if following[x] is not None else last if last is not None else 0
            found = [("D", at, at, word_gt[0], "")]
        elif op == "replace":
            found = char_issues(word_gt[0], word_htr[0], word_htr[1])
        else:
            continue
        for tag, a, b, g, h in found:
            out.append({"code": tag, "start": a, "end": b, "gt_text": g, "htr_text": h, "word_op": op, "word_gt": word_gt and word_gt[0], "word_htr": word_htr and word_htr[0], "gt_start": word_gt and word_gt[1], "gt_end": word_gt and word_gt[2], "htr_start": word_htr and word_htr[1], "htr_end": word_htr and word_htr[2]})
    return out


def _lengths(found: list[tuple[bool, int]]) -> list[int]:
    """The lengths of what is counted in one piece."""
    out, n = [], 0
    for counts, size in found:
        if counts:
            n += size
        elif n:
            out.append(n)
            n = 0
    return out + [n] * bool(n)


def quality_counts(gt_text: str, htr_text: str) -> dict:
    """Counts and run lengths behind the character metrics; windows as lists of their counts."""
    ref, hyp = latin_words(gt_text), latin_words(htr_text)
    gt, htr = "".join(ref), "".join(hyp)
    ops = runs(gt, htr)
    kinds = dict.fromkeys("MSDI", 0)
    for kind, _, _, length in ops:
        kinds[kind] += length
    n = len(gt)
    spans, errors = _lengths([(k in "MS", x) for k, _, _, x in ops]), _lengths([(k != "M", x) for k, _, _, x in ops])
    size = max(100, -(-n // 10)) if n else 0
    windows = -(-n // size) if n else 0
    edits, shifts = [0] * windows, [0] * windows
    if n:
        for kind, i, _, length in ops:
            if kind != "M":
                for k in range(i, i + length) if kind != "I" else [i] * length:
                    w = min(min(k, n - 1) // size, windows - 1)
                    edits[w] += 1
                    shifts[w] += kind != "S"
    rates = [e / (min((k + 1) * size, n) - k * size) for k, e in enumerate(edits)]
    drifts = [s / e if e else 0.0 for s, e in zip(shifts, edits, strict=True)]
    mean = sum(rates) / windows if windows else 0.0
    sd = (sum((r - mean) ** 2 for r in rates) / (windows - 1)) ** 0.5 if windows > 1 else 0.0
    return {
        "matches": kinds["M"], "substitutions": kinds["S"], "deletions": kinds["D"], "insertions": kinds["I"],
        "ref_chars_norm": n, "long_spans": sum(s for s in spans if s >= 50), "longest_span": max(spans, default=0), "error_runs": len(errors),
        "window_size": size, "window_count": windows, "window_max_cer": max(rates, default=0.0), "window_sd_cer": sd, "window_max_sdr": max(drifts, default=0.0),
        "wer_edits": distance(ref, hyp), "ref_tokens_norm": len(ref), **boundaries(gt_text, htr_text),
    }


def _folded(text: str, words: list[str]) -> list[str]:
    out = text.casefold().split()
    return out if len(out) == len(words) else [w.casefold() for w in words]


def boundary_spans(gt_text: str, htr_text: str):
    """Words split, merged or re-cut: runs of up to four words on either side that read the same when joined. Kind and both texts of each."""
    gt, htr = gt_text.split(), htr_text.split()
    a, b = _folded(gt_text, gt), _folded(htr_text, htr)
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            size = 16
            while a[i : i + size] == b[j : j + size] and i + size <= n and j + size <= m:
                i, j, size = i + size, j + size, size * 2
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            continue
        p = q = 1
        if not a[i].startswith(b[j]) and not b[j].startswith(a[i]):
            i, j = i + 1, j + 1
            continue
        right, text = {}, ""
        for y, w in enumerate(b[j : j + BOUNDARY_SPAN], 1):
            text += w
            right.setdefault(text, y)
        text = ""
        for x, w in enumerate(a[i : i + BOUNDARY_SPAN], 1):
            text += w
            y = right.get(text)
            if y:
                p, q = x, y
                yield "splits" if x == 1 else "merges" if y == 1 else "complex_boundary", " ".join(gt[i : i + x]), " ".join(htr[j : j + y])
                break
        i, j = i + p, j + q


def boundaries(gt_text: str, htr_text: str) -> dict:
    """How many words are split, merged and re-cut, and the words of both sides."""
    counts = {"splits": 0, "merges": 0, "complex_boundary": 0}
    for kind, _, _ in boundary_spans(gt_text, htr_text):
        counts[kind] += 1
    return {**counts, "boundary_events": sum(counts.values()), "gt_tokens": len(gt_text.split()), "htr_tokens": len(htr_text.split())}
