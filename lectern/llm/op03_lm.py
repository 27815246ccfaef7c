"""Language-model scoring with an Elias-Fano n-gram trie.

A trigram model with absolute discounting D, interpolated with bigrams and the unigram estimate of the base score:

    p(c | a b) = max(n(abc) - D, 0) / n(ab) + l(ab) * p(c | b)
    p(c | b)   = max(n(bc) - D, 0) / n(b) + l(b) * p(c),         p(c) = (n(c) + 0.5) / (N + 0.5 (V + 1))

where l is what the discounts of a context leave over (D times its distinct followers, divided by its places), so that every distribution
sums to one over all V known words and one unknown. The first word of a text has p(c); the second has a begin mark as a. N-grams of all words of all training rows are stored.

* All that a place (a, b, c) needs but n(c) can be counted where all places with the same middle word b meet, so one exchange serves both
  orders. Places are sent in blobs: about every ``BATCH`` tokens a task sorts its places and packs those of one shard as compressed columns.
  A shard has about ``SHARD`` places, so shards grow with the tokens and not with the cluster; beyond ``FAN`` shards they are dealt in
  two steps, so a task never sends more than ``FAN`` blobs a batch.
* The places of a word with more than ``unit`` of them are dealt to classes by a hash of the word before it, those of a pair (a, b) with more
  than ``unit`` by the word itself. That is a matter of layout: the model is the same. What such a word's bigrams and such a pair's totals are
  over all classes is counted first, in a pass over the texts of its own, and sent to each class. A triple that alone has so many places is not
  sent: all its counts are known by then, and its term is broadcast to the texts.
* A shard keeps its counts as a trie: units, their contexts (unit, a) and bigrams (unit, c), and the trigrams (context, c). Every level is a rising
  sequence in Elias-Fano form, with monotone pointers to the ranges of the next one, and short codes of the counts, which lose nothing. The
  levels are read where they lie, in an anonymous memory map: a directory of ones per 256 bits answers select, and
  successor search goes from a context's range to the place in it. Nothing is unpacked, and no file is written.
* Words are 64-bit hashes; the at most ``vocabulary`` most frequent ones (16 bytes each, broadcast) travel as numbers. n(c) of other words is
  joined by hash, as rows.

What is gathered grows with the input: every distinct trigram is in some shard.
Nulls: a null text is empty (one token, the end); a null id counts as the empty text for the split. Rows equal in id and text share one score.
Without training rows N and V are 0 and both scores come from unknown words alone. An empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import buffers, evenly, lean, mix, most_frequent, slices, words, written

DISCOUNT = 0.75
#: tokens whose places are packed together, places to a shard, shards to a task, shards that one step deals to
BATCH, SHARD, TASK, FAN = 1 << 21, 1 << 20, 6, 4096
#: a word or pair with more places is split; units of a whole corpus are at most so many
UNIT, UNITS = 1 << 20, 1 << 20
VOCABULARY = 1 << 20
#: a triple with more places than so many units needs a broadcast
WIDE = 1
#: distinct words that a task holds before it passes them on
WORDS = 1 << 20
END, BEGIN, TOKENS, TEXTS = (np.uint64(0x5EED0FE4D0FE4D01 + 2 * k) for k in range(4))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class EliasFano:
    """A rising sequence of integers below 2**63: low bits packed, high bits in unary, and the ones before each 256 of these.

    Access and successor search work on the packed bytes, on many keys at once.
    """

    def __init__(self, n: int, low: int, last: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.last, self.highs, self.ones = n, low, last, highs.reshape(-1, 4), ones
        # eight bytes from any byte on
        self.lows = np.ndarray((max(len(lows) - 7, 0),), "<u8", lows, strides=(1,))

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        n = len(values)
        last = int(values[-1]) if n else 0
        low = min(56, max(0, ((last + 1) // max(n, 1)).bit_length() - 1))
        top = last >> low
        bits = np.zeros(-(-(n + top + 1) // 512) * 512, np.uint8)  # an even number of blocks
        bits[(values >> low) + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little")
        blocks = np.bitwise_count(highs.view("<u8")).reshape(-1, 4).sum(1, dtype=np.int64)
        ones = (np.cumsum(blocks) - blocks).astype("<u4")
        packed = []
        for at in range(0, n, 1 << 18):
            part = values[at : at + (1 << 18)]
            columns = np.empty((len(part), low), np.uint8)
            for k in range(low):
                columns[:, k] = (part >> k) & 1
            packed.append(np.packbits(columns.ravel(), bitorder="little").tobytes())
        lows = b"".join(packed)
        lows += bytes(8 + -len(lows) % 8)
        return struct.pack("<QQQQQ", n, low, top, len(lows), len(ones)) + lows + highs.tobytes() + ones.tobytes()

    @classmethod
    def view(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, low, last, a, b = struct.unpack("<QQQQQ", data[at : at + 40].tobytes())
        at += 40
        lows, highs, ones = data[at : at + a], data[at + a : at + a + 32 * b], data[at + a + 32 * b : at + a + 36 * b]
        return cls(n, low, last, lows, highs.view("<u8"), ones.view("<u4")), at + a + 36 * b

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.int64) * self.low
        return ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray, zero: bool) -> np.ndarray:
        """The place of the i-th one, or zero, of the unary bits."""
        before = 256 * np.arange(len(self.ones)) - self.ones if zero else self.ones
        block = np.searchsorted(before, i, "right") - 1
        rest = i - before[block]
        row = self.highs[block]
        if zero:
            row = ~row
        upto = np.cumsum(np.bitwise_count(row), axis=1, dtype=np.int64)
        k = (upto <= rest[:, None]).sum(1)
        each = np.arange(len(i))
        rest = rest - np.where(k > 0, upto[each, k - 1], 0)
        word, at = row[each, np.minimum(k, 3)], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            under = word & np.uint64((1 << width) - 1)
            count = np.bitwise_count(under).astype(np.int64)
            up = rest >= count
            at += np.where(up, width, 0)
            rest = np.where(up, rest - count, rest)
            word = np.where(up, word >> np.uint64(width), under)
        return 256 * block + 64 * k + at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select(i, False) - i) << self.low) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose high part is at least ``high``, and the first one after those that have it."""
        begin, end = np.where(high > self.last, self.n, 0), np.full(len(high), self.n)
        if not self.n:
            return begin, end
        zero = np.where(high > 0, high, 1) - 1
        inner = np.flatnonzero(high <= self.last)
        at = self._select(zero[inner], True)
        first = high[inner] == 0
        begin[inner] = np.where(first, 0, at - zero[inner])
        # ones up to the next zero, if the word has one
        rest = (~self.highs.ravel()[at >> 6] >> (at & 63).astype(np.uint64)) >> np.uint64(1)
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end[inner] = np.where(first, at, begin[inner] + run)
        far = inner[(rest == 0) & ~first & (high[inner] < self.last)]
        end[far] = self._select(high[far], True) - high[far]
        end[inner[(rest == 0) & ~first & (high[inner] >= self.last)]] = self.n
        return begin, end

    def _search(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = np.minimum(keys >> self.low, self.last + 1)
        begin, end = self._bucket(high)
        a = np.maximum(lo, begin)
        end = np.maximum(a, np.minimum(hi, end))
        b, rest = end.copy(), keys & ((1 << self.low) - 1)
        live = np.flatnonzero(a < b)
        while len(live):
            x, y = a[live], b[live]
            mid = (x + y) >> 1
            less = self._low(mid) < rest[live]
            a[live], b[live] = np.where(less, mid + 1, x), np.where(less, y, mid)
            live = live[a[live] < b[live]]
        return a, end

    def successor(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least the key, or hi."""
        return np.minimum(self._search(keys, lo, hi)[0], np.maximum(lo, hi))

    def find(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor of each key in [lo, hi), and whether it is the key: its high bits are if it stands before those of the next."""
        place, end = self._search(keys, lo, hi)
        there = place < end
        there[there] = self._low(place[there]) == keys[there] & ((1 << self.low) - 1)
        return place, there


def _coded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct counts, and the code of each in as few bytes as they allow."""
    book, code = np.unique(count, return_inverse=True)
    return book, code.astype("<u1" if len(book) <= 1 << 8 else "<u2" if len(book) <= 1 << 16 else "<u4")


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Trie:
    """Units, contexts, bigrams and trigrams of a shard."""

    @staticmethod
    def pack(unit: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, width: int, follow: tuple, spread: tuple) -> tuple[bytes, tuple[np.ndarray, ...]]:
        """unit, a, c: sorted and distinct, n: how often each was seen; words are numbers below ``width``. follow: unit, c and n of all bigrams of units
        whose word is dealt to several; spread: unit, a, places and distinct followers of contexts that are. The levels, and each trigram's unit,
        context and bigram in them."""
        roots = np.unique(np.concatenate([unit, follow[0]]))
        root = np.searchsorted(roots, unit)
        apart = np.isin(roots, follow[0])[root] if len(follow[0]) else np.zeros(len(unit), bool)
        key = root * width + c
        pair, where = np.unique(key[~apart], return_inverse=True)
        seen = np.append(np.bincount(where, n[~apart], len(pair)).astype(np.int64), follow[2])
        pair = np.append(pair, np.searchsorted(roots, follow[0]) * width + follow[1])
        order = np.argsort(pair)
        pair, seen = pair[order], seen[order]
        bigram, first_of_unit = np.searchsorted(pair, key), _firsts(pair // width)
        key, others = root * width + a, np.searchsorted(roots, spread[0]) * width + spread[1]
        contexts = np.unique(np.append(key, others))
        context, others = np.searchsorted(contexts, key), np.searchsorted(contexts, others)
        size, kinds = np.bincount(context, n, len(contexts)), np.bincount(context, minlength=len(contexts)).astype(float)
        size[others], kinds[others] = spread[2], spread[3]
        sizes = np.add.reduceat(seen, first_of_unit).astype(float) if len(pair) else np.zeros(0)
        (book2, code2), (book3, code3) = _coded(seen), _coded(n)
        levels = [
            EliasFano.pack(roots),
            EliasFano.pack(np.searchsorted(contexts // width, np.arange(len(roots) + 1))),
            EliasFano.pack(contexts),
            EliasFano.pack(np.searchsorted(context, np.arange(len(contexts) + 1))),
            EliasFano.pack(context * width + c),
            EliasFano.pack(np.append(first_of_unit, len(pair))),
            EliasFano.pack(pair),
        ]
        left = lambda kinds, size: (DISCOUNT * kinds / size).astype("<f8")
        columns = [book2.astype("<i8"), code2, sizes, left(np.diff(np.append(first_of_unit, len(pair))), sizes), book3.astype("<i8"), code3, size.astype("<f8"), left(kinds, size)]
        raw = [x.tobytes() for x in columns]
        packed = b"".join([struct.pack("<Q", width), *levels, struct.pack("<8Q", *map(len, raw)), struct.pack("<2Q", code2.itemsize, code3.itemsize), *(r + bytes(-len(r) % 8) for r in raw)])
        return packed, (root, context, bigram)

    def __init__(self, data: np.ndarray):
        (self.width,), at = struct.unpack("<Q", data[:8].tobytes()), 8
        levels = []
        for _ in range(7):
            level, at = EliasFano.view(data, at)
            levels.append(level)
        self.units, self.to_contexts, self.contexts, self.to_trigrams, self.trigrams, self.to_bigrams, self.bigrams = levels
        *sizes, wide2, wide3 = struct.unpack("<10Q", data[at : at + 80].tobytes())
        at, columns = at + 80, []
        for size, kind in zip(sizes, ("<i8", f"<u{wide2}", "<f8", "<f8", "<i8", f"<u{wide3}", "<f8", "<f8"), strict=True):
            columns.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.book2, self.code2, self.size2, self.left2, self.book3, self.code3, self.size3, self.left3 = columns

    def _share2(self, bigram: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (self.book2[self.code2[bigram]] - DISCOUNT) / self.size2[root]

    def _share3(self, trigram: np.ndarray, context: np.ndarray) -> np.ndarray:
        return (self.book3[self.code3[trigram]] - DISCOUNT) / self.size3[context]

    @staticmethod
    def _child(level: EliasFano, pointers: EliasFano, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key among the children of its node, and whether it is there."""
        first = _firsts(node)
        each = np.diff(np.append(first, len(node)))
        ends = pointers.get(np.concatenate([node[first], node[first] + 1]))
        return level.find(key, *(np.repeat(x, each) for x in np.split(ends, 2)))

    def stored(self, root: np.ndarray, context: np.ndarray, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y, as in ``query``, of the trigrams in the trie, in their order."""
        left = self.left3[context]
        return self._share3(np.arange(len(context)), context) + left * self._share2(bigram, root), left * self.left2[root]

    def query(self, unit: np.ndarray, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y of each place: its probability is x + y * p(c). Runs of equal units and contexts are looked up once."""
        x, y = np.zeros(len(unit)), np.ones(len(unit))
        if not self.units.n or not len(unit):
            return x, y
        runs = lambda first: np.repeat(np.arange(len(first)), np.diff(np.append(first, len(unit))))
        first = _firsts(unit)
        zero = np.zeros(len(first), np.int64)
        root, there = self.units.find(unit[first], zero, zero + self.units.n)
        run = runs(first)
        own = np.flatnonzero(there[run])
        node, word = root[run][own], c[own]
        place, found = self._child(self.bigrams, self.to_bigrams, node, node * self.width + word)
        x[own[found]], y[own] = self._share2(place[found], node[found]), self.left2[node]
        first = _firsts(unit, a)
        inner = np.flatnonzero(there[run[first]])
        node = root[run[first[inner]]]
        context, known = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        context[inner], known[inner] = self._child(self.contexts, self.to_contexts, node, node * self.width + a[first[inner]])
        run = runs(first)
        own = np.flatnonzero(known[run])
        node, left = context[run][own], self.left3[context[run][own]]
        place, found = self._child(self.trigrams, self.to_trigrams, node, node * self.width + c[own])
        x[own] *= left
        y[own] *= left
        x[own[found]] += self._share3(place[found], node[found])
        return x, y


def mapped(blob: bytes) -> np.ndarray:
    """The bytes in an anonymous memory map: pages of their own, outside the heap, without a file."""
    area = mmap.mmap(-1, max(1, len(blob)))
    area.write(blob)
    return np.frombuffer(area, np.uint8, len(blob))


def _tokens(batch: pa.RecordBatch):
    """Token hashes of each part of a batch, the end token after each row, and row offsets."""
    for part in slices(batch, "text", 1 << 20):
        raw, off = buffers(part.column("text"))
        h, _, _, per = words(raw, off)
        yield part, np.insert(h, per[1:], END), per + np.arange(len(per))


def unigrams(docs: DataFrame) -> DataFrame:
    """h and c: the count of each word in the training rows, and under ``TOKENS`` and ``TEXTS`` those of all rows. Written."""

    def merged(found):
        h, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return h, np.bincount(where, np.concatenate([y for _, y in found]), len(h)).astype(np.int64)

    def emit(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    def run(batches):
        found, held, size = [], 0, [0, 0]
        for batch in batches:
            for part, h, at in _tokens(batch):
                size = [size[0] + len(h), size[1] + part.num_rows]
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(at))
                found.append(np.unique(h[train], return_counts=True))
                held += len(found[-1][0])
                if held >= WORDS:
                    found = [merged(found)]
                    held = 0
                    if len(found[0][0]) >= WORDS:
                        yield emit(*found.pop())
        if found:
            yield emit(*merged(found))
        yield emit(np.array([TOKENS, TEXTS]), np.array(size))

    return written(docs.select("text", "train").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "unigrams")


@dataclass
class Vocabulary:
    """The most frequent words, by hash; a word's number is its place, the begin mark's the one after the last, other words follow."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    #: into how many classes a word, the begin mark and any other word is split
    parts: np.ndarray = field(default_factory=lambda: np.ones(2, np.int32))
    #: split pairs (a, b) as sorted codes, their first class and their number of classes, their places and distinct followers in training rows
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: hashes of triples that are not sent, sorted, and their log probabilities
    wide: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    wide_terms: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def begin(self) -> int:
        return len(self.hashes)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1).astype(np.int32)
        at[self.hashes[at] != h] = -1
        return at

    def named(self, c: np.ndarray) -> np.ndarray:
        """The numbers of words given by their number or, if they have none, by their hash: else -1."""
        return np.where((c >= 0) & (c < self.begin), c, -1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def split(self, unit: int, rows: int) -> None:
        self.parts = np.append(np.maximum(1, -(-self.counts // unit)), [max(1, -(-rows // unit)), 1]).astype(np.int32)

    def split_pairs(self, codes: np.ndarray, counts: np.ndarray, unit: int) -> None:
        order = np.argsort(codes)
        self.pairs, self.pair_parts = codes[order], -(-counts[order] // unit)
        b = self.pairs & 0xFFFFFFFF
        # a word's own classes come first, then those of its pairs
        by_word = np.argsort(b, kind="stable")
        before, own = np.cumsum(self.pair_parts[by_word]) - self.pair_parts[by_word], b[by_word]
        first = _firsts(own)
        self.pair_first = np.empty(len(b), np.int64)
        self.pair_first[by_word] = self.parts[own] + before - np.repeat(before[first], np.diff(np.append(first, len(b))))

    def classes(self, word: int) -> int:
        """Into how many classes the places of a word are dealt, those of its split pairs included."""
        return int(self.parts[word] + self.pair_parts[(self.pairs & 0xFFFFFFFF) == word].sum())

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair among the split ones, and whether it is one."""
        code = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        return at, self.pairs[at] == code if len(self.pairs) else np.zeros(len(code), bool)


@dataclass
class Places:
    """Places as columns: number of the middle word, its class, the word before, the word itself, and the row, counted within the columns.

    Other words' numbers begin after the begin mark's and lead to ``rare``, sorted hashes.
    """

    b: np.ndarray
    g: np.ndarray
    a: np.ndarray
    c: np.ndarray
    row: np.ndarray
    uids: np.ndarray
    train: np.ndarray
    rare: np.ndarray

    def pack(self, own: np.ndarray, base: int) -> bytes:
        """The places at ``own``, which are sorted by middle word, class and the word before, as compressed columns."""
        b, g, a, c = (x[own] for x in (self.b, self.g, self.a, self.c))
        rows, row = np.unique(self.row[own], return_inverse=True)
        used = np.unique(np.concatenate([x[x >= base] for x in (a, b, c)]))
        a, b, c = (np.where(x >= base, base + np.searchsorted(used, x), x) for x in (a, b, c))
        first = _firsts(b, g)
        step = np.diff(a, prepend=a[:1] * 0)
        step[first] = a[first]
        columns = [np.diff(b, prepend=b[:1] * 0), g, step, c, row]  # steps may be negative: modulo 2**32
        planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in columns]
        raw = [self.uids[rows].tobytes(), self.train[rows].astype(np.uint8).tobytes(), self.rare[used - base].tobytes()]
        return zstandard.ZstdCompressor(3).compress(struct.pack("<3Q", len(own), len(rows), len(used)) + b"".join(raw + planes))

    @classmethod
    def unpack(cls, blob: bytes) -> Places:
        """The same columns."""
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, k, r = struct.unpack("<3Q", data[:24])
        at = 24
        uids, train = np.frombuffer(data, np.int64, k, at), np.frombuffer(data, np.uint8, k, at + 8 * k)
        at += 9 * k
        rare = np.frombuffer(data, np.uint64, r, at)
        at += 8 * r
        columns = []
        for _ in range(5):
            planes = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n)
            columns.append(np.ascontiguousarray(planes.T).view("<i4").ravel())
            at += 4 * n
        b, g, step, c, row = columns
        b = np.cumsum(b, dtype=np.int32)
        first = _firsts(b, g)
        upto = np.cumsum(step, dtype=np.int32)
        a = upto - np.repeat(upto[first] - step[first], np.diff(np.append(first, n))) if n else step
        return cls(b, g, a, c, row, uids, train == 1, rare)


def _back(x: np.ndarray, place: np.ndarray, k: int, fill) -> np.ndarray:
    """The value k places before in the same row, or ``fill``."""
    out = np.full_like(x, fill)
    out[k:] = x[:-k]
    out[place < k] = fill
    return out


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(mix(a) + b) * _ODD + c)


def context(v: Vocabulary, h: np.ndarray, number: np.ndarray, at: np.ndarray, wide: bool = False):
    """Middle word, the class that its probabilities are conditioned on (0, as they depend on no layout) and the word before of each token (row
    offsets ``at``), and if asked for the hash of triples of split words, else 0."""
    place = np.arange(len(h), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), np.diff(at))
    b, a = _back(number, place, 1, v.begin), _back(number, place, 2, v.begin)
    triple = np.zeros(len(h) if wide else 0, np.uint64)
    if wide:
        hot = np.flatnonzero((v.parts[np.minimum(b, v.begin + 1)] > 1) & (b != v.begin))
        triple[hot] = _triple(np.where(place[hot] > 1, h[hot - 2], BEGIN), h[hot - 1], h[hot])
    return b, np.zeros(len(h), np.int32), a, triple


def layout(v: Vocabulary, h: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The class that each token's place is dealt to: of the word before, of the word itself after the begin mark and a split pair."""
    g, parts = np.zeros(len(h), np.int32), v.parts[np.minimum(b, v.begin + 1)]
    hot = np.flatnonzero(parts > 1)
    if len(hot):
        before = np.where(a[hot] == v.begin, BEGIN, h[np.maximum(hot - 2, 0)])
        own = (mix(np.where(b[hot] == v.begin, h[hot], before)) % parts[hot].astype(np.uint64)).astype(np.int64)
        if len(v.pairs):
            at, there = v.pair(a[hot], b[hot])
            own = np.where(there, v.pair_first[at] + (mix(h[hot]) % v.pair_parts[at].astype(np.uint64)).astype(np.int64), own)
        g[hot] = own
    return g


def _shard(name: np.ndarray, g: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(name + (g.astype(np.uint64) + np.uint64(1)) * _ODD) % np.uint64(shards)).astype(np.int64)


def _followers(docs: DataFrame, shared, pairs: bool) -> DataFrame:
    """key, c, n, t: how often, in all rows and in training rows, the word c (its number, else its hash) follows a split word or the begin mark (by number) or, for ``pairs``, a
    split pair (by its place among them)."""

    def merged(found):
        key, c, n, t = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((c, key))
        key, c = key[order], c[order]
        first = _firsts(key, c)
        n, t = (np.add.reduceat(x[order], first, dtype=np.int32) if len(first) else x for x in (n, t))
        return key[first], c[first], n, t

    def emit(key, c, n, t):
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(c), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], names=["key", "c", "n", "t"])

    def run(batches):
        v, found, held = shared.value, [], 0
        for batch in batches:
            for part, h, at in _tokens(batch):
                number = v.numbers(h)
                number[number < 0] = v.begin + 1
                b, _, a, _ = context(v, h, number, at)
                if pairs:
                    key, own = v.pair(a, b)
                else:
                    split = lambda x: v.parts[np.minimum(x, v.begin + 1)] > 1  # noqa: E731, B023
                    key, own = b, np.where(b == v.begin, split(number), split(b))
                own = np.flatnonzero(own)
                row = np.searchsorted(at, own, "right") - 1
                c = np.where(number[own] < v.begin, number[own], h[own].view(np.int64))
                found.append((key[own], c, np.ones(len(own), np.int32), part.column("train").to_numpy(zero_copy_only=False).astype(np.int32)[row]))
                held += len(own)
                if held >= WORDS:
                    found, held = [merged(found)], 0
                    if len(found[0][0]) >= WORDS:
                        yield emit(*found.pop())
        if found:
            yield emit(*merged(found))

    return written(docs.select("text", "train").mapInArrow(lean(run), "key int, c long, n long, t long").groupBy("key", "c").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "followers")


_BLOB = "shard int, blob binary"
#: how a blob of bigrams begins; those of places have the mark of their compression
_FOLLOW = b"F"


def _bigrams(followers: DataFrame, shared, shards: int) -> DataFrame:
    """shard and blob: all bigrams of a split word with their counts, for each of its classes."""

    def run(batches):
        v = shared.value

        def emit(held):
            key, c, t = (np.concatenate(x) for x in zip(*held, strict=True))
            word, count = int(key[0]), v.classes(int(key[0]))
            to = _shard(np.full(count, v.hashes[word]), np.arange(count), shards)
            number = v.named(c)
            order = np.argsort(number, kind="stable")
            c, t, number = c[order], t[order], number[order]
            other = int((number < 0).sum())
            planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(number[other:].astype(np.int64), prepend=0), t)]
            body = zstandard.ZstdCompressor(3).compress(struct.pack("<2Q", len(c), other) + c[:other].tobytes() + b"".join(planes))
            for g in range(count):
                yield pa.RecordBatch.from_arrays([pa.array([int(to[g])], pa.int32()), pa.array([_FOLLOW + struct.pack("<2Q", word, g) + body], pa.binary())], names=["shard", "blob"])

        held = []
        for batch in batches:
            key, c, t = (batch.column(x).to_numpy() for x in ("key", "c", "t"))
            first = _firsts(key)
            for x, y in zip(first, np.append(first[1:], len(key)), strict=True):
                if held and held[0][0][0] != key[x]:
                    yield from emit(held)
                    held = []
                held.append((key[x:y], c[x:y], t[x:y]))
        if held:
            yield from emit(held)

    return followers.select("key", "c", "t").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), _BLOB)


def _unfollow(blob: bytes, v: Vocabulary) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Word, class, hashes and counts of its followers."""
    word, g = struct.unpack("<2Q", blob[1:17])
    data = zstandard.ZstdDecompressor().decompress(blob[17:])
    n, other = struct.unpack("<2Q", data[:16])
    whole = lambda at, k: np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * k, at).reshape(8, k).T).view(np.int64).ravel()
    at = 16 + 8 * other
    return word, g, np.append(np.frombuffer(data, np.uint64, other, 16), v.hashes[np.cumsum(whole(at, n - other))]), whole(at + 8 * (n - other), n)


def _names(v: Vocabulary, rare: np.ndarray) -> np.ndarray:
    return np.concatenate([v.hashes, [BEGIN], rare])


def _units(b: np.ndarray, g: np.ndarray, width: int) -> np.ndarray:
    """A number of each unit (word and class): a word's own for its first class, numbers from ``width`` on for others."""
    out = b.astype(np.int64)
    other = np.flatnonzero(g)
    if len(other):
        out[other] = width + np.unique((out[other] << 32) | g[other], return_inverse=True)[1]
    return out


def _order(unit: np.ndarray, a: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """What sorts by unit, a, c."""
    size = int(width - 1).bit_length()
    if int(unit.max(initial=0)).bit_length() + 2 * size <= 63:
        key = unit << size
        key |= a
        key <<= size
        key |= c
        return np.argsort(key)
    return np.lexsort((c, a, unit))


def _deal(places: Places, v: Vocabulary, shards: int, per: int):
    """A blob for each run of ``per`` shards that has places."""
    base, width = v.begin + 1, v.begin + 1 + len(places.rare)
    names, group = _names(v, places.rare), np.empty(len(places.b), np.uint16 if -(-shards // per) <= 1 << 16 else np.int64)
    for at in range(0, len(group), 1 << 18):
        own = slice(at, at + (1 << 18))
        group[own] = _shard(names[places.b[own]], places.g[own], shards) // per
    order = _order(_units(places.b, places.g, width), places.a, places.c, width)
    order = order[np.argsort(group[order], kind="stable")]
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(group[order].astype(np.int64)) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for x, y in zip(bounds, bounds[1:], strict=False):
        own = order[x:y]
        yield pa.RecordBatch.from_arrays([pa.array([int(group[own[0]])], pa.int32()), pa.array([places.pack(own, base)], pa.binary())], names=["shard", "blob"])


def _places(docs: DataFrame, shared, shards: int, per: int, tokens: int = BATCH) -> DataFrame:
    """shard (or run of shards) and blob: the places of each batch."""

    def gather(v, parts) -> Places:
        h, number, at = np.concatenate([h for _, h, _, _ in parts]), np.concatenate([x for *_, x in parts]), np.zeros(1, np.int64)
        for _, _, own, _ in parts:
            at = np.concatenate([at, at[-1] + own[1:]])
        other = np.flatnonzero(number < 0)
        rare, place = np.unique(h[other], return_inverse=True)
        number[other] = v.begin + 1 + place
        b, _, a, triple = context(v, h, number, at, len(v.wide) > 0)
        g = layout(v, h, b, a)
        uids = np.concatenate([p.column("uid").to_numpy() for p, *_ in parts])
        train = np.concatenate([p.column("train").to_numpy(zero_copy_only=False).astype(bool) for p, *_ in parts])
        row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        if len(v.wide):
            sent = v.wide[np.minimum(np.searchsorted(v.wide, triple), len(v.wide) - 1)] != triple
            b, g, a, number, row = (x[sent] for x in (b, g, a, number, row))
        return Places(b, g, a, number, row, uids, train, rare)

    def run(batches):
        v = shared.value
        held, n = [], 0
        for batch in batches:
            for part, h, at in _tokens(batch):
                held.append((part.select(["uid", "train"]), h, at, v.numbers(h)))
                n += len(h)
                if n >= tokens:
                    places, held, n = gather(v, held), [], 0
                    yield from _deal(places, v, shards, per)
                    del places
        if held:
            yield from _deal(gather(v, held), v, shards, per)

    return docs.select("uid", "train", "text").mapInArrow(lean(run), _BLOB)


def _dealt_again(places: DataFrame, shared, shards: int) -> DataFrame:
    """The second step beyond ``FAN`` shards: each run of shards is dealt to its shards."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                yield from _deal(Places.unpack(blob.as_buffer().to_pybytes()), shared.value, shards, 1)

    return places.repartition(FAN, "shard").mapInArrow(lean(run), _BLOB)


_TERMS = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("h", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("k", pa.int64())])


def _solve(blobs: list[bytes], v: Vocabulary):
    """Builds a shard's trie and scores its places.

    kind 0: uid, its sums of log probabilities (x) and of base scores (y) over k words of the vocabulary; kind 1: uid, another word h that stands
    k times with probability x + y p(h).
    """
    base = v.begin + 1
    parts, follow = [], []
    while blobs:
        blob = blobs.pop()
        if blob[:1].to_pybytes() == _FOLLOW:
            follow.append(_unfollow(blob.to_pybytes(), v))
        else:
            parts.append(Places.unpack(blob))
        del blob
    if not parts:
        return
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for *_, h, _ in follow)])
    numbers = v.numbers(hashes)
    rare = np.unique(np.concatenate([*(p.rare for p in parts), hashes[numbers < 0]]))
    width = base + len(rare)
    uids, uid = np.unique(np.concatenate([p.uids for p in parts]), return_inverse=True)
    uid, done = uid.astype(np.int32), 0
    for p in parts:
        table = np.concatenate([np.arange(base, dtype=np.int32), (base + np.searchsorted(rare, p.rare)).astype(np.int32)])
        p.b, p.a, p.c = table[p.b], table[p.a], table[p.c]
        p.train = p.train[p.row] & (p.b != v.begin)
        k = len(p.uids)
        p.row = uid[done : done + k][p.row]
        done += k
    b, g, a, c, owner, train = (np.concatenate([getattr(p, x) for p in parts]) for x in ("b", "g", "a", "c", "row", "train"))
    del parts, p, table
    unit = _units(np.append(b, np.array([word for word, *_ in follow], b.dtype)), np.append(g, np.array([k for _, k, *_ in follow], g.dtype)), width)
    unit, units = unit[: len(b)], unit[len(b) :]
    order = _order(unit, a, c, width)
    unit, a, c, owner, train = unit[order], a[order], c[order], owner[order], train[order]
    first = _firsts(unit, a, c)
    number = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(unit))))
    seen = np.add.reduceat(train, first, dtype=np.int64)
    unit, a, c, b = unit[first], a[first].astype(np.int64), c[first].astype(np.int64), b[order[first]]
    del order, train, g
    known = seen > 0
    # what the classes of a word and of a pair have together
    each = np.array([len(h) for *_, h, _ in follow], np.int64)
    numbers = np.where(numbers < 0, base + np.searchsorted(rare, hashes), numbers).astype(np.int64)
    counts = np.concatenate([np.zeros(0, np.int64), *(t for *_, t in follow)])
    head = _firsts(unit, a)
    at, there = v.pair(a[head], b[head])
    there[there] = v.pair_size[at[there]] > 0
    at, head = at[there], head[there]
    spread = (unit[head], a[head], v.pair_size[at], v.pair_kinds[at])
    packed, places = Trie.pack(unit[known], a[known], c[known], seen[known], width, (np.repeat(units, each), numbers, counts), spread)
    trie = Trie(mapped(packed))
    del packed, b
    x, y = np.zeros(len(unit)), np.ones(len(unit))
    x[known], y[known] = trie.stored(*places)
    del places
    others = np.flatnonzero(~known)
    for at in range(0, len(others), 1 << 17):
        own = others[at : at + (1 << 17)]
        x[own], y[own] = trie.query(unit[own], a[own], c[own])
    counted = c < len(v.counts)
    p = v.unigram(v.counts[np.minimum(c, len(v.counts) - 1)] if len(v.counts) else np.zeros(len(c)))
    term, plain_term = np.log10(x + y * p), np.log10(p)

    def batch(kind, key, h=None, px=None, py=None, k=None):
        size = len(key)
        fill = lambda v, t: pa.nulls(size, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(key, pa.int64()), fill(h, pa.int64()), fill(px, pa.float64()), fill(py, pa.float64()), fill(k, pa.int64())], schema=_TERMS)

    plain = counted[number]
    own, at = owner[plain], number[plain]
    k = np.bincount(own, minlength=len(uids))
    some = k > 0
    yield batch(0, uids[some], px=np.bincount(own, term[at], len(uids))[some], py=np.bincount(own, plain_term[at], len(uids))[some], k=k[some])
    other = np.flatnonzero(~plain)
    if len(other):
        key, k = np.unique(owner[other].astype(np.int64) * len(unit) + number[other], return_counts=True)
        own = key % len(unit)
        yield batch(1, uids[key // len(unit)], rare[c[own] - base].view(np.int64), x[own], y[own], k)


def _terms(places: DataFrame, shared) -> DataFrame:
    """What ``_solve`` gives of each shard, sums by uid added up over the shards of a task."""

    def added(held):
        uid, where = np.unique(np.concatenate([b.column("uid").to_numpy() for b in held]), return_inverse=True)
        x, y, k = (np.bincount(where, np.concatenate([b.column(c).to_numpy() for b in held]), len(uid)) for c in ("x", "y", "k"))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(uid), np.int32)), pa.array(uid), pa.nulls(len(uid), pa.int64()), pa.array(x), pa.array(y), pa.array(k.astype(np.int64))], schema=_TERMS)

    def shards(batches):
        blobs, at = [], None
        for batch in batches:
            for s, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):
                if blobs and s != at:
                    yield blobs
                    blobs = []
                at = s
                blobs.append(blob.as_buffer())
        if blobs:
            yield blobs

    def run(batches):
        held = []
        for blobs in shards(batches):
            first = True
            for out in _solve(blobs, shared.value):
                if not first:
                    yield out
                    continue
                held.append(out)
                first = False
                if sum(b.num_rows for b in held) >= 1 << 20:
                    held = [added(held)]
                    if held[0].num_rows >= 1 << 19:
                        yield held.pop()
        if held:
            yield added(held)

    return places.mapInArrow(lean(run), "kind int, uid long, h long, x double, y double, k long")


def _wide_terms(docs: DataFrame, shared) -> DataFrame:
    """uid, and its sums of log probabilities and base scores over k places whose triples were not sent."""

    def run(batches):
        v = shared.value
        for batch in batches:
            for part, h, at in _tokens(batch):
                number = v.numbers(h)
                *_, triple = context(v, h, np.where(number < 0, v.begin + 1, number).astype(np.int32), at, True)
                found = np.minimum(np.searchsorted(v.wide, triple), len(v.wide) - 1)
                own = np.flatnonzero(v.wide[found] == triple)
                score = np.zeros((3, len(h)))
                score[0, own] = v.wide_terms[found[own]]
                score[1, own] = np.log10(v.unigram(v.counts[number[own]]))
                score[2, own] = 1
                x, y, k = (np.add.reduceat(z, at[:-1]) for z in score)
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(x), pa.array(y), pa.array(k.astype(np.int64))], names=["uid", "x", "y", "k"])

    return docs.select("uid", "text").mapInArrow(lean(run), "uid long, x double, y double, k long")


def _spread(v: Vocabulary, docs: DataFrame, unit: int) -> DataFrame:
    """Splits pairs and finds wide triples, with all that their classes need to know; returns the followers of split words."""
    spark = docs.sparkSession
    followers = _followers(docs, spark.sparkContext.broadcast(v), False)
    often = followers.filter(F.col("n") > unit).toPandas()
    a, b, n = often["key"].to_numpy(np.int64), v.named(often["c"].to_numpy(np.int64)), often["n"].to_numpy(np.int64)
    own = (b >= 0) & (v.parts[b] > 1)
    v.split_pairs((a[own] << 32) | b[own], n[own], unit)
    if not len(v.pairs):
        return followers
    thirds = _followers(docs, spark.sparkContext.broadcast(v), True)
    sums = lambda df: df.groupBy("key").agg(F.sum("t").alias("t"), F.count_if(F.col("t") > 0).alias("k")).toPandas()
    whole = sums(thirds)
    v.pair_size, v.pair_kinds = np.zeros(len(v.pairs), np.int64), np.zeros(len(v.pairs), np.int64)
    v.pair_size[whole["key"]], v.pair_kinds[whole["key"]] = whole["t"], whole["k"]
    wide = thirds.filter(F.col("n") > WIDE * unit).toPandas()
    number = v.named(wide["c"].to_numpy(np.int64))
    wide, c = wide[number >= 0], number[number >= 0]
    if len(wide):
        pair, t = wide["key"].to_numpy(np.int64), wide["t"].to_numpy(np.int64)
        a, b = v.pairs[pair] >> 32, v.pairs[pair] & 0xFFFFFFFF
        asked = spark.createDataFrame(sorted(set(zip(b.tolist(), wide["c"].tolist(), strict=True))), "key int, c long")
        low = {(r["key"], r["c"]): r["t"] for r in followers.join(F.broadcast(asked), ["key", "c"]).collect()}
        seen = np.array([low[x] for x in zip(b.tolist(), wide["c"].tolist(), strict=True)], np.int64)
        each = sums(followers.join(F.broadcast(asked.select("key").distinct()), "key")).set_index("key").loc[b]
        size, kinds, pairs, pair_kinds = each["t"].to_numpy(), each["k"].to_numpy(), v.pair_size[pair], v.pair_kinds[pair]

        def share(n, kinds, size, lower):
            return np.where(size > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(size, 1), lower)

        p = share(t, pair_kinds, pairs, share(seen, kinds, size, v.unigram(v.counts[c])))
        name = np.append(v.hashes, BEGIN)
        hashes = _triple(name[a], name[b], v.hashes[c])
        order = np.argsort(hashes)
        v.wide, v.wide_terms = hashes[order], np.log10(p)[order]
    return followers


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row, the model learned where ``train`` holds."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    docs = docs.withColumn("uid", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    sized = unigrams(docs)
    special = [int(x) - (1 << 64 if int(x) >> 63 else 0) for x in (TOKENS, TEXTS)]
    every = sized.filter(~F.col("h").isin(special))
    total = every.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, size = ({r["h"]: r["c"] for r in sized.filter(F.col("h").isin(special)).collect()}.get(x, 0) for x in special)
    top = most_frequent(every, "c", vocabulary).select("h", "c").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    v = Vocabulary(h[order], top.column("c").to_numpy()[order], int(total[0]), int(total[1]))
    del top

    unit = max(unit, -(-tokens // UNITS))
    v.split(unit, size)
    followers = _spread(v, docs, unit) if (v.parts[:-2] > 1).any() else None
    shared = spark.sparkContext.broadcast(v)
    shards = max(1, -(-tokens // shard))
    places = _places(docs, shared, shards, -(-shards // FAN))
    if shards > FAN:
        places = _dealt_again(places, shared, shards)
    if followers is not None:
        places = places.unionByName(_bigrams(followers.filter((F.col("key") != v.begin) & (F.col("t") > 0)), shared, shards))
    places = evenly(places, F.floor(F.col("shard") / TASK), -(-shards // TASK)).sortWithinPartitions("shard")
    solved = written(_terms(places, shared), "terms")

    scale = F.lit(float(v.total + 0.5 * (v.distinct + 1)))
    rarer = every.filter(F.col("c") <= int(v.counts.min()) if len(v.counts) else F.lit(True))
    p, k, none = (F.coalesce("c", F.lit(0)) + 0.5) / scale, F.col("k"), F.lit(0).cast("long")
    plain = lambda df: df.select("uid", "x", "y", k.alias("n"), k.alias("known"), none.alias("same"))
    other = solved.filter("kind = 1").join(rarer, "h", "left").select("uid", (k * F.log10(F.col("x") + F.col("y") * p)).alias("x"), (k * F.log10(p)).alias("y"), k.alias("n"), F.when(F.col("c") > 0, k).otherwise(0).alias("known"), none.alias("same"))
    # equal rows have one uid: their sums are theirs together
    rows = docs.select("uid", "doc_id", "train")
    sums = plain(solved.filter("kind = 0")).unionByName(other).unionByName(rows.select("uid", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), none.alias("n"), none.alias("known"), F.lit(1).cast("long").alias("same")))
    if len(v.wide):
        sums = sums.unionByName(plain(_wide_terms(docs, shared)))
    sums = sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("x", "y", "n", "known", "same")])
    share = lambda c: F.col(c) / F.col("same")
    return rows.join(sums, "uid").select("doc_id", "train", share("n").cast("long").alias("n_tokens"), share("known").cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), share("y").alias("base_score"), share("x").alias("score"))
