"""Benchmark decontamination by latent semantic retrieval.

1. Documents are cut into passages; hashed words get inverse passage frequencies counted over all passages.
2. A randomised SVD of the TF-IDF matrix of passages: every task multiplies its passages A with a fixed
   random matrix and adds up its share of A^T (A W); the sum over tasks (buckets x columns, of fixed size) goes to the driver, where
   a Nystrom factorisation gives the leading right singular vectors and values. The space is fitted on the passages of all documents.
3. Projecting a run of words is a sum over its words, so prefix sums over stretches of ``STRETCH`` words give the latent vector of every window of
   a grid over the texts of a batch. Window lengths
   rise by a fixed ratio, and an item is held against the windows of the length nearest its own. Windows whose cosine with the item
   reaches the item's threshold are candidates. The threshold is calibrated: ``share`` of the item's words, with
   none, half as many or as many foreign words set between or with a run lost, stand among words drawn by frequency at every misalignment that the
   window grid allows, and in 99 of 100 texts of each sort the best window must pass. Items are a stated query set, taken in blocks of ``item_block``; documents are read whole
   and never shuffled. Candidates that share too few of the item's words to hold a common subsequence long enough are
   dropped by bit masks of the item's places, joined over the run that is examined (the window and an item's length on both sides).
4. Around each candidate the longest common subsequence of words with the item is taken. A text is contaminated if it holds
   ``copy`` of the item in order, or, as a paraphrase, ``share`` of the item and ``answer`` of its last sentence.

Nulls: a null text has no words and is clean; null or wordless items match nothing; null ids are carried through. Items of fewer
than ``least`` words count only as whole exact runs. Repeated rows each get their rows; repeated items each match. Empty
tables give no matches, and ``clean`` then keeps every row. Other columns are ignored by ``search`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textkit import ALNUM, buffers, lean, slices, trim, words

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
COLUMNS, RANK = 40, 32
PASSAGE = 48
RATIO, FIRST = 1.6, 10
#: words whose latent vectors and bit masks are joined first; lengths and steps of windows are multiples
STRETCH = 4
#: places whose vectors are summed at a time
PART = 1 << 11
#: cosines that are worked out at a time
CELLS = 1 << 22


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _passages(batch: pa.RecordBatch):
    """Passage and bucket of each distinct pair, its count, and the number of passages of each part."""
    for part in slices(batch, "text"):
        raw, off = buffers(part.column("text"))
        h, _, _, per = words(raw, off, ALNUM)
        count = np.diff(per)
        first = np.concatenate([[0], np.cumsum(-(-count // PASSAGE))])
        row = np.repeat(np.arange(len(count)), count)
        key = ((first[row] + (np.arange(len(h)) - per[row]) // PASSAGE) << BUCKET_BITS) | _bucket(h)
        key = np.sort(key.astype(np.uint32) if first[-1] < 1 << (32 - BUCKET_BITS) else key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf, key = np.diff(np.append(new, len(key))), key[new].astype(np.int64)
        yield key >> BUCKET_BITS, key & (BUCKETS - 1), tf, int(first[-1])


def _summed(rows: np.ndarray, at: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows at ``at`` over the runs that begin at ``first``, some ``PART`` places at a time so that they stay in the cache."""
    out = np.empty((len(first), rows.shape[1]), np.float32)
    cut = np.unique(np.append(np.searchsorted(first, np.arange(0, len(at), PART)), len(first)))
    for x, y in zip(cut, cut[1:], strict=False):
        lo, hi = first[x], first[y] if y < len(first) else len(at)
        part = rows.take(at[lo:hi], axis=0)
        part *= weight[lo:hi, None]
        np.add.reduceat(part, first[x:y] - lo, axis=0, out=out[x:y])
    return out


def _distinct(batch: pa.RecordBatch):
    """Buckets of each distinct pair of passage and bucket, and the number of passages of each part: ``_passages`` without counts."""
    for part in slices(batch, "text"):
        raw, off = buffers(part.column("text"))
        h, _, _, per = words(raw, off, ALNUM)
        count = np.diff(per)
        first = np.concatenate([[0], np.cumsum(-(-count // PASSAGE))])
        row = np.repeat(np.arange(len(count)), count)
        key = ((first[row] + (np.arange(len(h)) - per[row]) // PASSAGE) << BUCKET_BITS) | _bucket(h)
        key = np.sort(key.astype(np.uint32) if first[-1] < 1 << (32 - BUCKET_BITS) else key)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        yield (key[new] & (BUCKETS - 1)).astype(np.int64), int(first[-1])


@dataclass
class Space:
    """Latent coordinates of each bucket of words, inverse frequencies included."""

    project: np.ndarray
    frequency: np.ndarray

    def prefix(self, h: np.ndarray, every: int = 1, more: int = 0) -> np.ndarray:
        """Latent sums of all words before each ``every``-th place and the end, one row per dimension; the last one ``more`` times again."""
        starts = np.arange(0, len(h), every)
        out = np.zeros((self.project.shape[1], len(starts) + 1 + more), np.float32)
        bucket = _bucket(h).astype(np.int32)
        for k, row in enumerate(np.ascontiguousarray(self.project.T)):
            part = row[bucket]
            np.cumsum(part if every == 1 else np.add.reduceat(part, starts), out=out[k, 1 : len(starts) + 1])
        out[:, len(starts) + 1 :] = out[:, len(starts), None]
        return out


def fit(docs: DataFrame, text_col: str = "text", seed: int = 3) -> Space | None:
    """The latent space: frequencies and singular vectors over all passages."""
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for bucket, k in _distinct(batch):
                df += np.bincount(bucket, minlength=BUCKETS)
                n += k
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(df[own], n))], names=["bucket", "df"])

    found = texts.mapInArrow(lean(count), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = dict(zip(found["bucket"], found["df"], strict=True))
    n = df.pop(-1, 0)
    if not n:
        return None
    idf = np.log1p(float(n)) * np.ones(BUCKETS)
    idf[list(df)] = np.log((1 + n) / (1 + np.array(list(df.values()), float))) + 1e-3
    rng = np.random.default_rng(seed)
    test = np.linalg.qr(rng.normal(size=(BUCKETS, COLUMNS)))[0].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), test))

    def multiply(batches):
        weight, omega = shared.value
        out = np.zeros((BUCKETS, COLUMNS), np.float32)
        for batch in batches:
            for passage, bucket, tf, k in _passages(batch):
                if not k:
                    continue
                value = tf.astype(np.float32) * weight[bucket]
                value /= np.sqrt(np.bincount(passage, value * value, k)).astype(np.float32)[passage]
                y = _summed(omega, bucket, value, np.searchsorted(passage, np.arange(k)))
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                ordered = bucket[order]
                first = np.flatnonzero(np.diff(ordered, prepend=-1))
                out[ordered[first]] += _summed(y, passage[order], value[order], first)
        own = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(out[own, k]) for k in range(COLUMNS))], names=["bucket", *(f"y{k}" for k in range(COLUMNS))])

    sums = texts.mapInArrow(lean(multiply), "bucket long, " + ", ".join(f"y{k} float" for k in range(COLUMNS))).groupBy("bucket").agg(*[F.sum(f"y{k}").cast("float").alias(f"y{k}") for k in range(COLUMNS)]).toPandas()
    y = np.zeros((BUCKETS, COLUMNS))
    y[sums["bucket"].to_numpy(np.int64)] = sums[[f"y{k}" for k in range(COLUMNS)]].to_numpy(float)
    frequency = np.zeros(BUCKETS)
    frequency[list(df)] = list(df.values())
    return Space((idf[:, None] * singular(y, test.astype(float))).astype(np.float32), frequency / frequency.sum())


def singular(y: np.ndarray, test: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors over their singular values, from y = A^T A test (Nystrom)."""
    shift = max(1e-12, 1e-7 * np.linalg.norm(y))
    shifted = y + shift * test
    core = test.T @ shifted
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.trace(core) * np.eye(len(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(root, shifted.T).T, full_matrices=False)
    value = np.sqrt(np.maximum(s**2 - shift, 1e-12))
    rank = int(min(rank, (value > 1e-6 * value[0]).sum()))
    return u[:, :rank] / value[:rank]


@dataclass
class Item:
    key: object
    words: list[int]
    answer: list[int]


def lcs(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time (Hyyro's bit-vector recurrence)."""
    full = (1 << size) - 1
    v = full
    for w in text:
        u = v & pattern.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _pattern(ws: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ws):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def items_of(rows: list[tuple[object, str | None]]) -> list[Item]:
    def hashed(text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return words(raw, np.array([0, len(raw)]), ALNUM)[0].tolist()

    out = []
    for key, text in rows:
        ws = hashed(text or "")
        if ws:
            last = [s for s in re.split(r"[.?!\n]+", text) if len(s.split()) >= 3]
            out.append(Item(key, ws, (hashed(last[-1]) if last else []) or ws[-5:]))
    return out


def window_of(n: int) -> tuple[int, int]:
    """Length and step of the windows for items of n words."""
    k = max(0, round(np.log(n / FIRST) / np.log(RATIO)))
    size = STRETCH * max(1, round(FIRST * RATIO**k / STRETCH))
    return size, max(STRETCH, size // 3 // STRETCH * STRETCH)


class Matcher:
    """Finds items in texts: latent candidates, then subsequences."""

    def __init__(self, space: Space, items: list[Item], copy: float, share: float, answer: float, least: int):
        self.space, self.items, self.copy, self.share, self.answer, self.least = space, items, copy, share, answer, least
        sums = np.stack([space.prefix(np.array(i.words, np.uint64))[:, -1] for i in items])
        self.query = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.patterns = [(_pattern(i.words), _pattern(i.answer)) for i in items]
        self.windows: dict[tuple[int, int], np.ndarray] = {}
        for k, i in enumerate(items):
            key = window_of(len(i.words))
            self.windows[key] = np.append(self.windows.get(key, np.zeros(0, np.int64)), k)
        self.vocabulary = np.unique(np.array([w for i in items for w in i.words], np.uint64))
        self.places = [np.searchsorted(self.vocabulary, np.array(i.words, np.uint64)) for i in items]
        self.least_cosine = np.array([self._threshold(k) for k in range(len(items))], np.float32)

    def _threshold(self, k: int, trials: int = 100) -> float:
        """The cosine that the best window reaches in 99 of 100 texts that hold just ``share`` of the item, bare, with foreign words between, or with a run lost."""
        own, rng = _bucket(np.array(self.items[k].words, np.uint64)), np.random.default_rng(k)
        n, (size, step) = len(own), window_of(len(own))
        lost, best = n - int(np.ceil(self.share * n)), []
        for length, block in ((n, False), (n + n // 2, False), (2 * n, False), (n, True)):
            runs = rng.choice(BUCKETS, (trials, 2 * size + step + length), p=self.space.frequency)
            gone = (np.arange(n) - rng.integers(0, n, trials)[:, None]) % n if block else rng.random((trials, n)).argsort(1)
            words_ = np.where(gone < lost, rng.choice(BUCKETS, (trials, n), p=self.space.frequency), own)
            runs[:, size : size + length][rng.random((trials, length)).argsort(1) < n] = words_.ravel()
            sums = np.zeros((trials, runs.shape[1] + 1, self.space.project.shape[1]), np.float32)
            np.cumsum(self.space.project[runs], axis=1, out=sums[:, 1:])
            start = rng.integers(0, step, trials)[:, None] + np.arange(0, size + length, step)
            row = np.arange(trials)[:, None]
            v = sums[row, start + size] - sums[row, start]
            best.append(np.quantile((v @ self.query[k] / np.maximum(np.linalg.norm(v, axis=2), 1e-12)).max(1), 0.01))
        return float(min(best))

    def shared(self, k: int, ids: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
        """How many places of item k have a word that stands in each run [start, end) of the text: no common subsequence is longer."""
        n, out = len(self.items[k].words), np.zeros(len(start), np.int64)
        at = np.minimum(start[:, None] + np.arange(int((end - start).max())), end[:, None] - 1)
        own = ids[at]
        for low in range(0, n, 64):
            part = self.places[k][low : low + 64]
            np.bitwise_or.at(table, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
            out += np.bitwise_count(np.bitwise_or.reduce(table[own], axis=1))
            table[part] = 0
        return out

    def check(self, k: int, text: list[int]) -> tuple[float, float] | None:
        """Shares of the item and of its answer that the text has in order, if they are enough."""
        item, (whole, last) = self.items[k], self.patterns[k]
        n = len(item.words)
        if n < self.least:
            return (1.0, 1.0) if any(text[i : i + n] == item.words for i in range(len(text) - n + 1)) else None
        found = lcs(whole, n, text) / n
        if found < self.share:
            return None
        answer = lcs(last, len(item.answer), text) / len(item.answer)
        return (found, answer) if found >= self.copy or answer >= self.answer else None

    def _covered(self, k: int, ids: np.ndarray, starts: np.ndarray, size: int, step: int, table: np.ndarray) -> np.ndarray:
        """How many places of item k have a word in the run of each window of the grid: the window and n words or more on both sides.

        ids: of whole stretches.
        """
        n = len(self.items[k].words)
        side, count = -(-n // STRETCH), len(ids) // STRETCH
        length, stride = size // STRETCH + 2 * side, step // STRETCH
        out = np.zeros(len(starts), np.int64)
        for low in range(0, n, 64):
            part = self.places[k][low : low + 64]
            np.bitwise_or.at(table, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
            each = table[ids].reshape(-1, STRETCH)
            table[part] = 0
            mask = np.zeros(count + 2 * length, np.uint64)
            inner = mask[side : side + count]
            for column in each.T:
                inner |= column
            reach = 1
            while 2 * reach <= length:
                mask = mask[:-reach] | mask[reach:]
                reach *= 2
            last = stride * (len(starts) - 1) + 1
            out += np.bitwise_count(mask[:last:stride] | mask[length - reach : length - reach + last : stride])
        return out

    def find(self, raw: np.ndarray, off: np.ndarray):
        """row, item number, first word, words, cosine, share, answer share: the best match of each row and item."""
        h, _, _, per = words(raw, off, ALNUM)
        if not len(h):
            return []
        widest = max(size for size, _ in self.windows) // STRETCH
        sums = self.space.prefix(h, STRETCH, 2 * widest)
        ids = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        ids[self.vocabulary[ids] != h] = len(self.vocabulary)
        count = (len(h) - 1) // STRETCH + 1
        ids = np.append(ids, np.full(STRETCH * count - len(h), len(self.vocabulary)))
        table = np.zeros(len(self.vocabulary) + 1, np.uint64)
        out: dict[tuple[int, int], tuple] = {}
        for (size, step), own in self.windows.items():
            a, b = size // STRETCH, step // STRETCH
            many = -(-max(count - a, 0) // b) + 1
            last = (many - 1) * b + 1
            v = sums[:, a : a + last : b] - sums[:, :last:b]
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->j", v, v)), 1e-12)
            starts = step * np.arange(many)
            at_once = max(1, CELLS // many)
            for first in range(0, len(own), at_once):
                some = own[first : first + at_once]
                near = self.query[some] @ v
                for j, k in enumerate(some.tolist()):
                    candidate = near[j] >= self.least_cosine[k]
                    if not candidate.any():
                        continue
                    n = len(self.items[k].words)
                    candidate &= self._covered(k, ids, starts, size, step, table) >= self.share * n
                    self._examine(k, np.flatnonzero(candidate), starts, size, near[j], h, ids, per, table, out)
        return [(r, k, *x) for (r, k), x in sorted(out.items())]

    def _examine(self, k: int, win: np.ndarray, starts: np.ndarray, size: int, near: np.ndarray, h: np.ndarray, ids: np.ndarray, per: np.ndarray, table: np.ndarray, out: dict) -> None:
        """Common subsequences in the run of each window, in each row that the window touches."""
        if not len(win):
            return
        n = len(self.items[k].words)
        begin = starts[win]
        end = np.minimum(begin + size, len(h))
        first, upto = np.searchsorted(per, begin, "right") - 1, np.searchsorted(per, end, "left")
        rows = upto - first
        which = np.repeat(np.arange(len(win)), rows)
        row = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows) + first[which]
        lo, hi = np.maximum(per[row], begin[which] - n), np.minimum(per[row + 1], end[which] + n)
        own = np.flatnonzero(hi > lo)
        own = own[self.shared(k, ids, lo[own], hi[own], table) >= self.share * n] if len(own) else own
        for x in own.tolist():
            r, a, b, cosine = int(row[x]), int(lo[x]), int(hi[x]), float(near[win[which[x]]])
            key = (r, k)
            if key in out and out[key][3] >= 0.999:
                continue
            got = self.check(k, h[a:b].tolist())
            if got and (key not in out or (got[0], cosine) > (out[key][3], out[key][2])):
                out[key] = (a - int(per[r]), b - a, cosine, *got)


def matchers(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", item_block: int = 4096, copy: float = 0.8, share: float = 0.6, answer: float = 0.6, least: int = 8):
    """One broadcast matcher per block of items."""
    space = fit(docs, text_col)
    rows = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t"))
    total = rows.count()
    if space is None or not total:
        return
    blocks = -(-total // item_block)
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        found = items_of(sorted(((r["k"], r["t"]) for r in own), key=lambda x: (str(x[0]), x[1] or "")))
        if found:
            shared = docs.sparkSession.sparkContext.broadcast(Matcher(space, found, copy, share, answer, least))
            trim()
            yield shared


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", **options) -> DataFrame:
    """doc_id, item_id, first_word, n_words (of the examined run), cosine, share, answer_share: a row per match."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, cosine double, share double, answer_share double"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)

    def step(shared):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    found = shared.value.find(*buffers(part.column("text")))
                    if found:
                        row, item, *rest = zip(*found, strict=True)
                        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array([shared.value.items[k].key for k in item], item_type), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=["doc_id", "item_id", "first_word", "n_words", "cosine", "share", "answer_share"])

        return rows.mapInArrow(lean(run), schema)

    for shared in matchers(docs, items, item_id, text_col=text_col, **options):
        out = out.unionByName(step(shared))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose text matches no item."""

    def step(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in shared.value.find(*buffers(part.column(text_col)))]] = False
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(lean(run), rows.schema)

    out = docs
    for shared in matchers(docs, items, text_col=text_col, **options):
        out = step(out, shared)
    return out
