"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text is the mean of the embeddings of its hashed byte n-grams (2, 3 and 4 bytes, letters lower-cased, everything
that is no letter read as a space). A linear softmax over that mean gives the label. As the mean and the linear layer
commute, a model of few labels is folded into one table of a row of logits per bucket, and a text's logits are the mean of the
rows of its n-grams; with more labels than dimensions the mean embedding is taken and then the linear layer. Prediction is one pass over all
bytes of all texts.

Training takes a bounded sample of the labelled rows, about ``per_label`` distinct texts per label (chosen by a hash of text, so a group of
copies counts once, whatever its size), and learns from each whole text and from short pieces of it. Every label is learned. A fifth of the
sample is kept for calibration: a temperature by least log loss, and the rejection threshold that at most ``reject_share`` of rightly
labelled calibration texts fall under. The table sent to the executors has 4 * buckets * min(labels, width) bytes.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and rejected; a null label is never learned from; a
null id counts as the empty text for the split. Without any labelled row every text is ``und``.
Ties go to the label that sorts first. Repeated rows each get their row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import CHUNK, LOWER, buffers, lean, slices, trim

#: bytes of texts that are predicted at a time: a worker's arrays take some 45 bytes for each
AT_ONCE = 1 << 17
_ORDERS = (2, 3, 4)
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_KEEP = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in LOWER], np.uint8)


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes with letters lower-cased, in ASCII and the Latin-1 range, and a space for what is no letter in ASCII."""
    out = _KEEP[raw]
    if len(out) > 1:
        lead = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][lead] |= 0x20
    return out


def grams(low: np.ndarray, at: int, to: int, bits: int):
    """For each order the bucket of the n-gram that starts at each byte of low[at:to]."""
    n = len(low)
    for order, odd in zip(_ORDERS, _ODD, strict=True):
        end = min(to, n - order + 1)
        if end <= at:
            yield order, np.zeros(0, np.int64)
            continue
        code = low[at:end].astype(np.uint32)
        for k in range(1, order):
            code |= low[at + k : end + k].astype(np.uint32) << np.uint32(8 * k)
        with np.errstate(over="ignore"):
            code = (code ^ (code >> np.uint32(15))) * odd
        yield order, (code >> np.uint32(32 - bits)).astype(np.int64)


def row_logits(raw: np.ndarray, off: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Mean of the table rows of all n-grams of each row."""
    low = letters(raw)
    rows = len(off) - 1
    total, count = np.zeros((rows, table.shape[1])), np.zeros(rows)
    for at in range(0, len(low), CHUNK):
        to = min(at + CHUNK, len(low))
        for order, bucket in grams(low, at, to, bits):
            if not len(bucket):
                continue
            first = np.searchsorted(off, at, side="right") - 1
            last = np.searchsorted(off, at + len(bucket), side="left")
            lo = np.maximum(off[first:last], at) - at
            hi = np.clip(np.minimum(off[first + 1 : last + 1] - order + 1, at + len(bucket)) - at, 0, None)
            ok = hi > lo
            if not ok.any():
                continue
            part = table[bucket]
            # n-grams that would reach into the next row stand between hi of a row and lo of the next
            edges = np.stack([lo[ok], hi[ok]], 1).ravel()
            closed = edges[-1] == len(bucket)
            sums = np.add.reduceat(part, edges[:-1] if closed else edges, axis=0)[::2]
            total[first:last][ok] += sums
            count[first:last][ok] += hi[ok] - lo[ok]
    return total / np.maximum(count, 1)[:, None]


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum((_KEEP[raw] != 32) & (raw < 128))])
    out = ascii_[off[1:]] > ascii_[off[:-1]]
    for i in np.flatnonzero(~out):
        piece = raw[off[i] : off[i + 1]]
        if (piece >= 128).any():
            out[i] = any(map(str.isalpha, piece.tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class LangModel:
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int
    head: np.ndarray | None = None

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = row_logits(raw, off, self.table, self.bits)
        z = ((z if self.head is None else z @ self.head.T) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def _features(piece: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a piece's n-grams and their counts."""
    low = letters(piece)
    ids, n = np.unique(np.concatenate([b for _, b in grams(low, 0, len(low), bits)]), return_counts=True)
    return ids.astype(np.uint16 if bits <= 16 else np.uint32), n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32)


class Pieces:
    """Features of many pieces in a few long arrays, and their labels."""

    def __init__(self):
        self.parts: list[list[tuple]] = []
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []
        self.at, self.labels = [0], []

    def add(self, ids: np.ndarray, n: np.ndarray, label: int) -> None:
        self.parts.append((ids, n))
        self.at.append(self.at[-1] + len(ids))
        self.labels.append(label)
        if len(self.parts) >= 256:
            self._join()

    def _join(self) -> None:
        if self.parts:
            self.joined.append(tuple(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts = []

    def done(self) -> Pieces:
        self._join()
        kinds = [np.result_type(np.uint16, *(x[k] for x in self.joined)) for k in (0, 1)]
        self.ids, self.n = (np.empty(self.at[-1], kind) for kind in kinds)
        at = self.at[-1]
        while self.joined:  # what is copied goes at once
            ids, n = self.joined.pop()
            self.ids[at - len(ids) : at], self.n[at - len(ids) : at] = ids, n
            at -= len(ids)
        return self

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = self.n[self.at[i] : self.at[i + 1]]
        return self.ids[self.at[i] : self.at[i + 1]], (n / n.sum()).astype(np.float32), self.labels[i]


def fit(texts: list[bytes], labels: list[str], bits: int = 16, width: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 11, pieces: int = 2, reject_share: float = 0.001) -> LangModel | None:
    """SGD over whole texts and short pieces of them; a fifth calibrates."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(names)}
    sets = [Pieces(), Pieces()]
    whole: list[bool] = []
    for t, y in zip(texts, labels, strict=True):
        raw = np.frombuffer(t, np.uint8)
        spare = int(rng.random() < 0.2)
        for k in range(1 + pieces):
            size = int(rng.integers(12, 80)) if k else len(raw)
            start = int(rng.integers(0, len(raw) - size + 1)) if len(raw) > size else 0
            ids, n = _features(raw[start : start + size], bits)
            if len(ids):
                sets[spare].add(ids, n, code[y])
                if spare:
                    whole.append(k == 0)
    sets = [s.done() for s in sets]
    table, head, bias = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32), rng.normal(0, 0.1, (len(names), width)).astype(np.float32), np.zeros(len(names), np.float32)
    steps, done = max(1, epochs * len(sets[0])), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sets[0])):
            ids, w, y = sets[0][i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = w @ table[ids]
            z = head @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ head
            head -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            # the mean spreads the gradient thinly over many rows; each row moves by its share of the text
            table[ids] -= (lr * 30 * w)[:, None] * back
    folded = np.ascontiguousarray(table @ head.T) if len(names) <= width else None
    whole = whole if len(sets[1]) else [True] * len(sets[0])
    held = [sets[1][i] for i in range(len(sets[1]))] if len(sets[1]) else [sets[0][i] for i in range(len(sets[0]))]
    z = np.array([(w @ folded[ids] if folded is not None else head @ (w @ table[ids])) + bias for ids, w, _ in held])
    y = np.array([y for *_, y in held])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 80)
    heat = float(min(grid, key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = probabilities(heat)
    right = (p.argmax(1) == y) & np.array(whole)
    floor = 1 / len(names)
    threshold = float(np.quantile(p.max(1)[right], reject_share)) if right.any() else 0.0
    threshold = min(threshold, 0.5) if len(names) > 1 else floor
    return LangModel(names, table, bias, heat, threshold, bits, head) if folded is None else LangModel(names, folded, bias, heat, threshold, bits)


def fit_on(df: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang", per_label: int = 1500, **options) -> LangModel | None:
    """A model from about per_label distinct texts of each label among the rows for which ``learn`` holds."""
    usable = df.filter(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(text_col).alias("hash"))
    counts = usable.select("label", "hash").distinct().groupBy("label").count()
    if not counts.take(1):
        return None
    place = F.pmod(F.xxhash64("hash"), F.lit(1 << 30))
    sampled = usable.join(F.broadcast(counts), "label").filter(place < F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("count")) * (1 << 30))
    table = sampled.dropDuplicates(["label", "hash"]).select("label", F.col("text").cast("binary").alias("text")).toArrow()
    rows = sorted(zip(table.column("label").to_pylist(), table.column("text").to_pylist(), strict=True))
    del table
    model = fit([t for _, t in rows], [y for y, _ in rows], **options)
    del rows
    trim()
    return model


def detect(df: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                raw, off = buffers(part.column("text"))
                known = has_letter(raw, off) if m is not None else np.zeros(part.num_rows, bool)
                labels, score, rejected = np.full(part.num_rows, "und", object), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                if known.any():
                    best, p = m.predict(raw, off)
                    labels[known] = np.array(m.labels, object)[best[known]]
                    score[known] = p[known]
                    rejected[known] = p[known] < m.threshold
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, model: LangModel | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known and whose probability reaches the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, text_col, AT_ONCE):
                raw, off = buffers(part.column(text_col))
                keep = has_letter(raw, off) if m is not None else np.zeros(part.num_rows, bool)
                if keep.any():
                    keep &= m.predict(raw, off)[1] >= m.threshold
                yield part.filter(pa.array(keep))

    return df.mapInArrow(lean(run), df.schema)
