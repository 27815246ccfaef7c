"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Four base kinds (email, ip, card, phone) have exact definitions and always stay. Their matches are found from the runs
of digits and the @ and + signs of a text, in time linear in its length. Five more kinds come from loose generators that
propose overlapping spans; gradient-boosted trees, trained in numpy on examples made from format grammars, give each
candidate a probability from its form and the text around it, and per-kind thresholds, set on held-out examples for a
stated precision, select. A selected span yields to base spans and to likelier ones that it overlaps.

Each row is handled alone: no shuffle. Nulls: a null text counts as empty; a null id is carried through. Repeated
rows each get their row, an empty table gives an empty result, other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "local_phone", "national_id", "secret", "spelled_email")
KINDS = BASE + MORE

_DIGITS = re.compile("[0-9]+")
_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The loose generators.
_LOOSE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{16,}+={0,2}(?![A-Za-z0-9/+_-])"),
}
_SPELLED = re.compile(r" ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z]{2,20}(?![A-Za-z0-9]))+")
#: Signs that stand for an @, and endings of addresses.
_AT = ("(at)", "[at]", " at ")
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "eu", "uk", "ch", "at")
#: Words near a span that speak for a kind.
_CUES = {
    "iban": ("iban", "account", "bank", "konto"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "national_id": ("ssn", "social", "security", "id"),
    "secret": ("password", "passwd", "token", "secret", "key", "bearer", "akia"),
    "spelled_email": ("mail", "contact", "write", "reach"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = t.find("@")
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL_SET:
            a -= 1
        if a < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        # what stands before this @ can't belong to a later match: @ is in neither class
        done = max(done, at + 1)
        at = t.find("@", done)
    return out


def numbers(t: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """ip and card spans, from the runs of digits."""
    runs = [m.span() for m in _DIGITS.finditer(t)]
    ips, i = [], 0
    while i + 3 < len(runs):
        if all(runs[k + 1][0] == runs[k][1] + 1 and t[runs[k][1]] == "." for k in range(i, i + 3)):
            if all(b - a <= 3 or not t[a : b - 3].strip("0") for a, b in runs[i : i + 4]) and all(int(t[max(a, b - 3) : b]) <= 255 for a, b in runs[i : i + 4]):
                ips.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    cards, i = [], 0
    while i < len(runs):
        k, count = i, runs[i][1] - runs[i][0]
        while k + 1 < len(runs) and runs[k + 1][0] == runs[k][1] + 1 and t[runs[k][1]] in " -":
            k += 1
            count += runs[k][1] - runs[k][0]
        if 13 <= count <= 19 and _luhn("".join(t[a:b] for a, b in runs[i : k + 1])):
            cards.append((runs[i][0], runs[k][1]))
        i = k + 1
    return ips, cards


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in t:
        out += [("email", *x) for x in emails(t)]
    if _DIGITS.search(t):
        ips, cards = numbers(t)
        out += [("ip", *x) for x in ips] + [("card", *x) for x in cards]
        if "+" in t:
            out += [("phone", *x) for x in phones(t)]
    return out


def candidates(t: str) -> list[tuple[str, int, int]]:
    out = []
    digits = bool(_DIGITS.search(t))
    for kind, pattern in _LOOSE.items():
        if digits or kind == "secret":
            out += [(kind, *m.span()) for m in pattern.finditer(t)]
    for sign in _AT:
        at = t.find(sign)
        while at >= 0:
            # the local part is a whole run before the sign, the domain follows it
            b = at - (sign != " at " and t[at - 1 : at] == " ")
            a = b
            while a > 0 and t[a - 1] in _LOCAL_SET:
                a -= 1
            if a < b and (m := _SPELLED.match(t, at + len(sign) - (sign == " at "))):
                out.append(("spelled_email", a, m.end()))
            at = t.find(sign, at + 1)
    return list(dict.fromkeys(out))


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(t: str, kind: str, a: int, b: int) -> list[float]:
    s = t[a:b]
    n = len(s)
    digits, upper, lower = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    before, after = t[max(0, a - 32) : a].lower(), t[b : b + 16].lower()
    changes = sum((x.isdigit() != y.isdigit()) for x, y in zip(s, s[1:], strict=False))
    run = max((len(x) for x in re.findall("[a-z]+", s)), default=0)
    valid = _mod97(s) if kind == "iban" else s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[-4:] != "0000" if kind == "national_id" else False
    return [
        MORE.index(kind), n, digits / n, upper / n, lower / n, len(set(s)) / n, changes / n, run / n, float(valid),
        float(any(c in before for c in _CUES[kind])), float(any(c in before[-14:] for c in _CUES[kind])), float(before[-1:] in ("=", ":", '"', "'")), float(after[:1] in ('"', "'")),
        float(s.lower().endswith(_ENDINGS)), float(re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}", s) is not None), float(before[-1:] not in ("", " ", "\n")),
        float(any(c in s.lower() for c in _CUES[kind])), sum(c in "-_/+. " for c in s) / n, float("(" in s or "[" in s), float(s.startswith(("AKIA", "ghp_", "sk-", "sk_", "xox"))), float(re.fullmatch("[0-9a-f]+", s) is not None),
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: for each tree its tests, level by level, and its leaves."""

    start: float
    where: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for where, cut, leaf in zip(self.where, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, where[node]] > cut[node])
            z += leaf[node - (len(leaf) - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, exact splits on up to 32 cuts per feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33)))[:32] for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    where, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-6
            if len(own):
                gs, hs = g[own].sum(), h[own].sum()
                for f, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(codes[own, f], g[own], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(codes[own, f], h[own], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + least) + (gs - gl) ** 2 / (hs - hl + least) - gs**2 / (hs + least)
                        j = int(gain.argmax())
                        if gain[j] > best:
                            best, where[r, k], cut[r, k] = gain[j], f, c[j]
            node[own] = 2 * k + 1 + (x[own, where[r, k]] > cut[r, k])
        place = node - inner
        gl, hl = np.bincount(place, g, leaves), np.bincount(place, h, leaves)
        leaf[r] = -rate * gl / (hl + least)
        z += leaf[r][place]
    return Trees(start, where, cut, leaf)


@dataclass
class Detector:
    trees: Trees
    thresholds: dict[str, float]


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Made texts with one candidate each: text, kind, start, end, whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    digits, hexa, alnum, lower = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(lower, int(rng.integers(2, 9)))

    def iban(valid: bool) -> str:
        s = pick("ABCDEFGHIKLMNOPRST", 2), pick(digits, int(rng.integers(12, 24)))
        check = 98 - int("".join(str(int(c, 36)) for c in s[1] + s[0]) + "00") % 97
        return f"{s[0]}{check if valid else (check + 1 + int(rng.integers(0, 40))) % 98:02d}{s[1]}"

    out = []
    while len(out) < n:
        kind, good = MORE[int(rng.integers(len(MORE)))], bool(rng.random() < 0.5)
        cue = f"{rng.choice(_CUES[kind])}{rng.choice(['=', ': ', ' ', ' is '])}" if rng.random() < (0.6 if good else 0.08) else ""
        if kind == "iban":
            s = iban(good)
        elif kind == "local_phone":
            a, b, c = str(rng.integers(2, 10)) + pick(digits, 2), pick(digits, 3), pick(digits, 4)
            if good:
                s = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"][int(rng.integers(4))]
            else:  # tables of numbers, dates, parts of longer numbers
                s = [f"{rng.integers(10, 100)} {b} {pick(digits, 3)}", f"{rng.integers(1000, 10000)}-{b}-{pick(digits, 3)}", f"{rng.integers(10, 100)}.{b}.{pick(digits, 3)}", f"{rng.integers(10000, 99999)} {c} {pick(digits, 4)}"][int(rng.integers(4))]
        elif kind == "national_id":
            s = f"{int(rng.integers(1, 899)):03d}-{int(rng.integers(1, 99)):02d}-{int(rng.integers(1, 9999)):04d}" if good else f"{rng.choice(['000', '666', '9' + pick(digits, 2)])}-{pick(digits, 2)}-{pick(digits, 4)}"
        elif kind == "secret":
            good = good and bool(rng.random() < 0.6)  # most long tokens are none
            if good:
                letters = "".join(x + y for x, y in zip(pick(lower.upper(), 12), pick(lower, 12), strict=True))
                s = [pick(hexa, int(rng.integers(16, 48))), pick(alnum, int(rng.integers(18, 48))), "AKIA" + pick(digits + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), letters][int(rng.integers(4))]
                cue = cue or ("" if s.startswith("AKIA") else str(rng.choice(["token = \"", "password=", "secret: ", "key="])))
            else:
                # compounds and names in code, of random letters or of syllables
                long = "".join(pick("bcdfghklmnprstvz", 1) + pick("aeiou", 1) + pick("nrstlch", int(rng.integers(0, 3))) for _ in range(9))[: int(rng.integers(16, 25))]
                long = long if rng.random() < 0.8 else word() + word() + word() + word()
                s = [f"{word()}-{word()}-{word()}-{pick(digits, 4)}", f"{word()}/{word()}/{pick(digits, 4)}/{word()}x", pick(digits, int(rng.integers(16, 30))), f"{long}{pick(digits, 1)}", long, long.capitalize(), long.upper(), word() + "".join(word().capitalize() for _ in range(4))][int(rng.integers(8))]
        else:
            end = str(rng.choice(_ENDINGS))
            if good:
                s = [f"{word()}.{word()} (at) {word()} (dot) {end}", f"{word()}[at]{word()}.{end}", f"{word()} at {word()} dot {end}", f"{word()} at {word()}.{end}"][int(rng.integers(4))]
            else:  # prose, files, sentences that run on
                s = [f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{rng.choice(['txt', 'py', 'html', 'pdf', 'js', 'md'])}", f"{word()} at {word()}.{word()}"][int(rng.integers(3))]
        head = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        text = f"{head} {cue}{s}{'\"' if cue.endswith('\"') else ''} {word()} {word()}"
        at = text.index(s, len(head))
        there = (kind, at, at + len(s)) in candidates(text)
        assert there or not good, f"no candidate: {text}"
        if there:
            out.append((text, kind, at, at + len(s), int(good)))
    return out


def train(n: int = 4000, seed: int = 5, precision: float = 0.99) -> Detector:
    """Trees from made examples; for each kind the least threshold with that precision on a third held out."""
    rows = examples(n, seed)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([r[-1] for r in rows], float)
    held = np.arange(n) % 3 == 0
    trees = boost(x[~held], y[~held])
    p = 1 / (1 + np.exp(-trees.margin(x[held])))
    kinds, truth, thresholds = np.array([r[1] for r in rows])[held], y[held], {}
    for kind in MORE:
        own = kinds == kind
        order = np.argsort(-p[own], kind="stable")
        share = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(share >= precision)
        thresholds[kind] = float(max(0.5, p[own][order][ok[-1]])) if len(ok) else 1.1
    return Detector(trees, thresholds)


def find(texts: list[str | None], detector: Detector) -> list[list[tuple[str, int, int, float]]]:
    """All spans of each text: base ones with probability 1, selected ones with theirs; sorted by kind, then start."""
    base = [base_spans(t) if t else [] for t in texts]
    loose = [(i, *c) for i, t in enumerate(texts) if t for c in candidates(t)]
    out: list[list] = [[(*s, 1.0) for s in b] for b in base]
    if loose:
        p = 1 / (1 + np.exp(-detector.trees.margin(np.array([features(texts[i], *c) for i, *c in loose]))))
        taken: dict[int, list] = {}
        for j in np.lexsort((np.arange(len(p)), -p)):
            i, kind, a, b = loose[j]
            if p[j] < detector.thresholds[kind]:
                continue
            own = taken.setdefault(i, [s[1:3] for s in base[i]])
            if all(b <= c or d <= a for c, d in own):
                own.append((a, b))
                out[i].append((kind, a, b, float(p[j])))
    return [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) for s in out]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named for the first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(df: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end, score), and the redacted text if asked for."""
    shared = df.sparkSession.sparkContext.broadcast(detector or train())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                found = find(texts, shared.value)
                cols = [part.column("doc_id"), pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in f] for f in found], _SPAN)]
                if redacted:
                    cols.append(pa.array([None if t is None else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "spans", "redacted"][: len(cols)])

    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>" + ", redacted string" * redacted
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, a digest of the base spans, and all spans as text."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
