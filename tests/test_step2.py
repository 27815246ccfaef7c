"""Step 2 and the document metrics against plain restatements on small texts."""

import math
import statistics
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import kernels as K
from lectern.functions import storage
from lectern.functions.spans import touches
from lectern.operators import align, corpus, issues, report, risk, rules, sampling, stats
from lectern.operators.lines import line_structure

PAIR = "pair_id string, style string, gt string, htr string"
WORDS = ["rey", "grande", "de", "la", "españa", "espana", "conquista", "dores", "conquistadores", "1621", "1622", "porque", "por", "que", "Çena", "cena", "a", "tierra", "tiera", "tie", "rra"]
texts = st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join)
PAIRS = [
    ("p1", "s", "rey grande de españa\ny la tierra", "rey  de espana\ny la tiera"),
    ("p2", "s", "conquistadores de la tierra", "conquista dores de la la tierra"),
    ("p3", "t", "porque 1621 çena", "por que 1622 cena ,,"),
    ("p4", "t", "", "solo esto"),
    ("p5", "t", "algo falta", ""),
    ("p6", "s", None, None),
]


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def plain_alignment(gt, htr):
    """Every run near the cursor scored; the first perfect one, else the best (shorter, then earlier), if it reaches 90."""
    out, cursor = [], 0
    for i, (word, _, _) in enumerate(gt):
        own, runs = K.match_key(word), []
        long_enough = word.isdigit() or len(word) >= K.LEAST_LENGTH and word.lower() not in K.UNANCHORED
        stop = min(len(htr), cursor + K.WINDOW)
        for j in range(cursor, stop):
            for k in range(1, 1 + (K.LONGEST_RUN if long_enough else 1)):
                key = "".join(K.match_key(w) for w, _, _ in htr[j : j + k])
                if j + k <= stop and key:
                    score = 200 * subsequence(own, key) / (len(own) + len(key)) if own else 0
                    if word.isdigit() and key != own:
                        score -= 10
                    runs.append((score, k, j))
        perfect = [r for r in runs if r[0] >= 100]
        chosen = perfect[0] if perfect else min(runs, key=lambda r: (-r[0], r[1], r[2]), default=None)
        if chosen is None or chosen[0] < K.LEAST_SCORE:
            out.append(("delete", i, -1, 0))
            continue
        _, k, j = chosen
        out += [("insert", -1, x, 1) for x in range(cursor, j)]
        out += [("equal" if k == 1 and htr[j][0] == word else "replace", i, j, k)] + [("insert", -1, x, 1) for x in range(j + 1, j + k)]
        cursor = j + k
    return out + [("insert", -1, x, 1) for x in range(cursor, len(htr))]


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_word_alignment(a, b):
    gt, htr = K.tokens(a), K.tokens(b)
    assert K.align_words(gt, htr) == plain_alignment(gt, htr)


def path(a, b):
    """The steps of a cheapest alignment, read back from the end: diagonal before deletion before insertion."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("M" if a[i] == b[j] else "S", i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("D", i, j))
        else:
            j -= 1
            out.append(("I", i, j))
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=14), st.text("abcé", max_size=14))
def test_the_path_prefers_diagonal_then_deletion(a, b):
    assert [x[0] for x in K.operations(a, b)] == [x[0] for x in path(a, b)]


def runs_of(flags):
    return [len(x) for x in "".join("x" if f else " " for f in flags).split()]


def plain_quality(gt, htr):
    a, b = K.latin(gt), K.latin(htr)
    ops = path(a, b)
    kinds = [o for o, _, _ in ops]
    n, count = len(a), Counter(kinds)
    spans, wrong = runs_of(k in "MS" for k in kinds), runs_of(k != "M" for k in kinds)
    size = max(100, math.ceil(n / 10)) if n else 0
    windows = [[] for _ in range(math.ceil(n / size))] if n else []
    for k, i, _ in ops if n else ():
        windows[min(min(i, n - 1) // size, len(windows) - 1)].append(k)
    rates = [sum(k != "M" for k in w) / (min((x + 1) * size, n) - x * size) for x, w in enumerate(windows)]
    drift = [sum(k in "ID" for k in w) / max(1, sum(k != "M" for k in w)) for w in windows]
    return {
        "matches": count["M"], "substitutions": count["S"], "deletions": count["D"], "insertions": count["I"], "ref_chars_norm": n,
        "long_spans": sum(x for x in spans if x >= 50), "longest_span": max(spans, default=0), "error_runs": len(wrong), "window_size": size, "window_count": len(windows),
        "window_max_cer": max(rates, default=0), "window_sd_cer": statistics.stdev(rates) if len(rates) > 1 else 0, "window_max_sdr": max(drift, default=0),
        "wer_edits": sum(x[0] != "M" for x in path(K.latin_words(gt), K.latin_words(htr))), "ref_tokens_norm": len(K.latin_words(gt)),
    }


def test_tokens_with_punctuation():
    assert [t for t, _, _ in K.tokens("rey, (d'oro)")] == ["rey", "d'oro"]
    assert K.tokens("rey, (d'oro)", True) == [("rey", 0, 3), (",", 3, 4), ("(", 5, 6), ("d'oro", 6, 11), (")", 11, 12)]


def test_boundary_examples(spark):
    df = spark.createDataFrame([("p", "s", "porque no porque", "por que no por que"), ("q", "s", "a la", "ala")], PAIR)
    assert sorted((r.kind, r.gt, r.htr, r.n, r["rank"]) for r in align.boundary_examples(df).collect()) == [("merges", "a la", "ala", 1, 1), ("splits", "porque", "por que", 2, 1)]


def plain_boundaries(gt, htr):
    a, b = gt.casefold().split(), htr.casefold().split()
    i = j = 0
    out = Counter()
    while i < len(a) and j < len(b):
        spans = [(x, y) for x in range(1, 5) for y in range(1, 5) if i + x <= len(a) and j + y <= len(b) and "".join(a[i : i + x]) == "".join(b[j : j + y])]
        x, y = (1, 1) if a[i] == b[j] or not spans else spans[0]
        if (x, y) != (1, 1):
            out["splits" if x == 1 else "merges" if y == 1 else "complex_boundary"] += 1
        i, j = i + x, j + y
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=45).map(" ".join), st.lists(st.sampled_from(WORDS), max_size=45).map(" ".join))
def test_quality(a, b):
    got, want = K.quality_counts(a, b), plain_quality(a, b)
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: got[k] for k in want}


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=24), st.text("ab ", max_size=24))
def test_boundaries(a, b):
    want, got = plain_boundaries(a, b), K.boundaries(a, b)
    assert all(got[k] == want[k] for k in ("splits", "merges", "complex_boundary")) and got["boundary_events"] == sum(want.values())


@pytest.fixture(scope="module")
def two(spark):
    df = spark.createDataFrame(PAIRS, PAIR)
    return storage.settled(align.alignment_issues(df)), df


def test_document_metrics(spark):
    df = spark.createDataFrame([*PAIRS, PAIRS[0]], PAIR)
    metrics = align.document_metrics(df)
    rows = metrics.collect()
    assert len(rows) == len(PAIRS) + 1  # repeated rows stay as many as they are
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    by = {r.pair_id: r for r in rows}
    for p, _, g, h in PAIRS:
        q, r = plain_quality(g or "", h or ""), by[p]
        edits = q["substitutions"] + q["deletions"] + q["insertions"]
        part = lambda x, y: x / y if y else 0
        shifts, n = q["deletions"] + q["insertions"], q["ref_chars_norm"]
        want = {
            "cer_norm": part(edits, n), "structural_drift_ratio": part(shifts, edits), "indel_disruption_rate": part(shifts, edits + q["matches"]),
            "coverage": part(q["matches"] + q["substitutions"], q["matches"] + q["substitutions"] + q["deletions"]), "continuity": part(q["long_spans"], n), "lasr": part(q["longest_span"], n),
            "fragmentation": part(q["error_runs"], n) * 1000, "wer_norm": part(q["wer_edits"], q["ref_tokens_norm"]), "boundary_burden_proportion": part(sum(plain_boundaries(g or "", h or "").values()), edits),
        }
        assert {k: getattr(r, k) for k in want} == {k: pytest.approx(v) for k, v in want.items()}
        assert r.coverage_risk == pytest.approx(1 - r.coverage) and r.continuity_risk == pytest.approx(1 - r.continuity)
    assert by["p6"].line_structure_band == "Stable" and by["p6"].line_count == 0


def test_issues_and_overlaps(spark, two):
    rows, df = two
    texts_ = {p: (g or "", h or "") for p, _, g, h in PAIRS}
    ones = {}
    for r in rules.rule_issues(df, "S1").collect():
        ones.setdefault(r.pair_id, []).append((r.tag, r.start, r.end))
    got = rows.collect()
    for r in got:
        h = texts_[r.pair_id][1]
        assert r.htr_text == h[r.start : r.end] if r.tag != "S2D" else r.start == r.end
        end = max(r.end, r.start + 1)
        assert r.overlaps_step1 == sorted({t for t, a, b in ones.get(r.pair_id, ()) if max(a, r.start) < min(b, end)})
    twos = {}
    for r in got:
        twos.setdefault(r.pair_id, []).append((r.tag, r.start, r.end))
    for r in align.orthographic_overlaps(df).collect():
        assert sorted(r.touch_s1) == sorted(t for t, a, b in ones.get(r.pair_id, ()) if max(a, r.start) < min(b, r.end))
        assert sorted(r.touch_s2) == sorted(t for t, a, b in twos.get(r.pair_id, ()) if max(a, r.start) < min(b, max(r.end, r.start + 1)))
    index = {r.pair_id: (r.total_issues, r.S2) for r in issues.issue_index(rows).collect()}
    assert index == {p: (len(x), len(x)) for p, x in twos.items()}
    for r in issues.alignment_diagnostics(rows).collect():
        n = Counter(t for t, _, _ in twos[r.pair_id])
        assert (r.total_s2, r.S2X, r.S2I, r.S2D) == (sum(n.values()), n["S2X"], n["S2I"], n["S2D"])
        assert r.flag == ("ALIGNMENT_DRIFT" if max(n["S2I"], n["S2D"]) / sum(n.values()) > 0.4 else "OK")
    rate, worst = issues.drift_report(issues.alignment_diagnostics(rows))
    assert rate.first().docs == len(twos) and [r.total_s2 for r in worst.collect()] == sorted((r.total_s2 for r in worst.collect()), reverse=True)
    assert touches is not None


def test_confusions_topology_and_contexts(spark, two):
    rows, df = two
    got = rows.collect()
    want = Counter()
    for r in got:
        if r.tag == "S2X":
            for a, b in zip((r.gt_text or "").ljust(len(r.htr_text or ""), "Ø"), (r.htr_text or "").ljust(len(r.gt_text or ""), "Ø"), strict=True):
                want[r.style, a, b] += a != b
    assert {(r.style, r.gt_char, r.htr_char): r.n for r in issues.char_confusions(rows).collect()} == {k: v for k, v in want.items() if v}
    dense = issues.dense_matrix(issues.confusion_matrix(rows))
    assert "Ø" in dense.columns and {r.style for r in dense.filter("gt_char = 'Ø'").collect()} == {"s", "t"}
    assert dense.select(sum((F.col(f"`{c}`") for c in dense.columns[2:]), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] == issues.confusion_matrix(rows).agg(F.sum("n")).first()[0]
    ops = {"replace": "substitution", "insert": "insertion", "delete": "deletion"}
    events = Counter((r.style, ops[r.word_op], int(r.line_position_bin.split("-")[0]) // 10) for r in got if r.line_position_bin)
    docs = Counter(s for _, s, _, _ in PAIRS)
    table = issues.topology(rows.withColumn("op", issues.operation()), df, "line_bin").collect()
    assert len(table) == 2 * 3 * 10
    assert all(r.n == events[r.style, r.op, r.bin] and r.events_per_doc == pytest.approx(r.n / docs[r.style]) for r in table)
    assert issues.topology(rows.withColumn("op", issues.operation()).limit(0), df, "line_bin").count() == 0
    contexts = {(r.kind, r.style, r.gt, r.htr, r.token): r.n for r in issues.confusion_contexts(rows).collect()}
    assert contexts["char", "s", "ñ", "n", "españa"] == 1
    spelt = spark.createDataFrame([("Replace", "x"), (" DEL ", ""), ("", "S2I"), (None, "s2r"), ("inserted", None), ("", "S1W")], "word_op string, tag string")
    assert [r[0] for r in spelt.select(issues.operation()).collect()] == ["substitution", "deletion", "insertion", "substitution", "insertion", None]


@pytest.mark.parametrize("few", [10**6, 0])
def test_order_statistics_in_any_partitioning(spark, monkeypatch, few):
    """One window a group, or sums over sorted partitions: the same."""
    monkeypatch.setattr(stats, "FEW", few)
    own = stats.cumulative
    monkeypatch.setattr(stats, "cumulative", lambda long, by: own(long, by, few))
    values = {"a": [float(x % 37) for x in range(900)], "b": [1.0], "c": [float(x) for x in range(50)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(7)
    got = {r.k: r for r in stats.order_statistics(df, ["k"], ["v"], m=stats.median(), p=stats.percentile(0.9), q=stats.percentile_ceil(0.9)).collect()}
    for k, vs in values.items():
        s = sorted(vs)
        assert (got[k].m, got[k].p, got[k].q) == (statistics.median(s), s[min(int(len(s) * 0.9), len(s) - 1)], s[min(len(s) - 1, math.ceil(len(s) * 0.9) - 1)])
    mad = {r.k: r.mad for r in stats.robust_center(df, ["k"], ["v"]).collect()}
    assert all(mad[k] == statistics.median(abs(v - statistics.median(vs)) for v in vs) for k, vs in values.items())
    ranks = {}
    for r in stats.ranked(df, ["k"], [F.desc("v")], "r", "n").collect():
        ranks.setdefault(r.k, []).append((r.r, r.v, r.n))
    for k, vs in values.items():
        assert [v for _, v, _ in sorted(ranks[k])] == sorted(vs, reverse=True) and sorted(r for r, _, _ in ranks[k]) == list(range(1, len(vs) + 1)) and {n for *_, n in ranks[k]} == {len(vs)}


def test_wide_risk_and_rankings(spark):
    from lectern.schemas import WIDE_RISK_WEIGHTS

    metrics = storage.settled(align.document_metrics(spark.createDataFrame(PAIRS, PAIR)))
    rows = [r.asDict() for r in metrics.collect()]
    scored = storage.settled(risk.wide_risk(metrics))
    want = {}
    for r in rows:
        total = 0.0
        for m, w in WIDE_RISK_WEIGHTS.items():
            vs = [x[m] for x in rows if x["style"] == r["style"]]
            med = statistics.median(vs)
            mad = statistics.median(abs(v - med) for v in vs)
            total += w * ((r[m] - med) / mad if mad else 0.0)
        want[r["pair_id"]] = total
    got = {r.pair_id: r for r in scored.collect()}
    assert all(got[p].wide_risk_score == pytest.approx(v) for p, v in want.items())
    order = sorted(want, key=lambda p: (-round(want[p], 9), got[p].style, p))
    assert [got[p].wide_risk_rank for p in order] == list(range(1, len(order) + 1))
    ranked = risk.per_group_top(scored, "style", risk.STYLE_RANKINGS, "pair_id", 2).collect()
    for name, (m, up) in risk.STYLE_RANKINGS.items():
        for s in "st":
            own = sorted((r for r in scored.collect() if r.style == s), key=lambda r: (r[m] if up else -r[m], r.pair_id))[:2]
            assert [r.pair_id for r in sorted((r for r in ranked if r.metric == name and r.style == s), key=lambda r: r.rank)] == [r.pair_id for r in own]
    assert {r.style for r in risk.style_metrics(scored).collect()} == {"s", "t"}


def test_packet_and_metadata(spark):
    df = spark.createDataFrame(PAIRS, PAIR)
    docs = storage.settled(risk.governance(risk.risk_index(align.document_metrics(df))))
    tables = sampling.review_tables(sampling.layers(docs, 3, 1, 2), 2, listing=spark.createDataFrame([("x/p1_GT.txt",), ("x/p1",)], "path string"))
    every = tables["review_sample_all"].collect()
    assert tuple(tables["review_sample_all"].columns) == sampling.MASTER_COLUMNS
    assert len({r.doc_id for r in every}) == len(every) and Counter(r.selection_layer for r in every)["governance_validation"] == 3
    n = sum(tables[f"review_sample_{x}"].count() for x in ("governance_validation", "random_control", "diagnostic_case_studies"))
    assert n == len(every) == sum(tables[f"reviewer_{k}_packet"].count() for k in (1, 2))
    missing = {(r.doc_id, r.missing) for r in tables["file_copy_warnings"].collect()}
    assert missing == {(r.doc_id, m) for r in every for m in ("HTR", "GT") if r.doc_id != "p1"}
    summary = {(r.dimension, r.value): r.docs for r in tables["review_sample_summary"].collect()}
    assert summary["total", "documents"] == len(every) and summary["file_copy_warnings", "files"] == len(missing)
    assert sum(v for (d, _), v in summary.items() if d == "reviewer") == len(every)
    facts = spark.createDataFrame([("S1W",), ("S3T",), ("S3T",)], "tag string")
    meta = [(r.key, r.value) for r in report.metadata(docs, facts, corpus.split(df), "now", "c", "1").orderBy("place").collect()]
    assert len(meta) == 13 and meta[0] == ("Generated", "now") and dict(meta)["Logged S3 orthographic violations"] == "2"


def test_null_texts(spark):
    df = spark.createDataFrame([("n", "s", None, None), ("m", "s", "a\nb\nc\nd\ne", None)], PAIR)
    rows = {r.pair_id: r for r in line_structure(df).collect()}
    assert (rows["n"].line_structure_band, rows["n"].gt_original_line_count) == ("Stable", 0)
    assert rows["m"].line_structure_band == "Severe instability" and rows["m"].adjusted_delta_gt_minus_htr == 5
    assert {r.stat: r.value for r in corpus.text_diagnostics(df).collect() if r.metric == "document"}["max"] == 0


def test_strict_sources(spark, tmp_path):
    from lectern.sources import text_corpus as S

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x_GT.txt").write_bytes(b"caf\xe9")
    with pytest.raises(Exception, match="UTF"):
        S.read_texts(spark, str(tmp_path / "bad"), "_GT").collect()
    assert S.read_json(spark, str(tmp_path / "absent.json"), "a int").count() == 0
    assert S.read_json(spark, str(tmp_path / "absent.json"), "a int", default=spark.createDataFrame([(1,)], "a int")).first().a == 1
    (tmp_path / "some.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert [r.a for r in S.read_json(spark, str(tmp_path / "some.json"), "a int").collect()] == [1, 2]
    S.write_csv(spark.createDataFrame([("=1+1", 1)], "a string, b int"), str(tmp_path / "csv"), excel=True)
    assert S.read_csv(spark, str(tmp_path / "csv")).first().a == "'=1+1"
    assert [r.pair_ord for r in corpus.ordered(spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "s")], "pair_id string, style string")).orderBy("style", "pair_id").collect()] == [0, 1, 2]
