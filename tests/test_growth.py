"""Rows of kernels in one pass and in bounded memory, with the results of the plain methods."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import flat, storage
from lectern.functions import kernels as K
from lectern.functions.spans import Touching
from lectern.operators import align, issues, rules
from lectern.plans.queries import QUERIES
from tests.test_step2 import PAIR


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=8), st.integers(0, 20), st.integers(0, 6))
def test_touching(steps, start, size):
    spans, at = [], 0
    for gap, length in steps:
        spans.append((f"t{len(spans)}", at + gap, at + gap + length))
        at += gap + length
    t = Touching()
    t.add(spans)
    assert t.tags(start, start + size) == [x for x, a, b in spans if max(a, start) < min(b, start + size)]


def test_issues_are_rows_of_one_pass(spark, monkeypatch):
    monkeypatch.setattr(flat, "ROWS", 3)  # rows are handed on before a text is done
    df = spark.createDataFrame([(f"p{i}", "s", "rey  grande de españa " * i, "rey de  espana ,, " * i) for i in range(5)], PAIR)
    two, one, overlaps = align.alignment_issues(df), rules.rule_issues(df, "S1"), align.orthographic_overlaps(df)
    for rows in (two.filter("tag = 'S2X' and gt_text <> ''"), one, overlaps, align.word_operations(df)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "Generate" not in plan
    ones = {}
    for r in one.collect():
        ones.setdefault(r.pair_id, []).append((r.tag, r.start, r.end))
    got = two.collect()
    assert [r.ordinal for r in sorted(got, key=lambda r: (r.pair_id, r.ordinal)) if r.pair_id == "p3"] == list(range(len(K.word_issues("rey  grande de españa " * 3, "rey de  espana ,, " * 3))))
    assert all(r.overlaps_step1 == sorted({t for t, a, b in ones[r.pair_id] if max(a, r.start) < min(b, max(r.end, r.start + 1))}) for r in got)


def test_dense_matrix_holds_every_character(spark, sf):
    rows = storage.settled(issues.confusion_matrix(align.alignment_issues(spark.createDataFrame([("p", "s", "casa Élan ñu çb", "Casa élan nú cb")], PAIR))))
    dense = issues.dense_matrix(rows)
    assert {"C U+0043", "é", "n", "ú", "Ø"} <= set(dense.columns)
    whole = QUERIES["dense_confusion_matrix"](spark, sf)
    n = whole.agg(sum((F.sum(f"`{c}`") for c in whole.columns[2:]), F.lit(0))).first()[0]
    assert n == QUERIES["confusion_matrix"](spark, sf).agg(F.sum("n")).first()[0]
    assert len({c.lower() for c in whole.columns}) == len(whole.columns)
