from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import kernels as K
from lectern.functions.spans import Lines, python_pattern, spans_of
from lectern.schemas import STEP1_RULES, STEP3_RULES

short = st.text("abcé ", max_size=14)


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


@settings(max_examples=300, deadline=None)
@given(short, short)
def test_operations_turn_one_text_into_the_other(a, b):
    ops = K.operations(a, b)
    edits = sum(o != "M" for o, _, _ in ops)
    assert edits == table(a, b)[-1][-1] == K.distance(a, b)
    assert sum(o in "MSD" for o, _, _ in ops) == len(a) and sum(o in "MSI" for o, _, _ in ops) == len(b)
    assert "".join(b[j] for o, _, j in ops if o in "MSI") == b
    assert all(a[i] == b[j] for o, i, j in ops if o == "M")


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
def test_halving_keeps_the_distance(a, b):
    cells, K.CELLS = K.CELLS, 30
    try:
        assert sum(o != "M" for o, _, _ in K.operations(a, b)) == table(a, b)[-1][-1]
    finally:
        K.CELLS = cells


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_common_subsequence(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = d[i - 1][j - 1] + 1 if x == y else max(d[i - 1][j], d[i][j - 1])
    assert K.common(a, b) == d[-1][-1]


def spans(gt, htr):
    return [(x["code"], x["start"], x["end"], x["gt_text"], x["htr_text"]) for x in K.word_issues(gt, htr)]


def test_word_goldens():
    assert spans("çena", "cena") == [("X", 0, 1, "ç", "c")]
    assert spans("rey grande de españa", "rey de espana") == [("D", 4, 4, "grande", ""), ("X", 11, 12, "ñ", "n")]
    assert spans("la casa", "la la casa") == [("I", 3, 5, "", "la")]
    assert spans("conquistadores", "conquista dores") == [("D", 9, 9, "dores", ""), ("I", 10, 15, "", "dores")]
    assert spans("", "") == [] and spans("uno", "") == [("D", 0, 0, "uno", "")]
    # numbers match only exactly
    assert [x[0] for x in spans("1621", "1622")] == ["D", "I"]


def test_metric_golden():
    q = K.quality_counts("abc def", "abd def")
    assert (q["ref_chars_norm"], q["matches"], q["substitutions"], q["long_spans"], q["longest_span"], q["error_runs"]) == (6, 5, 1, 0, 6, 1)
    assert (q["window_size"], q["window_count"], round(q["window_max_cer"], 6), q["window_sd_cer"], q["wer_edits"], q["ref_tokens_norm"]) == (100, 1, 0.166667, 0.0, 1, 2)
    empty = K.quality_counts("", "abc")
    assert empty["ref_chars_norm"] == 0 and empty["window_count"] == 0 and empty["insertions"] == 3


def test_boundary_golden():
    assert K.boundaries("por que no", "porque no")["merges"] == 1
    assert K.boundaries("porque no", "por que no")["splits"] == 1
    assert K.boundaries("ab c d", "a bc d")["complex_boundary"] == 1


def test_rule_spans_golden():
    text = "  hola ,, rey \nfin"
    rules = [(k, __import__("regex").compile(python_pattern(p))) for k, p in STEP1_RULES.items()]
    got = {(s["tag"], s["start"], s["end"]) for s in spans_of(text, rules)}
    assert got == {("L", 0, 2), ("T", 13, 14), ("W", 0, 2), ("SP", 6, 8), ("P", 7, 9)}
    t = next(s for s in spans_of(text, rules) if s["tag"] == "T")
    assert (t["line"], t["char_start"], t["char_end"], t["line_length"]) == (1, 14, 14, 14)
    assert Lines("").begin == [0] and Lines("a\n").begin == [0] and Lines("a\r\nb").begin == [0, 3]
    third = [(k, __import__("regex").compile(python_pattern(p))) for k, p in STEP3_RULES.items()]
    assert {s["tag"] for s in spans_of("quo Wxx tratak aaa bb", third)} == {"Q", "WK", "DC", "E", "T"}
