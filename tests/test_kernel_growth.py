"""Alignment kernels whose work follows the edits, with the results of the plain methods."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import kernels as K
from tests.test_step2 import path, plain_alignment


def changed(a, letters, rate, seed=1):
    r, out = random.Random(seed), []
    for c in a:
        x = r.random()
        out.append(c if x > rate else "" if x < rate / 3 else r.choice(letters) + (c if x < rate * 2 / 3 else ""))
    return "".join(out)


@pytest.mark.parametrize("few", [True, False], ids=["waves", "band"])
@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=90), st.sampled_from([0.02, 0.1, 0.4]), st.integers(0, 9))
def test_the_path_is_that_of_the_whole_table(few, a, rate, seed):
    b = changed(a, "abc", rate, seed)
    kept, K._few = K._few, lambda edits, size: few
    try:
        assert K.operations(a, b) == path(a, b)
        assert K.distance(list(a), list(b)) == sum(o != "M" for o, _, _ in path(a, b))
    finally:
        K._few = kept


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=30, max_size=80), st.sampled_from([0.02, 0.2]), st.integers(0, 9))
def test_waves_cross_where_the_band_does(a, rate, seed):
    b, out = changed(a, "ab", rate, seed), []
    cells, few, K.CELLS = K.CELLS, K._few, 200
    try:
        for K._few in (lambda edits, size: True, lambda edits, size: False):
            out.append(K.operations(a, b))
    finally:
        K.CELLS, K._few = cells, few
    assert out[0] == out[1]


@pytest.mark.parametrize("rate", [0.0005, 0.02])
def test_metrics_of_long_texts(rate):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(16000)]
    text = " ".join(words)
    began = time.process_time()
    q = K.quality_counts(text, changed(text, "abcdefghijklmnopqrstuvwxyz", rate))
    # the whole tables have 8e9 cells: half a minute and more
    assert time.process_time() - began < 10 and 0 < q["wer_edits"] < 16000 and q["ref_chars_norm"] == sum(map(len, words))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["internacional", "inter", "nacional", "internacinal", "arquitectura", "arquitectvra", "arqitectura", "españa", "espana", "de", "la", "мир", "1621"]), max_size=40).map(" ".join), st.sampled_from([0.0, 0.03, 0.1]), st.integers(0, 9))
def test_words_that_nearly_fit(text, rate, seed):
    gt, htr = K.tokens(text), K.tokens(changed(text, "aeu ", rate, seed))
    assert K.align_words(gt, htr) == plain_alignment(gt, htr)
