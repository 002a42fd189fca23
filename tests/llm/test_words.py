"""Vectorised tokens against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import words as W

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TEXT = st.text(alphabet="aAbZ09 é中\t\n\x0b.,;'\x00\x1f\x7f", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words(texts):
    column = pa.array(texts, pa.string())
    for letters, pattern in ((W.SPACES, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = W.Words(column, letters, lower=True)
        got = [[w.word(k).decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "B"]), min_size=1, max_size=30), st.integers(1, 21))
def test_windows_agree_with_their_words(tokens, k):
    w = W.Words(pa.array([" ".join(tokens)]))
    h, ok = w.windows(k)
    seen = {}
    for i in np.flatnonzero(ok):
        seen.setdefault(tuple(tokens[i : i + k]), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)
    assert ok.sum() == max(0, len(tokens) - k + 1)


def test_long_words_and_slices():
    long = "x" * (W._CHUNK + 10)
    column = pa.array(["no", long + " y", long, "y"]).slice(1)
    w = W.Words(column)
    assert w.counts.tolist() == [2, 1, 1] and w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[3]
