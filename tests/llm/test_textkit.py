import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import textkit as X

TEXT = st.text(alphabet="ab C\n\t\x0b.é—😀 ", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_match_python(texts):
    w = X.Words(pa.array(texts, pa.string()), X.NONSPACE, lower=False)
    expected = [(t or "").encode().split() for t in texts]
    got = [[] for _ in texts]
    for a, b, o in zip(w.starts, w.ends, w.owner):
        got[o].append(w.raw[a:b].tobytes())
    assert got == expected
    # equal words have equal hashes, different ones differ
    seen = {}
    for word, h in zip((x for ws in expected for x in ws), w.hash):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_grams_match_python(texts):
    w = X.Words(pa.array(texts, pa.string()), X.NONSPACE, lower=False)
    h, own, _ = w.grams(3, short=True)
    for i, t in enumerate(texts):
        ws = t.encode().split()
        n = len(ws) - 2 if len(ws) >= 3 else min(len(ws), 1)
        assert (own == i).sum() == n
        grams = [tuple(ws[j : j + 3]) for j in range(n)]
        assert len(set(grams)) == len(set(h[own == i].tolist()))


def test_chunks_cover_all_rows_and_slices():
    arr = pa.array(["a" * 10, None, "b" * 300, "", "c"]).slice(1)
    parts = list(X.chunks(arr, 100))
    assert [p.to_pylist() for _, p in parts] == [[None], ["b" * 300], ["", "c"]]
    raw, off = X.buffers(arr)
    assert bytes(raw) == b"b" * 300 + b"c" and off.tolist() == [0, 0, 300, 300, 301]


def test_long_text_equals_short_parts():
    a = X.Words(pa.array([" ".join(["xyz"] * 400_000)]))
    assert len(set(a.hash.tolist())) == 1 and a.hash[0] == X.Words(pa.array(["xyz"])).hash[0]
    assert not np.any(np.diff(a.owner)) and re.fullmatch("xyz", "xyz")
