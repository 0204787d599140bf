from __future__ import annotations

import os
import re
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import alnum, spaced

from quillvec.llm import _text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \n\t\r.,é日\x00\x1c\U0001f600", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([(T.SPACED, spaced), (T.ALNUM, alnum)]), st.integers(1, 40))
def test_words(texts, kind, limit):
    table, plain = kind
    got = []
    for _, _, data, offsets in T.slices(pa.array(texts, pa.string()), limit):
        low = T.lowered(data)
        starts, ends, firsts = T.word_bounds(data, offsets, table)
        got += [[low[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(firsts, firsts[1:])]
    assert got == [plain(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_hashes(texts, n):
    words, hashes, grams = [], [], []
    for _, _, data, offsets in T.slices(pa.array(texts, pa.string()), 1 << 20):
        starts, ends, firsts = T.word_bounds(data, offsets, T.SPACED)
        h = T.span_hashes(data, starts, ends)
        words += [w for t in texts for w in spaced(t)]
        hashes += h.tolist()
        ok, counts = T.per_document(firsts, n)
        grams += T.gram_hashes(h, n)[ok].tolist()
        assert counts.sum() == ok.sum()
    assert len(set(words)) == len(set(hashes)) and len(words) == len(hashes)
    plain = [tuple(w[i : i + n]) for w in map(spaced, texts) for i in range(len(w) - n + 1)]
    assert len(plain) == len(grams) and len(set(plain)) == len(set(grams)) == len(set(zip(plain, grams)))


def test_slices_of_a_sliced_array():
    whole = pa.array(["ab", "cd", None, "éf"])
    parts = [(a, b, bytes(d)) for a, b, d, _ in T.slices(whole.slice(1, 3), 2)]
    assert b"".join(p[2] for p in parts) == "cdéf".encode()
    assert re.sub(r"\s", "", "".join(str(p[:2]) for p in parts)).startswith("(0,")
    assert np.array_equal(T.mix(np.arange(3, dtype=np.uint64)), T.mix(np.arange(3, dtype=np.uint64)))
