import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import gather
from flowloom.llm import textbytes as tb

PATTERNS = {"space": (tb.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), "word": (tb.WORDLIKE, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢\t\n.9", max_size=30)), max_size=8), st.sampled_from(sorted(PATTERNS)))
def test_words_are_those_of_the_pattern(texts, kind):
    table, pattern = PATTERNS[kind]
    data, offsets = tb.column_bytes(pa.array(texts, pa.string()))
    start, end, h, first = tb.words(data, offsets, table)
    names = {}
    for i, t in enumerate(texts):
        want = re.findall(pattern, lower((t or "").encode()))
        got = [lower(bytes(data[a:b])) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert got == want
        for w, x in zip(want, h[first[i] : first[i + 1]], strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_segments_do_not_matter(monkeypatch, size):
    text = ("Ab cde  éf. " * 40).strip()
    column = pa.array([text, "x" * 300, None, text])
    data, offsets = tb.column_bytes(column)
    want = tb.words(data, offsets, tb.WORDLIKE)
    monkeypatch.setattr(tb, "SEGMENT", size)
    for a, b in zip(tb.words(data, offsets, tb.WORDLIKE), want, strict=True):
        assert (a == b).all()


def test_ngrams_stay_inside_texts():
    data, offsets = tb.column_bytes(pa.array(["a b c", "b c", "", "c"]))
    _, _, h, first = tb.words(data, offsets, tb.NOT_SPACE)
    g, text = tb.word_ngrams(h, first, 2)
    assert text.tolist() == [0, 0, 1] and g[1] == g[2] != g[0]
    assert len(tb.word_ngrams(h, first, 9)[0]) == 0


def test_sliced_columns():
    column = pa.array(["one", "two three", None, "four"]).slice(1, 3)
    data, offsets = tb.column_bytes(column)
    assert bytes(data) == b"two threefour" and offsets.tolist() == [0, 9, 9, 13]


@pytest.mark.parametrize("width", [4, 6, 8])
def test_packed_keys_and_counts(width):
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** (8 * width) - 1, 100, dtype=np.uint64))
    assert (gather.unpack(gather.pack(keys, width), width) == keys).all()
    n = np.array([0, 1, 5, 2**40])
    assert (gather.unpack_counts(gather.pack_counts(n)) == n).all()
