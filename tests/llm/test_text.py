import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreframe.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t\x0bé!ñ", max_size=30)), max_size=12)


def found(values, kind, size=T.RUN_BYTES):
    words = []
    for first, end, data, offsets in T.runs(pa.array(values, pa.string()), size):
        low = T.lower(data)
        starts, ends, bounds = T.words(low, offsets, kind)
        content = low.tobytes()
        for a, b in zip(bounds[:-1], bounds[1:]):
            words.append([content[starts[i] : ends[i]].decode() for i in range(a, b)])
    return words


def small(value):
    return re.sub("[A-Z]", lambda m: m[0].lower(), value or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 8, 1 << 20]))
def test_words_of_runs(values, size):
    space = [re.findall(r"[^\x20\x09-\x0D]+", small(v)) for v in values]
    alnum = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(v)) for v in values]
    assert found(values, T.UNSPACED, size) == space
    assert found(values, T.ALNUM, size) == alnum


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_hashes_mean_equal_words_and_shingles(values):
    seen_words, seen_shingles = {}, {}
    for first, end, data, offsets in T.runs(pa.array(values, pa.string())):
        starts, ends, bounds = T.words(data, offsets)
        parts = T.hashes(data, starts, ends)
        content = data.tobytes()
        words = [content[a:b] for a, b in zip(starts, ends)]
        for word, value in zip(words, parts):
            assert seen_words.setdefault(value, word) == word
        assert len(set(words)) == len(set(parts.tolist()))
        grams, begins = T.shingles(parts, bounds, 3)
        for i in range(end - first):
            own = words[bounds[i] : bounds[i + 1]]
            expected = [tuple(own[j : j + 3]) for j in range(len(own) - 2)]
            expected = expected or ([tuple(own)] if own else [])
            got = grams[begins[i] : begins[i + 1]]
            assert len(got) == len(expected)
            for value, gram in zip(got, expected):
                assert seen_shingles.setdefault(value, gram) == gram


def test_runs_keep_offsets_of_slices():
    column = pa.array(["skip", "ab", None, "", "cde"]).slice(1)
    ((first, end, data, offsets),) = T.runs(column)
    assert (first, end) == (0, 4)
    assert data.tobytes() == b"abcde" and offsets.tolist() == [0, 2, 2, 2, 5]
    assert list(T.runs(pa.array([], pa.string()))) == []


def test_spread_out():
    group, place = T.spread_out(np.array([2, 0, 3]))
    assert group.tolist() == [0, 0, 2, 2, 2] and place.tolist() == [0, 1, 0, 1, 2]
