import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.words import Words, blocks, shingles


def brute(text):
    return (text or "").encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1cé日.", max_size=25)), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    words = Words(pa.array(texts, pa.string()))
    got = [[words.word(i) for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [brute(t) for t in texts]
    h = words.hashes()
    flat = [w for t in texts for w in brute(t)]
    assert len(set(h.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab  ", max_size=30), max_size=6))
def test_shingle_sets_match_tuples(texts):
    sh, at = shingles(Words(pa.array(texts, pa.string())))
    names = {}
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        w = brute(t)
        want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        assert len(want) == b - a
        for x, y in zip(want, sh[a:b].tolist(), strict=True):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_slices_and_blocks():
    column = pa.array(["x", "a b", None, "c d e"], pa.string()).slice(1)
    assert np.diff(Words(column).first).tolist() == [2, 0, 3]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc"] * 10 + [None], pa.string())})
    parts = list(blocks(batch, "text", 7))
    assert sum(p.num_rows for p in parts) == 11 and len(parts) > 3
