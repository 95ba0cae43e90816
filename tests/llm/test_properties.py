"""Properties of the building blocks under random input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.llm import exact_dedup, packing, suffix_dedup
from trellis.llm import textnp as T
from trellis.llm.simhash_bk import unite

FAST = settings(max_examples=60, deadline=None)


@FAST
@given(st.integers(1, 50_000), st.sampled_from([64, 1000, 2048]))
def test_pieces_fill_their_class(length, capacity):
    pieces = packing.cut(length, capacity)
    assert sum(pieces) == length and min(pieces) > 0
    for p in pieces:
        share = capacity // (capacity // p)
        assert p >= packing.FILL * share


@FAST
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.integers(0, 9), st.integers(0, 9)), max_size=40), st.integers(1, 5))
def test_merging_runs_in_any_grouping_gives_one_result(rows, groups):
    e = np.zeros(len(rows), exact_dedup._ENTRY)
    for k, (d, c, i, r) in enumerate(rows):
        e[k] = ([d, 0, 0, 7], c, i, r, 1)
    parts = [exact_dedup.merge_runs(p) for p in np.array_split(e, groups)]
    assert exact_dedup.merge_runs(np.concatenate(parts)).tobytes() == exact_dedup.merge_runs(e).tobytes()


@FAST
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=8))
def test_words_and_hashes_follow_the_text(texts):
    block = T.Block(texts)
    start, end, first = block.words()
    raw = block.data.tobytes()
    assert [raw[a:b] for a, b in zip(start, end, strict=True)] == [w for t in texts for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    h = T.Rolling(T.byte_values(1)[block.data])(start, end)
    words = [w for t in texts for w in t.split()]
    assert len(set(h.tolist())) == len(set(words))


@FAST
@given(st.binary(min_size=1, max_size=120))
def test_suffix_arrays_sort(raw):
    sa, rank = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert (rank[sa] == np.arange(len(raw))).all()


@FAST
@given(st.integers(1, 30), st.data())
def test_unite_joins_exactly_the_connected(n, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=30))
    label = np.arange(n)
    if pairs:
        unite(label, *map(np.array, zip(*pairs, strict=True)))
    want = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert label.tolist() == want
