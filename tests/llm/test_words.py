"""Arrays of words, sets, searches and permutations against plain Python."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docgraph.llm import bpe, common, jaccard, mixing, neighbours, pages

TEXT = st.text(alphabet="abAB \t\n\x0b\xa0é", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.booleans())
def test_words_are_runs_between_ascii_white_space(texts, lower):
    data, offsets = common.text_buffers(pa.array(texts, pa.string()))
    got = []
    for lo, hi in common.slices(offsets, 16):
        w = common.Words(data, offsets, lo, hi, lower)
        h = w.hashes()
        assert len(h) == len(w.starts)
        for r in range(hi - lo):
            got.append([w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.bounds[r] : w.bounds[r + 1]], w.ends[w.bounds[r] : w.bounds[r + 1]])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcABC ", max_size=60), min_size=1, max_size=6))
def test_shingle_sets_are_distinct_runs_of_five(texts):
    for s, t in zip(jaccard.sets_of(pa.array(texts)), texts):
        w = t.lower().split()
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=10, unique=True).map(sorted), max_size=12), st.integers(1, 8))
def test_t_occurrence_finds_all_ids_that_occur_often(lists, least):
    count = Counter(i for x in lists for i in x)
    assert jaccard.t_occurrence([x for x in lists if x], least) == {i: n for i, n in count.items() if n >= least}


def test_search_equals_brute_force():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 90, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for p in (0.5, 0.8, 0.9, 0.95, 1.0) for k in (0, 3, 10, 30)] + [np.zeros(0, np.uint64)]
    inter = [len(np.intersect1d(base, s)) for s in sets]
    assert sorted(jaccard.search(base, sets)) == [k for k, s in enumerate(sets) if len(s) and 100 * inter[k] >= 75 * (len(base) + len(s) - inter[k])]
    assert jaccard.search(np.zeros(0, np.uint64), sets) == []


def test_permutations_are_bijections_with_inverse():
    for n in (1, 2, 3, 75, 1000, 4097):
        p = mixing.permute(n, 99, np.arange(n))
        assert sorted(p) == list(range(n)) and (mixing.permute(n, 99, p, inverse=True) == np.arange(n)).all()


def test_targets_stop_at_three_times_the_size_and_reshare():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(got[1] - 1980 * 2 / 3) < 1e-9 and abs(sum(got) - 2010) < 1e-9


def test_pretokens_equal_the_pattern():
    import public_tokenizers as p
    import regex

    pattern = regex.compile(p.PATTERN)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab's tdLL0½ \n\t\xa0é中😀.,!'") for _ in range(rnd.randint(0, 25))) for _ in range(800)] + ["", " ", "a  ", "'s"]
    numbers, spans, words, _ = bpe._vocabulary(texts, p.PATTERN)
    at = np.concatenate([[0], np.cumsum(spans)])
    for k, t in enumerate(texts):
        assert [words[i] for i in numbers[at[k] : at[k + 1]]] == pattern.findall(t), t


def test_varints_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert (bpe._unvarint(bpe._varint(x)[0]) == x).all()


def test_unique_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(30):
        streams, run = [[rnd.choice("abc") for _ in range(rnd.randint(0, 40))] for _ in range(4)], 4
        distinct = list(dict.fromkeys(map(tuple, streams)))
        for s, got in zip(streams, pages.unique_runs(streams, run)):
            gone = [False] * len(s)
            for i in range(len(s) - run + 1):
                if any(tuple(s[i : i + run]) == u[j : j + run] for u in distinct if u != tuple(s) for j in range(len(u) - run + 1)):
                    gone[i : i + run] = [True] * run
            assert got == [t for t, g in zip(s, gone) if not g]


def test_common_prefixes_of_a_suffix_array():
    tokens = np.array([1, 2, 1, 2, 1, 3, 1, 2])
    order, ranks = pages.suffix_array(tokens)
    want = sorted(range(8), key=lambda i: tokens[i:].tolist())
    assert order.tolist() == want
    lcp = pages.common(order, ranks)
    for k in range(1, 8):
        a, b, n = tokens[want[k - 1] :], tokens[want[k] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_learned_partitions_reach_the_recall_they_claim():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model, probes, claimed = neighbours.learn(x[:3000], len(x), 0.95, 500)
    q, dealt = x[::37], model.logits(x).argmax(axis=1)
    near = neighbours.knn(x, q, 20, own=False)
    rank = np.argsort(np.argsort(-model.logits(q), axis=1), axis=1)
    assert claimed >= 0.95 and probes < 8 and (np.take_along_axis(rank, dealt[near], axis=1) < probes).mean() >= 0.9


def test_learning_holds_little_of_the_sample_against_itself():
    x = np.random.default_rng(3).standard_normal((6000, 8))
    tracemalloc.start()
    try:
        near = neighbours.knn(x, x, 12, own=True)
        neighbours.learn(x, 60_000, 0.5, 200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert near.shape == (6000, 12) and (near != np.arange(6000)[:, None]).all() and peak < 120e6
