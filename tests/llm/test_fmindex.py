import random

import numpy as np
import pytest

from tidelog.llm import fmindex as X


@pytest.mark.parametrize("s", [[], [1], [1, 1, 1, 1], [3, 1, 2], [1, 2] * 50, list(range(1, 200)), [1] * 100 + [2] + [1] * 100])
def test_suffix_array(s):
    s = np.array(s, np.int64)
    assert X.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_random(seed):
    rng = random.Random(seed)
    part = [rng.randrange(1, 2 + seed * 20) for _ in range(rng.randrange(1, 80))]
    s = np.array(part * 3 + [rng.randrange(1, 500) for _ in range(100)] + part, np.int64)
    assert X.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_bits(n):
    b = np.random.default_rng(n).random(n) < 0.3
    x = X.Bits(b)
    assert x.rank(np.arange(n + 1)).tolist() == [int(b[:k].sum()) for k in range(n + 1)]
    if n:
        assert x.get(np.arange(n)).tolist() == b.tolist()


def test_wavelet():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = X.Wavelet(s, 37)
    for c in range(37):
        i = np.arange(501)
        assert (w.rank(np.full(501, c), i) - w.rank(np.full(501, c), np.zeros(501, np.int64))).tolist() == [int((s[:k] == c).sum()) for k in i]
    c, i = w.get(np.arange(500))
    assert c.tolist() == s.tolist() and i.tolist() == w.rank(s, np.arange(500)).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_search_and_locate(seed):
    rng = random.Random(seed)
    k = 3 + 10 * seed
    s = [rng.randrange(1, k) for _ in range(700)]
    index = X.FMIndex(np.array(s, np.int64), k + 2, sample=1 + 3 * seed)
    patterns = [tuple(s[p : p + 3]) for p in range(0, 600, 7)] + [(k + 1,) * 3, (1, k, 1)]
    low, high = index.search(np.array(patterns, np.int64))
    for p, a, b in zip(patterns, low, high):
        want = [x for x in range(len(s) - 2) if tuple(s[x : x + 3]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("seed", range(4))
def test_separators_are_symbols_like_others(seed):
    rng = random.Random(seed)
    s = [0 if rng.random() < 0.05 else rng.randrange(1, 6) for _ in range(900)]
    index = X.FMIndex(np.array(s, np.int64), 6, sample=1 + 3 * seed)
    # every suffix is located, also those whose walk passes separators and the beginning
    assert sorted(index.locate(np.arange(index.n)).tolist()) == list(range(len(s) + 1))
    patterns = [tuple(s[p : p + 2]) for p in range(0, 890, 3)] + [(0, 0)]
    low, high = index.search(np.array(patterns, np.int64))
    for p, a, b in zip(patterns, low, high):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [x for x in range(len(s) - 1) if tuple(s[x : x + 2]) == p]


def test_a_broken_index_raises_and_does_not_loop():
    index = X.FMIndex(np.arange(1, 50), 60)
    index.marked = X.Bits(np.zeros(index.n, bool))
    with pytest.raises(AssertionError):
        index.locate(np.arange(3))
