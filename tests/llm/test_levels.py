import random
from pathlib import Path

import numpy as np
import pytest

from tidelog.llm import levels as L

DATA = Path("/root/testdata/sf0.01")


def isotonic_brute(y):
    """max over starts of min over ends of means."""
    n = len(y)
    return [max(min(np.mean(y[a : b + 1]) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.random(25), rng.integers(1, 5, 25)
    got_x, got = L.isotonic(x, y)
    assert (np.diff(got_x) >= 0).all() and np.allclose(got, isotonic_brute(y[np.argsort(x, kind="stable")]))


@pytest.mark.parametrize("seed", range(4))
def test_models_are_distributions(seed):
    """After any word, known or not, the probabilities of all words, the unknown one included, add up to 1; pairs are kept sparsely."""
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 9, rng.integers(2, 40)) for _ in range(3)]
    g = L.Ngrams(texts, 12)
    v, w = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12), indexing="ij"))
    assert np.allclose(np.exp2(-g.bits(v, w)).reshape(12, 12).sum(1), 1) and np.isclose(g.share.sum(), 1)
    pairs = [(a, b) for t in texts for a, b in zip(t.tolist(), t.tolist()[1:])]
    assert g.pair.tolist() == sorted({a * 12 + b for a, b in pairs}) and g.count.sum() == len(pairs)
    new, first = g.bits_of_new()
    for a, b, x in zip(v, w, g.bits(v, w)):
        if (a, b) not in pairs:
            assert np.isclose(x, (first if g.before[a] == 0 else new)[b])
    assert np.isfinite(L.Ngrams([], 5).bits(np.array([0, 3]), np.array([1, 0]))).all()


def test_statistics_are_those_of_the_distribution():
    rng = np.random.default_rng(1)
    parts = [rng.gamma(3, 2, n) for n in (0, 1, 50, 3000)]
    got = L.Model.statistics(np.stack([np.concatenate(parts)] * 2), np.cumsum([0] + [len(x) for x in parts]))
    assert np.isnan(got[:, 0]).all()
    for k in (1, 2, 3):
        assert np.allclose(got[:, k, 0], parts[k].mean())
    assert np.allclose(got[0, 3, 1:], np.quantile(parts[3], L.QUANTILES), atol=2 * L.BIN_BITS)


def test_texts_together_are_read_as_alone():
    rng = random.Random(3)
    m = L.Model([made(rng, k, 5) for k in (1, 2, 3, 4) for _ in range(5)], [k for k in (1, 2, 3, 4) for _ in range(5)])
    texts = [made(rng, rng.randrange(1, 5), rng.randrange(9)) + rng.choice(["", " zyx qwv"]) for _ in range(60)] + ["", "cat"]
    known, scores = m.read(texts)
    for t, k, s in zip(texts, known, scores):
        k1, s1 = m.read([t])
        assert np.isclose(k, k1[0]) and (np.isclose(s, s1[0]) or (np.isnan(s) and np.isnan(s1[0])))
    # words that no sample has count, and with them the score moves, but stays one of the scale
    assert m.score("cat dog " + "zyx " * 50) != m.score("cat dog") and 1 <= m.score("zyx qwv " * 20) <= 4 and m.score("cat") is None


def sentence(rng, level):
    words = {1: "cat dog bread hill", 2: "market road council letter", 3: "policy revenue statute inquiry", 4: "subsidiarity promulgation decarbonisation adjudication"}[level].split()
    return f"the {rng.choice(words)} may {rng.choice(['see', 'take'])} our {rng.choice(words)} {'whereas' if level > 2 else 'and'} the {rng.choice(words)} is old"


def made(rng, level, n):
    return ". ".join(sentence(rng, level) for _ in range(n))


def test_levels(spark):
    rng = random.Random(1)
    samples = [(made(rng, k, 8), k) for k in (1, 2, 3, 4) for _ in range(10)]
    docs = [(k * 100 + n, made(rng, k, 12)) for k in (1, 2, 3, 4) for n in range(20)]
    extra = [(1, None), (2, ""), (3, "der Rat " * 100), (4, "cat"), (5, made(rng, 1, 2)), (101, docs[1][1]), (6, "the cat"), (7, "x" * 500_000)]
    d = spark.createDataFrame([(*x, 9, "clash") for x in docs + extra], "doc_id bigint, text string, reading_level int, reading string").repartition(3)
    s = spark.createDataFrame(samples + [(None, 1), ("x", None)], "text string, reading_level int")
    got = [(r.doc_id, r.reading_level) for r in L.levels(d, s).collect()]
    assert sorted(got) == sorted([(i, i // 100) for i, _ in docs] + [(101, 1)])
    assert L.levels(d.where("false"), s).count() == 0
    with pytest.raises(ValueError):
        L.levels(d, s.where("false"))


def test_score_is_monotone():
    rng = random.Random(2)
    m = L.Model([made(rng, k, 5) for k in (1, 2, 3, 4) for _ in range(5)], [k for k in (1, 2, 3, 4) for _ in range(5)])
    got = [m.level(x) for x in np.linspace(0, 5, 60)]
    assert got == sorted(got) and set(got) == {1, 2, 3, 4}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """Each sample rated by models that were trained without it."""
    texts, levels = L.read_samples(spark.read.parquet(str(DATA / "level_samples.parquet")))
    right = 0
    for fold in range(5):
        m = L.Model([t for k, t in enumerate(texts) if k % 5 != fold], [x for k, x in enumerate(levels) if k % 5 != fold])
        right += sum(m.level(m.score(t)) == x for k, (t, x) in enumerate(zip(texts, levels)) if k % 5 == fold)
    assert right / len(texts) >= 0.95
