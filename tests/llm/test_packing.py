import numpy as np
import pytest

from tidelog.llm import packing as K

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("n, documents, cost", [(0, 9, None), (1, 9, None), (500, 1000, None), (500, 5, None), (500, 50, 30_000), (300, 1, None)])
def test_best_fit(n, documents, cost, rule):
    sizes = np.random.default_rng(n).integers(0, 101, n)
    b = K.best_fit(sizes, 100, documents, cost, rule)
    assert len(b) == n
    for k in set(b.tolist()):
        mine = sizes[b == k]
        assert mine.sum() <= 100 and len(mine) <= documents and (mine.astype(float) ** 2).sum() <= (cost or 100**2) + 1e-6
    if n:
        least = max(sizes.sum() / 100, n / documents, (sizes.astype(float) ** 2).sum() / (cost or 100**2))
        assert len(set(b.tolist())) <= least * 1.25 + 1


def test_small_cases():
    assert len(set(K.best_fit(np.array([6, 4, 5, 5, 7, 3]), 10).tolist())) == 3
    assert len(set(K.best_fit(np.array([0, 0, 0]), 10).tolist())) == 1
    with pytest.raises(ValueError):
        K.best_fit(np.array([11]), 10)
    with pytest.raises(ValueError):
        K.best_fit(np.array([1]), 10, rule="first")
    assert K.pieces(0, 5) == [(0, 0)] and K.pieces(5, 5) == [(0, 5)] and K.pieces(11, 5) == [(0, 5), (5, 5), (10, 1)]


def test_pack(spark):
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(["word"] * int(n))) for k, n in enumerate(rng.integers(0, 900, 300))] + [(900, "long " * 10_000), (901, ""), (902, None), (5, "again")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, container int").repartition(3)
    got = K.pack(d, TOKENIZER, block=64).collect()
    count = {i: len(K.encoding(TOKENIZER).encode_ordinary(t)) for i, t in docs[:-1] if t is not None}
    loads, seen = {}, {}
    for r in got:
        loads[r.container] = loads.get(r.container, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(loads.values()) <= K.CAPACITY
    for i, n in count.items():
        if i != 5:
            assert sorted(seen[i]) == K.pieces(n, K.CAPACITY)  # whole, in order, split only where it must be
    assert len(seen[5]) == 2 and 902 not in seen and len(seen) == len(count)
    assert sum(loads.values()) / (len(loads) * K.CAPACITY) > 0.85  # texts of up to 900 tokens in blocks of 64
    assert K.pack(d.where("false"), TOKENIZER).count() == 0
    again = {(r.doc_id, r.first_token, r.n_tokens, r.container) for r in K.pack(d.repartition(7), TOKENIZER, block=64).collect()}
    assert again == {(r.doc_id, r.first_token, r.n_tokens, r.container) for r in got}


def test_large_blocks_leave_little_room(spark):
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.lognormal(5.5, 1, 8000).astype(int), K.CAPACITY)
    b = K.best_fit(sizes)
    assert sizes.sum() / (K.CAPACITY * (b.max() + 1)) > 0.99


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_bind(spark, rule):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(k, "word " * int(n)) for k, n in enumerate(rng.integers(1, 300, 400))], "doc_id bigint, text string")
    got = K.pack(d, TOKENIZER, 512, 6, 60_000.0, rule, (1.0, 1.0, 1.0)).collect()
    loads = {}
    for r in got:
        loads.setdefault(r.container, []).append(r.n_tokens)
    assert all(sum(x) <= 512 and len(x) <= 6 and sum(n * n for n in x) <= 60_000 and max(x) <= 244 for x in loads.values())
    near = [sum(sum(x) > 500 for x in loads.values()), sum(len(x) == 6 for x in loads.values()), sum(sum(n * n for n in x) > 58_000 for x in loads.values())]
    assert min(near) > 0, near  # each of the three keeps some container from taking more
    with pytest.raises(ValueError):
        K.pack(d, TOKENIZER, cost=0.5)
