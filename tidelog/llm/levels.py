"""Reading level of each document.

Method: an interpolated n-gram model (words, orders 2, 1 and 0, weights by deleted interpolation, and a share for words that no
sample has) is trained on the samples of each level. A text's surprisal is taken over all its words, known or not, under each
model; the distribution of it, by its mean and quantiles, says how likely each level is, and the level to be expected is the text's
score. Isotonic regression on the samples maps scores monotonically to levels; each sample is scored by models that were trained
without it.

The samples are few and fixed: they are collected, and more than MOST_SAMPLE_WORDS words are refused; counts are kept of the pairs of words
that occur. Documents are scored where they are read, whole, without a shuffle.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import runs, words

MOST_SAMPLE_WORDS = 2_000_000
MIN_WORDS = 100
SHARPNESS = 10.0  # so many bits less, in the mean or a quantile, make a level twice as likely so many times
KNOWN = 0.5  # share of a text's words that the English samples must know for it to be English
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
MEAN_SHARE = 0.8  # of the mean in the score; the quantiles share the rest
BINS, BIN_BITS = 256, 0.1  # surprisal is counted in bins of so many bits, the last open
UNKNOWN = 0


class Ngrams:
    """The model of one level: counts of single words and of the pairs that occur. Word 0 stands for all unknown ones."""

    def __init__(self, texts: list[np.ndarray], n_words: int):
        self.n_words = n_words
        self.one = np.bincount(np.concatenate([*texts, np.zeros(0, np.int64)]), minlength=n_words).astype(float)
        pairs = np.concatenate([*[w[:-1] * n_words + w[1:] for w in texts], np.zeros(0, np.int64)])
        self.pair, count = np.unique(pairs, return_counts=True)
        self.count = count.astype(float)
        self.before = np.bincount(self.pair // n_words, self.count, n_words)
        # as many words as have come once are yet to come for the first time
        self.one[UNKNOWN] = max(1.0, float((self.one == 1).sum()))
        self.total = self.one.sum()
        self.share = self.weights()

    def weights(self) -> np.ndarray:
        """Weights of orders 2, 1 and 0: each pair votes for the order that predicts it best when it is itself left out."""
        v, w, n = self.pair // self.n_words, self.pair % self.n_words, self.count
        two = np.where(self.before[v] > 1, (n - 1) / np.maximum(self.before[v] - 1, 1), 0)
        one = (self.one[w] - 1) / max(self.total - 1, 1)
        best = np.argmax(np.stack([two, one, np.full(len(n), 1 / self.n_words)]), 0)
        votes = np.bincount(best, n, 3) + 1
        return votes / votes.sum()

    def bits_of_new(self) -> tuple[np.ndarray, np.ndarray]:
        """Surprisal of each word after a word that it has not followed yet, and after one that nothing has followed yet."""
        l2, l1, l0 = self.share
        return tuple(-np.log2(x * self.one / self.total + l0 / self.n_words) for x in (l1, l1 + l2))

    def bits(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Surprisal of w after v."""
        key = v * self.n_words + w
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        n = np.where(self.pair[at] == key, self.count[at], 0) if len(self.pair) else np.zeros(len(v))
        l2, l1, l0 = self.share
        return -np.log2(l2 * n / np.maximum(self.before[v], 1) + (l1 + l2 * (self.before[v] == 0)) * self.one[w] / self.total + l0 / self.n_words)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit (pool adjacent violators): x in order and its fitted values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v in y[order].astype(float):
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return x[order], np.concatenate([np.full(int(n), v) for v, n in blocks])


class Model:
    """Scores and levels, trained on texts with levels."""

    def __init__(self, texts: list[str], levels: list[int]):
        self.vocabulary: dict[str, int] = {}
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.int64) for t in texts]
        if sum(map(len, ids)) > MOST_SAMPLE_WORDS:
            raise ValueError("more sample text than this model is for")
        self.levels = sorted(set(levels))
        self.n_words = len(self.vocabulary) + 1
        of = {k: [w for w, y in zip(ids, levels) if y == k] for k in self.levels}
        self.grams = [Ngrams(of[k], self.n_words) for k in self.levels]
        # bits of all pairs that any level knows, by level; of the others they depend on the second word, and on whether the first is known
        self.pair = np.unique(np.concatenate([g.pair for g in self.grams]))
        self.known_bits = np.stack([g.bits(self.pair // self.n_words, self.pair % self.n_words) for g in self.grams])
        self.new_bits = np.stack([np.stack(g.bits_of_new()) for g in self.grams])
        self.alone = np.stack([(g.before == 0) for g in self.grams])
        everywhere = np.bincount(np.concatenate([*ids, np.zeros(0, np.int64)]), minlength=self.n_words)
        x = []
        for n, (w, k) in enumerate(zip(ids, levels)):
            # trained without this sample: words that it alone has are unknown then
            own = Ngrams([o for m, (o, y) in enumerate(zip(ids, levels)) if y == k and m != n], self.n_words)
            w = np.where(everywhere[w] > np.bincount(w, minlength=self.n_words)[w], w, UNKNOWN)
            bits = np.stack([(own if y == k else g).bits(w[:-1], w[1:]) for y, g in zip(self.levels, self.grams)])
            x.append(self.expected(self.statistics(bits, np.array([0, max(len(w) - 1, 0)])))[0])
        self.sample_scores = np.nan_to_num(np.array(x), nan=float(np.mean(self.levels)))
        self.x, self.fit = isotonic(self.sample_scores, np.array(levels))

    def surprisals(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bits of each word w after v, by level."""
        key = v * self.n_words + w
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        hit = self.pair[at] == key if len(self.pair) else np.zeros(len(key), bool)
        out = np.empty((len(self.levels), len(key)))
        for k in range(len(self.levels)):
            out[k] = self.new_bits[k][self.alone[k][v].astype(np.int64), w]
            out[k, hit] = self.known_bits[k, at[hit]]
        return out

    @staticmethod
    def statistics(bits: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Mean and quantiles of the distribution of each text (words edge[k]..edge[k+1]), by level: levels, texts, statistics. nan without words."""
        n = np.diff(edge)
        text = np.repeat(np.arange(len(n)), n)
        out = np.full((len(bits), len(n), 1 + len(QUANTILES)), np.nan)
        some = n > 0
        for k, b in enumerate(bits):
            out[k, some, 0] = (np.bincount(text, b, len(n)) / np.maximum(n, 1))[some]
            place = np.minimum((b / BIN_BITS).astype(np.int64), BINS - 1)
            upto = np.bincount(text * BINS + place, minlength=len(n) * BINS).reshape(len(n), BINS).cumsum(1)
            for j, q in enumerate(QUANTILES, 1):
                # linear inside the bin that the quantile falls in
                want = q * n[:, None]
                at = np.minimum((upto < want).sum(1), BINS - 1)
                below = np.where(at > 0, np.take_along_axis(upto, np.maximum(at - 1, 0)[:, None], 1)[:, 0], 0)
                inside = np.take_along_axis(upto, at[:, None], 1)[:, 0] - below
                out[k, some, j] = ((at + (want[:, 0] - below) / np.maximum(inside, 1)) * BIN_BITS)[some]
        return out

    def expected(self, statistics: np.ndarray) -> np.ndarray:
        """The level to be expected of each text: by each statistic, as each model's bits say, and the mean of that."""
        with np.errstate(invalid="ignore"):
            p = np.exp2(-SHARPNESS * (statistics - statistics.min(0)))
            each = (p * np.array(self.levels)[:, None, None]).sum(0) / p.sum(0)
        return each @ np.array([MEAN_SHARE, *[(1 - MEAN_SHARE) / len(QUANTILES)] * len(QUANTILES)])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Share of known words and score of each text; nan for a text of fewer than two words."""
        get = self.vocabulary.get
        each = [words(t) for t in texts]
        n = np.array([len(w) for w in each], np.int64)
        ids = np.fromiter(map(get, chain.from_iterable(each), repeat(UNKNOWN)), np.int64, int(n.sum()))
        end = np.cumsum(n)
        known = np.bincount(np.repeat(np.arange(len(n)), n), ids != UNKNOWN, len(n)) / np.maximum(n, 1)
        # the first word of a text follows none
        second = np.ones(len(ids), bool)
        second[(end - n)[n > 0]] = False
        at = np.flatnonzero(second)
        bits = self.surprisals(ids[at - 1], ids[at])
        return known, self.expected(self.statistics(bits, np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])))

    def score(self, text: str) -> float | None:
        score = self.read([text])[1][0]
        return None if np.isnan(score) else float(score)

    def level(self, score: float) -> int:
        """The level nearest to the fit at a score (linear between samples)."""
        v = float(np.interp(score, self.x, self.fit))
        return min(self.levels, key=lambda k: (abs(k - v), k))


def read_samples(samples: DataFrame) -> tuple[list[str], list[int]]:
    rows = samples.where("text is not null and reading_level is not null").select("text", "reading_level").limit(MOST_SAMPLE_WORDS + 1).collect()
    if not rows:
        raise ValueError("no samples")
    return [r.text for r in rows], [r.reading_level for r in rows]


def scored(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """documents with a struct `reading`: n_words (by white space), known (share of words that the samples know), score and level.

    Null texts have a null `reading`; score and level are null where there are fewer than two words.
    """
    texts, levels = read_samples(samples)
    model = Model(texts, levels)

    @F.arrow_udf("n_words bigint, known double, score double, level int")
    def reading(text: pa.Array) -> pa.Array:
        rows = text.to_pylist()
        texts = [t for t in rows if t is not None]
        parts = [model.read(texts[a:b]) for a, b in runs(texts)]
        known, scores = (np.concatenate(x) for x in zip(*parts)) if parts else ((), ())
        got = iter([(len(t.split()), float(k), None if np.isnan(s) else float(s)) for t, k, s in zip(texts, known, scores)])
        out = [None if t is None else next(got) for t in rows]
        return pa.array([None if r is None else {"n_words": r[0], "known": r[1], "score": r[2], "level": None if r[2] is None else model.level(r[2])} for r in out], pa.struct([("n_words", pa.int64()), ("known", pa.float64()), ("score", pa.float64()), ("level", pa.int32())]))

    return documents.withColumn("reading", reading.asNondeterministic()(F.col("text")))


def levels(documents: DataFrame, samples: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and reading_level of each English text of min_words words or more. English is what the samples know half the words of."""
    d = scored(documents.select("doc_id", "text"), samples)
    return d.where((F.col("reading.n_words") >= min_words) & (F.col("reading.known") >= KNOWN) & F.col("reading.level").isNotNull()).select("doc_id", F.col("reading.level").alias("reading_level"))
