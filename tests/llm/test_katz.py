"""Katz backoff against counts in dictionaries, and its normalisation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslab.llm import katz


def plain_discounts(counts):
    """Good-Turing discounts from counts of counts on a line in the logarithms."""
    n = Counter(c for c in counts.values() if c <= katz.K + 1)
    if len(n) > 1:
        x, y = [math.log(r) for r in sorted(n)], [math.log(n[r]) for r in sorted(n)]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        power = 1 + sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        if power < 0:
            over = (katz.K + 1) ** power
            return lambda c: c * ((1 + 1 / c) ** power - over) / (1 - over) if c <= katz.K else c - katz.KEPT
    return lambda c: c - 0.5 if c <= katz.K else c - katz.KEPT


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [None] + [Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in range(1, order + 1)]
        self.kept = [None] + [plain_discounts(c) for c in self.counts[1:]]
        self.total = sum(self.counts[1].values())
        self.after = defaultdict(Counter)
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.after[g[:-1]][g[-1]] = c

    def p(self, gram):
        k = len(gram)
        if k == 1:
            c = self.counts[1]
            if not self.total:
                return 1.0
            return self.kept[1](c[gram]) / self.total if c[gram] else 1 - sum(map(self.kept[1], c.values())) / self.total
        c, after = self.counts[k][gram], self.after[gram[:-1]]
        if c:
            return self.kept[k](c) / sum(after.values())
        if not after:
            return self.p(gram[1:])
        alpha = (1 - sum(map(self.kept[k], after.values())) / sum(after.values())) / (1 - sum(self.p((*gram[1:-1], w)) for w in after))
        return alpha * self.p(gram[1:])

    def score(self, text):
        return sum(math.log10(self.p(tuple(text[max(0, i + 1 - self.order) : i + 1]))) for i in range(len(text)))

    def base(self, text):
        c = self.counts[1]
        return sum(math.log10((c[(w,)] + 1) / (self.total + len(c) + 1)) for w in text)


def tokens(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    for x in "\t\n\x0b\x0c\r":
        low = low.replace(x, " ")
    return [w for w in low.split(" ") if w] + [None]


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "é", "The", "tHE", " "]
    rows = [(k, rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randrange(0, 40)))) for k in range(120)]
    rows += [(120, None), (121, ""), (None, "w1 w2 new"), (None, "w1 w2 new"), (5, "w0 w0 w0 w0 w0 w0 w0 w0 w0"), (122, "never seen words w1 w1")]
    return [(*r, "x", 7.0) for r in rows]


@pytest.mark.parametrize("order, block_tokens, bucket_keys, hot", [(1, 100, 50, 500_000), (2, 300, 100, 500_000), (2, 4_000_000, 1_500_000, 30), (3, 250, 200, 20), (3, 4_000_000, 1_500_000, 500_000)])
def test_scores_equal_plain_ones(spark, order, block_tokens, bucket_keys, hot):
    rows = corpus(order)
    df = spark.createDataFrame(rows, "doc_id long, text string, learnt string, score double").repartition(3)
    got = katz.scores(df, ~katz.held_out(df["doc_id"]), order, block_tokens=block_tokens, bucket_keys=bucket_keys, hot=hot).collect()
    learns = [not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2) for r in rows]
    model = Plain([tokens(r[1]) for r, a in zip(rows, learns) if a], order)
    want = sorted((repr(r[0]), a, len(tokens(r[1])), sum(model.counts[1][(w,)] > 0 for w in tokens(r[1])), model.total, round(model.base(tokens(r[1])), 7), round(model.score(tokens(r[1])), 7)) for r, a in zip(rows, learns))
    assert sorted((repr(r.doc_id), r.learnt, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in got) == want
    assert 3 < sum(not a for a in learns)


def test_probabilities_sum_to_one():
    model = Plain([tokens(r[1]) for r in corpus(9)], 3)
    words = [w for (w,) in model.counts[1]]
    for h in [(), ("w0",), ("w0", "w0"), ("w3", "w1"), ("nope", "w2")]:
        assert abs(sum(model.p((*h, w)) for w in [*words, "unknown"]) - 1) < 1e-9


def test_discounts():
    d = katz.good_turing([1000, 300, 140, 80, 55, 40, 0, 0])
    assert d[0] == 0 and all(0 < a < b < 1 for a, b in zip(d[1:], d[2:]))
    assert katz.good_turing([5, 5, 5, 5, 5, 5])[1] == 0.5 and katz.good_turing([0] * 6)[2] == 0.75 and katz.good_turing([3, 0, 0, 0, 0, 0])[1] == 0.5


def test_packing():
    for a in (np.zeros(0, np.uint64), np.arange(7, dtype=np.uint32), np.array([2**63 + 5, 1], np.uint64), np.array([0.5, -1.0])):
        assert (katz.unpack(katz.pack(a), a.dtype.type) == a).all()


def test_nothing_and_nothing_learnt(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scores(none, F.lit(True)).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in katz.scores(some, F.lit(False)).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens, rows[1].base_score, rows[1].score) == (3, 0, 0, 0.0, 0.0)
    assert rows[2].n_tokens == 1
