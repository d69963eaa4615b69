"""Topics against a plain variational Bayes in dictionaries and loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import topics as TM
from corpuslab.operators.shared import written


def documents(seed, n=60):
    rnd = random.Random(seed)
    themes = [[f"{a}{k}" for k in range(12)] for a in "abc"]
    return [(k, " ".join(rnd.choices(themes[k % 3], k=rnd.randrange(5, 40)) + rnd.choices(sum(themes, []), k=2))) for k in range(n)]


def plain(docs, terms, k, steps, lam):
    """lam, bounds: one unit after the other, each to its fixed point."""
    alpha = eta = 1 / k
    bounds = []
    dig = lambda x: float(TM.digamma(np.array([x]))[0])
    for _ in range(steps):
        log_beta = [[dig(lam[w][t]) - dig(sum(lam[v][t] for v in range(len(terms)))) for t in range(k)] for w in range(len(terms))]
        sums = [[0.0] * k for _ in terms]
        bound = 0.0
        for d in docs:
            gamma = [alpha + sum(d.values()) / k] * k
            for _ in range(3000):
                theta = [math.exp(dig(g) - dig(sum(gamma))) for g in gamma]
                norm = {w: sum(theta[t] * math.exp(log_beta[w][t]) for t in range(k)) for w in d}
                after = [alpha + theta[t] * sum(n / norm[w] * math.exp(log_beta[w][t]) for w, n in d.items()) for t in range(k)]
                done = max(abs(a - b) for a, b in zip(after, gamma)) < 1e-9
                gamma = after
                if done:
                    break
            log_theta = [dig(g) - dig(sum(gamma)) for g in gamma]
            for w, n in d.items():
                z = sum(math.exp(log_theta[t] + log_beta[w][t]) for t in range(k))
                bound += n * math.log(z)
                for t in range(k):
                    sums[w][t] += n * math.exp(log_theta[t] + log_beta[w][t]) / z
            bound += sum((alpha - g) * x + math.lgamma(g) - math.lgamma(alpha) for g, x in zip(gamma, log_theta)) + math.lgamma(k * alpha) - math.lgamma(sum(gamma))
        for t in range(k):
            column = [row[t] for row in lam]
            bound += sum((eta - x) * log_beta[w][t] + math.lgamma(x) - math.lgamma(eta) for w, x in enumerate(column)) + math.lgamma(eta * len(terms)) - math.lgamma(sum(column))
        bounds.append(bound)
        lam = [[eta + x for x in row] for row in sums]
    return np.array(lam), bounds


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.0, 300.0, 1e6])
    assert np.allclose(TM.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    steps = (np.array([math.lgamma(v + 1e-4 * v) for v in x]) - [math.lgamma(v - 1e-4 * v) for v in x]) / (2e-4 * x)
    assert np.allclose(TM.digamma(x), steps, rtol=1e-4)
    assert abs(TM.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10


def test_steps_equal_plain_ones(spark):
    docs = documents(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    counts, names = TM.counted(df, "doc_id", F.split("text", " "), 1, 1.0, 20_000)
    terms = [r.term for r in names.orderBy("id").collect()]
    assert len(terms) == 36 and [r.id for r in names.orderBy("id").collect()] == list(range(36))
    counts = counts.cache()
    model = TM.fitted(counts, len(terms), 3, 6, rise=0.0, inner=3000, settled=1e-12)
    at = {w: k for k, w in enumerate(terms)}
    plain_docs = []
    for _, text in docs:
        d = {}
        for w in text.split():
            d[at[w]] = d.get(at[w], 0) + 1
        plain_docs.append(d)
    lam, bounds = plain(plain_docs, terms, 3, len(model.bounds), np.random.default_rng(1).gamma(100.0, 0.01, (len(terms), 3)).tolist())
    assert np.allclose(model.bounds, bounds, rtol=1e-6) and np.allclose(model.lam, lam, rtol=2e-3, atol=2e-3)
    assert all(b > a for a, b in zip(model.bounds, model.bounds[1:]))


def test_topics_of_three_themes(spark):
    df = spark.createDataFrame([*documents(2), (900, "only once here"), (901, None), (902, "")], "doc_id long, text string")
    best, units, model = TM.lda(df, F.split("text", " "), 3, most_words=1, rise=1e-7)
    rows = best.collect()
    assert len(rows) == 30 and all(len({r.term[0] for r in rows if r.topic == t}) == 1 for t in range(3))
    found = {r.doc_id: r for r in units.collect()}
    assert len(found) == 63 and found[901].topic is found[901].share is None and found[900].terms == found[902].terms == 0
    assert len({(found[k].topic, k % 3) for k in range(60)}) == 3
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))


def test_bigrams_few_units_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")
    words = F.split("text", " ")
    assert sorted(df.select(F.explode(TM.ngrams(words, 2)).alias("t")).toPandas()["t"]) == sorted("a b c b c d".split() + ["a b", "b c", "b c", "c d"])
    best, units, model = TM.lda(df, words, 5, max_share=1.0)
    assert {r.topic for r in best.collect()} == {0, 1} and {r.term for r in best.collect()} == {"b", "c", "b c"} and model.lam.shape == (3, 2)
    best, units, model = TM.lda(df.limit(0), words, 5)
    assert best.collect() == units.collect() == [] and model is None


def test_words_are_found_once(spark):
    found = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        found.add(1)
        return text.split(" ")

    units = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5}") for i in range(20)], "doc_id long, text string")
    TM.lda(units, split("text"), 2, most_steps=2)[1].collect()
    assert found.value == 20


@pytest.mark.parametrize("most, vocabulary, share", [(1, 20_000, 0.95), (2, 20_000, 0.95), (2, 40, 0.3), (3, 60, 0.9)])
def test_terms_counted_by_number_equal_those_spelt_out(spark, most, vocabulary, share):
    rnd = np.random.default_rng(3)
    rows = [(k, [f"ŵ{w}" for w in rnd.zipf(1.4, rnd.integers(0, 40)) % 60]) for k in range(120)]
    rows += [(5, ["ŵ1", "ŵ2", "ŵ1"]), (5, []), (None, ["ŵ1", "ŵ2"]), (300, None), (301, ["alone"])]
    spelt = written(spark.createDataFrame(rows, "doc_id long, _words array<string>").repartition(3).select("doc_id", F.coalesce("_words", F.array().cast("array<string>")).alias("_words")), "spelt")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    got, want = [], []
    for out, made in ((got, lambda: TM.counted_words(spelt, "doc_id", most, 2, share, vocabulary)), (want, lambda: TM.counted(spelt, "doc_id", TM.ngrams(F.col("_words"), most), 2, share, vocabulary))):
        before = shuffled()
        counts, names = made()
        out += [sorted(str((r.doc_id, list(r.ids), list(r.n))) for r in counts.collect()), {r.id: r.term for r in names.collect()}, shuffled() - before]
    assert got[:2] == want[:2] and len(got[1]) > 10
    assert most > 2 or got[2] < 0.8 * want[2]


def test_long_batches_are_worked_on_in_parts():
    import pyarrow as pa

    from corpuslab.operators.shared import list_slices

    lists = [["a"] * n for n in (3, 0, 5, 20, 1, 1)] + [None]
    parts = list(list_slices(pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["w"]), "w", 8))
    assert [x for p in parts for x in p.column("w").to_pylist()] == lists and len(parts) > 2
    assert all(len(p.column("w").flatten()) <= 20 + 8 for p in parts) and not list(list_slices(parts[0].slice(0, 0), "w"))
