import random
from itertools import product

import numpy as np

from corpuslab.llm import langid

LANGS = {"aa": "ba be bi bo bu ka ke".split(), "bb": "xor xir yor yir zor zir".split(), "cc": "mné mnó lné ló rné".split()}


def text_of(lang, rnd, n):
    return " ".join("".join(rnd.choice(LANGS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_shares_equal_enumeration():
    rnd = np.random.default_rng(5)
    lengths, size = np.array([1, 2, 5, 7]), 3
    scores, transitions = rnd.normal(size=(lengths.sum(), size)), rnd.normal(size=(size, size))
    got, at = langid.shares(scores, lengths, transitions), 0
    for d, n in enumerate(lengths):
        total, mean = 0.0, np.zeros(size)
        for path in product(range(size), repeat=n):
            w = np.exp(sum(scores[at + k, s] for k, s in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for s in path:
                mean[s] += w / n
        assert np.allclose(got[d], mean / total)
        at += n


def test_blocks_equal_one_sequence():
    rnd = np.random.default_rng(6)
    scores, transitions = rnd.normal(size=(200, 4)), rnd.normal(size=(4, 4))
    want = langid.posterior(scores[None], transitions)[0][0].mean(0)
    assert np.allclose(langid.shares(scores, np.array([200]), transitions)[0], want)


def test_languages_and_switches(spark):
    rnd = random.Random(8)
    docs = [(k, text_of(lang := rnd.choice(sorted(LANGS)), rnd, rnd.randint(3, 120)), lang, 0.5) for k in range(400)]
    odd = [(1000, None, "aa", 0.0), (1001, "", None, 0.0), (1002, "12 34 !? _", "bb", 0.0), (None, text_of("aa", rnd, 30), "aa", 0.0), (1003, text_of("bb", rnd, 30_000), None, 0.0)]
    odd += [(1004, text_of("aa", rnd, 60) + " " + text_of("cc", rnd, 30), None, 0.0), docs[0], docs[0]]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score double")
    model = langid.learned(df)
    got = langid.predict(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003].lang_pred == "bb" and by[1004].lang_pred == "aa" and 0.6 < by[1004].score < 0.75
    assert sum(by[k].lang_pred == lang for k, _, lang, _ in docs) > 0.98 * len(docs)
    none = langid.learned(df.filter("lang = 'zz'"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).collect() == []
