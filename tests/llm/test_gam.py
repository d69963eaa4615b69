import random

import numpy as np

from corpuslab.llm import gam


def test_learns_main_effects_and_an_interaction():
    rnd = np.random.default_rng(3)
    x = rnd.random((6000, 5))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)) * 1.0
    y[x[:, 2] > 0.9] = 1
    model = gam.fit(x[:4000], y[:4000])
    assert (0, 1) in model.pairs
    assert ((model.log_odds(x[4000:]) > 0) == y[4000:]).mean() > 0.93


def test_scores_of_held_out_texts(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    docs, labels = [], []
    for k in range(600):
        good = k % 2
        words = [word() for _ in range(rnd.randint(20, 80))]
        docs.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:10] * 4), "x"))
        labels.append((k, good))
    docs += [(None, "null id", "x"), (9000, None, "x"), (9001, "", "x"), (1, docs[1][1], "x"), (9002, "w " * 60_000, "x")]
    labels += [(None, 1), (3, None), (1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    measured = gam.features(df).cache()
    model = gam.learned(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = gam.scored(measured, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 600]
    assert sum(right) > 0.98 * len(right)
    none = gam.learned(measured, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in gam.scored(measured, none).collect()} == {0.5}
    assert gam.scored(gam.features(df.limit(0)), model).collect() == []
