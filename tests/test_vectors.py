"""The neighbour index against the exact search, and the outlier factor against a plain one."""

import math
import random

import numpy as np

from corpuslab.operators import outliers as O
from corpuslab.operators import vectors as V


def cloud(seed, n, dims, groups=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((groups, dims)) * 3
    return [(int(k), [float(v) for v in centres[k % groups] + rnd.standard_normal(dims)]) for k in range(n)]


def test_index_has_nearly_all_neighbours(spark):
    vectors = V.distinct_vectors(spark.createDataFrame(cloud(1, 900, 24), "k long, x array<float>"), "k", "x").cache()
    found = V.index(vectors)
    seen = V.recall(found, vectors, 10, 3).first()
    assert seen.asked > 200 and seen.recall >= 0.97
    counts = found.groupBy("v").count().collect()
    assert len(counts) == 900 and all(r["count"] == V.KEPT for r in counts)
    true = {(r.v, r.other): r.d for r in V.all_pairs(vectors, V.KEPT).collect()}
    both = [(r.d, true[r.v, r.other]) for r in found.collect() if (r.v, r.other) in true]
    assert len(both) > 0.9 * len(true) and all(abs(a - b) < 1e-9 for a, b in both)


def test_index_of_texts_as_keys_and_of_few(spark):
    kind = "k string, x array<double>"
    few = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("c", [5.0, 5.0])], kind)
    got = {(r.v, r.other, round(r.d, 6)) for r in V.index(V.distinct_vectors(few, "k", "x")).collect()}
    assert got == {(a, b, round(math.dist(p, q), 6)) for a, p in few.collect() for b, q in few.collect() if a != b}
    assert V.index(V.distinct_vectors(few.limit(1), "k", "x")).collect() == []
    assert V.index(V.distinct_vectors(few.limit(0), "k", "x")).collect() == []


def plain_lof(points, k):
    """For each key; copies are each other's nearest, ties go to the lesser key."""
    near = {a: sorted((math.dist(x, y), b) for b, y in points if a != b)[:k] for a, x in points}
    kd = {a: n[-1][0] for a, n in near.items()}
    lrd = {a: 1 / max(sum(max(d, kd[b]) for d, b in n) / len(n), 1e-12) for a, n in near.items()}
    return {a: sum(lrd[b] for _, b in n) / len(n) / lrd[a] for a, n in near.items()}


def test_outlier_factor_equals_a_plain_one(spark):
    rnd = random.Random(2)
    points = [(k, [rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)]) for k in range(120)]
    points += [(200 + k, points[7][1]) for k in range(5)] + [(300 + k, [9.0, 9.0, 9.0]) for k in range(30)] + [(999, [40.0, 0.0, 0.0])]
    df = spark.createDataFrame([*points, (None, [1.0, 1.0, 1.0]), (5000, None), (5001, [None, 1.0, 2.0])], "k long, x array<double>")
    want = plain_lof(points, 8)
    for exact in (True, False):
        got = {r.k: r.lof for r in O.local_outlier_factor(df, "k", "x", 8, exact=exact).collect()}
        assert set(got) == set(want)
        assert all(abs(got[a] - want[a]) < 1e-6 * want[a] for a in want)
    flags = [r.k for r in O.local_outlier_factor(df, "k", "x", 8, share=0.01).collect() if r.outlier]
    assert 999 in flags and len(flags) <= 2


def test_exact_search_by_blocks_is_exact(spark, monkeypatch):
    """Many ties, far outliers, an offset: the same neighbours as one by one, in few rows for each vector, and not the index's 0.8 of them."""
    rnd = np.random.default_rng(5)
    for x in (rnd.integers(0, 3, (150, 4)).astype(float), rnd.standard_normal((150, 9)) + 1e6, np.r_[rnd.standard_normal((140, 3)), 1e12 * rnd.standard_normal((10, 3))]):
        monkeypatch.setattr(V, "STRIP", 1000)
        for y, own in ((x, True), (x[:70] + 0.5, False)):
            want = [(i, int(j), d[j]) for i in range(len(x)) for d in [np.sqrt(((x[i] - y) ** 2).sum(1))] for j in [j for j in np.lexsort((np.arange(len(y)), d)) if not own or j != i][:6]]
            r, c, d = V.nearest(x, y, own, 6)
            assert list(zip(r.tolist(), c.tolist(), d.tolist(), strict=True)) == want
    points = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in enumerate(rnd.standard_normal((700, 30)))], "k string, x array<double>")
    rows = {r.k: np.array(r.x) for r in points.collect()}
    keys, x = sorted(rows), np.array([rows[k] for k in sorted(rows)])
    want = {(k, keys[j]) for i, k in enumerate(keys) for j in np.argsort(((x[i] - x) ** 2).sum(1), kind="stable")[1:11]}
    for most in (V.CELL_NUMBERS, 1000):  # 3 cells, and 21
        monkeypatch.setattr(V, "CELL_NUMBERS", most)
        got = V.all_pairs(V.distinct_vectors(points, "k", "x"), 10)
        assert {(r.v, r.other) for r in got.collect()} == want


def test_outlier_factor_shuffles_little(spark):
    """No round after round of lists: a vector is dealt out once for each cell, not in 48 groups a round."""
    import re

    plan = V.all_pairs(V.distinct_vectors(spark.createDataFrame(cloud(2, 300, 8), "k long, x array<float>"), "k", "x"), 10)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3
