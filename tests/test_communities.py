"""Louvain communities: never worse than a plain sequential Louvain on test graphs, the same however rows are dealt out."""

import random
from collections import defaultdict

import pytest

from corpuslab.operators import communities as C
from corpuslab.operators import graph as G

KARATE = "1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"


def quality(edges, label):
    m = sum(w for _, _, w in edges)
    inside, ends = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        ends[label[a]] += w
        ends[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - (ends[c] / (2 * m)) ** 2 for c in ends)


def plain_louvain(edges):
    """One vertex after the other, to its best community, until none moves; then folded, and again."""
    label = {v: v for a, b, _ in edges for v in (a, b)}
    graph = list(edges)
    while True:
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in graph:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        m = sum(k.values()) / 2
        c, s = {v: v for v in k}, dict(k)
        moved = True
        any_moved = False
        while moved:
            moved = False
            for v in sorted(k):
                to = defaultdict(float)
                for u, w in near[v].items():
                    to[c[u]] += w
                own = c[v]
                s[own] -= k[v]
                worth = {x: to[x] / m - k[v] * s[x] / (2 * m * m) for x in {*to, own}}
                best = max(worth, key=lambda x: (worth[x], x == own, -x))
                if worth[best] <= worth[own] + 1e-12:
                    best = own
                moved |= best != own
                c[v] = best
                s[best] += k[v]
            any_moved |= moved
        if len(set(c.values())) == len(k):
            return label
        label = {v: c[x] for v, x in label.items()}
        folded = defaultdict(float)
        for a, b, w in graph:
            folded[min(c[a], c[b]), max(c[a], c[b])] += w
        graph = [(a, b, w) for (a, b), w in folded.items()]


def cliques(n, size):
    edges = [(k * size + i, k * size + j, 1.0) for k in range(n) for i in range(size) for j in range(i)]
    return edges + [(k * size, (k + 1) % n * size + 1, 1.0) for k in range(n)]


def planted(seed, groups=5, size=20, inner=0.4, outer=0.03):
    rnd = random.Random(seed)
    n = groups * size
    return [(i, j, round(rnd.uniform(0.5, 2), 3)) for i in range(n) for j in range(i) if rnd.random() < (inner if i // size == j // size else outer)]


GRAPHS = {
    "karate": [(*map(int, e.split("-")), 1.0) for e in KARATE.split()],
    "cliques": cliques(8, 5),
    "star": [(0, k, 1.0) for k in range(1, 40)],
    "planted": planted(1, 4, 12),
    "two parts": planted(2, 2, 8) + [(a + 1000, b + 1000, w) for a, b, w in planted(3, 2, 7)],
}


def labels_of(rows):
    return {r.id: r.community for r in rows.collect()}


@pytest.mark.parametrize("name, in_one_task", [*[(name, C.IN_ONE_TASK) for name in sorted(GRAPHS)], ("karate", 0)])
def test_no_worse_than_a_plain_louvain(spark, name, in_one_task):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = labels_of(C.louvain(df, in_one_task=in_one_task))
    if not in_one_task:
        assert got == labels_of(C.louvain(df)) == labels_of(C.louvain(df, in_one_task=len(edges) // 3))  # wherever the rounds are made
    assert set(got) == {v for a, b, _ in edges for v in (a, b)}
    assert all(min(v for v in got if got[v] == c) == c for c in set(got.values()))
    assert quality(edges, got) >= quality(edges, plain_louvain(edges)) - 1e-9
    q = G.modularity(df, spark.createDataFrame(list(got.items()), "id long, community long")).first()
    assert abs(q.q - quality(edges, got)) < 1e-9 and q.communities == len(set(got.values()))


def test_dealing_and_ranges_do_not_matter(spark, monkeypatch):
    edges = planted(7, 2, 9)
    one = labels_of(C.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"), in_one_task=0))
    turned = [(b, a, w / 2) for a, b, w in edges] + [(a, b, w / 2) for a, b, w in edges]
    assert labels_of(C.louvain(spark.createDataFrame(turned, "src long, dst long, weight double").repartition(7))) == one
    monkeypatch.setattr(C, "MOST_IN_TASK", 0)
    assert labels_of(C.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"), in_one_task=0)) == one


def test_loops_nulls_and_nothing(spark):
    kind = "src string, dst string, weight double"
    assert C.louvain(spark.createDataFrame([], kind)).collect() == []
    odd = [("a", "a", 3.0), ("b", "c", 1.0), (None, "c", 9.0), ("d", "e", 0.0), ("f", "g", None)]
    assert labels_of(C.louvain(spark.createDataFrame(odd, kind))) == {"a": "a", "b": "b", "c": "b"}


def test_propagation_settles(spark):
    df = spark.createDataFrame(GRAPHS["cliques"], "src long, dst long, weight double")
    got = labels_of(G.label_propagation(df))
    assert len(set(got.values())) == 8
    with pytest.raises(RuntimeError, match="still change"):
        G.label_propagation(df, 1)
