"""Entropy balancing against a plain solver of the dual, and the limits that the rounding keeps."""

import math
import random
import warnings
from collections import Counter, defaultdict

import pytest

from corpuslab.llm import mixing


def plain_targets(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """Shares handed out by weight; what is over a limit is handed out again."""
    whole = defaultdict(int)
    for source, size in sizes:
        whole[source] += size
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest = share * sum(whole.values()) - sum(target.values())
        part = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > most * whole[s]}
        if not over:
            target |= part
            break
        target |= {s: most * whole[s] for s in over}
        free -= over
    return whole, target


def plain_rates(sizes, most=2.0):
    """Rates by nested bisection: lambda of each source for a given mu, and mu."""
    whole, target = plain_targets(sizes, most=most)
    words = sum(whole.values())
    mean = sum(s * math.log(1 + s) for _, s in sizes) / words
    z = lambda s: math.log(1 + s) - mean
    ridge = mixing.RIDGE * max(1.0, sum(s * z(s) ** 2 for _, s in sizes))
    free = {x for x in whole if whole[x] and target[x] < most * whole[x] * (1 - 1e-9)}
    own = {x: Counter(s for y, s in sizes if y == x) for x in free}

    def lam(x, mu):
        lo, hi = -30.0, 30.0
        for _ in range(80):
            mid = (lo + hi) / 2
            if sum(n * s * min(most, math.exp(mid + mu * z(s))) for s, n in own[x].items()) < target[x]:
                lo = mid
            else:
                hi = mid
        return lo

    def slope(mu):
        lams = {x: lam(x, mu) for x in free}
        moved = sum(s * z(s) * (min(most, math.exp(lams[x] + mu * z(s))) if x in free else target[x] / whole[x] if whole[x] else 0) for x, s in sizes)
        return moved + ridge * mu, lams

    lo, hi = -5.0, 5.0
    for _ in range(50):
        mid = (lo + hi) / 2
        if slope(mid)[0] < 0:
            lo = mid
        else:
            hi = mid
    lams = slope(lo)[1]
    return whole, target, lambda x, s: min(most, math.exp(lams[x] + lo * z(s))) if x in free else (target[x] / whole[x] if whole[x] else 0.0)


def corpus(seed, n):
    rnd = random.Random(seed)
    docs = []
    for k in range(n):
        source = rnd.choice(["big"] * 6 + ["mid"] * 3 + ["tiny", None, "long"])
        docs.append((k, source, rnd.randint(400, 900) if source == "long" else rnd.randint(0, 200)))
    return docs + [docs[3], docs[3], (None, "mid", 50), (None, "mid", 50), (n, "empty", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_equal_a_plain_solver(spark, seed):
    docs = corpus(seed, 1500)
    df = spark.createDataFrame([(*d, 7.0, 9) for d in docs], "doc_id long, source string, size long, target double, copies int")
    got = mixing.with_copies(df, mixing.solved(df)).collect()
    assert len(got) == len(docs)
    whole, target, rate = plain_rates([(s, n) for _, s, n in docs])
    taken = Counter()
    for r in got:
        assert r.source_size == whole[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        if r.size:
            assert abs(r.rate - rate(r.source, r.size)) < 3e-6, (r, rate(r.source, r.size))
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in whole:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 60)
    # documents of one source and different length have different rates, and the mix keeps the mean length better than one rate for each source
    assert len({round(r.rate, 4) for r in got if r.source == "big"}) > 20
    again = mixing.with_copies(df.repartition(7), mixing.solved(df.repartition(5))).collect()
    assert Counter((r.doc_id, r.size, r.rate, r.copies) for r in again) == Counter((r.doc_id, r.size, r.rate, r.copies) for r in got)


def test_nothing_and_one_source(spark):
    kind = "doc_id long, source string, size long"
    none = spark.createDataFrame([], kind)
    assert mixing.with_copies(none, mixing.solved(none)).collect() == []
    empty = spark.createDataFrame([(1, "a", 0), (2, None, 0)], kind)
    assert {(r.rate, r.copies) for r in mixing.with_copies(empty, mixing.solved(empty)).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(k, "a", 10) for k in range(100)], kind)
    rows = mixing.with_copies(one, mixing.solved(one)).collect()
    assert sum(r.copies for r in rows) == 150


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(k, "one two three", "s", "mine", k, "r") for k in range(20)], "doc_id long, text string, source string, target string, size long, rate string")
    out = mixing.mixed(docs, docs.select("source", mixing.word_count(docs["text"]).alias("size")))
    assert out.columns == docs.columns
    assert all(r.target == "mine" and r.size == r.doc_id and r.rate == "r" for r in out.collect())
    assert out.count() == 30
    nulls = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert mixing.mixed(nulls, nulls.select("source", mixing.word_count(nulls["text"]).alias("size"))).collect() == []


def test_many_sources_are_ordered_by_ranges(spark, monkeypatch):
    sizes = spark.createDataFrame([(f"s{k % 37:02d}" if k % 37 else None, k % 11) for k in range(800)], "source string, size long")
    one = sorted(map(tuple, mixing.source_targets(sizes, mixing.Scratch(spark, "mix")).collect()), key=repr)
    monkeypatch.setattr(mixing, "MOST_IN_TASK", 3)
    assert sorted(map(tuple, mixing.source_targets(sizes, mixing.Scratch(spark, "mix")).collect()), key=repr) == one
    want = plain_targets([tuple(r) for r in sizes.collect()])
    assert all(abs(t - want[1][s]) < 1e-6 * max(1, t) and n == want[0][s] for s, n, _, t in one)


def test_a_solve_that_does_not_settle_says_so(spark, monkeypatch):
    sizes = spark.createDataFrame([(x, k, s) for k, x, s in corpus(4, 300)], "source string, doc_id long, size long")
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 0)
    with warnings.catch_warnings(), pytest.raises((RuntimeError, UserWarning), match="still off"):
        warnings.simplefilter("error", UserWarning)
        mixing.solved(sizes.select("source", "size"))


def test_rows_alike_in_id_and_size_are_told_apart(spark):
    docs = spark.createDataFrame([(1, f"w{k} x y", "s") for k in range(60)], "doc_id long, text string, source string")
    sizes = docs.select("source", mixing.word_count(docs["text"]).alias("size"))
    runs = [Counter(map(tuple, mixing.mixed(docs.repartition(n), sizes).collect())) for n in (1, 5, 7)]
    assert runs[0] == runs[1] == runs[2]
