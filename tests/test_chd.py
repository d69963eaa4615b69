import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import chd


def table(spark, n=60):
    rnd = random.Random(4)
    vocabulary = [[f"{c}{k}" for k in range(15)] for c in "abc"] + [[f"z{k}" for k in range(5)]]
    rows = []
    for u in range(n):
        for t in sorted(set(rnd.sample(vocabulary[u % 3], 8) + rnd.sample(vocabulary[3], 2) + rnd.sample(vocabulary[(u + 1) % 3], 1))):
            rows.append((u, t, 1))
    return spark.createDataFrame(rows, "doc_id long, term string, n long"), rows


def chi2_by_hand(rows, left):
    sums = {}
    for u, t, _ in rows:
        a = sums.setdefault(t, [0, 0])
        a[u not in left] += 1
    n1, n2 = sum(a for a, _ in sums.values()), sum(b for _, b in sums.values())
    n = n1 + n2
    return sum((o - (a + b) * m / n) ** 2 / ((a + b) * m / n) for a, b in sums.values() for o, m in ((a, n1), (b, n2))) if n1 and n2 else 0.0


def test_sweep_finds_the_best_cut_and_moves_end_where_single_moves_do(spark):
    counts, rows = table(spark)
    units, names = chd.unit_rows(counts, "doc_id", 20_000)
    scored = chd.first_axis(units, names).cache()
    sides = chd.sweep(scored, len(names))
    order = [r.unit for r in scored.orderBy("score", "unit").collect()]
    best = max(chi2_by_hand(rows, set(order[: k + 1])) for k in range(len(order) - 1))
    left = {r.unit for r in sides.collect() if r.side == 1}
    assert abs(chi2_by_hand(rows, left) - best) < 1e-6
    a, s = chd.side_sums(sides, len(names))
    assert abs(chd.chi2_from(a, s) - best) < 1e-6
    moved = {r.unit for r in chd.refined(sides, len(names), 30).collect() if r.side == 1}
    end = chi2_by_hand(rows, moved)
    plain = set(left)  # one move after another, while one helps
    while True:
        gain, u = max((chi2_by_hand(rows, plain ^ {u}) - chi2_by_hand(rows, plain), u) for u in range(60))
        if gain <= 1e-9:
            break
        plain ^= {u}
    assert end >= best - 1e-6 and end >= 0.98 * chi2_by_hand(rows, plain)
    assert all(chi2_by_hand(rows, moved ^ {u}) <= end + 1e-6 for u in range(60))


def test_the_axis_is_the_first_of_a_correspondence_analysis(spark):
    import numpy as np

    counts, rows = table(spark)
    units, names = chd.unit_rows(counts, "doc_id", 20_000)
    got = {r.unit: r.score for r in chd.first_axis(units, names, 400, 1e-12).collect()}
    m = np.zeros((60, len(names)))
    for u, t, _ in rows:
        m[u, names.index(t)] = 1
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    u, _, _ = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    axis = u[:, 0] / np.sqrt(r)
    assert abs(np.corrcoef(axis, [got[k] for k in range(60)])[0, 1]) > 1 - 1e-6


def test_classes_are_found(spark):
    counts, _ = table(spark)
    leaves, tree = chd.classify(counts, 3, refine=1)
    by = {}
    for r in chd.terminal(leaves, tree, 1).collect():
        by.setdefault(r.doc_id % 3, []).append(r["class"])
    main = [max(set(v), key=v.count) for v in by.values()]
    assert len(set(main)) == 3 and all(v.count(m) >= 0.9 * len(v) for v, m in zip(by.values(), main, strict=True))
    assert len(tree) == 4


@pytest.mark.parametrize(
    "sizes, tree, least, want",
    [
        ({2: 10, 4: 8, 5: 2}, [(1, 2), (1, 3), (3, 4), (3, 5)], 5, {2: 1, 4: 2, 5: 0}),  # a small leaf beside a class is in none
        ({2: 10, 4: 3, 5: 4}, [(1, 2), (1, 3), (3, 4), (3, 5)], 5, {2: 1, 4: 2, 5: 2}),  # two small ones together
        ({2: 10, 4: 1, 5: 1}, [(1, 2), (1, 3), (3, 4), (3, 5)], 2, {2: 1, 4: 2, 5: 2}),
        ({2: 3, 3: 30}, [(1, 2), (1, 3)], 5, {2: 1, 3: 2}),  # fewer than two classes: all leaves
    ],
)
def test_small_leaves_go_to_their_mother(spark, sizes, tree, least, want):
    rows = [(100 * leaf + k, leaf) for leaf, n in sizes.items() for k in range(n)] + [(1, 0)]
    got = chd.terminal(spark.createDataFrame(rows, "doc_id long, leaf int"), tree, least).collect()
    assert {r.doc_id // 100: r["class"] for r in got if r.doc_id > 1} == want
    assert [r["class"] for r in got if r.doc_id == 1] == [0]


def test_two_classifications(spark):
    kind = "doc_id long, class int"
    first = spark.createDataFrame([(k, 1 + k % 2) for k in range(40)] + [(50, 0)], kind)
    second = spark.createDataFrame([(k, 2 - k % 2 if k < 36 else 1) for k in range(40)] + [(50, 1)], kind)
    found = {(r.a, r.b): r.chi2 for r in chd.crossed(first, second).collect()}
    assert found[1, 2] > 3.84 and found[2, 1] > 3.84 and found[1, 1] < 0
    got = Counter(r["class"] for r in chd.stable_classes(first, second).collect())
    assert got[0] == 3 and sum(got.values()) == 41  # two that disagree, and the one without a class


def test_segments_are_joined_to_a_size(spark):
    segs = spark.createDataFrame([(d, k, n) for d, ns in ((1, [5, 5, 5, 5, 3]), (2, [2]), (3, [30, 1, 1])) for k, n in enumerate(ns)], "doc_id long, seg_no int, n long")
    groups = {}
    for r in chd.size_merged(segs, F.col("n"), 10).collect():
        groups.setdefault((r.doc_id, r.group), []).append((r.seg_no, r.n))
    assert {k: sorted(v) for k, v in groups.items() if k[0] != 3} == {(1, 0): [(0, 5), (1, 5)], (1, 1): [(2, 5), (3, 5), (4, 3)], (2, 0): [(0, 2)]}
    assert sum(len(v) for k, v in groups.items() if k[0] == 3) == 3


def odd_texts(spark):
    rnd = random.Random(5)
    rows = [(u, " ".join(rnd.choice([f"{'abc'[u % 3]}{rnd.randrange(30)}", f"z{rnd.randrange(12)}"]) for _ in range(rnd.randrange(5, 190)))) for u in range(90)]
    rows += [(3, "a1 a2 new"), (3, "a1 " * 100), (None, "a1 a2"), (None, "b1 z1"), (200, ""), (201, None), (202, "rare1 rare2"), (203, "z1")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_tables_of_words_equal_those_of_counts(spark):
    from corpuslab.functions import text as T
    from corpuslab.operators import tokens as K

    docs = odd_texts(spark)
    counts = K.frequent(K.dfm(K.tokens(docs)), min_docs=5, max_share=0.5)
    for most in (20_000, 25):
        words = chd.Words(chd.unit_words(docs, T.words_lower("text")))
        table = words.table(5, 0.5, most)
        words.drop()
        held = {r.unit: [int.from_bytes(r.ts[k : k + 2], "little") for k in range(0, len(r.ts), 2)] for r in table.rows.collect()}
        want, names = chd.unit_rows(counts, "doc_id", most)
        assert names == table.names and held == {r.unit: list(r.ts) for r in want.collect()}
        got, tree = table.classify(3, refine=1)
        plain, same = chd.classify(counts, 3, refine=1, most_terms=most)
        assert tree == same and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_groups_of_segments_are_cut_where_the_text_stands(spark):
    from corpuslab.functions import text as T
    from corpuslab.operators import tokens as K

    docs = odd_texts(spark)
    got = {r.unit: set(r.w) for r in chd.group_words(docs, T.words_lower("text"), 10, 20).collect()}
    segs = chd.size_merged(K.segments_fixed(docs, 10), F.col("n_words"), 20)
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("group").cast("string")).alias("unit")
    want = {r.unit: set(r.w) for r in segs.groupBy(name).agg(F.collect_list("segment").alias("s")).select("unit", F.array_distinct(F.split(F.array_join("s", " "), " ")).alias("w")).collect()}
    once = {u for u in want if u.split("_")[0] not in ("3", "0", "1")}
    assert got.keys() == want.keys() and all(got[u] == want[u] for u in once) and len(once) > 100


@pytest.mark.parametrize("cells", [1 << 22, 50])
def test_cuts_by_ranges_equal_each_other(spark, monkeypatch, cells):
    counts, rows = table(spark)
    units, names = chd.unit_rows(counts, "doc_id", 20_000)
    monkeypatch.setattr(chd, "RANGE_CELLS", cells)
    scored = chd.first_axis(units, names)
    left = {r.unit for r in chd.sweep(scored, len(names)).collect() if r.side == 1}
    order = [r.unit for r in scored.orderBy("score", "unit").collect()]
    assert abs(chi2_by_hand(rows, left) - max(chi2_by_hand(rows, set(order[: k + 1])) for k in range(len(order) - 1))) < 1e-6


def test_a_classification_leaves_no_tables_of_its_cuts(spark):
    from pathlib import Path

    from corpuslab.functions import text as T
    from corpuslab.operators.shared import shared_dir

    def held():
        return sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*.parquet"))

    rnd = random.Random(6)
    docs = spark.createDataFrame([(u, " ".join(f"{'abcd'[u % 4]}{rnd.randrange(60)}" if rnd.random() < 0.8 else f"z{rnd.randrange(20)}" for _ in range(120))) for u in range(600)], "doc_id long, text string")
    before = held()
    words = chd.Words(chd.unit_words(docs, T.words_lower("text")))
    found = words.table(10, 0.9)
    words.drop()
    table_size = sum(f.stat().st_size for x in found.rows.inputFiles() for f in [Path(x.replace("file://", ""))])
    found.classify(4, refine=1)
    assert held() - before < 2 * table_size + 20_000
