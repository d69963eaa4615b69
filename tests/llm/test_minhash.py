import random
import re

from corpuslab.llm import minhash


def by_hand(docs, n, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted((i is None, i or 0, len(sets[k]), -1 if ids.get(find(k)) is None else ids[find(k)], ids.get(find(k)) == i) for k, (i, _) in enumerate(docs))


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    docs = [(0, None), (1, ""), (2, "  \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one\x0btwo"), (None, "solo null id"), (7, "é É"), (8, "é é")]
    k = 10
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 8)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((k, " ".join(copy)))
            k += 1
    docs += [docs[-1], docs[-1], (k, docs[20][1].upper()), (None, docs[20][1])]
    docs.append((k + 1, " ".join(word() for _ in range(30_000))))
    return docs


def test_components_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, node int")
    for n, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(df, shingle_words=n, percent=percent).collect()
        rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept and r.doc_id is not None) for r in got)
        want = by_hand(docs, n, percent)
        assert [r[:3] for r in rows] == [r[:3] for r in want]
        assert [r for r in rows if not r[0]] == [r for r in want if not r[0]]


def test_kept_rows(spark):
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (1, "a b c d e f g h"), (3, None), (4, "")]
    df = spark.createDataFrame([(*d, "src") for d in docs], "doc_id long, text string, source string")
    out = minhash.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_one_of_each_component_without_distinct_ids(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    docs, groups = [], 0
    for ids in ([None] * 5, [7] * 5, [None, 9, None, 9, 9], [8, None, 8, 12, 8]):
        groups += 1
        base = [word() for _ in range(120)]
        for k, i in enumerate(ids):
            copy = list(base)
            copy[20 * k] = word()
            docs.append((i, " ".join(copy), groups))
        docs += [docs[-1], (ids[-1], docs[-1][1].upper(), groups)]
    df = spark.createDataFrame(docs, "doc_id long, text string, grp int")
    rows = minhash.without_near_duplicates(df).collect()
    assert sorted((r.grp, r.doc_id) for r in rows if r.grp > 1) == [(2, 7), (3, 9), (4, 8)]
    assert [r.doc_id for r in rows if r.grp == 1] == [None]
    marked = {(r.component_id, r.doc_id, r.text_key) for r in minhash.near_duplicates(df).filter("kept").collect()}
    assert len(marked) == groups
