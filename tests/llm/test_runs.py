"""Runs against a comparison of every text with itself at every shift."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpuslab.llm import runs


def plain_runs(words, least=1):
    """(start, length, period) of all longest stretches of three periods or more, by trying every period."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= 3 * p:
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in best.items() if b - a >= least)


def texts_of(seed):
    """Texts with few words, copies of stretches, repeated roots, repeated roots of repeated roots."""
    rnd = random.Random(seed)
    out = []
    for _ in range(60):
        letters = rnd.choice([1, 2, 2, 3, 5, 50])
        t = [rnd.randrange(letters) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 4)):
            kind = rnd.randrange(4)
            if kind == 0 and t:
                root = t[-rnd.randrange(1, len(t) + 1) :]
                t += (root * rnd.randrange(2, 6))[: rnd.randrange(1, 300)]
            elif kind == 1:
                root = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 40))]
                t += (root * 9)[: rnd.randrange(1, 9 * len(root) + 1)]
            elif kind == 2:
                root = [0] * rnd.randrange(1, 70) + [1] * rnd.randrange(0, 3)
                t += (root * 5)[: rnd.randrange(1, 5 * len(root) + 1)]
            else:
                t += [rnd.randrange(letters) for _ in range(rnd.randrange(0, 30))]
        out.append(np.array(t, np.int64))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_plain_runs(seed):
    texts = texts_of(seed)
    got = runs.runs_of(texts)
    for t, g in zip(texts, got, strict=True):
        assert g == plain_runs(t.tolist()), t.tolist()


def test_words_of_fibonacci_and_of_one_letter():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    t = np.array(b, np.int64)
    one = np.zeros(5000, np.int64)
    got = runs.runs_of([t, one, one[:2], one[:0]])
    assert got[0] == plain_runs(b)
    assert got[1] == [(0, 5000, 1)] and got[2] == got[3] == []


def plain_row(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = [r for r in plain_runs(words) if r[1] >= max(24, 3 * r[2])]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    told = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *one, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("batch_words", [1, 700, 250_000])
def test_rows_equal_plain_rows(spark, batch_words):
    rnd = random.Random(5)
    rows = []
    for k in range(160):
        words = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 200))]
        if k % 3 == 0:
            root = [f"é{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 20))]
            words += root * rnd.randrange(1, 9)
        rows.append((k, rnd.choice([" ", "\n", " \t\x0b"]).join(words), k, "x"))
    rows += [(160, None, 1, "x"), (160, None, 1, "x"), (161, "", 1, "x"), (None, "a b " * 30, 1, "x"), (None, None, 1, "x"), (162, "a b " * 40, 1, "x"), (162, "a b " * 40, 1, "x")]
    rows += [(163, " ".join(["long"] + [f"v{i % 1100}" for i in range(3900)]), 1, "x")]  # a long period
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string")
    got = runs.repeated_stretches(df, plant=True, batch_words=batch_words).select(*COLUMNS).collect()
    want = [plain_row(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_runs > 0 for r in got) > 20


def test_empty_table_and_names(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert runs.repeated_stretches(none).collect() == []
    other = spark.createDataFrame([("k", "a " * 30)], "name string, body string")
    row = runs.repeated_stretches(other, "name", "body").first()
    assert row["name"] == "k" and row["runs"] == [0, 30, 1] and row["exponent_milli"] == 30000
