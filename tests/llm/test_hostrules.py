"""Measures against plain counts, host verdicts by hand, and odd rows."""

import random
import re
from collections import Counter

from corpuslab.llm import hostrules


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {p for k in range(len(words) - 7) if wins[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def texts():
    rnd = random.Random(3)
    parts = ["a", "bb", "é\x0bé", "#x", " ", "\n", "\t", "same line\n", "\x1c", "<>&", "\r\n"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(120)]
    return out + [None, "", " \n\t", "w " * 5000, "a b c d e f g h " * 2, "x" * 200_000]


def test_measures(spark):
    rows = [(k, t, "h") for k, t in enumerate(texts())] + [(None, "a b", None), (None, "a b", None)]
    got = hostrules.measured(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    want = Counter((i, *by_hand(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got) == want


def test_verdicts_of_hosts(spark):
    rows = [(h, k < bad, False) for h, n, bad in (("bad", 40, 38), ("good", 4000, 0), ("mixed", 100, 20), (None, 10, 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "source string, base_failed boolean, soft_failed boolean")
    got = {r.host: r for r in hostrules.host_verdicts(df).collect()}
    hosts = {"bad": (40, 38), "good": (4000, 0), "mixed": (100, 20), None: (10, 3)}
    n, k = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    mu = k / n
    s2 = sum(a * (b / a - mu) ** 2 for a, b in hosts.values()) / n
    rho = (s2 - mu * (1 - mu) * len(hosts) / n) / (mu * (1 - mu))
    strength = 1 / max(0.001, min(0.5, rho)) - 1
    for h, (a, b) in hosts.items():
        assert abs(got[h].host_rate - (b + mu * strength) / (a + strength)) < 1e-9
    assert {h: r.host_verdict for h, r in got.items()} == {"bad": "reject", "good": "trust", "mixed": "judge", None: "judge"}


def test_odd_tables(spark):
    kind = "doc_id long, text string, source string, kept string, n_words string"
    none = spark.createDataFrame([], kind)
    rows = hostrules.measured(none)
    assert hostrules.judged(rows, hostrules.host_verdicts(rows)).collect() == []
    one = hostrules.measured(spark.createDataFrame([(1, None, None, "k", "n")], kind))
    out = hostrules.judged(one, hostrules.host_verdicts(one)).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in out] == [(0, True, False)]
