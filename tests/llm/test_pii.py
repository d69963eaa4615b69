import hashlib
import random
import re
import time
from collections import Counter

import numpy as np

from corpuslab.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = [int(c) for c in d[::-1]]
    return sum(odd[::2] + [sum(divmod(2 * x, 10)) for x in odd[1::2]]) % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rnd = random.Random(11)
    parts = ["a.b", "@", "@x.co", "mail1.example.com", ".", "-", " ", "1", "255", "256", "0007", ".", "4111111111111111", "+1 (076) 555-8046", "+", "(", ")", "é", "\n", "12.34.56.78", "5500 0000 0000 0004", "77"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    return out + ["", None, "x" * 500 + "@a.b", "9" * 500, "1" * 300 + ".1.1.1", "a@b.c@d.e@f"]


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    weights = pii.fit(df)
    got = pii.annotate(df, weights).collect()
    assert len(got) == len(rows)
    left = sorted((r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got)
    want = sorted((i is None, i or 0, *[sum(k == x for k, _, _ in by_hand(t)) for x in pii.KINDS]) for i, t in rows)
    assert left == want
    base = lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(by_hand(t), key=lambda x: (list(pii.KINDS).index(x[0]), x[1])))
    sha = lambda t: hashlib.sha256(base(t).encode()).hexdigest()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((i, sha(t)) for i, t in rows)
    by_text = {(i, sha(t)): t for i, t in rows}
    for r in got:  # all base spans are kept, in order, and every span lies in the text
        spans = [x.split(":") for x in r.spans.split(",") if x]
        places = [(list(pii.KINDS).index(k), int(a)) for k, a, _ in spans]
        assert places == sorted(places)
        text = by_text[r.doc_id, r.base_sha256] or ""
        assert all(0 <= int(a) < int(b) <= len(text) for _, a, b in spans)
        assert set(base(text).split(",")) <= {":".join(x) for x in spans} | {""}


def test_candidates_that_touch_others_are_left_out():
    rnd = random.Random(8)
    for _ in range(300):
        cuts = lambda n: [(0, a, a + rnd.randint(0, 9)) for a in (rnd.randrange(60) for _ in range(n))]
        weak, taken = cuts(rnd.randint(0, 12)), [(a, b) for _, a, b in cuts(rnd.randint(0, 6)) if a < b]
        want, held = [], list(taken)
        for kind, a, b in sorted(weak, key=lambda w: (w[1], -w[2])):
            if a < b and not any(x < b and a < y for x, y in held):
                want.append((kind, a, b))
                held.append((a, b))
        assert [(s.kind, s.start, s.end) for s in pii.untouched(weak, taken)] == want


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000 + "@", "9" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "1 " * 100_000 + ":" * 9, "020 123 4567, " * 20_000):
        start = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - start < 20  # a quadratic search takes minutes


def test_em_finds_the_reliable_labelers():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.9, 0.8])
    cast = np.where(rnd.random((4000, 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    p = pii.posteriors(np.zeros(4000, int), cast, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail me: a.b@c.org or +1 (076) 555-8046 now", "s"), (2, None, "s"), (3, "clean", "s")], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in pii.redact(df, pii.fit(df)).collect()}
    assert out == {1: "mail me: <EMAIL> or <PHONE> now", 2: None, 3: "clean"}
    assert pii.annotate(df.limit(0), pii.fit(df.limit(0))).collect() == []
