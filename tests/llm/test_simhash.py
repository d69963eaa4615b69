import hashlib
import random
import re
from collections import Counter
from functools import reduce

import xxhash

from corpuslab.llm import simhash


def rows_of(n):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 7)))
    docs = [(k, " ".join(word() for _ in range(rnd.randint(0, 60)))) for k in rnd.sample(range(10**6), n)]
    long = " ".join(word() for _ in range(400))
    docs += [(20 * k, long + f" {k} end") for k in range(50_001, 50_012)]  # near copies, some asked for
    return docs + [(None, "no id"), (5, "same id"), (5, "same id"), (5, "other"), (6, None), (7, ""), (8, " \n "), (9, "x" * 50_000)]


def by_hand(text):
    """The fingerprint as a number: 64-bit hashes of word pairs vote, chained as Spark's hash function chains its arguments."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    chain = lambda *parts: reduce(lambda seed, p: xxhash.xxh64(p, seed=seed).intdigest(), [p.encode() if isinstance(p, str) else p for p in parts if p is not None], 42)
    votes = [0] * 128
    for first, second in zip(words, [*words[1:], None], strict=False):
        term = chain(first, second) << 64 | chain(second, first, (1).to_bytes(4, "little"))
        for b in range(128):
            votes[b] += 1 if term >> b & 1 else -1
    return sum(1 << b for b in range(128) if votes[b] > 0)


def check(spark, docs):
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, fingerprint string")
    got = simhash.edit_report(df).collect()
    assert len(got) == len(docs)
    # the order by id is fixed but among rows of one id
    known = [d for d in docs if [x for x, _ in docs].count(d[0]) == 1]
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    by = {r.doc_id: r for r in got}
    for i, t in known:
        at = next(k for k, d in enumerate(order) if d[0] == i)
        following = order[(at + 1) % len(order)]
        options = [d[1] or "" for d in docs if d[0] == following[0]]
        t = t or ""
        half = len(t) // 2
        assert by[i].n_chars == len(t)
        edits = {hashlib.sha256(e.encode()).hexdigest(): (e, o) for o in options for e in [t[: len(t) - half] + o[:half]]}
        assert by[i].edited_sha256 in edits
        assert by[i].fingerprint == f"{by_hand(t):032x}"
        edited, nexts = edits[by[i].edited_sha256][0], {by_hand(o) for o in options}
        assert by[i].edited_fingerprint == f"{by_hand(edited):032x}"
        assert by[i].near_edited == 1 - (by_hand(t) ^ by_hand(edited)).bit_count() / 128
        assert by[i].near_next in {1 - (by_hand(t) ^ x).bit_count() / 128 for x in nexts}
    prints = {by_hand(t) for _, t in docs}
    for r in got:
        others = sum(0 < (int(r.fingerprint, 16) ^ x).bit_count() <= simhash.RADIUS for x in prints)
        assert r.n_near == (others if r.doc_id is not None and r.doc_id % 20 == 0 else None)
    return got


def test_edited_texts_follow_the_order(spark, monkeypatch):
    docs = rows_of(300)
    whole = check(spark, docs)
    apart = [r for r in whole if r.n_chars > 150 and (r.doc_id or 0) < 10**6]  # near copies, which follow each other, have higher ids
    assert sum(r.near_edited > r.near_next for r in apart) > 0.95 * len(apart)
    monkeypatch.setattr(simhash, "RANGE_ROWS", 25)
    many = check(spark, docs)
    assert Counter((r.doc_id, r.fingerprint) for r in whole) == Counter((r.doc_id, r.fingerprint) for r in many)
    check(spark, [(1, "only one here")])
    assert simhash.edit_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_an_id_with_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 10)
    docs = [(7, f"text {k}") for k in range(80)] + [(None, f"null {k}") for k in range(80)] + [(k, f"t {k}") for k in range(100, 180)]
    pairs = simhash.with_next_text(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    step = {r.text: r.next_text for r in pairs}
    at, seen = docs[0][1], set()
    while at not in seen:
        seen.add(at)
        at = step[at]
    assert len(seen) == len(docs)


def test_links_find_all_within_the_radius(spark, monkeypatch):
    rnd = random.Random(4)
    prints = []
    for _ in range(40):
        base = rnd.getrandbits(128)
        for _ in range(5):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(128)
            prints.append(x)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (2**64 - 1))) for x in prints], "hi long, lo long")
    for radius, blocks, rows in ((3, 6, 1024), (2, 3, 2), (1, 5, 1024)):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
        got = simhash.links(df, radius, blocks).collect()
        want = {frozenset((x, y)) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= radius}
        assert {frozenset((((r.a_hi % 2**64) << 64) | r.a_lo % 2**64, ((r.b_hi % 2**64) << 64) | r.b_lo % 2**64)) for r in got} == want
        assert len(got) == len(want)
