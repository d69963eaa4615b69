"""The trie of rebuilt conversations against dictionaries of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpuslab.llm import tries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        children = sum(len(q) == len(path) + 1 for q in below)
        leaves = sum(not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        told = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, told))
    return sorted(out, key=repr)


def table(seed, convs=60, turns=9):
    rnd = random.Random(seed)
    rows = []
    texts = ["", None, "é", "yes", "no", "a longer text"]
    for c in range(convs):
        if c % 7 == 3:
            continue
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, t if rnd.random() > 0.05 else None, rnd.choice(["user", "assistant", None]) if t > 2 else "user", rnd.choice(texts) if t else "first", 1, "x"))
    same = [(t, "user", f"copy {t}") for t in range(12)]
    rows += [(100 + 5 * k, *t, 1, "x") for k in range(25) for t in same]  # copies
    rows += [(400, t, "user", f"long {t % 13}", 1, "x") for t in range(70)] + [(401, t, "user", f"long {t % 13}", 1, "x") for t in range(64)]
    rows += [(500, 1, "user", "twice", 1, "x")] * 2 + [(None, 0, "user", "nobody", 1, "x")]
    return rows


KIND = "conv_id long, turn long, role string, text string, depth int, n_convs string"


@pytest.mark.parametrize("seed, band, shard", [(1, 256, 250_000), (2, 16, 40), (3, 16, 1), (4, 64, 200)])
def test_nodes_equal_plain_ones(spark, seed, band, shard):
    rows = table(seed)
    got = tries.rebuilt_trie(spark.createDataFrame(rows, KIND).repartition(5), band, shard, 20).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie([r[:4] for r in rows])


def test_no_conversations(spark):
    assert tries.rebuilt_trie(spark.createDataFrame([], KIND)).collect() == []
    assert tries.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], KIND)).collect() == []


def test_conversation_without_turns(spark):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 400) if c % 5}
    c = next(c for c, x in h.items() if x == 8)
    rows = [(c, 0, "user", "only", 1, "x"), (1000, 0, "user", "a", 1, "x")]
    got = tries.rebuilt_trie(spark.createDataFrame(rows, KIND)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie([r[:4] for r in rows])
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 2 and root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_double_array_walks_every_sequence():
    rnd = random.Random(3)
    seqs = sorted({tuple(rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 8))) for _ in range(500)} | {tuple([k]) for k in range(1, 200)})
    flat = np.array([x for s in seqs for x in s])
    lengths = np.array([len(s) for s in seqs])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    trie = tries.DoubleArray(flat, starts, lengths)
    nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert len(trie.order) == len(nodes) == (trie.check[: trie.size] != -1).sum()
    seen = {}
    for s in seqs:
        state = np.zeros(1, np.int64)
        for d, a in enumerate(s, 1):
            state = trie.step(state, np.array([a]))
            assert seen.setdefault(int(state[0]), s[:d]) == s[:d]
    assert len(seen) == len(nodes) - 1
