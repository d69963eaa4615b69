"""The pipeline against a plain version of its stages on a small table."""

import random
import re
from collections import Counter

import public_tokenizers

import corpus_pipeline
from tests.llm import test_bpe, test_minhash


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {p for k in range(len(words) - 7) if wins[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words) >= 20 and 100 * len(hit) <= 30 * len(words) and 10 * symbols <= len(words) and not (again >= 3 and 100 * again > 30 * len(lines))


def small_documents():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 7)))
    docs = []
    for k in range(160):
        text = " ".join(word() for _ in range(rnd.randint(5, 150)))
        if k % 9 == 0:
            text += " mail a.b@c.org or +1 (076) 555-8046 "
        if k % 11 == 0:
            text = " ".join(w + "###" for w in text.split())
        if k % 13 == 0 and docs:
            text = docs[rnd.randrange(len(docs))][1]
        docs.append((k, text, "en", f"src{rnd.randrange(3)}" if k % 17 else None, len(text or "")))
    return docs + [(900, None, None, "src0", None), (901, "", "fr", None, 0), docs[5], (902, "x" * 40_000 + " y z " * 30, "en", "src1", 40_150)]


def test_stages(spark, tmp_path):
    docs = small_documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path)).cache()
        at.append(rows.collect())
    kept, single, masked, mixed, encoded = at
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((d[0], d[1]) for d in docs if plain_quality(d[1]))
    want = test_minhash.by_hand([(r.doc_id, r.text) for r in kept], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted({w[1] for w in want if w[4]})
    assert {r.doc_id for r in masked} == {r.doc_id for r in single}
    assert not any("a.b@c.org" in r.text or "555-8046" in r.text for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    assert any("<EMAIL> or <PHONE>" in r.text for r in masked)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in masked}
    size = {r.doc_id: len(r.text.split()) for r in masked}
    whole, taken = sum(size.values()), sum(size[r.doc_id] for r in mixed)
    assert abs(taken - 1.5 * whole) < 0.02 * whole
    enc = test_bpe.reference()
    texts = {r.doc_id: r.text for r in mixed}
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == Counter((r.doc_id, tuple(enc.encode_ordinary(texts[r.doc_id]))) for r in mixed)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(encoded)
    assert public_tokenizers.PATTERN


def test_odd_tables_pass_each_stage(spark, tmp_path):
    """Nulls, repeated rows, ties, clashing column names and an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars int, kept string, n_words string, size string, target string, doc string, host string"
    good = " ".join(f"word{k}" for k in range(60))
    mine = ("k", "n", "s", "t", "d", "h")
    rows = [(1, good, "en", "a", 1, *mine), (1, good, "en", "a", 1, *mine), (None, good + " more", None, None, None, *mine), (None, None, None, None, None, *mine), (2, "", "en", "a", 0, *mine)]
    rows += [(k, " ".join(f"w{k}x{j}" for j in range(40)) + " a@b.org", "en", "a", 9, *mine) for k in range(3, 9)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "token ids":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
                assert all((r.kept, r.n_words, r["size"], r.target, r.doc, r.host) == mine for r in out.collect())
            got = out.collect()
            assert bool(got) == bool(table)
            if name == "near-dedup" and table:
                assert sum((r.text or "").startswith("word0") for r in got) == 1
        again = stage(spark, docs, str(tmp_path))
        assert len(again.collect()) == len(table)
