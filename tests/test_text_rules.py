"""Rules of texts held against examples worked out by hand and plain Python versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import connectors as C
from corpuslab.operators import counts as N
from corpuslab.operators import lexicon as L
from corpuslab.operators import ranges as R
from corpuslab.operators import stats as S
from corpuslab.operators import tokens as K


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize("word, n", [("journée", 1), ("petites", 3), ("qu'il", 1), ("12", 0), ("le", 1), ("été", 2), ("école", 2), ("_", 0), ("l'homme", 1), ("brrr", 1), ("œuvre", 1)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.col("text")), word) == n


def test_readability_of_texts_without_words(spark):
    df = spark.createDataFrame([("a", "..."), ("b", "Le chat dort. Il rêve !"), ("c", None)], "g string, text string")
    got = {r.g: r for r in N.readability(df, ["g"]).collect()}
    assert (got["a"].sentences, got["a"].ease, got["a"].grade) == (0, 0.0, 0.0)
    b = got["b"]
    assert (b.sentences, b.words, b.syllables) == (2, 5, 5)
    assert abs(b.ease - (206.835 - 1.015 * 2.5 - 84.6)) < 1e-6


def span(label, shown):
    return f'<span class="connector-annotation connector-{label.lower()}"><span class="connector-label">{label}</span><span class="connector-text">{shown}</span></span>'


def test_annotation_is_one_pass(spark):
    labels = {"and then": "AND", "and": "X", "class": "Y"}
    assert one(spark, T.annotate_html("text", labels), "a <b> And then and \"class\"") == f"a &lt;b&gt; {span('AND', 'And then')} {span('X', 'and')} &quot;{span('Y', 'class')}&quot;"
    assert one(spark, T.annotate_html("text", {"x": "A"}), None) == "" and one(spark, T.annotate_html("text", {}), "a'b") == "a&#x27;b"
    got = one(spark, T.annotate_html("text", {"\n": "FIN", "et": "AND"}), "**** *a_1 et\nx et\r\ny")
    assert got == f"**** *a_1 {span('AND', 'et')}<br />x {span('AND', 'et')}{span('FIN', '↵')}<br />y"


def test_line_ends_after_headers_are_no_connectors(spark):
    df = spark.createDataFrame([("**** *a_1\nx\r\ny et\n",), ("et",)], "text string")
    labels = {"\n": "FIN", "et": "AND"}
    assert {(r.connector, r.n) for r in C.connector_counts(df, labels).collect()} == {("\n", 2), ("et", 2)}
    assert {(r.label, r.n) for r in C.label_counts(df, labels).collect()} == {("FIN", 2), ("AND", 2)}


def plain_segments(text, keys, punctuation):
    word = "|".join(rf"\b{re.escape(k)}\b" for k in sorted(keys, key=len, reverse=True))
    text = re.sub(r"(?m)^[ \t]*\*{4}.*$\n?", "", text)
    if not re.search(word, text, re.I):
        return [(text.strip(" "), None, None)] if re.findall(r"\w+", text) else []
    out, before, last = [], None, 0
    marks = [*re.finditer(f"{word}|[.!?;:]+" if punctuation else word, text, re.I), None]
    for m in marks:
        piece, after = text[last : m.start() if m else len(text)], m.group() if m else None
        known = lambda x: x if x is not None and re.fullmatch(word, x, re.I) else None
        if re.findall(r"\w+", piece) and (known(before) or known(after)):
            out.append((piece.strip(" "), known(before), known(after)))
        before, last = after, m.end() if m else last
    return out


def test_segments_with_any_characters(spark):
    rnd = random.Random(6)
    parts = ["et", "Ou", " ", "\n", "rouge", "\x01", "\x02", "p", ".", "; ", "bleu vert", "été", "**** *x et\n", "ouest", "\x01pbleu"]
    texts = ["red\x01pblue et green", "", "et", "et et", "a et"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for punctuation in (False, True):
        got = {}
        for r in C.segments(df, {"et": "A", "ou": "B"}, punctuation).orderBy("doc_id", "k").collect():
            got.setdefault(r.doc_id, []).append((r.segment, r.before, r.after))
        for k, t in enumerate(texts):
            assert got.get(k, []) == plain_segments(t, ["et", "ou"], punctuation), repr(t)


def test_contexts_stand_between_borders_of_words(spark):
    docs = spark.createDataFrame([("go to the organ now. See the, or - else.",), ("Nothing here.",), ("the cat. or dog " + "x" * 300,), (None,)], "text string")
    grams = spark.createDataFrame([(2, "the or")], "n int, ngram string")
    assert {r.context for r in K.contexts(docs, grams).collect()} == {"See the, or - else."}
    bridged = spark.createDataFrame([(2, "cat dog")], "n int, ngram string")
    assert {r.context for r in K.contexts(docs, bridged, stop=["or"], header=F.lit("H")).collect()} == {("H – " + ("the cat. or dog " + "x" * 300)[:240])[:240].rstrip() + "…"}
    assert K.contexts(docs, grams.limit(0)).collect() == []


def test_top_ngrams_equal_plain_counts(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("xy"), " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30)))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for stop in ([], ["a"]):
        counts = {}
        for _, text in rows:
            w = [x for x in text.split() if x not in stop]
            for n in (2, 3):
                for k in range(len(w) - n + 1):
                    key = n, " ".join(w[k : k + n])
                    counts[key] = counts.get(key, 0) + 1
        want = {(n, g, c, k) for n in (2, 3) for k, (c, g) in enumerate(sorted((-c, g) for (m, g), c in counts.items() if m == n and c >= 2)[:5], 1)}
        assert {(r.n, r.ngram, -r.freq, r["rank"]) for r in K.top_ngrams(docs, 2, 3, "lang", 5, 2, stop).collect()} == want


def test_expressions_by_both_ways(spark):
    entries = {"Pomme de terre": "pomme_de_terre", "de terre": "DE_TERRE", "l’œuf": "l_oeuf", "c'est à dire": "càd", "a+b": "$x\\1", "": "no", "ete": "été_x"}
    texts = ["POMME  de terre, pômmé de terré!", "l`œuf et l´oeuf", "c’est à dire; c'est a dire", "a+b aa+b", "été ete étés", None, ""]
    df = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "k long, text string, replaced_by string")
    few = sorted((r.k, r.replaced, r.text) for r in L.apply_expressions(df, entries).collect())
    many = sorted((r.k, r.replaced, r.text) for r in L.apply_expressions(df, entries, most_folded=0).collect())
    assert few == many
    assert [x[1:] for x in few] == [(2, "POMME  de_terre, pomme_de_terre!"), (2, "l_oeuf et l_oeuf"), (1, "càd; c'est a dire"), (1, "$x\\1 aa+b"), (2, "été_x été_x étés"), (None, None), (0, "")]


def test_ordered_work_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    rnd = random.Random(2)
    rows = [(g, k, rnd.choice([None, 1.0, 2.0, 3.0, 7.0])) for g in ("a", None, "b") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    by = {g: [v for h, _, v in rows if h == g] for g in ("a", None, "b")}
    for r in R.running(df, ["g"], ["k"], {"s": F.coalesce("v", F.lit(0.0))}).collect():
        assert abs(r.s - sum(v or 0 for v in by[r.g][: r.k + 1])) < 1e-9
    for r in R.last_known(df, ["g"], ["k"], F.col("v"), "known").collect():
        assert r.known == next((v for v in reversed(by[r.g][: r.k + 1]) if v is not None), None)
    for r in R.with_neighbours(df, ["g"], ["k"], 3, 2, {"n": lambda w: F.sum("v").over(w.rowsBetween(-3, 2))}).collect():
        near = [v for v in by[r.g][max(0, r.k - 3) : r.k + 3] if v is not None]
        assert r.n == (sum(near) if near else None)
    for share in (0.0, 0.3, 0.5, 1.0):
        for r in R.quantiles(df, ["g"], "v", share, "q").collect():
            known = sorted(v for v in by[r.g] if v is not None)
            at = (len(known) - 1) * share
            assert abs(r.q - (known[math.floor(at)] + (known[math.ceil(at)] - known[math.floor(at)]) * (at - math.floor(at)))) < 1e-9


def test_permutations_and_corrections(spark):
    rnd = random.Random(3)
    rows = [(k, "ab"[k % 2], rnd.gauss(0.8 * (k % 2), 1)) for k in range(120)]
    got = S.ks_permutation(spark.createDataFrame(rows, "doc_id long, g string, v double"), "g", "v", 200).first()
    assert got.n == 200 and got.p < 0.1
    same = S.ks_permutation(spark.createDataFrame([(k, g, float(k % 7)) for k, g, _ in rows], "doc_id long, g string, v double"), "g", "v", 200, buckets=4).first()
    assert same.p > 0.2
    ps = [0.01, 0.04, 0.03, 0.005, 0.8]
    out = {r.k: r for r in S.corrected(spark.createDataFrame(list(enumerate(ps)), "k long, p double")).collect()}
    order = sorted(range(5), key=lambda k: ps[k])
    for at, k in enumerate(order):
        assert abs(out[k].holm - max(min(1, ps[j] * (5 - i)) for i, j in enumerate(order[: at + 1]))) < 1e-12
        assert abs(out[k].bh - min(min(1, ps[j] * 5 / (i + 1)) for i, j in list(enumerate(order))[at:])) < 1e-12
        assert abs(out[k].bonferroni - min(1, 5 * ps[k])) < 1e-12


def test_permutations_equal_all_relabellings(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 2.0), ("b", 6.0), ("b", 7.0), ("b", 7.0), ("b", 9.0), ("a", None), ("b", float("nan"))]
    values = [v for _, v in rows[:9]]

    def gap(first):
        return max(abs(sum(values[i] <= x for i in first) / len(first) - sum(values[i] <= x for i in range(9) if i not in first) / (9 - len(first))) for x in values)

    d = gap((0, 1, 2, 3))
    every = [gap(c) for c in itertools.combinations(range(9), 4)]
    want = sum(g >= d - 1e-12 for g in every) / len(every)
    df = spark.createDataFrame(rows, "g string, v double")
    for buckets in (1, 2, 2048):
        got = S.ks_permutation(df, "g", "v", 4000, seed=buckets, buckets=buckets).first()
        assert abs(got.d - d) < 1e-12 and got.n == 4000 and abs(got.p - want) < 4 * math.sqrt(want * (1 - want) / 4000)
    assert S.ks_permutation(df, "g", "v", 50, 1).first() == S.ks_permutation(df.repartition(5), "g", "v", 50, 1).first()
    assert S.ks_permutation(df.limit(0), "g", "v", 50).collect() == []


def test_draws_of_any_size():
    x = S.drawn(np.full(4000, 40), 100, 10, (1, 2))
    assert x.min() >= 0 and x.max() <= 10 and abs(x.mean() - 4) < 0.1
    y = S.drawn(np.full(4000, 4 * 10**9), 10**10, 10**6, (1, 2))
    assert abs(y.mean() - 4e5) < 60 and 400 < y.std() < 580


def test_emoji_query_equals_its_twin_on_odd_texts(spark, tmp_path):
    import duckdb

    from corpuslab.plans import registry

    odd = ["", " ", "plain", " both ends ", "end ", " no-break　", " thin​", "a☀b \U0001f600\U0001f680 c", "\U0001f1eb\U0001f1f7", "line\n", "\tline", "two lines \n ", None]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.value for r in registry.QUERIES["fn_emoji"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.execute(registry.ORACLES["fn_emoji"]).fetchall())
    assert one(spark, T.strip_emoji("text"), " \U0001f600 so ☀ ") == "so"
