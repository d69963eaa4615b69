"""Operators without a twin, and the reference cases, on tiny frames."""

import math
import random
import time

import numpy as np
import pytest

from corpuslab.functions import pvalues as P
from corpuslab.operators import connectors as C
from corpuslab.operators import dedup as D
from corpuslab.operators import factor as X
from corpuslab.operators import graph as G
from corpuslab.operators import outliers as O
from corpuslab.operators import timeline as TL
from corpuslab.operators import policy as Q
from corpuslab.operators import stats as S
from corpuslab.operators import tokens as K
from corpuslab.sources import readers as R


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def pieces(spark, text, keys, punctuation=False):
    rows = C.segments(docs(spark, text), {k: "L" for k in keys}, punctuation).orderBy("k").collect()
    return [r.segment.strip(" .") for r in rows]


def test_segments_between_connectors(spark):
    assert pieces(spark, "Une phrase, sans rien. Une autre, encore.", ["mais"], True) == ["Une phrase, sans rien. Une autre, encore"]
    assert pieces(spark, "Il avance mais il hésite. Pourtant il continue", ["mais", "pourtant"], True) == ["Il avance", "il hésite", "il continue"]
    assert pieces(spark, "Bonjour. Ensuite si tu veux. Merci.", ["si"], True) == ["Ensuite", "tu veux"]
    assert pieces(spark, "un\ndeux\r\ntrois", ["\n", "\r\n"]) == ["un", "deux", "trois"]
    lengths = C.segments(docs(spark, "Il avance, mais il hésite encore !"), {"mais": "L"}).orderBy("k").collect()
    assert [r.n_words for r in lengths] == [2, 3]
    heading = C.segments(docs(spark, "**** *model_a *prompt_1 []\nTexte mais suite"), {"mais": "L"}).collect()
    assert all("****" not in r.segment for r in heading)


def test_matrix_drops_empty_rows(spark):
    rows = C.matrix(docs(spark, "", "Le connecteur apparait"), {"connecteur": "L"}).collect()
    assert [(r.doc_id, r.n) for r in rows] == [(1, 1)]


def test_subcorpus_keeps_header_and_sentences(spark):
    from pyspark.sql import functions as F

    rows = C.subcorpus(docs(spark, "Rien ici. Mais oui. Fin.", "Rien."), {"mais": "L"}, F.lit("**** *a_1")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["**** *a_1\nMais oui.", "**** *a_1"]


def test_rules_stay_inside_segments(spark):
    segs = K.pieces(docs(spark, "Bonjour. Salut!", "Si tu viens alors nous partirons."), r"(?<=[.!?;:\n])\s+")
    assert [(r.label, r.n) for r in C.rule_counts(segs, [("A", "bonjour.+salut"), ("B", "si.+alors")]).collect()] == [("B", 1)]


def test_trigrams(spark):
    df = spark.createDataFrame([("A", "alpha beta gamma alpha beta gamma"), ("B", "alpha beta delta")], "groupe string, text string")
    first = K.top_ngrams(df, 3, 3, "groupe", 2).orderBy("rank").first()
    assert (first.ngram, first.freq, first.modality) == ("alpha beta gamma", 2, "A")


def test_starred_corpora(spark):
    lines = [(0, "before"), (1, "**** *groupe_alpha *periode_01"), (2, "Un texte."), (3, "Suite."), (4, "**** *groupe_beta"), (5, "Deux.")]
    df = spark.createDataFrame([("f", *x) for x in lines], "file string, pos int, line string")
    rows = R.starred(df).orderBy("record").collect()
    assert [(r.texte, r.vars) for r in rows] == [("Un texte.\nSuite.", {"groupe": "alpha", "periode": "01"}), ("Deux.", {"groupe": "beta"})]
    none = R.starred(df.filter("pos in (0, 2)"), "r").orderBy("record").collect()
    assert [r.texte for r in none] == ["before", "Un texte."]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "c.json").write_text('{" si": "CONDITION", "\\n": "LINE", "\\r\\n": "LINE", "": "X"}')
    assert set(R.read_connectors(spark, str(tmp_path / "c.json"))) == {"si", "\n"} or set(R.read_connectors(spark, str(tmp_path / "c.json"))) == {" si".strip(), "\n"}
    with pytest.raises(ValueError):
        R.checked_connectors({1: "x"})
    (tmp_path / "r.json").write_text('{"name": "n", "patterns": [{"label": "A", "regex": "x+", "category": "c", "interpretation": "i"}]}')
    assert R.read_rules(spark, str(tmp_path / "r.json")) == [("A", "x+")]
    (tmp_path / "t.txt").write_bytes("déjà\nvu".encode("latin-1"))
    assert [r.text for r in R.read_texts(spark, str(tmp_path / "t.txt")).collect()] == ["déjà\nvu"]


def test_tail_probabilities():
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert P.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert P.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert P.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert P.f_sf(4.102821015130, 2, 10) == pytest.approx(0.05, abs=1e-7)
    assert P.binom_sf(8, 10, 0.5) == pytest.approx(56 / 1024)
    assert P.wilcoxon_p(0, 5, 0) == pytest.approx(2 / 32)
    assert P.ks_p(1.0, 3, 3) == pytest.approx(0.1)
    assert P.norm_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_p_value_columns(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", float(x) + 5) for x in range(10)], "g string, x double")
    r = S.anova(df, "g", "x").first()
    t = S.ttests(df, "g", "x", pooled=True).first()
    assert r.f == pytest.approx(t.t**2) and r.p == pytest.approx(t.p)
    assert S.ks_pairs(df, "g", "x").first().d == pytest.approx(0.5)


def test_maximum_tree_is_the_heaviest(spark):
    rnd = random.Random(1)
    names = [f"v{k:02d}" for k in range(14)]
    edges = [(a, b, float(rnd.randint(1, 9))) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.5]
    tree = G.maximum_tree(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = 0.0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want += w
    assert sum(r.weight for r in tree) == want and len(tree) == len({find(n) for n in names}) * -1 + len(names)


def test_inertia_of_correspondence_analysis(spark):
    rows = [(r, c, n) for r, line in {"x": [10, 2, 3], "y": [4, 9, 1], "z": [2, 2, 12]}.items() for c, n in zip("abc", line, strict=True)]
    counts = spark.createDataFrame(rows, "row string, column string, n long")
    coordinates, _, values = X.correspondence(counts, "row", "column", 3)
    assert sum(values) == pytest.approx(S.chi2(counts, "row", "column", with_p=False).first().chi2 / 45)
    assert coordinates.count() == 3


def test_outliers(spark):
    rnd = np.random.default_rng(0)
    points = [(k, [float(v) for v in rnd.normal(size=3)]) for k in range(120)] + [(999, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(points, "k long, x array<double>")
    assert O.local_outlier_factor(df, "k", "x", 8).orderBy("lof", ascending=False).first().k == 999
    assert O.isolation_forest(df, "k", "x", 30, 64).orderBy("score", ascending=False).first().k == 999
    near = {(r.k, r.other) for r in O.neighbours(df, "k", "x", 3).collect()}
    x = dict(points)
    for k in (0, 57, 999):
        want = sorted((math.dist(x[k], x[o]), o) for o in x if o != k)[:3]
        assert {o for _, o in want} == {o for a, o in near if a == k}


def test_policy_cuts_at_the_strongest_mark():
    text = "un deux trois, quatre cinq. six sept huit neuf dix"
    assert Q.cut_by_policy(text, 6) == ["un deux trois, quatre cinq.", "six sept huit neuf dix"]
    assert "".join(Q.cut_by_policy("a " * 50, 7)).count("a") == 50


def test_repeated_page_edges(spark):
    pages = spark.createDataFrame([("d", k, f"Journal\nPage\ntexte {k}\nfin\n{k}") for k in range(4)], "doc string, page int, text string")
    lines = D.page_lines(pages, "doc", "page")
    body = D.without_page_numbers(D.without_edges(lines, D.repeated_edges(lines, "doc", "page", 2), "doc", "page"), "doc", "page").collect()
    assert sorted(r.line for r in body) == sorted([f"texte {k}" for k in range(4)] + ["fin"] * 4)


def test_streams_equal_their_batch_twins(spark):
    from pyspark.sql import functions as F

    from corpuslab.plans import registry

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["stream_sessions"](spark, sf)
    whole = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = whole.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    # the watermark holds back only what the last rows might still change
    late = whole.agg(F.max("ts")).first()[0]
    closed = {tuple(r) for r in want.collect() if (late - r["end"]).total_seconds() > 600}
    assert closed <= {tuple(r) for r in got.collect()} <= {tuple(r) for r in want.collect()}


def test_streams_close_their_last_windows(spark):
    from pyspark.sql import functions as F

    from corpuslab.plans import registry
    from corpuslab.streaming import twins

    sf = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, want in (("stream_sessions", twins.sessions(whole, "ts", "user_id")), ("stream_second_bins", twins.second_bins(whole, "ts", "value", "1 hour"))):
        assert sorted(map(tuple, registry.QUERIES[name](spark, sf).collect())) == sorted(map(tuple, want.collect()))


def test_words_around_a_time(spark):
    words = [(k, 0.4 * i, 0.4 * i + 0.4, f"w{i}") for k in ("a", "b") for i in range(30)] + [("c", 5.0, None, " one "), ("c", 5.0, 5.0, "two"), ("d", None, 1.0, "lost")]
    points = [("a", 6.1, "x"), ("a", 0.0, "x"), ("a", 0.4, "tie"), ("b", 99.0, "far"), ("c", 5.3, "x"), ("c", None, "x"), ("d", 0.5, "x"), ("e", 1.0, "x"), (None, 1.0, "x"), ("a", 6.1, "x")]
    got = TL.word_contexts(spark.createDataFrame(points, "k string, t double, context string"), spark.createDataFrame(words, "k string, t0 double, t1 double, word string"), "k", "t", 0.6, 2, 3).collect()
    rows = sorted([(r.k, r.t, r.word_n, r.context) for r in got], key=repr)
    want = [
        ("a", 6.1, 16, "… w13 w14 w15 w16 w17 w18 …"), ("a", 6.1, 16, "… w13 w14 w15 w16 w17 w18 …"), ("a", 0.0, 1, "w0 w1 w2 w3 …"), ("a", 0.4, 1, "w0 w1 w2 w3 …"),
        ("b", 99.0, None, None), ("c", 5.3, 2, "one two"), ("c", None, None, None), ("d", 0.5, None, None), ("e", 1.0, None, None), (None, 1.0, None, None),
    ]
    assert [r for r in rows if r[0] != "c"] == sorted([w for w in want if w[0] != "c"], key=repr)
    assert {r[3] for r in rows if r[0] == "c"} == {"one two", None} and [r.delta for r in got if r.k == "b"] == [None]


def test_stream_of_several_batches_loses_no_row(spark, tmp_path):
    """Events that come in files of rising time, one batch each: no row is late, and the last windows are closed too."""
    from corpuslab.plans import q_io
    from corpuslab.streaming import twins

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    cuts = [None, *[r[0] for r in events.selectExpr("ntile(4) over (order by ts) as k", "ts").groupBy("k").agg({"ts": "max"}).orderBy("k").select("max(ts)").collect()[:3]], None]
    for a, b in zip(cuts[:-1], cuts[1:]):  # one file after the other, as the source takes files by their age
        part = events.filter((events["ts"] > a) if a else "true").filter((events["ts"] <= b) if b else "true")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    got = q_io.streamed(spark, str(tmp_path), lambda s: twins.second_bins(s, "ts", "value", "1 second"), "batches", windows=True, files=1)
    assert got.agg({"n": "sum"}).first()[0] == rows.count()
    want = twins.second_bins(rows.withColumn("ts", rows["ts"].cast("timestamp")), "ts", "value", "1 second")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_class_terms_have_their_probabilities(spark):
    import math

    from corpuslab.plans import registry

    rows = registry.QUERIES["st_class_terms"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.p < 0.001 for r in rows) and any(r.p > 0.3 for r in rows)
    assert all(abs(r.p - math.erfc(math.sqrt(abs(r.chi2) / 2))) < 1e-4 for r in rows)
    assert "as p from" in registry.ORACLES["st_class_terms"]


@pytest.fixture(scope="module")
def class_texts(tmp_path_factory):
    """Documents in three classes and in none: each has eight terms of its own and shares others; one text of a class holds none of its terms, ids repeat."""
    import duckdb

    folder = tmp_path_factory.mktemp("classes")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    rows = [(k, " ".join(f"{c}{(k + j * j) % 8} shared{j % 3}" for j in range(25)), c) for c in "abc" for k in range(8)]
    rows += [(1, "a7 once", "a"), (100, "shared0 shared1", "b"), (101, "a1 b1 c1", None), (102, "", "a"), (103, None, "a")]
    con.executemany("insert into documents values (?, ?, ?, 's')", rows)
    con.execute(f"copy documents to '{folder}/documents.parquet' (format parquet)")
    return str(folder), con


def test_all_characteristic_terms_of_a_class_meet_its_segments(spark, class_texts):
    from corpuslab.plans import registry

    folder, con = class_texts
    rows = registry.QUERIES["jn_word_segment"](spark, folder).collect()
    sql = registry.ORACLES["jn_word_segment"]
    assert sorted((r["class"], r.term, r.segments, round(r.chi2, 3)) for r in rows) == sorted((a, b, n, round(x, 3)) for a, b, n, x in con.execute(f"select class, term, segments, chi2 from ({sql})").fetchall())
    assert min(sum(r["class"] == c for r in rows) for c in "abc") > 5


@pytest.mark.parametrize("told", [200, 2])
def test_segments_with_any_characteristic_term_are_in_the_concordance(spark, class_texts, told):
    from corpuslab.plans import q_assoc, registry

    folder, con = class_texts
    got = {r["class"]: r.segments for r in q_assoc.cl_concordance(spark, folder, told).collect()}
    assert got == dict(con.execute(f"select class, segments from ({registry.ORACLES['cl_concordance']})").fetchall())
    five = con.execute(f"with {q_assoc.VIEW} select cls, list(term) from v where rank <= 5 group by cls").fetchall()
    capped = {c: sum(bool(set(words[i : i + 40]) & set(terms)) for lang, text in con.execute("select lang, text from documents where text is not null").fetchall() if lang == c for words in [text.split()] for i in range(0, len(words), 40)) for c, terms in five}
    assert any(got[c] > n for c, n in capped.items())
