"""Cases of long keys, long texts and repeated units that smaller tables do not show."""

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import pvalues as P
from corpuslab.functions import text as T
from corpuslab.operators import chd as CHD
from corpuslab.operators import classes as C
from corpuslab.operators import ranges as R
from corpuslab.operators import timeline as L
from corpuslab.operators import tokens as K
from corpuslab.plans import registry


def test_hms_of_long_texts_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, 39_999), (2, 40_001), (3, 123_456)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.QUERIES["fn_hms"](spark, str(tmp_path)).collect()}
    sql = registry.ORACLES["fn_hms"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall())


def test_texts_of_a_second_come_in_order_of_events_numbered_beyond_six_digits(spark, tmp_path):
    rows = [(10_000_001, "a", "2024-01-01 00:00:05"), (9_999_999, "c", "2024-01-01 00:00:05"), (2_000_000, "b", "2024-01-02 00:00:05")]
    spark.createDataFrame(rows, "event_id long, event_type string, t string").withColumn("ts", F.to_timestamp("t")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.QUERIES["src_timestamps"](spark, str(tmp_path)).collect()] == [(5, "b c a")]


def test_binomial_tail_of_many_draws(spark):
    import time

    start = time.time()
    assert all(P.binom_sf(k, 3_000_000, 0.25) >= P.binom_sf(k + 1, 3_000_000, 0.25) for k in range(749_900, 750_100))
    assert time.time() - start < 5
    assert P.binom_sf(750_000, 3_000_000, 0.25) == pytest.approx(0.5, abs=1e-3)
    assert P.binom_sf(2, 10, 0.5) == pytest.approx(1 - 11 / 1024) and P.binom_sf(10, 10, 0.5) == pytest.approx(1 / 1024)


def test_class_terms_from_words_equal_those_from_counts(spark):
    rows = [(1, "a", "x y x"), (1, "a", "x z"), (2, "a", "y"), (2, "b", "y y"), (3, "b", ""), (4, "b", None), (None, "b", "x"), (5, None, "z x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    words = T.words_lower("text")
    plain = C.class_terms(K.dfm(K.tokens(docs, ["doc_id", "lang"]), ["doc_id", "lang"]), "lang", with_p=False)
    got = C.word_class_terms(docs, words, "lang", with_p=False)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.select(got.columns).collect())) and got.count() > 4


def shuffles_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_class_statistics_do_not_deal_out_all_words_of_all_units(spark):
    plan = shuffles_of(registry.QUERIES["st_class_view"](spark, "/root/testdata/sf0.001"))
    assert "doc_id" not in plan


def shuffled_mb(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6


def test_top_ngrams_do_not_deal_out_all_runs(spark):
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(i, "ab"[i % 2] if i % 7 else None, " ".join([vocabulary[(i * j * j + j) % 50] for j in range(300)] + ["the", "same", "five", "words", "here"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    before = shuffled_mb(spark)
    got = K.top_ngrams(docs, 3, 5, "lang", 1).collect()
    assert shuffled_mb(spark) - before < 8
    assert {(r.n, r.freq, r.ngram) for r in got} == {(5, 2000, "the same five words here"), *((r.n, r.freq, r.ngram) for r in got if r.n < 5)} and len(got) == 3


def test_contexts_deal_out_no_text(spark):
    rows = [(i, f"Text {i} has a long tail of words. " + "x" * 500 + f". The cat sat on {i} mats.") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    grams = spark.createDataFrame([(3, "the cat sat"), (4, "cat sat on 7")], "n int, ngram string")
    before = shuffled_mb(spark)
    got = K.contexts(docs, grams).collect()
    assert len(got) == 501 and ("The cat sat on 7 mats.") in {r.context for r in got if r.n == 4}
    assert shuffled_mb(spark) - before < 0.12


def test_a_cut_does_not_deal_out_all_cells(spark):
    rows = [(i, sorted({(i * j * j + j * (i % 3)) % 300 for j in range(60)}), ((i * 7919) % 4001) / 4001) for i in range(4000)]
    units = spark.createDataFrame(rows, "unit long, ts array<int>, score double").repartition(4).cache()
    cells = units.select(F.sum(F.size("ts"))).first()[0]
    before = shuffled_mb(spark)
    sides = CHD.sweep(units, 300)
    assert {r["side"] for r in sides.select("side").distinct().collect()} == {1, 2}
    assert shuffled_mb(spark) - before < cells * 16 / 1e6


def test_no_frame_ends_with_the_last_row(spark):
    """Such a frame is added up anew for each of its rows: time would grow with the square of a range."""
    rows = spark.createDataFrame([(i, float(i * 37 % 101) if i % 3 else None) for i in range(300)], "i long, x double")
    least = R.running_extreme(rows, [], ["i"], F.col("x"), "low", most=False, forward=False)
    known = R.carried(rows, [], ["i"], F.col("x"), lambda v: F.last(v, ignorenulls=True), "next", forward=False)
    near = L.nearest(rows.select(F.lit(1).alias("k"), "i"), rows.select(F.lit(1).alias("k"), "i", "x"), "k", "i", "i", "x", 5.0)
    for df in (least, known, near):
        plan = df._jdf.queryExecution().analyzed().toString().lower().replace(" ", "")
        assert "currentrow$(),unboundedfollowing$()" not in plan and "rowframe,1,unboundedfollowing$()" not in plan
    x = [r.x for r in rows.orderBy("i").collect()]
    assert [r.low for r in least.orderBy("i").collect()] == [min([v for v in x[i:] if v is not None], default=None) for i in range(300)]
    found = known.select("i", F.coalesce("next_own", "next_far").alias("v")).orderBy("i").collect()
    assert [r.v for r in found] == [next((v for v in x[i:] if v is not None), None) for i in range(300)]


def test_texts_do_not_go_along_with_the_seconds(spark):
    rows = [("a", 0.0, 900.0, "long " * 400), ("a", 899.5, 900.2, "b"), ("a", 900.1, 899.0, "a"), ("a", 5.0, 6.0, None), ("b", 3.0, 3.0, None), (None, 1.0, 2.5, "x"), (None, 2.0, 2.0, "")]
    df = spark.createDataFrame(rows, "k string, start double, end double, text string")
    got = L.second_digests(df, ["k"])
    want = L.every_second(df, ["k"])
    texts = {(r.k, r.second): r.texts for r in want.collect()}
    found = {(r.k, r.second): (r.n, r.digest) for r in got.collect()}
    import hashlib

    assert found.keys() == texts.keys() and found["b", 3] == (1, None)
    assert all(d == hashlib.md5(texts[at].encode()).hexdigest() for at, (_, d) in found.items() if at != ("b", 3))
    assert (found["a", 900][0], found["a", 5][0], found[None, 2][0]) == (3, 2, 2)


def test_a_segment_is_split_once_for_all_its_words(spark):
    df = spark.createDataFrame([("a", 0.0, 4.0, " one two\tthree\nfour ")], "k string, start double, end double, text string")
    out = L.timed_words(df.withColumnRenamed("k", "conv"), "conv")
    assert [(r.word, r.t0, r.t1, r.idx) for r in out.orderBy("idx").collect()] == [("one", 0.0, 1.0, 0), ("two", 1.0, 2.0, 1), ("three", 2.0, 3.0, 2), ("four", 3.0, 4.0, 3)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "split(" not in above


def test_degrees_need_no_pairs(spark):
    from corpuslab.operators import assoc as A

    df = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["a", "b"]), (2, 0, ["d"]), (2, 1, ["a", "e"])], "doc_id long, seg_no int, items array<string>")
    out = A.window_degrees(df)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in A.degrees(A.pairs(df)).collect()} == {("a", 4), ("b", 3), ("c", 2), ("e", 1)}
