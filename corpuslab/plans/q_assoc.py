"""Queries of co-occurrence, similarity and class statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import assoc as A
from corpuslab.operators import classes as C
from corpuslab.operators import counts as N
from corpuslab.operators import pairs as W
from corpuslab.operators import tokens as K
from corpuslab.operators.shared import broadcast_if_small, written
from corpuslab.plans.q_tokens import TOK, P, docs, tok
from corpuslab.plans.registry import query

PATTERN = r"[.!?;:]+|\n+"
WIN = rf"p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{PATTERN}'), lambda x: trim(x, E' \n\t\r')), lambda x: length(x) >= 1) as t from documents), sg as (select doc_id, unnest(range(len(t))) as seg_no, unnest(t) as x from p), win as (select doc_id, seg_no, list_sort(list_distinct(regexp_extract_all(lower(x), '{P}'))) as items from sg where len(regexp_extract_all(lower(x), '{P}')) > 0), it as (select doc_id, seg_no, unnest(items) as w from win), pr as (select a.w as w1, b.w as w2, count(*) as k11 from it a join it b on a.doc_id = b.doc_id and a.seg_no = b.seg_no and a.w < b.w group by a.w, b.w), pres as (select w, count(*) as n from it group by w), tot as (select count(*) as n from win)"
CELL = "case when {x} > 0 then {x} * ln({x}::double * {n} / (({r})::double * ({c}))) else 0 end"


def llr_sql(a, f1, f2, n):
    b, c, d = f"({f1} - {a})", f"({f2} - {a})", f"({n} - {f1} - {f2} + {a})"
    parts = [CELL.format(x=x, n=n, r=r, c=k) for x, r, k in ((a, f1, f2), (b, f1, f"{n} - {f2}"), (c, f"{n} - {f1}", f2), (d, f"{n} - {f1}", f"{n} - {f2}"))]
    return "2 * (" + " + ".join(parts) + ")"


def windows(spark, d):
    return K.unit_sets(K.pieces(docs(spark, d), PATTERN), T.words_lower("segment"))


def word_pairs(spark, d):
    return W.Pairs(K.pieces(docs(spark, d), PATTERN), T.words_lower("segment"))


@query("co_pairs", f"with {WIN} select * from pr where k11 >= 2")
def co_pairs(spark, d):
    return word_pairs(spark, d).counts(2).select("w1", "w2", "k11")


@query("co_presence", f"with {WIN} select w as word, n as windows from pres")
def co_presence(spark, d):
    return A.presence(windows(spark, d))


@query("co_degree", f"with {WIN} select w as word, sum(k11)::bigint as degree from (select w1 as w, k11 from pr union all select w2, k11 from pr) group by w")
def co_degree(spark, d):
    return A.window_degrees(windows(spark, d))


@query("co_density", f"with {WIN} select edges, v, round(2.0 * edges / (v * (v - 1)), 9) as density from (select (select count(*) from pr) as edges, (select count(*) from (select w1 from pr union select w2 from pr)) as v)")
def co_density(spark, d):
    return word_pairs(spark, d).density().withColumn("density", F.round("density", 9))


@query("co_llr", f"with {WIN} select w1, w2, k11, round({llr_sql('k11', 'x.n', 'y.n', 'tot.n')}, 6) as llr from pr join pres x on x.w = w1 join pres y on y.w = w2, tot where k11 >= 3")
def co_llr(spark, d):
    found = word_pairs(spark, d)
    return A.pair_likelihood(found.counts(3), found.units, with_p=False).withColumn("llr", F.round("llr", 6))


PIVOT = f"{WIN}, pv as (select doc_id, seg_no from it where w = 'et'), a as (select w as word, count(*) as a from it join pv using (doc_id, seg_no) where w <> 'et' group by w), f as (select count(*) as f1 from pv)"


@query("co_pivot_freq", f"with {PIVOT} select * from a")
def co_pivot_freq(spark, d):
    return A.pivot_counts(windows(spark, d), "et")


@query("co_pivot_g2", f"with {PIVOT} select word, a, pres.n as f2, f1, tot.n as t, round({llr_sql('a', 'f1', 'pres.n', 'tot.n')}, 6) as g2 from a join pres on w = word, f, tot")
def co_pivot_g2(spark, d):
    return A.pivot_g2(windows(spark, d), "et", with_p=False).withColumn("g2", F.round("g2", 6))


@query("co_pivot_summary", f"with {PIVOT}, h as (select doc_id, w from it join pv using (doc_id, seg_no) where w <> 'et') select win.doc_id, count(*) as windows, count(*) filter (where list_contains(items, 'et')) as with_pivot, (select count(distinct w) from h where h.doc_id = win.doc_id) as distinct_words, (select count(*) from h where h.doc_id = win.doc_id) as total_words from win group by win.doc_id")
def co_pivot_summary(spark, d):
    return A.pivot_summary(windows(spark, d), "et", ["doc_id"])


@query("co_kwic_pair", f"with {TOK} select distinct a.doc_id, greatest(0, least(a.pos, b.pos) - 5)::int as start, (greatest(a.pos, b.pos) + 5)::int as \"end\" from tok a join tok b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 5 where a.token = 'the' and b.token = 'that'")
def co_kwic_pair(spark, d):
    return A.pair_lines(tok(spark, d), "the", "that", 5)


@query("co_kwic_pivot", f"with {WIN} select doc_id, seg_no::int as seg_no from win where list_contains(items, 'et') and list_contains(items, 'le') order by doc_id, seg_no limit 50")
def co_kwic_pivot(spark, d):
    return A.holding_all(windows(spark, d), ["et", "le"]).orderBy("doc_id", "seg_no").limit(50).select("doc_id", "seg_no")


@query("co_terms_all", f"with {WIN} select doc_id, seg_no::int as seg_no, len(items) as n from win where list_has_all(items, ['de', 'la', 'que'])")
def co_terms_all(spark, d):
    return A.holding_all(windows(spark, d), ["de", "la", "que"]).select("doc_id", "seg_no", F.size("items").alias("n"))


@query("dist_jsd", f"with {TOK}, a as (select token, count(*)::double / sum(count(*)) over () as p from tok where lang = 'fr' group by token), b as (select token, count(*)::double / sum(count(*)) over () as p from tok where lang = 'es' group by token), j as (select token as word, coalesce(a.p, 0) as p_a, coalesce(b.p, 0) as p_b from a full join b using (token)), s as (select *, (case when p_a > 0 then p_a * log2(p_a / ((p_a + p_b) / 2)) else 0 end + case when p_b > 0 then p_b * log2(p_b / ((p_a + p_b) / 2)) else 0 end) / 2 as score from j) select word, round(p_a, 9) as p_a, round(p_b, 9) as p_b, round(score, 9) as score, round(case when p_a >= p_b then -score else score end, 9) as oriented, round(100 * score / sum(score) over (), 6) as share, case when p_a >= p_b then 'A' else 'B' end as dominant from s")
def dist_jsd(spark, d):
    t = tok(spark, d, "lang")
    out = N.jsd(t.filter("lang = 'fr'"), t.filter("lang = 'es'"))
    return out.select("word", *[F.round(c, 9).alias(c) for c in ("p_a", "p_b", "score", "oriented")], F.round("share", 6).alias("share"), "dominant")


TFIDF = rf"tf as (select source, token as term, count(*) as tf from (select source, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) as token from documents) group by all), dfs as (select term, count(*) as df from tf group by term), u as (select count(distinct source) as n from tf), raw as (select source, term, tf, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join dfs using (term), u), tfidf as (select source, term, tf, w / sqrt(sum(w * w) over (partition by source)) as weight from raw)"


def vectors(spark, d):
    return N.tfidf(K.tokens(docs(spark, d), ["source"], words=T.extract_all(F.lower("text"), r"[\p{L}\p{N}_]{2,}")), "source")


@query("vec_tfidf", f"with {TFIDF} select source, term, tf, round(weight, 8) as weight from tfidf")
def vec_tfidf(spark, d):
    return vectors(spark, d).withColumn("weight", F.round("weight", 8))


@query("sim_cosine", f"with {TFIDF} select x.source as a, y.source as b, round(sum(x.weight * y.weight), 8) as cosine from tfidf x join tfidf y using (term) where x.source < y.source group by all")
def sim_cosine(spark, d):
    return N.cosine(vectors(spark, d), "source").withColumn("cosine", F.round("cosine", 8))


@query("sim_terms", f"with {TOK}, c as (select doc_id, token as term, count(*) as n from tok group by all), t as (select term, count(*) as df, sum(n) as s from c group by term order by s desc, term limit 100), k as (select doc_id, term, df from c join t using (term)), n as (select count(distinct doc_id) as n from c) select x.term as src, y.term as dst, count(*) as a, round(count(*)::double / (x.df + y.df - count(*)), 8) as weight from k x join k y using (doc_id) where x.term < y.term group by x.term, y.term, x.df, y.df")
def sim_terms(spark, d):
    return A.term_similarity(K.dfm(tok(spark, d)), "jaccard", 100).withColumn("weight", F.round("weight", 8))


@query("sim_binom")
def sim_binom(spark, d):
    return A.word_binomial(docs(spark, d), T.words_lower("text"), 100)


CLS = f"{TOK}, c as (select doc_id, lang as cls, token as term, count(*) as n from tok group by all), cell as (select cls, term, sum(n)::bigint as occ_st, count(*) as eff_st from c group by all), term as (select term, sum(n)::bigint as occ_total, count(*) as eff_total from c group by term), sz as (select cls, sum(n)::bigint as k, count(distinct doc_id) as units from c group by cls), al as (select sum(k)::bigint as n from sz), x as (select cls, term, occ_st, occ_total, eff_st, eff_total, k, units, n, occ_st::double as a, (occ_total - occ_st)::double as b, (k - occ_st)::double as c, (n - k - occ_total + occ_st)::double as d from cell join term using (term) join sz using (cls), al), st as (select *, case when a >= occ_total * k::double / n then 1 else -1 end * case when (a + b) * (c + d) * (a + c) * (b + d) > 0 then n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) else 0 end as chi2, case when a >= occ_total * k::double / n then 1 else -1 end * {llr_sql('a', '(a + b)', '(a + c)', '(a + b + c + d)')} as lr from x)"


def chi2_p_sql(chi2):
    """P(chi-squared with one degree of freedom > chi2) = erfc(x), x = sqrt(chi2 / 2), by the trapezoidal rule with steps of 1/2, which is exact to about 1e-15."""
    x = f"sqrt({chi2} / 2)"
    rule = f"{x} / pi() * exp(-{chi2} / 2) * (1 / {chi2} + list_sum(list_transform(range(1, 13), lambda k: exp(-k * k / 4.0) / ({chi2} / 2 + k * k / 4.0))))"
    return f"case when {chi2} < 1e-6 then 1 - 2 * {x} / sqrt(pi()) * (1 - {chi2} / 6) when {x} < 6 then {rule} - 2 / (exp(4 * pi() * {x}) - 1) else {rule} end"


def stats(spark, d, with_p=False):
    return C.word_class_terms(docs(spark, d), T.words_lower("text"), "lang", with_p=with_p)


def best_terms(spark, d, n=5):
    """class, term, chi2 of the first n terms of each class: a few rows, told to all tasks."""
    return broadcast_if_small(written(C.class_view(stats(spark, d), n).select("class", "term", "chi2"), "best-terms"))


def class_best(spark, d):
    """class, term, chi2, occ_st of all terms that are characteristic of a class, as many as there are."""
    return stats(spark, d).filter("chi2 >= 3.84").select("class", "term", "chi2", "occ_st")


def class_segments(spark, d):
    """class, doc_id, seg_no, words of each segment."""
    segs = K.segments_fixed(docs(spark, d).withColumn("text", F.lower("text")), keys=["doc_id", "lang"])
    return segs.select(F.col("lang").alias("class"), "doc_id", "seg_no", F.split("segment", " ").alias("words"))


@query("st_class_terms", f"with {CLS} select cls as class, term, round(chi2, 6) as chi2, round(lr, 5) as lr, occ_st, occ_total, eff_st, eff_total, round(100.0 * eff_st / eff_total, 6) as share, round(occ_st::double / k, 9) as frequency, round(eff_st::double / units, 9) as docprop, round({chi2_p_sql('abs(chi2)')}, 6) as p from st")
def st_class_terms(spark, d):
    out = stats(spark, d, with_p=True)
    return out.withColumns({"p": F.round("p", 6), "chi2": F.round("chi2", 6), "lr": F.round("lr", 5), "share": F.round("share", 6), "frequency": F.round("frequency", 9), "docprop": F.round("docprop", 9)})


VIEW = f"{CLS}, v as (select *, row_number() over (partition by cls order by chi2 desc, occ_st desc, term) as rank from st where chi2 >= 3.84)"


@query("st_class_view", f"with {VIEW} select cls as class, term, rank, round(chi2, 4) as chi2 from v where rank <= 20")
def st_class_view(spark, d):
    return C.class_view(stats(spark, d)).select("class", "term", "rank", F.round("chi2", 4).alias("chi2"))


@query("cl_top_terms", f"with {CLS}, v as (select *, row_number() over (partition by cls order by greatest(chi2, 0) desc, occ_st desc, term) as by_chi2, row_number() over (partition by cls order by occ_st desc, term) as by_freq from st) select cls as class, term, by_chi2, by_freq, round(greatest(chi2, 0), 4) as weight from v where by_chi2 <= 15 or by_freq <= 15")
def cl_top_terms(spark, d):
    rows = stats(spark, d).withColumn("weight", F.greatest(F.col("chi2"), F.lit(0.0)))
    w = Window.partitionBy("class")
    rows = rows.withColumns({"by_chi2": F.row_number().over(w.orderBy(F.desc("weight"), F.desc("occ_st"), "term")), "by_freq": F.row_number().over(w.orderBy(F.desc("occ_st"), "term"))})
    return rows.filter("by_chi2 <= 15 or by_freq <= 15").select("class", "term", "by_chi2", "by_freq", F.round("weight", 4).alias("weight"))


@query("agg_class_sizes", f"with {VIEW}, b as (select cls, string_agg(term, ', ' order by rank) as terms from v where rank <= 5 group by cls) select lang as class, count(*) as units, any_value(terms) as terms from documents left join b on cls = lang group by lang")
def agg_class_sizes(spark, d):
    return C.class_sizes(docs(spark, d), "lang", stats(spark, d))


@query("st_class_term_actions", f"with {CLS} select cls as class, round(chi2, 4) as chi2, eff_st from st where term = 'de'")
def st_class_term_actions(spark, d):
    return stats(spark, d).filter("term = 'de'").select("class", F.round("chi2", 4).alias("chi2"), "eff_st")


@query("st_keyness", f"with {CLS} select cls as class, term, round(chi2, 4) as chi2 from st where abs(chi2) >= 3.841458820694124")
def st_keyness(spark, d):
    return stats(spark, d).filter("abs(chi2) >= 3.841458820694124").select("class", "term", F.round("chi2", 4).alias("chi2"))


@query("jn_word_segment", rf"with {VIEW}, s as (select doc_id, lang, seg_no, unnest(list_distinct(t)) as term from (select doc_id, lang, t[i * 40 + 1:i * 40 + 40] as t, i as seg_no from (select doc_id, lang, t, unnest(range((len(t) + 39) // 40)) as i from (select doc_id, lang, regexp_extract_all(lower(text), '{P}') as t from documents)))) select cls as class, v.term, count(*) as segments, round(any_value(chi2), 4) as chi2 from v join s on s.term = v.term and s.lang = v.cls group by cls, v.term")
def jn_word_segment(spark, d):
    # segments are counted for each word where they stand, and the class's terms picked from the counts
    held = class_segments(spark, d).select("class", F.explode(F.array_distinct("words")).alias("term")).groupBy("class", "term").agg(F.count("*").alias("segments"))
    return held.join(class_best(spark, d), ["class", "term"]).select("class", "term", "segments", F.round("chi2", 4).alias("chi2"))


@query("jn_best_segment", rf"with {VIEW}, s as (select doc_id, lang, i as seg_no, unnest(t[i * 40 + 1:i * 40 + 40]) as term from (select doc_id, lang, t, unnest(range((len(t) + 39) // 40)) as i from (select doc_id, lang, regexp_extract_all(lower(text), '{P}') as t from documents))), k as (select cls, v.term, doc_id, seg_no, count(*) as n from v join s on s.term = v.term and s.lang = v.cls where rank <= 5 group by all), r as (select *, row_number() over (partition by cls, term order by n desc, doc_id, seg_no) as r from k) select cls as class, term, doc_id, seg_no::int as seg_no, n from r where r = 1")
def jn_best_segment(spark, d):
    held = class_segments(spark, d).select("class", "doc_id", "seg_no", F.explode("words").alias("term"))
    n = held.join(best_terms(spark, d).drop("chi2"), ["class", "term"]).groupBy("class", "term", "doc_id", "seg_no").agg(F.count("*").alias("n"))
    best = n.groupBy("class", "term").agg(F.min(F.struct((-F.col("n")).alias("neg"), "doc_id", "seg_no")).alias("b"))
    return best.select("class", "term", "b.doc_id", "b.seg_no", (-F.col("b.neg")).alias("n"))


@query("cl_concordance", rf"with {VIEW}, s as (select row_number() over () as id, lang, t[i * 40 + 1:i * 40 + 40] as t from (select lang, t, unnest(range((len(t) + 39) // 40)) as i from (select lang, regexp_extract_all(lower(text), '{P}') as t from documents))), w as (select id, lang, unnest(t) as term from s) select lang as class, count(distinct id) as segments from w join v on cls = lang and v.term = w.term group by lang")
def cl_concordance(spark, d, told=200):
    """Most segments hold one of the `told` most frequent characteristic terms of their class; only the words of the others meet all the terms."""
    best = written(class_best(spark, d), "best-terms")
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("occ_st"), "term"))
    often = best.withColumn("_r", rank).filter(F.col("_r") <= told).groupBy("class").agg(F.collect_list("term").alias("terms"))
    left = F.when(~F.arrays_overlap("words", "terms"), F.array_distinct("words"))
    segs = written(class_segments(spark, d).join(F.broadcast(often), "class").select("class", left.alias("left")), "segments-left")
    words = segs.filter("left is not null").withColumn("id", F.monotonically_increasing_id()).select("class", "id", F.explode("left").alias("term"))
    more = words.join(best.select("class", "term").hint("merge"), ["class", "term"], "left_semi").select("class", "id").distinct()
    return segs.filter("left is null").select("class").unionByName(more.select("class")).groupBy("class").agg(F.count("*").alias("segments"))


@query("flt_concord_terms", f"with {CLS}, g as (select * from st where length(term) >= 3 and chi2 >= 3.841458820694124) select cls as class, term from g")
def flt_concord_terms(spark, d):
    return stats(spark, d).filter("length(term) >= 3 and chi2 >= 3.841458820694124").select("class", "term")
