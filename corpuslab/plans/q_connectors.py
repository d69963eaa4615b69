"""Queries of the connector dictionary. The invented texts hold these function words."""

from pyspark.sql import functions as F

from corpuslab.operators import connectors as C
from corpuslab.operators import counts as N
from corpuslab.operators import stats as S
from corpuslab.operators import tokens as K
from corpuslab.operators.lexicon import present_terms
from corpuslab.plans.q_stats import rounded
from corpuslab.plans.q_tokens import P, docs
from corpuslab.plans.registry import query

LABELS = {"et": "AND", "and": "AND", "und": "AND", "ou": "ALTERNATIVE", "or": "ALTERNATIVE"}
W = rf"w as (select doc_id, lang, source, regexp_extract_all(lower(text), '{P}') as t from documents), x as (select doc_id, lang, source, unnest(t) as token from w), l as (select * from (values ('et', 'AND'), ('and', 'AND'), ('und', 'AND'), ('ou', 'ALTERNATIVE'), ('or', 'ALTERNATIVE')) v(token, label)), h as (select doc_id, lang, source, token, label from x join l using (token))"


@query("agg_connectors", f"with {W} select token as connector, label, count(*) as n from h group by all")
def agg_connectors(spark, d):
    return C.connector_counts(docs(spark, d), LABELS)


@query("agg_connectors_label", f"with {W} select label, count(*) as n from h group by label")
def agg_connectors_label(spark, d):
    return C.label_counts(docs(spark, d), LABELS)


@query("agg_label_by_modality", f"with {W}, g as (select lang, label from (select distinct lang from documents) cross join (select distinct label from l)), n as (select lang, label, count(*) as n from h group by all) select lang, label, coalesce(n, 0) as n from g left join n using (lang, label)")
def agg_label_by_modality(spark, d):
    return C.filled_labels(C.label_counts(docs(spark, d), LABELS, ["lang"]), docs(spark, d), LABELS, ["lang"])


@query("agg_density", f"with {W} select (select count(*) from h) as connectors, (select count(*) from x) as words, round((select count(*) from h)::double / (select count(*) from x) * 1000, 8) as density")
def agg_density(spark, d):
    return rounded(C.densities(docs(spark, d), LABELS), 8)


@query("agg_density_label", f"with {W} select label, count(*) as connectors, (select count(*) from x) as words, round(count(*)::double / (select count(*) from x) * 1000, 8) as density from h group by label")
def agg_density_label(spark, d):
    return rounded(C.densities_by_label(docs(spark, d), LABELS), 8)


@query("agg_density_modality", f"with {W}, a as (select lang, count(*) as words from x group by lang), b as (select lang, count(*) as connectors from h group by lang) select lang, coalesce(connectors, 0) as connectors, words, round(coalesce(connectors, 0)::double / words * 1000, 8) as density from a left join b using (lang)")
def agg_density_modality(spark, d):
    return rounded(C.densities(docs(spark, d), LABELS, ["lang"]), 8)


@query("agg_density_modality_label", f"with {W}, a as (select lang, count(*) as words from x group by lang), g as (select * from a cross join (select distinct label from l)), b as (select lang, label, count(*) as connectors from h group by all) select lang, label, coalesce(connectors, 0) as connectors, words, round(coalesce(connectors, 0)::double / words * 1000, 8) as density from g left join b using (lang, label)")
def agg_density_modality_label(spark, d):
    return rounded(C.densities_by_label(docs(spark, d), LABELS, ["lang"]), 8)


@query("agg_density_row", f"with {W}, b as (select doc_id, count(*) as c from h group by doc_id) select w.doc_id, coalesce(c, 0) as connectors, len(t)::bigint as words, round(case when len(t) > 0 then coalesce(c, 0)::double / len(t) * 1000 else 0 end, 8) as density from w left join b using (doc_id)")
def agg_density_row(spark, d):
    return rounded(C.densities(docs(spark, d), LABELS, ["doc_id"]), 8)


@query("agg_connector_matrix", f"with {W} select doc_id, token as connector, count(*) as n from h group by all")
def agg_connector_matrix(spark, d):
    return C.matrix(docs(spark, d), LABELS)


@query("st_contingency_conn", f"with {W}, a as (select lang, count(*) as words from x group by lang), b as (select lang, count(*) as connectors from h group by lang) select lang, coalesce(connectors, 0) as connectors, greatest(0, words - coalesce(connectors, 0)) as others from a left join b using (lang)")
def st_contingency_conn(spark, d):
    rows = C.densities(docs(spark, d), LABELS, ["lang"])
    return rows.select("lang", "connectors", F.greatest(F.lit(0), F.col("words") - F.col("connectors")).alias("others"))




def segs(spark, d):
    return C.segments(docs(spark, d), LABELS, keys=["doc_id", "lang"])


@query("seg_connector", rf"with {W}, b as (select doc_id, t, list_filter(range(1, len(t) + 1), lambda i: list_contains(['et', 'and', 'und', 'ou', 'or'], t[i])) as c from w), g as (select doc_id, unnest(list_concat([0], c)) as lo, unnest(list_concat(c, [len(t) + 1])) as hi from b) select doc_id, count(*) as segments, sum(hi - lo - 1)::bigint as words from g where hi - lo > 1 group by doc_id")
def seg_connector(spark, d):
    return segs(spark, d).groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum("n_words").alias("words"))


CUT = rf"{W}, b as (select doc_id, lang, t, list_filter(range(1, len(t) + 1), lambda i: list_contains(['et', 'and', 'und', 'ou', 'or'], t[i])) as c from w), g as (select doc_id, lang, unnest(list_concat([0], c)) as lo, unnest(list_concat(c, [len(t) + 1])) as hi from b), s as (select doc_id, lang, hi - lo - 1 as n from g where hi - lo > 1)"


@query("agg_lms", f"with {CUT} select lang, count(*) as segments, round(avg(n), 8) as lms from s group by lang")
def agg_lms(spark, d):
    return rounded(C.length_stats(segs(spark, d), ["lang"]).select("lang", "segments", "lms"), 8)


@query("agg_lms_std", f"with {CUT} select lang, count(*) as segments, round(avg(n), 6) as lms, round(stddev_pop(n), 6) as sd, round(greatest(0, avg(n) - stddev_pop(n)), 6) as low, round(avg(n) + stddev_pop(n), 6) as high from s group by lang")
def agg_lms_std(spark, d):
    return rounded(C.length_stats(segs(spark, d), ["lang"]).select("lang", "segments", "lms", "sd", "low", "high"))


@query("agg_lms_row", f"with {CUT} select doc_id, count(*) as segments, sum(n)::bigint as total, round(avg(n), 6) as lms, round(stddev_pop(n), 6) as sd, round(stddev_pop(n) / avg(n), 6) as cv, median(n)::double as median, round(avg((n <= 5)::int), 6) as share_short from s group by doc_id")
def agg_lms_row(spark, d):
    return rounded(C.length_stats(segs(spark, d), ["doc_id"]).select("doc_id", "segments", "total", "lms", "sd", "cv", "median", "share_short"))


@query("agg_lms_stats", f"with {CUT}, r as (select doc_id, lang, count(*) as k, sum(n) as total, stddev_pop(n) as sd, median(n) as m from s group by all) select lang, count(*) as rows, sum(k)::bigint as segments, round(sum(total)::double / sum(k), 6) as lms, median(m)::double as median_of_medians, round(avg(sd), 6) as mean_sd from r group by lang")
def agg_lms_stats(spark, d):
    per = C.length_stats(segs(spark, d), ["doc_id", "lang"])
    return rounded(C.pooled_stats(per, ["lang"]))


@query("st_anova_density")
def st_anova_density(spark, d):
    return S.anova(C.densities(docs(spark, d), LABELS, ["doc_id", "lang"]), "lang", "density")


@query("seg_subcorpus")
def seg_subcorpus(spark, d):
    return C.subcorpus(docs(spark, d), LABELS, F.concat(F.lit("**** *lang_"), F.col("lang")))


@query("agg_patterns", r"select lang, sum(len(regexp_extract_all(lower(text), 'tion')))::bigint as n from documents group by lang")
def agg_patterns(spark, d):
    return C.pattern_counts(docs(spark, d), "tion", ["lang"], "text")


@query("agg_regex_rules")
def agg_regex_rules(spark, d):
    rules = [("CONDITION", r"\bthe\b.+\bthat\b"), ("CONDITION", r"\bthe\b.+\bthat\b"), ("SUITE", r"\bet\b.+\bet\b")]
    return C.rule_counts(K.pieces(docs(spark, d), r"(?<=[.!?;:\n])\s+"), rules)


@query("agg_term_presence", r"select doc_id, array_to_string(list_filter(['of', 'the', 'tion'], lambda w: regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || w || '[sx]?($|[^\p{L}\p{N}_])')), ',') as terms from documents")
def agg_term_presence(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(present_terms(F.col("text"), ["the", "of", "tion"]), ",").alias("terms"))


@query("agg_flesch", r"""
with w as (select lang, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+'), lambda w: regexp_replace(w, '[^a-zàâäéèêëîïôöùûüÿœç-]', '', 'g')) as t, len(list_filter(regexp_split_to_array(text, '[.!?;:]+|\n+'), lambda x: trim(x, E' \n\t\r') <> '')) as s from documents),
y as (select lang, s, len(t) as n, coalesce(list_sum(list_transform(t, lambda k: case when k = '' then 0 else greatest(1, len(regexp_extract_all(k, '[aeiouyàâäéèêëîïôöùûüÿœ]+')) - case when suffix(k, 'e') and len(regexp_extract_all(k, '[aeiouyàâäéèêëîïôöùûüÿœ]+')) > 1 then 1 else 0 end) end)), 0) as k from w),
g as (select lang, (case when sum(n) > 0 then sum(s) else 0 end)::bigint as sentences, sum(n)::bigint as words, sum(k)::bigint as syllables from y group by lang),
e as (select *, case when words > 0 then 206.835 - 1.015 * words / greatest(sentences, 1) - 84.6 * syllables / words else 0 end as ease, case when words > 0 then 0.39 * words / greatest(sentences, 1) + 11.8 * syllables / words - 15.59 else 0 end as grade from g)
select lang, sentences, words, syllables, round(ease, 6) as ease, round(grade, 6) as grade, case when ease >= 90 then 1 when ease >= 80 then 2 when ease >= 70 then 3 when ease >= 60 then 4 when ease >= 50 then 5 when ease >= 30 then 6 else 7 end as band from e""")
def agg_flesch(spark, d):
    return N.readability(docs(spark, d), ["lang"])


@query("agg_group_text", "with r as (select 'lang = ' || lang || ' | source = ' || source as label, doc_id, text, (row_number() over (partition by lang, source order by doc_id) - 1) // 64 as part from documents) select label, part, md5(string_agg(text, chr(10) || chr(10) order by doc_id)) as text from r group by label, part")
def agg_group_text(spark, d):
    return N.group_text(docs(spark, d), ["lang", "source"]).withColumn("text", F.md5("text"))
