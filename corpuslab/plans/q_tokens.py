"""Queries of filters, segments, windows and counts over tokens."""

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import tokens as K
from corpuslab.operators import windows as W
from corpuslab.operators.counts import corpus_stats
from corpuslab.operators.filters import free, in_modalities, since
from corpuslab.operators.lexicon import without_stop_words
from corpuslab.operators.ranges import numbered
from corpuslab.plans.registry import query, table

P = r"[\p{L}\p{N}_]+"
TOK = rf"tok as (select doc_id, lang, source, unnest(t) as token, unnest(range(len(t))) as pos from (select doc_id, lang, source, regexp_extract_all(lower(text), '{P}') as t from documents))"


def docs(spark, d):
    return table(spark, d, "documents")


def tok(spark, d, *keys):
    return K.tokens(docs(spark, d), ["doc_id", *keys])


@query("flt_modalities", "select doc_id, lang from documents where lang in ('fr', 'de')")
def flt_modalities(spark, d):
    return in_modalities(docs(spark, d), "lang", ["fr", "de"]).select("doc_id", "lang")


@query("flt_has_connector", r"select doc_id from documents where regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(et|ou)($|[^\p{L}\p{N}_])')")
def flt_has_connector(spark, d):
    return docs(spark, d).filter(F.col("text").rlike(T.alternation(["et", "ou"]))).select("doc_id")


@query("flt_contains_term", rf"select doc_id from documents where list_contains(regexp_extract_all(lower(text), '{P}'), 'und') order by doc_id limit 300")
def flt_contains_term(spark, d):
    return docs(spark, d).filter(F.array_contains(T.words_lower("text"), "und")).orderBy("doc_id").select("doc_id").limit(300)


@query("flt_form_class", rf"select doc_id, lang from documents where lang = 'en' and list_contains(regexp_extract_all(lower(text), '{P}'), 'that') order by doc_id limit 200")
def flt_form_class(spark, d):
    counts = K.dfm(tok(spark, d)).filter("term = 'that'")
    return docs(spark, d).filter("lang = 'en'").join(counts, "doc_id", "left_semi").orderBy("doc_id").limit(200).select("doc_id", "lang")


@query("flt_terms_any", rf"select doc_id from documents where list_has_any(regexp_extract_all(lower(text), '{P}'), ['der', 'las', 'pour'])")
def flt_terms_any(spark, d):
    terms = F.array(*[F.lit(t) for t in ("der", "las", "pour")])
    return docs(spark, d).filter(F.arrays_overlap(T.words_lower("text"), terms)).select("doc_id")


@query("flt_min_freq", f"with {TOK}, c as (select doc_id, token as term, count(*) as n from tok group by all), u as (select count(distinct doc_id) as u from c), k as (select term, count(*) as df, sum(n) as total from c group by term) select term, df, total::bigint as total from k, u where df >= 5 and df <= 0.6 * u")
def flt_min_freq(spark, d):
    kept = K.frequent(K.dfm(tok(spark, d)), min_docs=5, max_share=0.6)
    return kept.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))


@query("flt_drop_empty", f"with {TOK} select doc_id from documents where doc_id in (select doc_id from tok where length(token) > 9)")
def flt_drop_empty(spark, d):
    return docs(spark, d).join(tok(spark, d).filter(F.length("token") > 9), "doc_id", "left_semi").select("doc_id")


@query("flt_free", "select doc_id, n_chars from documents where n_chars > 1000 and lang = 'es'")
def flt_free(spark, d):
    return free(docs(spark, d), "n_chars > 1000 and lang = 'es'").select("doc_id", "n_chars")


@query("flt_since", "select event_id from events where ts > timestamp '2024-01-05 00:00:00' and event_type like '%cl%'")
def flt_since(spark, d):
    return since(table(spark, d, "events"), "ts", "2024-01-05 00:00:00").filter(F.col("event_type").contains("cl")).select("event_id")


@query("flt_dates", "select event_id, strftime(ts, '%Y-%m-%d') as day from events where strftime(ts, '%Y-%m-%d') in ('2024-01-02', '2024-01-09')")
def flt_dates(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").filter(day.isin("2024-01-02", "2024-01-09")).select("event_id", day.alias("day"))


@query("flt_video_lang", "select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' or o_orderpriority = '1-URGENT') and o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31' order by o_totalprice desc nulls last, o_orderkey limit 50")
def flt_video_lang(spark, d):
    rows = table(spark, d, "orders").filter("(o_orderstatus = 'F' or o_orderpriority = '1-URGENT') and o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'")
    return rows.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("flt_short", rf"select doc_id, len(regexp_extract_all(text, '{P}')) as n_words from documents where len(regexp_extract_all(text, '{P}')) < 300")
def flt_short(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.words("text")).alias("n_words")).filter("n_words < 300")


@query("seg_fixed", rf"with w as (select doc_id, regexp_extract_all(text, '{P}') as t from documents), s as (select doc_id, t, unnest(range((len(t) + 39) // 40)) as seg_no from w) select doc_id, seg_no::int as seg_no, len(t[seg_no * 40 + 1:seg_no * 40 + 40]) as n_words, array_to_string(t[seg_no * 40 + 1:seg_no * 40 + 40], ' ') as segment from s")
def seg_fixed(spark, d):
    return K.segments_fixed(docs(spark, d))


@query("seg_double", rf"with w as (select doc_id, regexp_extract_all(text, '{P}') as t from documents), z as (select * from (values (12, '_rst1'), (14, '_rst2')) v(k, s)), x as (select doc_id, t, k, s, unnest(range((len(t) + k - 1) // k)) as seg_no from w, z) select doc_id || '_seg' || seg_no || s as seg_id, len(t[seg_no * k + 1:seg_no * k + k]) as n_words from x")
def seg_double(spark, d):
    return K.segments_double(docs(spark, d)).select("seg_id", "n_words")


def piece_query(name, spark_pattern, sql_pattern, least=1, source="documents"):
    """source: in SQL, the documents as they are or with marks where a pattern that looks back would cut."""
    sql = rf"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{sql_pattern}'), lambda x: trim(x, E' \n\t\r')), lambda x: length(x) >= {least}) as t from {source}) select doc_id, unnest(range(len(t)))::int as seg_no, md5(unnest(t)) as segment from p"

    def run(spark, d):
        return K.pieces(docs(spark, d), spark_pattern, least).withColumn("segment", F.md5("segment"))

    query(name, sql)(run)


def marked(pattern):
    """The documents with a private-use character in place of the blanks after a match of one character."""
    return rf"(select doc_id, regexp_replace(text, '({pattern})[ \t\n\x0B\f\r]+', '\1' || chr(57344), 'g') as text from documents)"


piece_query("seg_sentence_strong", r"\r?\n+|(?<=[.!?])\s+", r"\r?\n+|\x{E000}", source=marked("[.!?]"))
piece_query("seg_sentence_wide", r"(?<=[.!?;:\n])\s+", r"\x{E000}", source=marked(r"[.!?;:\n]"))
piece_query("seg_sentence_flesch", r"[.!?;:]+|\n+", r"[.!?;:]+|\n+")
piece_query("seg_lda", r"[.!?;:\n]", r"[.!?;:\n]", 20)
piece_query("seg_paragraph", r"\n\s*\n+", r"\n\s*\n+")


@query("win_words", f"with {TOK}, w as (select doc_id, pos, list_sort(list_distinct(list(token) over (partition by doc_id order by pos rows between 3 preceding and 3 following))) as items from tok) select doc_id, pos::int as pos, array_to_string(items, ' ') as items from w")
def win_words(spark, d):
    return K.sliding_sets(tok(spark, d), 3).select("doc_id", "pos", F.array_join("items", " ").alias("items"))


@query("win_pivot", f"with {TOK}, w as (select a.doc_id, a.pos, list_sort(list_distinct(list(b.token))) as items from tok a join tok b on a.doc_id = b.doc_id and b.pos between a.pos - 5 and a.pos + 5 where a.token = 'und' group by a.doc_id, a.pos) select doc_id, pos::int as pos, array_to_string(items, ' ') as items from w")
def win_pivot(spark, d):
    return K.sliding_sets(tok(spark, d), 5, "und").select("doc_id", "pos", F.array_join("items", " ").alias("items"))


def set_query(name, pattern):
    sql = rf"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: trim(x, E' \n\t\r')), lambda x: length(x) >= 1) as t from documents), s as (select doc_id, unnest(range(len(t)))::int as seg_no, unnest(t) as x from p), i as (select doc_id, seg_no, list_sort(list_distinct(regexp_extract_all(lower(x), '{P}'))) as items from s) select doc_id, seg_no, len(items) as n, md5(array_to_string(items, ' ')) as items from i where len(items) > 0"

    def run(spark, d):
        rows = K.unit_sets(K.pieces(docs(spark, d), pattern), T.words_lower("segment"))
        return rows.select("doc_id", "seg_no", F.size("items").alias("n"), F.md5(F.array_join("items", " ")).alias("items"))

    query(name, sql)(run)


set_query("win_sentence", r"[.!?;:]+|\n+")
set_query("win_paragraph", r"\n")


@query("win_document", rf"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;:]+|\n+'), lambda x: trim(x, E' \n\t\r')), lambda x: length(x) >= 1) as t from documents), s as (select doc_id, unnest(t) as x from p), i as (select doc_id, list_distinct(regexp_extract_all(lower(x), '{P}')) as items from s) select doc_id, count(*) as windows, sum(len(items))::bigint as items from i where len(items) > 0 group by grouping sets ((doc_id), ())")
def win_document(spark, d):
    rows = K.unit_sets(K.pieces(docs(spark, d), r"[.!?;:]+|\n+"), T.words_lower("segment"))
    return rows.rollup("doc_id").agg(F.count("*").alias("windows"), F.sum(F.size("items")).alias("items"))


@query("ngr_explode", rf"with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''-]+') as t from documents), g as (select doc_id, n, t, unnest(range(1, len(t) - n + 2)) as i from w, (values (2), (3)) v(n) where len(t) >= n) select doc_id, n, array_to_string(t[i:i + n - 1], ' ') as ngram from g")
def ngr_explode(spark, d):
    return K.ngrams(docs(spark, d), 2, 3)


GRAMS = r"w as (select doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_''-]+') as t from documents), g as (select lang, n, array_to_string(t[i:i + n - 1], ' ') as ngram from (select lang, n, t, unnest(range(1, len(t) - n + 2)) as i from w, (values (3), (4), (5), (6)) v(n) where len(t) >= n))"


@query("agg_ngrams", f"with {GRAMS}, p as (select n, ngram, lang, count(*) as c from g group by all), t as (select n, ngram, sum(c)::bigint as freq, min(struct_pack(neg := -c, m := lang)) as best from p group by n, ngram having sum(c) >= 2), r as (select *, row_number() over (partition by n order by freq desc, ngram) as rank from t) select n, ngram, freq, rank, best.m as modality, -best.neg as in_modality from r where rank <= 20")
def agg_ngrams(spark, d):
    return K.top_ngrams(docs(spark, d), 3, 6, "lang", 20, 2)


STOP = ["the", "of", "and", "de", "la", "le", "der", "die", "und", "el"]
STOPPED = GRAMS.replace("regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''-]+') as t", "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''-]+'), lambda x: x not in (" + ", ".join(f"'{w}'" for w in STOP) + ")) as t")


@query("agg_ngrams_stop", f"with {STOPPED}, p as (select n, ngram, lang, count(*) as c from g group by all), t as (select n, ngram, sum(c)::bigint as freq, min(struct_pack(neg := -c, m := lang)) as best from p group by n, ngram having sum(c) >= 2), r as (select *, row_number() over (partition by n order by freq desc, ngram) as rank from t) select n, ngram, freq, rank, best.m as modality, -best.neg as in_modality from r where rank <= 10")
def agg_ngrams_stop(spark, d):
    return K.top_ngrams(docs(spark, d), 3, 6, "lang", 10, 2, STOP)


@query("dd_contexts")
def dd_contexts(spark, d):
    best = K.top_ngrams(docs(spark, d), 3, 6, "lang", 5, 2, STOP)
    return K.contexts(docs(spark, d), best, stop=STOP)


@query("agg_corpus_stats", f"with {TOK}, c as (select token, count(*) as n from tok group by token), r as (select n, row_number() over (order by n desc, token) as rank from c) select (select count(*) from documents) as texts, (select sum(n)::bigint from c) as tokens, (select count(*) from c) as forms, (select count(*) from c where n = 1) as hapax, round(regr_slope(ln(n), ln(rank)), 6) as slope, round(regr_intercept(ln(n), ln(rank)), 6) as intercept from r where rank <= 160")
def agg_corpus_stats(spark, d):
    return corpus_stats(docs(spark, d))


@query("agg_dfm", f"with {TOK} select doc_id, token as term, count(*) as n from tok group by doc_id, token")
def agg_dfm(spark, d):
    return K.dfm(tok(spark, d))


@query("topk_features", f"with {TOK} select token as term, count(*) as total from tok group by token order by total desc, term limit 50")
def topk_features(spark, d):
    return K.most_frequent(K.dfm(tok(spark, d)), 50)


@query("gr_terms_menu", f"with {TOK} select token as term, count(distinct doc_id) as docs from tok group by token")
def gr_terms_menu(spark, d):
    return tok(spark, d).groupBy(F.col("token").alias("term")).agg(F.countDistinct("doc_id").alias("docs"))


@query("gr_profile01", f"with {TOK} select token as term, lang, count(distinct doc_id) as n from tok group by token, lang")
def gr_profile01(spark, d):
    return K.dfm(tok(spark, d, "lang"), ["doc_id", "lang"]).groupBy("term", "lang").agg(F.count("*").alias("n"))


@query("set_vocab_union", f"with {TOK} select token from tok where lang = 'fr' union select token from tok where lang = 'es'")
def set_vocab_union(spark, d):
    t = tok(spark, d, "lang")
    return t.filter("lang = 'fr'").select("token").union(t.filter("lang = 'es'").select("token")).distinct()


@query("set_union_all", rf"with w as (select doc_id, len(regexp_extract_all(text, '{P}')) as n from documents) select doc_id, (n + 11) // 12 + (n + 13) // 14 as segments from w where n > 0")
def set_union_all(spark, d):
    return K.segments_double(docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("segments"))


@query("set_excluded", "select doc_id from documents except select doc_id from labels")
def set_excluded(spark, d):
    return docs(spark, d).select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("set_intersect", f"with {TOK} select token from (values ('the'), ('und'), ('absent')) v(token) intersect select token from tok")
def set_intersect(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "und", "absent")])).alias("token"))
    return asked.intersect(tok(spark, d).select("token"))


@query("jn_stop", f"with {TOK} select lang, count(*) as n from tok where token not in ('the', 'of', 'der', 'la') group by lang")
def jn_stop(spark, d):
    stop = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "of", "der", "la")])).alias("w"))
    return without_stop_words(tok(spark, d, "lang"), stop).groupBy("lang").agg(F.count("*").alias("n"))


@query("wf_rank_top", "select lang, doc_id, n_chars, rank from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) where rank <= 3")
def wf_rank_top(spark, d):
    return W.top(docs(spark, d), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("lang", "doc_id", "n_chars", "rank")


@query("topk_group", f"with {TOK}, c as (select lang, token as term, count(*) as n from tok group by all), r as (select *, row_number() over (partition by lang order by n desc, term) as rank from c) select * from r where rank <= 10")
def topk_group(spark, d):
    return W.top(tok(spark, d, "lang").groupBy("lang", F.col("token").alias("term")).agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.asc("term")], 10)


@query("topk_global", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def topk_global(spark, d):
    return docs(spark, d).orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("topk_quota", "with r as (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents), q as (select greatest(1, 30 // count(distinct lang)) as q from documents) select doc_id, lang, n_chars from r, q order by r <= q desc, n_chars desc, doc_id limit 30")
def topk_quota(spark, d):
    return W.by_quota(docs(spark, d).select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), F.asc("doc_id")], 30)


@query("sort_multi", "select lang, doc_id, n_chars, row_number() over (order by lang desc, n_chars asc nulls last, doc_id) as place from documents")
def sort_multi(spark, d):
    rows = docs(spark, d).select("lang", "doc_id", "n_chars")
    return numbered(rows, [], [F.desc_nulls_last("lang"), F.asc_nulls_last("n_chars"), F.col("doc_id")], "place")


@query("spaced_n", "with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as m from documents) select lang, doc_id from r where list_contains(list_transform(range(5), lambda k: floor(k * (m - 1) / 4.0)::bigint), i)")
def spaced_n(spark, d):
    return W.spaced(docs(spark, d).select("lang", "doc_id"), 5, ["lang"], ["doc_id"])


@query("sample_n", "select doc_id, lang from documents order by md5('42/' || doc_id), doc_id limit 20")
def sample_n(spark, d):
    return W.sampled(docs(spark, d), 20, 42).select("doc_id", "lang")


@query("wf_avg_rank", "select doc_id, lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from documents")
def wf_avg_rank(spark, d):
    return W.with_average_rank(docs(spark, d).select("doc_id", "lang", "n_chars"), "n_chars", ["lang"], "r").select("doc_id", "lang", "r")


@query("wf_share", "select doc_id, round(n_chars::double / sum(n_chars) over (partition by lang), 9) as share from documents")
def wf_share(spark, d):
    return W.with_share(docs(spark, d).select("doc_id", "lang", "n_chars"), "n_chars", ["lang"], "share").select("doc_id", F.round("share", 9).alias("share"))


@query("rs_melt", "select doc_id, 'quality' as variable, quality as value from labels union all select doc_id, 'toxic', toxic from labels")
def rs_melt(spark, d):
    return table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "variable", "value")


