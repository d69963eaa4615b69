"""The numbered queries of this subpackage, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import bpe, gam, hostrules, katz, langid, minhash, mixing, pii, runs, sharding, simhash, tries, urlfilter
from corpuslab.llm.common import crc_of_id, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_sql(column: str) -> str:
    """DuckDB's expression of the crc32 of a number's decimal text, as it has no such function: a fold over the digits' bytes, bit by bit."""
    bits = "xor(crc, b) & 255"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    digits = f"list_transform(range(1, length({column}::varchar) + 1), lambda _at: ascii(substr({column}::varchar, _at::int, 1))::bigint)"
    folded = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {digits}), lambda crc, b: xor(crc >> 8, {bits})))"
    return f"case when {column} is not null then {folded} end"


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document. The measures are written once, as hosts and documents both read them."""
    rows = written(hostrules.measured(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"), "op6")
    judged = hostrules.judged(rows, hostrules.host_verdicts(rows))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


QUERIES["op6_host_rules"] = op6_host_rules
ORACLES["op6_host_rules"] = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
g as (select rid, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') as win
      from (select rid, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
twice as (select rid, win from g group by rid, win having count(*) > 1),
covered as (select rid, count(distinct p) as n_repeat_words
            from (select g.rid, unnest(range(g.i, g.i + 8)) as p from g join twice using (rid, win)) group by rid),
line as (select rid, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
         from (select rid, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
m as (select d.rid, doc_id, source, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
             coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from d join w on w.rid = d.rid left join covered c on c.rid = d.rid left join line l on l.rid = d.rid),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
             10 * n_symbols > n_words or (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines) as soft_failed from m),
h as (select source as host, count(*) as n, count(*) filter (where base_failed or soft_failed) as k from f group by source),
t as (select sum(k)::double / sum(n) as mu, count(*)::double / sum(n) as thin from h),
v as (select max(mu) as mu, max(thin) as thin, sum(n * (k::double / n - mu) ** 2) / sum(n) as s2 from h, t),
p as (select mu, 1 / greatest(0.001, least(0.5, case when mu * (1 - mu) <= 0 then 0 else (s2 - mu * (1 - mu) * thin) / (mu * (1 - mu)) end)) - 1 as strength from v),
q as (select host, (k + mu * strength) / (n + strength) as rate from h, p),
j as (select f.*, case when rate > 0.5 then 'reject' when rate <= 0.005 then 'trust' else 'judge' end as host_verdict
      from f join q on f.source is not distinct from q.host)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and host_verdict <> 'reject' and (not soft_failed or host_verdict = 'trust') as kept, host_verdict from j
"""


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir))


QUERIES["op4_jump_shards"] = op4_jump_shards


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are written once, as sources and documents both read them."""
    sizes = written(documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "op8")
    rows = mixing.with_copies(sizes, mixing.solved(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


QUERIES["op8_entropy_mix"] = op8_entropy_mix


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rules_frame(spark, urlfilter.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES["op7_url_filter"] = op7_url_filter
ORACLES["op7_url_filter"] = r"""
with p as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from p),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
v as (select *, case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                     when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                     when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
                     when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from v
"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), shingle_words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["op2_minhash_dedup"] = op2_minhash_dedup


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs)


QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.annotate(docs, pii.fit(docs))


QUERIES["op3_weak_pii"] = op3_weak_pii


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_report(documents(spark, sf_dir))


QUERIES["op10_simhash"] = op10_simhash


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures are written once, as the model and the scores both read them."""
    measured = written(gam.features(documents(spark, sf_dir)), "op5")
    scores = gam.scored(measured, gam.learned(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op5_additive_quality"] = op5_additive_quality


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.learned(docs))
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES["op9_crf_language"] = op9_crf_language


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES["op11_prefix_trie"] = op11_prefix_trie
ORACLES["op11_prefix_trie"] = rf"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
           from conversations where conv_id is not null),
k as (select c, pos, md5(length(role) || ':' || role || text) as key, strlen(text) as bytes from t),
i as (select c, c - c % 5 as base, ({crc_sql('c')}) % 9 as h from (select distinct c from t)),
r as (select i.c, 0 as part, pos, key, bytes from i join k on k.c = base and pos <= h union all select i.c, 1, pos, key, bytes from i join k on k.c = i.c and pos > h),
o as (select *, row_number() over w as d, md5(string_agg(key, '' order by part, pos) over w) as node from r window w as (partition by c order by part, pos)),
m as (select c, d, node, bytes from o union all select c, 0, '', 0 from i),
l as (select *, lag(node) over (partition by c order by d) as up, lead(node) over (partition by c order by d) is null as ends from m),
n as (select node, min(up) as up, min(d) as depth, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes, string_agg(c::varchar, ',' order by c) filter (where ends) as ids from l group by node),
ch as (select up as node, count(*) as n_children from n where up is not null group by up),
a as (select distinct x.node as top, y.node as node from m x join m y on x.c = y.c and y.d >= x.d),
s as (select top as node, count(*) filter (where n_children is null) as n_leaves, sum((n_convs - 1) * bytes) as saved from a join n using (node) left join ch using (node) group by top)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved::bigint as saved_tokens,
       sha256(coalesce(n.ids, '')) as ends_sha256 from n join s using (node) left join ch using (node) left join n p on p.node = n.up
"""


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return runs.repeated_stretches(documents(spark, sf_dir), plant=True).select(*columns)


QUERIES["op12_word_runs"] = op12_word_runs


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by pairs of words; rounded to millionths, as sums of logarithms differ in their last digits with the order of adding."""
    docs = documents(spark, sf_dir)
    rows = katz.scores(docs, ~katz.held_out(docs["doc_id"]))
    return rows.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


QUERIES["op13_katz_scores"] = op13_katz_scores
ORACLES["op13_katz_scores"] = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(({crc_sql('doc_id')}) % 7 = 2, false) as held_out,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select rid, held_out, list_append(regexp_extract_all(text, '[^ 	-
]+'), ' ') as words from d),
t as (select rid, held_out, unnest(words) as w, unnest(list_prepend(null, words[:-2])) as h from w),
u as (select w, count(*) as c from t where not held_out group by w),
b as (select h, w, count(*) as c from t where not held_out and h is not null group by h, w),
n as (select sum(c)::bigint as total, count(*) as v from u),
s1 as (select 1 + regr_slope(ln(n), ln(c)) as s from (select c, count(*) as n from u where c <= 6 group by c)),
s2 as (select 1 + regr_slope(ln(n), ln(c)) as s from (select c, count(*) as n from b where c <= 6 group by c)),
d1 as (select {", ".join(f"((1 + 1 / {r}::double) ** s - 6 ** s) / (1 - 6 ** s) as d{r}" for r in range(1, 6))} from s1),
d2 as (select {", ".join(f"((1 + 1 / {r}::double) ** s - 6 ** s) / (1 - 6 ** s) as d{r}" for r in range(1, 6))} from s2),
p1 as (select w, c, (case c {" ".join(f"when {r} then {r} * d{r}" for r in range(1, 6))} else c - 0.01::double end) / total as p from u, d1, n),
k2 as (select h, w, c, case c {" ".join(f"when {r} then {r} * d{r}" for r in range(1, 6))} else c - 0.01::double end as kept from b, d2),
a as (select h, sum(k2.c) as ch, (1 - sum(kept) / sum(k2.c)) / (1 - sum(p)) as alpha from k2 join p1 using (w) group by h),
r as (select 1 - sum(p) as rest from p1),
s as (select rid, t.w, coalesce(p1.c, 0) as c1,
             case when k2.c is not null then kept / ch else coalesce(alpha, 1) * coalesce(p1.p, rest) end as p
      from t cross join r left join p1 on p1.w = t.w left join a on a.h = t.h left join k2 on k2.h = t.h and k2.w = t.w),
q as (select rid, count(*) as n_tokens, count(*) filter (where c1 > 0) as n_known, sum(log10((c1 + 1) / (total + v + 1)::double)) as base_score,
             sum(log10(p)) as score from s, n group by rid)
select doc_id, held_out, n_tokens, n_known, total as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score from q join d using (rid), n
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
