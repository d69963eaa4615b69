"""Queries of tests and contingency tables, on the plain tables."""

from pyspark.sql import functions as F

from corpuslab.operators import counts as N
from corpuslab.operators import stats as S
from corpuslab.plans.registry import query, table


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CT = "c as (select lang, source, count(*) as o from documents group by all), r as (select lang, sum(o)::bigint as r from c group by 1), k as (select source, sum(o)::bigint as k from c group by 1), t as (select sum(o)::bigint as n from c), f as (select r.lang, k.source, coalesce(o, 0)::bigint as o, r.r * k.k::double / n as e, n from r cross join k cross join t left join c on c.lang = r.lang and c.source = k.source)"


def contingency(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("st_contingency_labels", f"with {CT} select lang, source, o as observed, round(e, 6) as expected from f")
def st_contingency_labels(spark, d):
    return rounded(S.cells(contingency(spark, d), "lang", "source").select("lang", "source", "observed", "expected"))


@query("st_chi2", f"with {CT} select round(sum((o - e) ** 2 / e), 6) as chi2, ((count(distinct lang) - 1) * (count(distinct source) - 1))::bigint as df, max(n)::bigint as n, round(sqrt(sum((o - e) ** 2 / e) / (max(n) * (least(count(distinct lang), count(distinct source)) - 1))), 6) as cramer_v from f")
def st_chi2(spark, d):
    return rounded(S.chi2(contingency(spark, d), "lang", "source", with_p=False))


@query("st_chi2_export", f"with {CT} select lang, source, section, round(value, 6) as value from (select lang, source, unnest(['observed', 'expected', 'residual', 'contribution']) as section, unnest([o::double, e, (o - e) / sqrt(e), (o - e) ** 2 / e]) as value from f)")
def st_chi2_export(spark, d):
    return rounded(S.long_export(contingency(spark, d), "lang", "source"))


@query("st_col_stats", f"with {CT} select source, round(sum((o - e) ** 2 / e), 6) as chi2, count(*) - 1 as df, min(struct_pack(a := -(o - e) / sqrt(e), b := lang)).b as best from f group by source")
def st_col_stats(spark, d):
    return rounded(S.column_stats(contingency(spark, d), "lang", "source"))


ORD = "select o_orderpriority as g, o_totalprice as x from orders"


@query("st_anova", f"with s as ({ORD}), p as (select g, count(x) as n, sum(x) as s, sum(x * x) as q from s group by g), t as (select count(*) as k, sum(n)::bigint as n, sum(s * s / n) as b, sum(s) as s, sum(q) as q from p) select round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) as f, k - 1 as df_between, n - k as df_within, round((b - s * s / n) / (q - s * s / n), 6) as eta2, n as n_total, n as n_used from t")
def st_anova(spark, d):
    return rounded(S.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", with_p=False))


@query("st_ttest_pairs", f"with p as (select g, count(x) as n, avg(x) as m, var_samp(x) as v from ({ORD}) group by g) select x.g as a, y.g as b, round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 6) as t, round((x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)), 4) as df from p x join p y on x.g < y.g")
def st_ttest_pairs(spark, d):
    out = S.ttests(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", with_p=False)
    return out.withColumns({"t": F.round("t", 6), "df": F.round("df", 4)})


RK = "r as (select g, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r, count(*) over (partition by x) as t from s)"


@query("st_kruskal", f"with s as (select event_type as g, value as x from events), {RK}, p as (select g, count(*) as n, sum(r) as s, sum(t * t - 1) as t from r group by g), z as (select sum(n)::double as n, count(*) as k, sum(s * s / n) as b, sum(t) as t from p) select round((12 / (n * (n + 1)) * b - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) as h, k - 1 as df, n::bigint as n_total, n::bigint as n_used from z")
def st_kruskal(spark, d):
    return rounded(S.kruskal(table(spark, d, "events"), "event_type", "value", with_p=False))


PAIR = "t as (select conv_id as block, role as model, avg(length(text)) as x from conversations group by all), w as (select block from t group by block having count(*) = (select count(distinct model) from t)), p as (select t.* from t join w using (block))"


def paired(spark, d):
    rows = table(spark, d, "conversations").withColumn("x", F.length("text"))
    return S.paired(rows, "conv_id", "role", "x")


@query("st_friedman", f"with {PAIR}, r as (select model, rank() over (partition by block order by x) + (count(*) over (partition by block, x) - 1) / 2.0 as r, count(*) over (partition by block, x) as t from p), m as (select model, sum(r) as s, count(*) as n, sum(t * t - 1) as t from r group by model), z as (select count(*)::double as k, max(n)::double as n, sum(s * s) as q, sum(t) as t from m) select round((12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))), 6) as chi2, (k - 1)::bigint as df, n::bigint as blocks, round((12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) / (n * (k - 1)), 6) as kendall_w from z")
def st_friedman(spark, d):
    return rounded(S.friedman(paired(spark, d), with_p=False))


@query("st_wilcoxon_pairs", f"with {PAIR}, d as (select x.model as a, y.model as b, x.x - y.x as d, round(abs(x.x - y.x), 12) as m from p x join p y using (block) where x.model < y.model and x.x <> y.x), r as (select a, b, d, rank() over (partition by a, b order by m) + (count(*) over (partition by a, b, m) - 1) / 2.0 as r, count(*) over (partition by a, b, m) as t from d) select a, b, count(*) as n, round(least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)), 6)::double as w, sum(t * t - 1)::double as ties from r group by a, b")
def st_wilcoxon_pairs(spark, d):
    return rounded(S.wilcoxon(paired(spark, d), with_p=False))


KS = "s as (select event_type as g, value as v from events), n as (select g, count(*) as n from s group by g), pr as (select x.g as a, y.g as b, x.n as na, y.n as nb from n x join n y on x.g < y.g), st as (select a, b, na, nb, v, sum(case when g = a then 1.0::double / na else -1.0::double / nb end) as step from s join pr on g = a or g = b group by all), gp as (select a, b, na, nb, v, abs(round(sum(step) over (partition by a, b order by v), 12)) as gap from st)"


@query("st_ks_pairs", f"with {KS} select a, b, na, nb, round(max(gap), 9) as d from gp group by all")
def st_ks_pairs(spark, d):
    return S.ks_pairs(table(spark, d, "events"), "event_type", "value", with_p=False).select("a", "b", "na", "nb", F.round("d", 9).alias("d"))


@query("st_ks", f"with {KS} select round(max(gap), 9) as d, max(na)::bigint as na, max(nb)::bigint as nb from gp where a = 'click' and b = 'view'")
def st_ks(spark, d):
    two = table(spark, d, "events").filter("event_type in ('click', 'view')")
    return S.ks_pairs(two, "event_type", "value", with_p=False).select(F.round("d", 9).alias("d"), "na", "nb")


@query("st_ks_perm")
def st_ks_perm(spark, d):
    lengths = table(spark, d, "documents").filter("lang in ('fr', 'de')").select("doc_id", "lang", "n_chars")
    return S.ks_permutation(lengths, "lang", "n_chars")


@query("wf_running", "with c as (select event_type, value as v, count(*) as c from events group by all) select event_type, v, round(sum(c) over (partition by event_type order by v)::double / sum(c) over (partition by event_type), 9) as share from c")
def wf_running(spark, d):
    return S.ecdf(table(spark, d, "events"), "event_type", "value").withColumn("share", F.round("share", 9))


@query("st_correct", "with p as (select event_id, value / 1000.0 as p from events), k as (select *, count(*) over () as m, row_number() over (order by p, event_id) as k from p) select event_id, round(p, 9) as p, round(least(1, p * m), 9) as bonferroni, round(max(least(1, p * (m - k + 1))) over (order by p, event_id rows between unbounded preceding and current row), 9) as holm, round(min(least(1, p * m / k)) over (order by p, event_id rows between current row and unbounded following), 9) as bh from k")
def st_correct(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 1000.0).alias("p"))
    return rounded(S.corrected(rows), 9)


@query("st_types", "select 'o_orderstatus' as \"column\", count(distinct o_orderstatus) as \"distinct\", count(o_orderstatus) as known, 'categorical' as kind from orders union all select 'o_totalprice', count(distinct o_totalprice), count(o_totalprice), 'numeric' from orders union all select 'o_orderpriority', count(distinct o_orderpriority), count(o_orderpriority), 'categorical' from orders")
def st_types(spark, d):
    return S.variable_types(table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("st_auto_catcat", "with c as (select o_orderstatus as x, o_orderpriority as y, count(*) as o from orders group by all), f as (select x, y, coalesce(o, 0) as o, r * k::double / n as e, n from (select x, sum(o) as r from c group by x) cross join (select y, sum(o) as k from c group by y) cross join (select sum(o)::bigint as n from c) left join c using (x, y)) select 'o_orderstatus' as a, 'o_orderpriority' as b, round(sum((o - e) ** 2 / e), 6) as chi2, max(n)::bigint as n, ((count(distinct x) - 1) * (count(distinct y) - 1))::bigint as df, round(avg((e < 5)::int), 6) as low_share from f")
def st_auto_catcat(spark, d):
    return rounded(S.auto_categories(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("st_auto_numcat", "with l as (select 'l_quantity' as num, 'l_returnflag' as cat, l_quantity as v, l_returnflag as g from lineitem union all select 'l_discount', 'l_returnflag', l_discount, l_returnflag from lineitem), p as (select num, cat, g, count(v) as n, sum(v) as s, sum(v * v) as q from l group by all), t as (select num, cat, count(*) as k, sum(n)::bigint as n, sum(s * s / n) as b, sum(s) as s, sum(q) as q from p group by all) select num, cat, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) as f, k - 1 as df_between, n - k as df_within, round((b - s * s / n) / (q - s * s / n), 8) as eta2, n as n_total, n as n_used from t")
def st_auto_numcat(spark, d):
    out = S.auto_means(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    return out.withColumns({"f": F.round("f", 5), "eta2": F.round("eta2", 8)})


@query("st_auto_numnum", "select 'l_quantity' as a, 'l_extendedprice' as b, count(*) as n, round(corr(l_quantity, l_extendedprice), 8) as pearson from lineitem union all select 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 8) from lineitem union all select 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 8) from lineitem")
def st_auto_numnum(spark, d):
    return S.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("pearson", F.round("pearson", 8))


@query("st_spearman", "with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem) select count(*) as n, round(corr(a, b), 8) as spearman from r")
def st_spearman(spark, d):
    return S.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 8))


@query("agg_crosstab", "with c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) select *, round(n::double / sum(n) over (partition by o_orderstatus), 9) as share from c")
def agg_crosstab(spark, d):
    return N.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "rows").withColumn("share", F.round("share", 9))


@query("agg_pivot", "select l_returnflag, round(sum(l_quantity) filter (where l_linestatus = 'F'), 4) as f, round(sum(l_quantity) filter (where l_linestatus = 'O'), 4) as o from lineitem group by l_returnflag")
def agg_pivot(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 4))
    return out.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("agg_groupby", "select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean, max(c_acctbal) as top from customer group by c_mktsegment")
def agg_groupby(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.max("c_acctbal").alias("top"))
