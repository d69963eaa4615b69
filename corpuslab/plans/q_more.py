"""Queries of graphs, factors, clusters, topics, outliers, duplicates and the remaining joins."""

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import assoc as A
from corpuslab.operators import chd as CHD
from corpuslab.operators import communities as C
from corpuslab.operators import dedup as D
from corpuslab.operators import factor as X
from corpuslab.operators import frames as R
from corpuslab.operators import graph as G
from corpuslab.operators import lexicon as L
from corpuslab.operators import outliers as O
from corpuslab.operators import stats as S
from corpuslab.operators import tokens as K
from corpuslab.operators import topics as TM
from corpuslab.plans.q_stats import rounded
from corpuslab.plans.q_tokens import TOK, docs, tok
from corpuslab.plans.registry import query, table


def word_graph(spark, d):
    return A.word_similarity(docs(spark, d), T.words_lower("text"), "jaccard", 100, above=0.05)


@query("gr_max_tree")
def gr_max_tree(spark, d):
    return G.maximum_tree(word_graph(spark, d))


@query("gr_communities")
def gr_communities(spark, d):
    return C.louvain(word_graph(spark, d))


@query("gr_propagation")
def gr_propagation(spark, d):
    return G.label_propagation(G.kept(word_graph(spark, d)))


@query("gr_modularity")
def gr_modularity(spark, d):
    edges = G.kept(word_graph(spark, d))
    found = [G.modularity(edges, f(edges)).withColumn("method", F.lit(name)) for name, f in (("louvain", C.louvain), ("propagation", G.label_propagation))]
    return rounded(found[0].unionByName(found[1]))


SIM = f"with {TOK}, c as (select doc_id, token as term, count(*) as n from tok group by all), t as (select term, count(*) as df, sum(n) as s from c group by term order by s desc, term limit 100), k as (select doc_id, term, df from c join t using (term)), e as (select x.term as src, y.term as dst, round(count(*)::double / (x.df + y.df - count(*)), 8) as weight from k x join k y using (doc_id) where x.term < y.term group by x.term, y.term, x.df, y.df having count(*)::double / (x.df + y.df - count(*)) > 0.05)"


@query("gr_ego", f"{SIM} select * from e where src = 'the' or dst = 'the'")
def gr_ego(spark, d):
    return G.ego(word_graph(spark, d), "the").select("src", "dst", F.round("weight", 8).alias("weight"))


@query("gr_merge", f"{SIM} select src, dst, greatest(weight, 0.5) as weight, case when weight >= 0.5 then 0 else 1 end as origin from e")
def gr_merge(spark, d):
    g = word_graph(spark, d).withColumn("weight", F.round("weight", 8))
    return G.merged([g, g.withColumn("weight", F.lit(0.5))])


@query("fa_ca_classes")
def fa_ca_classes(spark, d):
    counts = K.dfm(tok(spark, d, "lang"), ["lang"])
    best = K.most_frequent(counts, 200).select("term")
    rows, _, _ = X.correspondence(counts.join(F.broadcast(best), "term"), "term", "lang", 3)
    return rounded(rows, 5)


INERTIA = "with c as (select lang, source, count(*) as o from documents group by all), f as (select o, r * k::double / n as e, n from (select lang, sum(o) as r from c group by 1) cross join (select source, sum(o) as k from c group by 1) cross join (select sum(o) as n from c) left join c using (lang, source)) select round(sum((coalesce(o, 0) - e) ** 2 / e) / max(n), 6) as inertia from f"


@query("fa_ca_variables", INERTIA)
def fa_ca_variables(spark, d):
    counts = docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    _, _, values = X.correspondence(counts, "source", "lang", 4)
    return counts.agg(F.round(F.lit(float(sum(values))), 6).alias("inertia"))


@query("fa_ca_terms")
def fa_ca_terms(spark, d):
    """All terms by sources, with the coordinates of the sources: more terms than a matrix on the driver could hold."""
    counts = docs(spark, d).select("source", F.explode(T.words_lda("text")).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    rows, _, _ = X.wide_correspondence(counts, "source", "term", 2)
    return rounded(rows, 5)


@query("fa_ca_modalities")
def fa_ca_modalities(spark, d):
    """Modalities of two variables by class of quality: those of the source make the axes, those of the language are placed among them."""
    rows = docs(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("class")), "doc_id", "left")
    rows = X.modalities(rows.withColumn("class", F.coalesce("class", F.lit("none"))), ["source", "lang"]).groupBy("variable", "modality", "class").agg(F.count("*").alias("n"))
    rows = G.kept(rows)
    active = rows.filter("variable = 'source'")
    coordinates, classes, values = X.correspondence(active, "modality", "class", 2)
    by_class = classes.withColumnRenamed("class", "_c")
    more = X.supplementary(rows.filter("variable = 'lang'"), "modality", "class", classes, values)
    kinds = [("active", coordinates, "modality"), ("supplementary", more, "modality"), ("class", by_class, "_c")]
    parts = [x.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), *[a for a in x.columns if a.startswith("axis")]) for kind, x, c in kinds]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5)


@query("fa_ca_labels")
def fa_ca_labels(spark, d):
    from corpuslab.operators.connectors import connector_counts
    from corpuslab.plans.q_connectors import LABELS

    by_connector = connector_counts(docs(spark, d), LABELS, ["doc_id"], "strip")
    labels = by_connector.groupBy("doc_id", "label").agg(F.sum("n").alias("n"))
    rows, _, values = X.correspondence(labels, "doc_id", "label", 1)
    return rounded(X.supplementary(by_connector, "connector", "doc_id", rows, values), 5)


def vectors(spark, d):
    return table(spark, d, "embeddings")


@query("fa_pca")
def fa_pca(spark, d):
    return X.pca(vectors(spark, d), "embedding", "vec_id", 2)[0]


@query("cl_kmeans")
def cl_kmeans(spark, d):
    points, _ = X.pca(vectors(spark, d), "embedding", "vec_id", 2)
    return X.kmeans(points, "pc", "vec_id", range(2, 5))[0]


@query("agg_cluster_means", "with e as (select label, unnest(embedding)::double as v, unnest(range(len(embedding)))::int as i from embeddings) select label, i, round(avg(v), 6) as mean from e group by label, i")
def agg_cluster_means(spark, d):
    return rounded(vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("mean")))


@query("sim_cosine_vec", "with e as (select label, unnest(embedding)::double as v, unnest(range(len(embedding)))::int as i from embeddings), m as (select label, i, avg(v) as m from e group by all), n as (select label, sqrt(sum(m * m)) as n from m group by label) select x.label as a, y.label as b, round(sum(x.m * y.m) / (any_value(nx.n) * any_value(ny.n)), 6) as cosine from m x join m y using (i) join n nx on nx.label = x.label join n ny on ny.label = y.label where x.label < y.label group by x.label, y.label")
def sim_cosine_vec(spark, d):
    means = vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    unit = means.join(norm, "label").select("label", "i", (F.col("m") / F.col("n")).alias("u"))
    x, y = unit.select(F.col("label").alias("a"), "i", F.col("u").alias("ua")), unit.select(F.col("label").alias("b"), "i", F.col("u").alias("ub"))
    return rounded(x.join(y, "i").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")))


@query("tm_lda")
def tm_lda(spark, d):
    return TM.lda(docs(spark, d), T.words_lda("text"), 4)[0]


@query("tm_units")
def tm_units(spark, d):
    return TM.lda(docs(spark, d), T.words_lda("text"), 4)[1]


@query("tm_heat_terms")
def tm_heat_terms(spark, d):
    best = TM.lda(docs(spark, d), T.words_lda("text"), 4)[0]
    top = best.groupBy("term").agg(F.min(F.struct((-F.col("weight")).alias("neg"), "topic")).alias("b"))
    return top.select("term", F.col("b.topic").alias("topic"), (-F.col("b.neg")).alias("weight")).orderBy("topic", F.desc("weight"), "term").limit(100)


@query("an_lof")
def an_lof(spark, d):
    return O.local_outlier_factor(vectors(spark, d), "vec_id", "embedding")


@query("an_isoforest")
def an_isoforest(spark, d):
    return O.isolation_forest(vectors(spark, d), "vec_id", "embedding", 200, 256)


@query("dd_exact", r"select doc_id, doc_id > min(doc_id) over (partition by text) as copy, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) < 300 as short from documents")
def dd_exact(spark, d):
    return D.exact(docs(spark, d)).select("doc_id", "copy", "short")


def lines(spark, d):
    text = F.concat(F.lit("HEAD "), "lang", F.lit("\n"), "text", F.lit("\n"), F.col("doc_id").cast("string"))
    return D.page_lines(docs(spark, d).select("source", "doc_id", text.alias("text")), "source", "doc_id")


LINES = "ln as (select source, doc_id, unnest(range(len(t)))::int as from_top, len(t) - 1 - unnest(range(len(t))) as from_end, unnest(t) as line from (select source, doc_id, list_filter(list_transform(string_split('HEAD ' || lang || chr(10) || text || chr(10) || doc_id, chr(10)), lambda x: trim(x)), lambda x: x <> '') as t from documents))"


@query("dd_headers", f"with {LINES}, pg as (select source, count(distinct doc_id) as pages from ln group by 1), r as (select source, doc_id, 'top' as edge, k, string_agg(line, chr(10) order by from_top) as block from ln, (values (1), (2), (3)) v(k) where from_top < k group by all having count(*) = k union all select source, doc_id, 'end', k, string_agg(line, chr(10) order by from_end) from ln, (values (1), (2), (3)) v(k) where from_end < k group by all having count(*) = k) select source, edge, k, md5(block) as block, count(*) as n from r join pg using (source) group by source, edge, k, block, pages having count(*) >= greatest(2, ceil(0.4 * pages))")
def dd_headers(spark, d):
    return D.repeated_edges(lines(spark, d), "source", "doc_id", 3, 0.4).withColumn("block", F.md5("block"))


@query("dd_page_numbers", f"with {LINES}, m as (select *, min(regexp_full_match(line, '[0-9]+')::int) over (partition by source, doc_id order by from_top) as a, min(regexp_full_match(line, '[0-9]+')::int) over (partition by source, doc_id order by from_end) as b from ln) select doc_id, count(*) as kept from m where a = 0 and b = 0 group by doc_id")
def dd_page_numbers(spark, d):
    return D.without_page_numbers(lines(spark, d), "source", "doc_id").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("dd_consecutive", "select event_id, event_type from (select event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events) where p is null or p <> event_type")
def dd_consecutive(spark, d):
    return R.without_repeats(table(spark, d, "events"), ["user_id"], [F.col("event_id")], "event_type").select("event_id", "event_type")


LEX = [("the", "le", "ART"), ("and", "et", "CON"), ("of", "de", "PRE"), ("of", "des", "PRE"), ("that", "que", "PRO"), ("und", "et", "CON")]


def lexicon(spark):
    return spark.createDataFrame(LEX, "c_mot string, c_lemme string, c_morpho string")


LEXSQL = "lx as (select * from (values ('the', 'le', 'ART'), ('and', 'et', 'CON'), ('of', 'de', 'PRE'), ('of', 'des', 'PRE'), ('that', 'que', 'PRO'), ('und', 'et', 'CON')) v(c_mot, c_lemme, c_morpho))"


@query("src_lexicon", f"with {LEXSQL}, t as (select distinct p_brand as b from part) select lower(trim(b)) as c_mot, min(lower(b)) as c_lemme from t group by 1")
def src_lexicon(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("c_mot"), F.col("p_brand").alias("c_lemme"), F.lit("NOM").alias("c_morpho"))
    return L.first_forms(rows).select("c_mot", "c_lemme")


@query("jn_lemma", f"with {TOK}, {LEXSQL}, f as (select c_mot, min(c_lemme) as l from lx group by c_mot) select coalesce(l, token) as lemma, count(*) as n from tok left join f on c_mot = token group by 1")
def jn_lemma(spark, d):
    return L.lemmatised(tok(spark, d), lexicon(spark)).groupBy("lemma").agg(F.count("*").alias("n"))


@query("jn_type", f"with {TOK}, {LEXSQL}, t as (select distinct token as term from tok), f as (select c_mot, string_agg(distinct c_morpho, '|' order by c_morpho) as a from lx group by 1), g as (select c_lemme, string_agg(distinct c_morpho, '|' order by c_morpho) as b from lx group by 1) select term, coalesce(a, b) as type from t left join f on c_mot = term left join g on c_lemme = term")
def jn_type(spark, d):
    return L.term_types(tok(spark, d).select(F.col("token").alias("term")).distinct(), lexicon(spark))


@query("jn_expand", f"with {TOK}, {LEXSQL}, t as (select distinct token as term, regexp_replace(translate(trim(lower(token)), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9_]', '', 'g') as k from tok) select term, term as also from t union select term, c_mot from t join lx on c_lemme = k union select term, c_lemme from t join lx on c_mot = k")
def jn_expand(spark, d):
    terms = tok(spark, d).select(F.col("token").alias("term")).distinct()
    return L.expanded(terms, lexicon(spark))


@query("flt_pos_lexicon", f"with {TOK}, {LEXSQL}, t as (select distinct token as term from tok) select term from t where term in (select c_mot from lx where c_morpho in ('CON', 'PRE') union select c_lemme from lx where c_morpho in ('CON', 'PRE')) and term <> 'des'")
def flt_pos_lexicon(spark, d):
    terms = tok(spark, d).select(F.col("token").alias("term")).distinct()
    return L.by_category(terms, lexicon(spark), ["CON", "PRE"], without=["des"])


@query("src_expressions", "select lower(p_name) as dic_mot, min(p_brand) as dic_norm from part group by 1")
def src_expressions(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("dic_mot"), F.col("p_brand").alias("dic_norm"), F.lit("NOM").alias("dic_morpho"))
    return L.merged_expressions(part, part.withColumn("dic_norm", F.lit("other"))).select("dic_mot", "dic_norm")


@query("src_norms", 'select \'n_chars\' as "column", round(avg(n_chars), 6) as mean, sum(n_chars)::double as total from documents where lang in (\'fr\', \'es\')')
def src_norms(spark, d):
    keys = spark.range(1).select(F.explode(F.array(F.lit("FR"), F.lit("ES"))).alias("key"))
    return rounded(L.norms(docs(spark, d).select(F.col("lang").alias("ortho"), "n_chars"), keys))


@query("agg_majority_tag", f"with {TOK}, c as (select token as form, lang as tag, count(*) as n from tok group by all), r as (select *, row_number() over (partition by form order by n desc, tag) as r from c) select form, tag from r where r = 1")
def agg_majority_tag(spark, d):
    counts = tok(spark, d, "lang").groupBy(F.col("token").alias("form"), F.col("lang").alias("tag")).agg(F.count("*").alias("n"))
    return counts.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("neg"), "tag")).alias("b")).select("form", "b.tag")


@query("jn_category", "select s_suppkey, coalesce(n_name, '') as title from supplier left join nation on n_nationkey = s_nationkey and n_regionkey < 3")
def jn_category(spark, d):
    nation = table(spark, d, "nation").filter("n_regionkey < 3")
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("title"))


@query("jn_thread", "select c.conv_id, c.turn, r.turn as reply from conversations c left join conversations r on r.conv_id = c.conv_id and r.turn = c.turn + 1")
def jn_thread(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    replies = c.select(F.col("conv_id").alias("_c"), F.col("turn").alias("reply"))
    return c.join(replies, (c["conv_id"] == replies["_c"]) & (c["turn"] + 1 == replies["reply"]), "left").select("conv_id", "turn", "reply")


@query("jn_stats_ca", "with a as (select lang, count(*) as n from documents group by lang), b as (select lang, max(n_chars) as m from documents where lang <> 'es' group by lang) select a.lang, coalesce(m, n) as chi2 from a left join b using (lang)")
def jn_stats_ca(spark, d):
    a = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    b = docs(spark, d).filter("lang <> 'es'").groupBy("lang").agg(F.max("n_chars").alias("m"))
    return a.join(b, "lang", "left").select("lang", F.coalesce("m", "n").alias("chi2"))


@query("agg_terminal_sizes", "select lang as class, count(*) as units from documents group by lang having count(*) >= 0.1 * (select count(*) from documents) union all select 'none', count(*) from documents where lang in (select lang from documents group by lang having count(*) < 0.1 * (select count(*) from documents)) having count(*) > 0")
def agg_terminal_sizes(spark, d):
    sizes = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    total = docs(spark, d).agg(F.count("*").alias("all"))
    rows = sizes.crossJoin(F.broadcast(total)).withColumn("class", F.when(F.col("n") >= 0.1 * F.col("all"), F.col("lang")).otherwise("none"))
    return rows.groupBy("class").agg(F.sum("n").alias("units"))


@query("cl_double_cross", "with c as (select d.lang as a, s.quality as b, count(*) as o from documents d join labels s using (doc_id) group by all), f as (select a, b, coalesce(o, 0)::bigint as o, r * k::double / n as e from (select a, sum(o) as r from c group by a) cross join (select b, sum(o) as k from c group by b) cross join (select sum(o) as n from c) left join c using (a, b)) select a, b, o as observed, round(case when o >= e then 1 else -1 end * (o - e) ** 2 / e, 6) as chi2 from f")
def cl_double_cross(spark, d):
    first = docs(spark, d).select("doc_id", F.col("lang").alias("class"))
    second = table(spark, d, "labels").select("doc_id", F.col("quality").alias("class"))
    return CHD.crossed(first, second, none=None).select("a", "b", "observed", F.round("chi2", 6).alias("chi2"))


def class_words(spark, d):
    """Words of documents; classes are found by terms in the middle of the frequency range, and the invented languages are the classes to be found."""
    return CHD.Words(CHD.unit_words(docs(spark, d), T.words_lower("text")))


@query("cl_chd")
def cl_chd(spark, d):
    words = class_words(spark, d)
    table = words.table(10, 0.5)
    words.drop()
    return CHD.terminal(*table.classify(4), 1)


@query("cl_terminal")
def cl_terminal(spark, d):
    """Sizes of the classes that are large enough, of eight leaves."""
    words = class_words(spark, d)
    table = words.table(10, 0.5)
    words.drop()
    found = CHD.terminal(*table.classify(8, refine=0))
    return found.groupBy("class").agg(F.count("*").alias("units"))


@query("cl_double")
def cl_double(spark, d):
    """Documents by two classifications, of terms in at least 10 and in at least 30 documents, and the classes on which both agree."""
    words = class_words(spark, d)
    tables = [words.table(least, 0.5) for least in (10, 30)]
    words.drop()
    return CHD.stable_classes(*[CHD.terminal(*t.classify(4, refine=0), 1) for t in tables])


@query("cl_rainette")
def cl_rainette(spark, d):
    """Segments of 40 words, joined to 80 or more, in a tree whose classes are cut while they have 20 units."""
    words = CHD.Words(CHD.group_words(docs(spark, d), T.words_lower("text"), 40, 80))
    table = words.table(30, 0.5)
    words.drop()
    return CHD.terminal(*table.classify(3, least=20, unit="unit", refine=0), 20, "unit")
