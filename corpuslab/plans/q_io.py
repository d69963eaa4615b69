"""Queries of readers, writers, streaming twins and sequential segmentation."""

import uuid

from pyspark.sql import functions as F

from corpuslab.operators import counts as N
from corpuslab.operators import policy as Q
from corpuslab.operators.shared import shared_dir
from corpuslab.plans.q_assoc import vectors
from corpuslab.plans.q_tokens import docs
from corpuslab.plans.registry import query, table
from corpuslab.sources import readers as R
from corpuslab.sources import writers as W
from corpuslab.sources.press import header as press_header
from corpuslab.streaming import twins


def header():
    return F.concat(F.lit("**** *lang_"), F.col("lang"), F.lit(" *source_"), F.col("source"))


def corpus_lines(spark, d):
    """The documents as lines of corpus files, one for each."""
    rows = docs(spark, d).select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("file"), F.concat(header(), F.lit("\n"), "text").alias("t"))
    return rows.select("file", F.posexplode(F.split("t", "\n")).alias("pos", "line"))


STAR = "select source || '-' || doc_id as file, lang, source, md5(trim(text, E' \\n\\t')) as texte from documents"


@query("src_starred_py", STAR)
def src_starred_py(spark, d):
    rows = R.starred(corpus_lines(spark, d))
    return rows.select("file", F.col("vars")["lang"].alias("lang"), F.col("vars")["source"].alias("source"), F.md5("texte").alias("texte"))


@query("src_starred_r", "select source || '-' || doc_id as file, lang, source, md5(trim(replace(text, chr(10), ' '), E' \\n\\t')) as texte from documents")
def src_starred_r(spark, d):
    rows = R.starred(corpus_lines(spark, d), "r")
    return rows.select("file", F.col("vars")["lang"].alias("lang"), F.col("vars")["source"].alias("source"), F.md5("texte").alias("texte"))


@query("src_build_frame", "select doc_id, 'lang' as variable, lang as value from documents union all select doc_id, 'source', source from documents")
def src_build_frame(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("variable", "value"))


@query("src_articles")
def src_articles(spark, d):
    return R.articles(table(spark, d, "pages"))


def press_pages(spark, d):
    """Two documents a page, as articles of an export: journal, date, title (the language), text, a link and an advert."""
    text = F.regexp_replace(F.regexp_replace("text", "[^\\p{L}\\p{N} .,\n]", ""), "[ \n]+", " ")
    day = F.concat((F.col("doc_id") % 28 + 1).cast("string"), F.lit(" mars 2024"))
    one = F.concat(
        F.lit('<article><div class="rdp__DocPublicationName"><span class="DocPublicationName">'), "source", F.lit(", no. 7</span></div><span class='DocHeader'>Monde, "), day,
        F.lit(", p. 3</span><p class='sm-margin-TopNews titreArticleVisu rdp__articletitle'>"), F.upper("lang"), F.lit("</p><p>"), F.trim(text), F.lit(" <a href='x'>link</a></p><aside>advert</aside></article>"),
    )
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 2).alias("page_id"), "doc_id", one.alias("h"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"])
    return rows.groupBy("page_id").agg(F.concat(F.lit("<html>"), F.array_join(parts, ""), F.lit("</html>")).alias("html"))


@query("src_press", r"""
with t as (select doc_id, lang, source, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N} .,\n]', '', 'g'), '[ \n]+', ' ', 'g')) as x, doc_id % 28 + 1 as day from documents),
n as (select *, row_number() over (partition by doc_id // 2 order by doc_id) - 1 as article, trim(upper(lang) || ' ' || x) as y from t)
select doc_id // 2 as page_id, article::int as article, source || ', no. 7' as journal, '2024-03-' || lpad(day::varchar, 2, '0') as date, upper(lang) as title,
       '**** *source_' || source || ' *date_2024-03-' || lpad(day::varchar, 2, '0') || ' *am_2024-03 *annee_2024' as header, md5(case when y like '%.' then y else y || '.' end) as text from n""")
def src_press(spark, d):
    found = R.press_articles(press_pages(spark, d))
    return found.select("page_id", "article", "journal", F.col("date").cast("string").alias("date"), "title", press_header(found).alias("header"), F.md5("text").alias("text"))


@query("src_rainette_docs", "select doc_id, substr(text, 1, 80) as text from documents where regexp_matches(text, '(?i)tion') order by doc_id limit 30")
def src_rainette_docs(spark, d):
    return R.cluster_documents(docs(spark, d), "tion", 30, 80).select("doc_id", "text")


@query("src_posts_flat", "select conv_id, turn, count(*) over (partition by conv_id) as n_comments from conversations")
def src_posts_flat(spark, d):
    posts = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("commentaires"))
    return R.flat_posts(posts).select("conv_id", F.col("comment.turn").alias("turn"), F.col("n_comments").cast("long").alias("n_comments"))


@query("src_timestamps", "select floor(epoch_us(ts)::double / 1e6)::bigint % 86400 as second, string_agg(event_type, ' ' order by event_id) as text from events group by 1")
def src_timestamps(spark, d):
    rows = table(spark, d, "events")
    return R.timed_text(rows.select(F.date_format("ts", "HH:mm:ss").alias("start"), F.col("event_type").alias("text"), "event_id"), order="event_id")


@query("src_annotations", "select substr(text, 3, 8) as text, lang as label from documents where length(text) >= 10")
def src_annotations(spark, d):
    item = F.array(F.struct(F.col("lang").alias("tag"), F.lit(2).alias("start"), F.lit(10).alias("end")))
    return R.flat_annotations(docs(spark, d).select(F.to_json(item).alias("j"), "text"), "j", "text")


@query("flt_annot_rules", "select substr(text, 3, 8) as text, lang as label from documents where length(text) >= 10 and lang not in ('fr', 'de')")
def flt_annot_rules(spark, d):
    return R.annotation_rules(src_annotations(spark, d), ["nothing"], ["FR", "De"])


@query("flt_annot_include", r"with t as (select lower(text) as text from documents) select 'ART' as label, sum(len(regexp_extract_all(text, '\bthe\b')))::bigint as n from t union all select 'PRE', sum(len(regexp_extract_all(text, '\bof\b')))::bigint from t")
def flt_annot_include(spark, d):
    return R.included_annotations(docs(spark, d), {"the": "ART", "of": "PRE"}).groupBy("label").agg(F.count("*").alias("n"))


@query("flt_sections")
def flt_sections(spark, d):
    return docs(spark, d).select("doc_id", R.kept_sections(F.col("text"), ["the", "les"], keep=False).alias("text"))


@query("flt_paragraph_terms")
def flt_paragraph_terms(spark, d):
    return R.articles(table(spark, d, "pages"), "texte", ("The ",)).select("page_id", "text")


@query("snk_starred", "select md5('**** *lang_' || lang || ' *source_' || source || chr(10) || text || chr(10) || chr(10)) as value from documents")
def snk_starred(spark, d):
    return W.starred_blocks(docs(spark, d), header()).select(F.md5("value").alias("value"))


@query("snk_md_table", "select '| ' || doc_id || ' | ' || lang || ' | a\\|b |' as value from documents")
def snk_md_table(spark, d):
    return W.markdown_rows(docs(spark, d).select("doc_id", "lang", F.lit("a|b").alias("x")))


def through_files(spark, df, kind):
    """Written to the shared folder and read again."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    if kind == "csv":
        W.write_csv(df, path)
        return spark.read.csv(path, header=True)
    df.write.text(path)
    return spark.read.text(path)


@query("snk_csv", "select event_type, printf('%.6f', sum(value)) as total from events group by event_type")
def snk_csv(spark, d):
    sums = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    return through_files(spark, sums, "csv")


@query("snk_json", """select case when lang is null then '{"doc_id":' || doc_id || '}' else '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' end as value from documents""")
def snk_json(spark, d):
    return through_files(spark, W.as_json(docs(spark, d).select("doc_id", "lang")), "text")


@query("snk_report_txt", "select printf('%-8s %10.3f', event_type, sum(value)) as value from events group by event_type")
def snk_report_txt(spark, d):
    sums = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    return through_files(spark, W.report_lines(sums, "%-8s %10.3f", "event_type", "total"), "text")


@query("snk_graph")
def snk_graph(spark, d):
    from corpuslab.operators.graph import vertices
    from corpuslab.plans.q_more import word_graph

    edges, path = word_graph(spark, d), f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    W.write_graph(vertices(edges), edges, path)
    return spark.read.csv(f"{path}/vertices", header=True)


@query("src_txt_multi", "with r as (select source, doc_id % 4 as part, md5(text) as h from documents) select source, part::int as part, count(*) as lines, md5(string_agg(h || chr(10), '' order by h)) as text from r group by source, part")
def src_txt_multi(spark, d):
    """A text file for each source and quarter, read again as whole texts."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    rows = docs(spark, d).select("source", (F.col("doc_id") % 4).cast("int").alias("part"), F.md5("text").alias("value"))
    rows.repartition("source", "part").sortWithinPartitions("source", "part", "value").write.partitionBy("source", "part").text(path)
    found = R.read_texts(spark, f"{path}/source=*/part=*/*.txt")
    name = lambda key: F.regexp_extract("file", rf"/{key}=([^/]+)/", 1)
    return found.select(name("source").alias("source"), name("part").cast("int").alias("part"), F.regexp_count("text", F.lit("\n")).cast("long").alias("lines"), F.md5("text").alias("text"))


def nation_file(spark, d):
    """A dictionary file made of the nations, with blanks round the keys and one blank key."""
    path = f"{shared_dir(spark)}/connectors-{uuid.uuid4().hex}"
    entry = F.struct(F.concat(F.lit(" "), "n_name", F.lit("\t")).alias("key"), F.col("n_regionkey").cast("string").alias("label"))
    entries = table(spark, d, "nation").agg(F.collect_list(entry).alias("e"))
    entries.select(F.to_json(F.map_from_entries(F.concat("e", F.array(F.struct(F.lit("  ").alias("key"), F.lit("none").alias("label")))))).alias("value")).write.text(path)
    return f"{path}/*.txt"


@query("src_connectors", "select n_name as connector, n_regionkey::varchar as label from nation")
def src_connectors(spark, d):
    return spark.createDataFrame(list(R.read_connectors(spark, nation_file(spark, d)).items()), "connector string, label string")


@query("src_connectors_check", "select n_regionkey::varchar as label, count(*) as entries from nation group by 1")
def src_connectors_check(spark, d):
    checked = R.checked_connectors(R.read_connectors(spark, nation_file(spark, d)))
    return spark.createDataFrame(list(checked.items()), "connector string, label string").groupBy("label").agg(F.count("*").alias("entries"))


@query("src_regex_rules", r"select r_name as label, '\b' || lower(r_name) || '\b' as regex from region")
def src_regex_rules(spark, d):
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    rule = F.struct(F.col("r_name").alias("label"), F.concat(F.lit(r"\b"), F.lower("r_name"), F.lit(r"\b")).alias("regex"))
    table(spark, d, "region").agg(F.collect_list(rule).alias("patterns")).write.json(path)
    return spark.createDataFrame(R.read_rules(spark, path), "label string, regex string")


@query("seg_policy")
def seg_policy(spark, d):
    return Q.segments_policy(docs(spark, d))


@query("cl_hier")
def cl_hier(spark, d):
    pairs = N.cosine(vectors(spark, d), "source").collect()  # a row for each pair of sources
    distance = {(r["a"], r["b"]): 1 - r["cosine"] for r in pairs}
    names = sorted({n for p in distance for n in p})
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            distance.setdefault((a, b), 1.0)
    return spark.createDataFrame(Q.average_linkage(names, distance), "a string, b string, height double, size int")


def streamed(spark, d, make, name, windows=False, files=1000):
    """Run a streaming query over the events file until it is done, and read what it wrote.

    Windows that the watermark has not passed are closed by a second run of the same query, from its checkpoint, which finds one more row: a marker a day after the last
    event. It comes when all events, in however many batches, have gone through, so it makes none of them late; its own window stays open and is never written.
    """
    events = table(spark, d, "events")
    schema = events.schema
    read = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream = read(f"{d}/events.parquet*")
    if windows:
        events.limit(0).write.parquet(f"{base}/marker")
        stream = stream.unionByName(read(f"{base}/marker"))
    out = make(stream)

    def run():
        out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    if windows:
        last = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).alias("ts"))
        last.select(*[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{base}/marker")
        run()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_second_bins")
def stream_second_bins(spark, d):
    return streamed(spark, d, lambda s: twins.second_bins(s, "ts", "value", "1 hour"), "bins", windows=True)


@query("stream_sessions")
def stream_sessions(spark, d):
    return streamed(spark, d, lambda s: twins.sessions(s, "ts", "user_id"), "sessions", windows=True)


MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("stream_seconds", "select strftime(date_trunc('second', ts::timestamp), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n, min(value) as low, max(value) as high, round((min(value) + max(value)) / 2, 6) as middle from events group by all")
def stream_seconds(spark, d):
    out = streamed(spark, d, lambda s: twins.second_bins(s, "ts", "value", "1 second"), "seconds", windows=True)
    return out.select(F.date_format("start", MICROS).alias("start"), "n", "low", "high", F.round("middle", 6).alias("middle"))


@query("stream_user_runs", "with g as (select user_id, ts::timestamp as ts, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as fresh from events), k as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S.%f') as \"end\", count(*) as n from k group by user_id, k")
def stream_user_runs(spark, d):
    out = stream_sessions(spark, d)
    return out.select("user_id", F.date_format("start", MICROS).alias("start"), F.date_format("end", MICROS).alias("end"), "n")


@query("stream_dedup")
def stream_dedup(spark, d):
    return streamed(spark, d, lambda s: twins.first_texts(s, "ts", "props", "1 day"), "dedup").select("event_id", "props")


