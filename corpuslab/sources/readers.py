"""Readers of corpora, dictionaries, annotations and press pages. Paths go to Spark's own readers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files. Each file is one row first: a corpus file is a document collection of moderate size, and its lines have an order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of text files; bytes that are not UTF-8 are read as Latin-1, blank files dropped."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("file", text.alias("text")).filter(F.trim("text") != "")


def starred(lines: DataFrame, dialect: str = "py", join_lines: str | None = None, by: str = "file") -> DataFrame:
    """by, record, entete, texte, vars of a corpus whose records begin with a line of four stars.

    Dialect "py": variables are *name_value of any non-blank characters, bodies keep their lines, text before the first header is dropped.
    Dialect "r": names and values of letters, digits, _ and -; the first _ parts them, a missing value is "1"; lines are joined by a blank, empty
    bodies skipped; without any header each non-blank line is a record.
    """
    header = F.col("line").startswith("****")
    w = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"_h": header, "record": F.sum(header.cast("long")).over(w)})
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line"))))
    glue = join_lines if join_lines is not None else ("\n" if dialect == "py" else " ")
    text = F.btrim(F.array_join(F.transform(body, lambda x: x["line"]), glue), F.lit(" \n\t"))
    out = rows.filter("record > 0").groupBy(by, "record").agg(F.max(F.when(F.col("_h"), F.col("line"))).alias("entete"), text.alias("texte"))
    token = r"\*[^\s_*]+_\S+" if dialect == "py" else r"\*[\p{L}\p{N}_-]+"
    pairs = F.transform(F.regexp_extract_all("entete", F.lit(token), F.lit(0)), variable_pair)
    out = out.withColumn("vars", F.map_from_entries(F.array_distinct(pairs)))
    if dialect == "r":
        none = rows.groupBy(by).agg(F.max("record").alias("_m")).filter("_m = 0").select(F.col(by).alias("_by"))
        plain = rows.join(none, rows[by] == none["_by"], "left_semi").filter(F.trim("line") != "")
        numbered = plain.select(by, (F.col("pos").cast("long") + 1).alias("record"), F.lit(None).cast("string").alias("entete"), F.trim("line").alias("texte"), F.create_map().cast("map<string,string>").alias("vars"))
        out = out.filter("texte <> ''").unionByName(numbered)
    return out


def variable_pair(token: Column) -> Column:
    name = F.substring_index(F.substring(token, F.lit(2), F.length(token)), "_", 1)
    value = F.substring(token, F.length(name) + 3, F.length(token))
    return F.struct(name.alias("key"), F.when(value == "", "1").otherwise(value).alias("value"))


def read_connectors(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys without blanks and tabs at their ends, CR LF as LF, empty ones dropped. A dictionary has some hundred entries."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "label"))
    key = F.btrim(F.replace("key", F.lit("\r\n"), F.lit("\n")), F.lit(" \t"))
    return {r["key"]: r["label"] for r in rows.select(key.alias("key"), "label").filter("key <> ''").collect()}


def checked_connectors(entries: object) -> dict[str, str]:
    if not isinstance(entries, dict) or not entries or not all(isinstance(k, str) and isinstance(v, str) for k, v in entries.items()):
        raise ValueError("a dictionary of connectors maps strings to strings and is not empty")
    return entries


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(label, regex) of a rule file, in order."""
    rows = spark.read.json(path, multiLine=True).select(F.posexplode("patterns").alias("k", "p")).orderBy("k")
    return [(r["label"], r["regex"]) for r in rows.select("k", "p.label", "p.regex").collect()]


def timed_text(df: DataFrame, time_names: tuple[str, ...] = ("time", "start", "t", "debut", "ts"), text_names: tuple[str, ...] = ("text", "texte", "caption", "value"), order: str | None = None) -> DataFrame:
    """second, text from a table with one of the named columns each: texts of one second joined in order of time, then of the order column, if given, and of text."""
    pick = lambda names: next((c for n in names for c in df.columns if c.lower() == n), None)
    t, x = pick(time_names), pick(text_names)
    if t is None or x is None:
        raise ValueError("no time or text column found")
    then = [] if order is None else [F.col(order).alias("_o")]
    rows = df.select(T.seconds_of(F.col(t).cast("string")).alias("_t"), *then, F.col(x).cast("string").alias("_x")).filter("_t is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*rows.columns))), lambda s: s["_x"]), " ")
    return rows.groupBy(F.floor("_t").alias("second")).agg(joined.alias("text"))


def flat_annotations(df: DataFrame, json_col: str, text_col: str) -> DataFrame:
    """text, label of annotation items: the label under any of its names, the snippet from offsets that fit."""
    item = "array<struct<label string, tag string, category string, text string, start int, `end` int>>"
    rows = df.select(F.col(text_col).alias("_t"), F.explode(F.from_json(json_col, item)).alias("a")).select("_t", "a.*")
    fits = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("_t"))
    snippet = F.when(fits, F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("text"))
    return rows.select(snippet.alias("text"), F.coalesce("label", "tag", "category").alias("label")).filter("text is not null and label is not null")


class ArticleParser(HTMLParser):
    """Title and paragraphs of a page's article; scripts, styles, menus and adverts are left out."""

    SKIPPED = ("script", "style", "nav", "footer", "aside")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.title, self.parts = 0, "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED or (tag == "div" and ("class", "ad") in attrs):
            self.skip += tag in self.SKIPPED
            self.inside = "ad" if tag == "div" else self.inside
        elif tag in ("h1", "p", "title"):
            self.inside = tag
            if tag == "p":
                self.parts.append("")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "title", "p", "div"):
            self.inside = ""

    def handle_data(self, data):
        if self.skip or not self.inside or self.inside == "ad":
            return
        if self.inside == "h1":
            self.title.append(data)
        elif self.inside == "p" and self.parts:
            self.parts[-1] += data


def articles(pages: DataFrame, mode: str = "titre_texte", stop_paragraphs: tuple[str, ...] = (), patterns: tuple[str, ...] = (), key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, text of web pages: paragraphs with a stop term go, patterns and "(lien : ...)" are removed; mode "titre_texte" puts the title first."""
    drop = [re.compile(p) for p in (*patterns, r"\(lien : [^)]*\)")]

    def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, page in zip(pdf[key], pdf[html], strict=True):
                parser = ArticleParser()
                parser.feed(page or "")
                title = " ".join("".join(parser.title).split())
                body = "\n".join(t for p in parser.parts if (t := " ".join(p.split())) and not any(s in t for s in stop_paragraphs))
                for d in drop:
                    body = d.sub("", body)
                rows.append((k, title, f"{title}\n{body}".strip() if mode == "titre_texte" else body.strip()))
            yield pd.DataFrame(rows, columns=[key, "title", "text"])

    return pages.select(key, html).mapInPandas(made, f"{key} long, title string, text string")


def cluster_documents(docs: DataFrame, pattern: str, n: int, longest: int, seed: int | None = None, text_col: str = "text") -> DataFrame:
    """The first (or by seed, drawn) n documents that match, cut to a length; a pattern that is no regex is taken literally."""
    try:
        re.compile(pattern)
        found = docs.filter(F.col(text_col).rlike("(?i)" + pattern))
    except re.error:
        found = docs.filter(F.lower(text_col).contains(pattern.lower()))
    order = [F.col("doc_id")] if seed is None else [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    return found.orderBy(*order).limit(n).withColumn(text_col, F.substring(text_col, 1, longest))


def flat_posts(posts: DataFrame, comments: str = "commentaires") -> DataFrame:
    """A row for each comment, with the number of the post's comments; posts without comments are kept."""
    n = F.coalesce(F.size(comments), F.lit(0))
    return posts.withColumns({"n_comments": F.greatest(n, F.lit(0)), "comment": F.explode_outer(comments)}).drop(comments)


def kept_sections(text: Column, headings: list[str], keep: bool) -> Column:
    """An article's text by sections (a heading is a short line with a capital first): those whose heading begins with one named, or the others; the lead always."""
    parts = F.split(text, r"\n(?=\p{Lu}[^\n.]{0,60}\n)")
    head = lambda p: T.strip_accents(F.lower(F.trim(F.split(p, "\n")[0])))
    named = lambda p: F.coalesce(F.array_max(F.array(*[head(p).startswith(h) for h in headings])), F.lit(False))
    rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: named(p) if keep else ~named(p))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "\n")


def annotation_rules(items: DataFrame, exclude_texts: list[str], exclude_labels: list[str]) -> DataFrame:
    """Items (text, label) without those excluded by text, or by label in any case."""
    return items.filter(~F.col("text").isin(*exclude_texts) & ~F.lower("label").isin(*[x.lower() for x in exclude_labels]))


def included_annotations(df: DataFrame, include: dict[str, str], text_col: str = "text") -> DataFrame:
    """text, label of every occurrence of the listed texts, between borders of words and in any case, with the label that the rules give it."""

    def items(text: str, label: str) -> Column:
        return F.transform(F.regexp_extract_all(text_col, F.lit(rf"(?iU)\b\Q{text}\E\b"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit(label).alias("label")))

    return df.select(F.inline(F.concat(*[items(t, label) for t, label in include.items()])))


from corpuslab.sources.press import press_articles  # noqa: E402, F401
