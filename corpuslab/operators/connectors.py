"""A dictionary of connectors (key -> label) applied to texts: counts, densities, matrices, segments between connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def pattern(keys: list[str], mode: str = "any_word") -> str:
    """The connectors as one group, in any case; see functions.text.connector_pattern."""
    return f"(?iU)({T.connector_pattern(keys, mode)})"


def connector_counts(docs: DataFrame, labels: dict[str, str], by: list[str] = (), mode: str = "edge_alnum", text_col: str = "text") -> DataFrame:
    """by, connector, label, n: each key counted on its own, so one inside another counts twice; keys not found go.

    The end of a line that begins with four stars is no connector.
    """
    text = T.without_header_ends(text_col)
    found = [F.struct(F.lit(k).alias("connector"), F.lit(v).alias("label"), F.regexp_count(text, F.lit(pattern([k], mode))).alias("c")) for k, v in labels.items()]
    rows = docs.select(*by, F.explode(F.array(*found)).alias("s")).select(*by, "s.*")
    return rows.groupBy(*by, "connector", "label").agg(F.sum("c").alias("n")).filter("n > 0")


def label_counts(docs: DataFrame, labels: dict[str, str], by: list[str] = (), mode: str = "edge_alnum", text_col: str = "text") -> DataFrame:
    """by, label, n: matches of one alternation, which do not overlap."""
    names = F.create_map(*[F.lit(x) for k, v in {k.lower(): v for k, v in labels.items()}.items() for x in (k, v)])
    hits = F.regexp_extract_all(T.without_header_ends(text_col), F.lit(pattern(list(labels), mode)), F.lit(1))
    rows = docs.select(*by, F.explode(hits).alias("hit")).withColumn("label", names[F.lower(F.regexp_replace("hit", "\r\n", "\n"))])
    return rows.groupBy(*by, "label").agg(F.count("*").alias("n"))


def filled_labels(counts: DataFrame, docs: DataFrame, labels: dict[str, str], by: list[str]) -> DataFrame:
    """The counts with a row of 0 for each group and label that has none; groups and labels are few."""
    names = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in sorted(set(labels.values()))])).alias("label"))
    grid = docs.select(*by).distinct().crossJoin(names)
    return grid.join(counts, [*by, "label"], "left").fillna(0, ["n"])


def densities(docs: DataFrame, labels: dict[str, str], by: list[str] = (), base: int = 1000, mode: str = "any_word", text_col: str = "text") -> DataFrame:
    """by, connectors, words, density: connectors for `base` words."""
    rows = docs.select(*by, F.regexp_count(text_col, F.lit(pattern(list(labels), mode))).alias("c"), F.size(T.words(text_col)).alias("w"))
    sums = rows.groupBy(*by).agg(F.sum("c").alias("connectors"), F.sum("w").alias("words"))
    return sums.withColumn("density", F.when(F.col("words") > 0, F.col("connectors") / F.col("words") * base).otherwise(0.0))


def densities_by_label(docs: DataFrame, labels: dict[str, str], by: list[str] = (), base: int = 1000, mode: str = "any_word", text_col: str = "text") -> DataFrame:
    """by, label, connectors, words, density, each label matched on its own; rows of 0 are kept."""
    of = {v: [k for k, w in labels.items() if w == v] for v in sorted(set(labels.values()))}
    found = [F.struct(F.lit(v).alias("label"), F.regexp_count(text_col, F.lit(pattern(keys, mode))).alias("c")) for v, keys in of.items()]
    rows = docs.select(*by, F.size(T.words(text_col)).alias("w"), F.explode(F.array(*found)).alias("s")).select(*by, "w", "s.*")
    sums = rows.groupBy(*by, "label").agg(F.sum("c").alias("connectors"), F.sum("w").alias("words"))
    return sums.withColumn("density", F.when(F.col("words") > 0, F.col("connectors") / F.col("words") * base).otherwise(0.0))


def matrix(docs: DataFrame, labels: dict[str, str], mode: str = "strip", unit: str = "doc_id") -> DataFrame:
    """unit, connector, n: without empty rows and columns."""
    return connector_counts(docs, labels, [unit], mode).select(unit, "connector", "n")


def segments(docs: DataFrame, labels: dict[str, str], punctuation: bool = False, mode: str = "any_word", keys: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, k, segment, before, after, n_words: pieces of a text between connectors (and, if asked, ends of clauses).

    Kept are pieces with words that touch a connector (before, after: the connector, or null); a text without connectors is one piece.
    """
    body = T.strip_meta(text_col)
    word = T.connector_pattern(list(labels), mode)
    found = T.cut_at("_body", f"(?iU){word}" + (r"|[.!?;:]+" if punctuation else ""))
    is_connector = lambda x: F.when(x.rlike(f"(?iU)^(?:{word})$"), x)
    cut = F.transform("_p", lambda x, i: F.struct(
        i.alias("k"), F.trim(x["piece"]).alias("segment"), is_connector(F.when(i > 0, F.get("_p", i - 1)["mark"])).alias("before"), is_connector(x["mark"]).alias("after"),
    ))
    alone = F.col("_body").rlike(f"(?iU){word}")
    rows = docs.select(*keys, body.alias("_body")).select(*keys, (~alone).alias("_alone"), found.alias("_p"), "_body")
    whole = F.array(F.struct(F.lit(0).alias("k"), F.trim("_body").alias("segment"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    touching = F.filter(cut, lambda x: x["before"].isNotNull() | x["after"].isNotNull())
    kept = rows.select(*keys, F.inline(F.when(F.col("_alone"), whole).otherwise(touching)))
    return kept.withColumn("n_words", F.size(T.words("segment"))).filter("n_words > 0")


def length_stats(segs: DataFrame, by: list[str], short: int = 5) -> DataFrame:
    """by, segments, total, lms (mean length), sd (population), low, high, cv, median, share_short."""
    n = F.col("n_words")
    sums = segs.groupBy(*by).agg(F.count("*").alias("segments"), F.sum(n).alias("total"), F.avg(n).alias("lms"), F.stddev_pop(n).alias("sd"), F.median(n).alias("median"), F.avg((n <= short).cast("double")).alias("share_short"))
    return sums.withColumns({"low": F.greatest(F.lit(0.0), F.col("lms") - F.col("sd")), "high": F.col("lms") + F.col("sd"), "cv": F.when(F.col("lms") > 0, F.col("sd") / F.col("lms"))})


def pooled_stats(per_row: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, segments, lms (all lengths over all segments), median_of_medians, mean_sd from the rows' length_stats."""
    return per_row.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum("segments").alias("segments"), (F.sum("total") / F.sum("segments")).alias("lms"), F.median("median").alias("median_of_medians"), F.avg("sd").alias("mean_sd")
    )


def subcorpus(docs: DataFrame, labels: dict[str, str], header: Column, text_col: str = "text") -> DataFrame:
    """doc_id, text: the header and only those sentences that hold a connector; the header alone if none does."""
    sentences = F.split(text_col, r"\r?\n+|(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: s.rlike(pattern(list(labels), "strip")))
    return docs.select("doc_id", F.concat_ws("\n", header, F.nullif(F.array_join(kept, "\n"), F.lit(""))).alias("text"))


def pattern_counts(segs: DataFrame, literal: str, by: list[str], text_col: str = "segment") -> DataFrame:
    """by, n: occurrences of a literal pattern."""
    return segs.groupBy(*by).agg(F.sum(F.regexp_count(text_col, F.lit(rf"(?i)\Q{literal}\E"))).alias("n"))


def rule_counts(segs: DataFrame, rules: list[tuple[str, str]], text_col: str = "segment") -> DataFrame:
    """label, segments, n of each rule (label, regex), matched within segments; a rule listed twice counts twice."""
    found = [F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"), F.regexp_count(text_col, F.lit(f"(?iU){regex}")).alias("n")) for k, (label, regex) in enumerate(rules)]
    rows = segs.select(F.explode(F.array(*found)).alias("s")).select("s.*").filter("n > 0")
    return rows.groupBy("label").agg(F.count("*").alias("segments"), F.sum("n").alias("n"))
