"""Counts and summaries of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import tokens as K
from corpuslab.operators.ranges import numbered


def corpus_stats(docs: DataFrame, head: int = 160) -> DataFrame:
    """texts, tokens, forms, hapax, and the line of ln(frequency) on ln(rank) over the `head` most frequent forms."""
    counts = K.tokens(docs).groupBy("token").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "token").limit(head)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    line = ranked.agg(F.round(F.regr_slope(F.ln("n"), F.ln("rank")), 6).alias("slope"), F.round(F.regr_intercept(F.ln("n"), F.ln("rank")), 6).alias("intercept"))
    forms = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("forms"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax"))
    return docs.agg(F.count("*").alias("texts")).crossJoin(forms).crossJoin(line)  # three one-row tables


def per_thousand(part: Column, whole: Column, base: int = 1000) -> Column:
    return F.when(whole > 0, part / whole * base).otherwise(0.0)


def readability(docs: DataFrame, by: list[str]) -> DataFrame:
    """by, sentences, words, syllables, ease, grade (reading ease and grade level of each group's texts) and band; all 0 without words, but the band, which is then 7."""
    words = T.words_flesch("text")
    sentences = F.size(F.filter(F.split("text", r"[.!?;:]+|\n+"), lambda x: F.btrim(x, F.lit(" \n\t\r")) != ""))
    rows = docs.select(*by, sentences.alias("s"), F.size(words).alias("w"), F.aggregate(F.transform(words, T.syllables), F.lit(0).cast("long"), lambda a, x: a + x).alias("y"))
    sums = rows.groupBy(*by).agg(F.sum("s").alias("sentences"), F.sum("w").alias("words"), F.sum("y").alias("syllables"))
    sums = sums.withColumn("sentences", F.when(F.col("words") > 0, F.col("sentences")).otherwise(0))
    per_sentence, per_word = F.col("words") / F.greatest(F.col("sentences"), F.lit(1)), F.col("syllables") / F.greatest(F.col("words"), F.lit(1))
    out = sums.withColumns({"ease": F.when(F.col("words") > 0, F.round(206.835 - 1.015 * per_sentence - 84.6 * per_word, 6)).otherwise(0.0)})
    out = out.withColumn("grade", F.when(F.col("words") > 0, F.round(0.39 * per_sentence + 11.8 * per_word - 15.59, 6)).otherwise(0.0))
    ease = F.col("ease")
    band = F.when(ease >= 90, 1).when(ease >= 80, 2).when(ease >= 70, 3).when(ease >= 60, 4).when(ease >= 50, 5).when(ease >= 30, 6).otherwise(7)
    return out.withColumn("band", band)


def jsd(left: DataFrame, right: DataFrame) -> DataFrame:
    """word, p_a, p_b, score (its part of the Jensen-Shannon divergence, base 2), oriented (negative where A has more), share, dominant.

    left and right: (token) tables; both are counted first, so only vocabularies meet.
    """

    def distribution(t: DataFrame, name: str) -> DataFrame:
        counts = t.groupBy("token").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("_t"))
        return counts.crossJoin(F.broadcast(total)).select("token", (F.col("n") / F.col("_t")).alias(name))

    both = distribution(left, "p_a").join(distribution(right, "p_b"), "token", "full_outer").fillna(0.0, ["p_a", "p_b"])
    a, b = F.col("p_a"), F.col("p_b")
    m = (a + b) / 2
    part = lambda p: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    rows = both.withColumn("score", (part(a) + part(b)) / 2)
    total = rows.agg(F.sum("score").alias("_total"))
    rows = rows.crossJoin(F.broadcast(total))
    return rows.select(
        F.col("token").alias("word"), "p_a", "p_b", "score", F.when(a >= b, -F.col("score")).otherwise(F.col("score")).alias("oriented"),
        F.when(F.col("_total") > 0, 100 * F.col("score") / F.col("_total")).otherwise(0.0).alias("share"), F.when(a >= b, "A").otherwise("B").alias("dominant"),
    )


def tfidf(tokens: DataFrame, unit: str) -> DataFrame:
    """unit, term, tf, weight: raw counts times ln((1 + n) / (1 + df)) + 1, each unit's vector of length 1."""
    counts = tokens.groupBy(F.col(unit), F.col("token").alias("term")).agg(F.count("*").alias("tf"))
    units = counts.select(unit).distinct().agg(F.count("*").alias("_n"))
    df = counts.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(units))
    raw = counts.join(df, "term").withColumn("_w", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    norm = raw.groupBy(F.col(unit).alias("_u")).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return raw.join(norm, raw[unit].eqNullSafe(norm["_u"])).select(unit, "term", "tf", (F.col("_w") / F.col("_l")).alias("weight"))


def cosine(vectors: DataFrame, unit: str) -> DataFrame:
    """a, b, cosine for all pairs of units a < b from (unit, term, weight) with vectors of length 1; units are few."""
    x = vectors.select(F.col(unit).alias("a"), "term", F.col("weight").alias("wa"))
    y = vectors.select(F.col(unit).alias("b"), "term", F.col("weight").alias("wb"))
    return x.join(y, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def group_text(docs: DataFrame, by: list[str], order: str = "doc_id", text_col: str = "text", part_rows: int = 64) -> DataFrame:
    """label ("a = x | b = y", blank values as unspecified), part, text: the texts of each combination in order, blank line between, in parts of so many.

    A group's whole text is its parts in order, with blank lines between them; as one row it would be as large as the group.
    """
    named = [F.concat(F.lit(f"{c} = "), F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Non spécifié"))) for c in by]
    rows = numbered(docs.select(F.concat_ws(" | ", *named).alias("label"), order, text_col), ["label"], [order, text_col], "_i")
    texts = F.array_sort(F.collect_list(F.struct("_i", text_col)))
    parts = rows.groupBy("label", F.floor((F.col("_i") - 1) / part_rows).alias("part")).agg(texts.alias("_t"))
    return parts.select("label", "part", F.array_join(F.transform("_t", lambda x: x[text_col]), "\n\n").alias("text"))


def crosstab(df: DataFrame, rows: str, columns: str, normalise: str | None = None) -> DataFrame:
    """rows, columns, n and, if asked, its share of the row ("rows"), the column ("columns") or all ("all"); long form."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    by = {"rows": [rows], "columns": [columns], "all": []}.get(normalise)
    if by is None:
        return counts
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
