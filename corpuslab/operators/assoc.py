"""Co-occurrence: pairs, pivots, log-likelihood, concordance lines, similarity of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.pvalues import binom_p_column, chi2_p_column
from corpuslab.operators.shared import written


def pairs(windows: DataFrame) -> DataFrame:
    """w1, w2, k11 for w1 < w2 from windows with sorted distinct items; a pair counts once for each window."""
    first = windows.filter(F.size("items") > 1).select("items", F.posexplode("items").alias("i", "w1"))
    both = first.select("w1", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.lit(0), F.size("items") - F.col("i") - 1))).alias("w2"))
    return both.groupBy("w1", "w2").agg(F.count("*").alias("k11"))


def presence(windows: DataFrame) -> DataFrame:
    """word, windows: in how many windows each word is."""
    return windows.select(F.explode("items").alias("word")).groupBy("word").agg(F.count("*").alias("windows"))


def degrees(pair_counts: DataFrame) -> DataFrame:
    """word, degree: the weights of a word's pairs together."""
    return pair_counts.select(F.explode(F.array("w1", "w2")).alias("word"), "k11").groupBy("word").agg(F.sum("k11").alias("degree"))


def window_degrees(windows: DataFrame) -> DataFrame:
    """What degrees gives, without the pairs: in a window of n items each has n - 1 others."""
    rows = windows.select("items", (F.size("items") - 1).cast("long").alias("_n")).select("_n", F.explode("items").alias("word"))
    return rows.groupBy("word").agg(F.sum("_n").alias("degree")).filter("degree > 0")


def density(pair_counts: DataFrame) -> DataFrame:
    words = pair_counts.select(F.explode(F.array("w1", "w2")).alias("w")).agg(F.countDistinct("w").alias("v"))
    return pair_counts.agg(F.count("*").alias("edges")).crossJoin(words).withColumn("density", F.when(F.col("v") > 1, 2 * F.col("edges") / (F.col("v") * (F.col("v") - 1))).otherwise(0.0))


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood ratio of a 2 x 2 table; negative cells count as 0."""
    a, b, c, d = (F.greatest(x, F.lit(0)).cast("double") for x in (a, b, c, d))
    n = a + b + c + d

    def cell(x: Column, row: Column, column: Column) -> Column:
        return F.when(x > 0, x * F.ln(x * n / (row * column))).otherwise(0.0)

    return 2 * (cell(a, a + b, a + c) + cell(b, a + b, b + d) + cell(c, c + d, a + c) + cell(d, c + d, b + d))


def log_likelihood(windows: DataFrame, least: int = 1, with_p: bool = True) -> DataFrame:
    """w1, w2, k11, llr (and p) of all pairs seen `least` times."""
    seen = presence(windows)
    total = windows.agg(F.count("*").alias("n"))
    x, y = (seen.select(F.col("word").alias(w), F.col("windows").alias(n)) for w, n in (("w1", "n1"), ("w2", "n2")))
    rows = pairs(windows).filter(F.col("k11") >= least).join(x, "w1").join(y, "w2").crossJoin(F.broadcast(total))
    return pair_likelihood(rows, F.col("n"), with_p)


def pair_likelihood(rows: DataFrame, n: Column | int, with_p: bool = True) -> DataFrame:
    """w1, w2, k11, llr (and p) from the windows with both words and with either (k11, n1, n2), of n windows."""
    k, n = F.col("k11"), F.lit(n)
    rows = rows.withColumn("llr", g2(k, F.col("n1") - k, F.col("n2") - k, n - F.col("n1") - F.col("n2") + k))
    out = rows.select("w1", "w2", "k11", "llr")
    return out.withColumn("p", chi2_p_column("llr", F.lit(1))) if with_p else out


def pivot_counts(windows: DataFrame, pivot: str) -> DataFrame:
    """word, a: windows that hold the word and the pivot."""
    return presence(windows.filter(F.array_contains("items", pivot))).filter(F.col("word") != pivot).withColumnRenamed("windows", "a")


def pivot_g2(windows: DataFrame, pivot: str, df: int = 3, with_p: bool = True) -> DataFrame:
    """word, a, f2, f1, t, g2 (and p) of every word seen with the pivot. A table with a negative or empty margin gives 0 and 1."""
    total = windows.agg(F.count("*").alias("t"), F.count(F.when(F.array_contains("items", pivot), 1)).alias("f1"))
    rows = pivot_counts(windows, pivot).join(presence(windows).withColumnRenamed("windows", "f2"), "word").crossJoin(F.broadcast(total))
    a, f1, f2, t = (F.col(c) for c in ("a", "f1", "f2", "t"))
    sound = (f1 - a >= 0) & (f2 - a >= 0) & (t - f1 - f2 + a >= 0) & (t > f1)
    rows = rows.withColumn("g2", F.when(sound, g2(a, f1 - a, f2 - a, t - f1 - f2 + a)).otherwise(0.0))
    out = rows.select("word", "a", "f2", "f1", "t", "g2")
    return out.withColumn("p", chi2_p_column("g2", F.lit(df))) if with_p else out


def pivot_summary(windows: DataFrame, pivot: str, by: list[str]) -> DataFrame:
    """by, windows, with_pivot, distinct and total co-occurrents."""
    base = windows.groupBy(*by).agg(F.count("*").alias("windows"), F.count(F.when(F.array_contains("items", pivot), 1)).alias("with_pivot"))
    held = windows.filter(F.array_contains("items", pivot)).select(*by, F.explode("items").alias("w")).filter(F.col("w") != pivot)
    counts = held.groupBy(*by).agg(F.countDistinct("w").alias("distinct_words"), F.count("*").alias("total_words"))
    return base.join(counts, by, "left").fillna(0, ["distinct_words", "total_words"])


def pair_lines(tokens: DataFrame, w1: str, w2: str, k: int, margin: int = 5) -> DataFrame:
    """doc_id, start, end of the distinct spans that hold both words within k places, with a margin."""
    x = tokens.filter(F.col("token") == w1).select("doc_id", F.col("pos").alias("p1"))
    y = tokens.filter(F.col("token") == w2).select("doc_id", F.col("pos").alias("p2"))
    # words meet in cells of k + 1 places, so a long text is not compared with itself
    x = x.withColumn("cell", F.explode(F.sequence(F.floor((F.col("p1") - k) / (k + 1)), F.floor((F.col("p1") + k) / (k + 1)))))
    y = y.withColumn("cell", F.floor(F.col("p2") / (k + 1)))
    near = x.join(y, ["doc_id", "cell"]).filter(F.abs(F.col("p1") - F.col("p2")) <= k)
    return near.select("doc_id", F.greatest(F.lit(0), F.least("p1", "p2") - margin).alias("start"), (F.greatest("p1", "p2") + margin).alias("end")).distinct()


def holding_all(segments: DataFrame, terms: list[str], items: str = "items") -> DataFrame:
    """Segments whose words include all the terms."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return segments.filter(F.size(F.array_except(wanted, F.col(items))) == 0)


#: Similarities of two terms from a (both), b, c (one of them), d (none).
MEASURES = {
    "cooccurrence": lambda a, b, c, d: a,
    "share": lambda a, b, c, d: a / (a + b + c + d),
    "jaccard": lambda a, b, c, d: a / (a + b + c),
    "dice": lambda a, b, c, d: 2 * a / (2 * a + b + c),
    "mozley": lambda a, b, c, d: a * (a + b + c + d) / ((a + b) * (a + c)),
    "ochiai": lambda a, b, c, d: a / F.sqrt((a + b) * (a + c)),
    "simpson": lambda a, b, c, d: a / F.least(a + b, a + c),
    "braun_blanquet": lambda a, b, c, d: a / F.greatest(a + b, a + c),
    "kulczynski2": lambda a, b, c, d: (a / (a + b) + a / (a + c)) / 2,
    "kulczynski1": lambda a, b, c, d: F.when(b + c > 0, a / (b + c)),
    "fager": lambda a, b, c, d: a / F.sqrt((a + b) * (a + c)) - F.sqrt(F.greatest(a + b, a + c)) / 2,
    "mountford": lambda a, b, c, d: F.when(a * b + a * c + 2 * b * c > 0, 2 * a / (a * b + a * c + 2 * b * c)),
    "russel": lambda a, b, c, d: a / (a + b + c + d),
    "simple_matching": lambda a, b, c, d: (a + d) / (a + b + c + d),
    "hamman": lambda a, b, c, d: (a + d - b - c) / (a + b + c + d),
    "faith": lambda a, b, c, d: (a + d / 2) / (a + b + c + d),
    "tanimoto": lambda a, b, c, d: (a + d) / (a + 2 * b + 2 * c + d),
    "phi": lambda a, b, c, d: F.when((a + b) * (a + c) * (b + d) * (c + d) > 0, (a * d - b * c) / F.sqrt((a + b) * (a + c) * (b + d) * (c + d))),
    "michael": lambda a, b, c, d: 4 * (a * d - b * c) / (F.pow(a + d, F.lit(2)) + F.pow(b + c, F.lit(2))),
    "yule1": lambda a, b, c, d: F.when(a * d + b * c > 0, (a * d - b * c) / (a * d + b * c)),
    "yule2": lambda a, b, c, d: F.when(F.sqrt(a * d) + F.sqrt(b * c) > 0, (F.sqrt(a * d) - F.sqrt(b * c)) / (F.sqrt(a * d) + F.sqrt(b * c))),
    "stiles": lambda a, b, c, d: F.when(
        ((a + b) * (a + c) * (b + d) * (c + d) > 0) & (F.abs(a * d - b * c) > (a + b + c + d) / 2),
        F.log10((a + b + c + d) * F.pow(F.abs(a * d - b * c) - (a + b + c + d) / 2, F.lit(2)) / ((a + b) * (a + c) * (b + d) * (c + d))),
    ),
}


def term_similarity(counts: DataFrame, measure: str, n_terms: int = 100, unit: str = "doc_id", above: float = 0.0) -> DataFrame:
    """src, dst, a, weight of the n_terms most frequent terms over units; weights at or under the threshold go.

    The self-join meets terms within units on at most n_terms terms each.
    """
    total = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("_s")).orderBy(F.desc("_s"), "term").limit(n_terms).select("term", "df")
    kept = counts.select(unit, "term").distinct().join(F.broadcast(total), "term")
    n = counts.agg(F.countDistinct(unit).alias("_n"))
    x, y = (kept.select(unit, F.col("term").alias(t), F.col("df").alias(f)) for t, f in (("src", "f1"), ("dst", "f2")))
    both = x.join(y, unit).filter("src < dst").groupBy("src", "dst", "f1", "f2").agg(F.count("*").alias("a")).crossJoin(F.broadcast(n))
    a, b, c = F.col("a").cast("double"), (F.col("f1") - F.col("a")).cast("double"), (F.col("f2") - F.col("a")).cast("double")
    d = F.col("_n").cast("double") - a - b - c
    return both.select("src", "dst", "a", MEASURES[measure](a, b, c, d).alias("weight")).filter(F.col("weight") > above)


def word_pairs(docs: DataFrame, words: Column, n_terms: int = 100, unit: str = "doc_id") -> tuple[DataFrame, int]:
    """src, dst, a (units with both), f1, f2 (with either) of the n_terms most frequent words, and the number of units with words: only those words leave a row, so no table of all (unit, term) is dealt out."""
    base = docs.select(F.col(unit).alias("u"), words.alias("w"))
    order = [F.desc("s"), F.asc("term")]
    top = [r["term"] for r in base.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("s")).orderBy(*order).limit(n_terms).collect()]
    inside = F.array_intersect("w", F.array(*[F.lit(t) for t in top]).cast("array<string>"))
    rows = base.filter(F.size("w") > 0).select("u", inside.alias("t"))
    units = written(rows.groupBy("u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("items")), "terms-of-units")
    n = units.count()
    df = units.select(F.explode("items").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    f1, f2 = (F.broadcast(df.select(F.col("term").alias(w), F.col("df").alias(f))) for w, f in (("w1", "f1"), ("w2", "f2")))  # n_terms rows
    return pairs(units).join(f1, "w1").join(f2, "w2").select(F.col("w1").alias("src"), F.col("w2").alias("dst"), F.col("k11").alias("a"), "f1", "f2"), n


def word_similarity(docs: DataFrame, words: Column, measure: str, n_terms: int = 100, unit: str = "doc_id", above: float = 0.0) -> DataFrame:
    """What term_similarity gives, from the words of each unit's rows."""
    both, n = word_pairs(docs, words, n_terms, unit)
    a, b, c = F.col("a").cast("double"), (F.col("f1") - F.col("a")).cast("double"), (F.col("f2") - F.col("a")).cast("double")
    return both.select("src", "dst", "a", MEASURES[measure](a, b, c, F.lit(float(n)) - a - b - c).alias("weight")).filter(F.col("weight") > above)


def binomial(counts: DataFrame, n_terms: int = 50, unit: str = "doc_id") -> DataFrame:
    """src, dst, a, p: how likely at least so many units hold both terms, if they were independent."""
    total = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("_s")).orderBy(F.desc("_s"), "term").limit(n_terms)
    kept = counts.select(unit, "term").join(F.broadcast(total.select("term", "df")), "term")
    n = counts.agg(F.countDistinct(unit).alias("_n"))
    x, y = (kept.select(unit, F.col("term").alias(t), F.col("df").alias(f)) for t, f in (("src", "f1"), ("dst", "f2")))
    both = x.join(y, unit).filter("src < dst").groupBy("src", "dst", "f1", "f2").agg(F.count("*").alias("a")).crossJoin(F.broadcast(n))
    return both.select("src", "dst", "a", binom_p_column(F.col("a"), F.col("_n"), F.col("f1") * F.col("f2") / (F.col("_n") * F.col("_n"))).alias("p"))


def word_binomial(docs: DataFrame, words: Column, n_terms: int = 50, unit: str = "doc_id") -> DataFrame:
    """What binomial gives, from the words of each unit's rows."""
    both, n = word_pairs(docs, words, n_terms, unit)
    n = F.lit(n).cast("long")
    return both.select("src", "dst", "a", binom_p_column(F.col("a"), n, F.col("f1") * F.col("f2") / (n * n)).alias("p"))
