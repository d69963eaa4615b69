"""What characterises classes: signed chi-squared and likelihood ratio of terms, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.pvalues import chi2_p_column
from corpuslab.operators.assoc import g2
from corpuslab.operators.shared import broadcast_if_small, written


def class_terms(counts: DataFrame, cls: str, unit: str = "doc_id", with_p: bool = True) -> DataFrame:
    """class, term, chi2 (signed: negative where the term is rarer than expected), lr, occ_st, occ_total, eff_st, eff_total, share, frequency, p.

    chi2 is on occurrences, without continuity correction; eff counts units. counts: (unit, class, term, n).
    """
    cell = counts.groupBy(F.col(cls).alias("class"), "term").agg(F.sum("n").alias("occ_st"), F.count("*").alias("eff_st"))
    size = counts.groupBy(F.col(cls).alias("class")).agg(F.sum("n").alias("_class"), F.countDistinct(unit).alias("_units"))
    return from_cells(cell, size, with_p)


def word_class_terms(docs: DataFrame, words: Column, cls: str, unit: str = "doc_id", with_p: bool = True) -> DataFrame:
    """What class_terms gives, from the words of each unit's row: words are counted by class where they stand, so no table of all (unit, term) is dealt out.

    A unit with several rows of a class has them counted together, on a way of its own.
    """
    rows = docs.select(F.col(unit).alias("u"), F.col(cls).alias("class"), words.alias("w"))
    twice = written(docs.groupBy(F.col(unit).alias("u"), F.col(cls).alias("class")).agg(F.count("*").alias("_n")).filter("_n > 1").select("u", "class"), "repeated-units")
    parts = [rows]
    if not twice.isEmpty():
        told = broadcast_if_small(twice.select(F.col("u").alias("_u"), F.col("class").alias("_c")))
        same = rows["u"].eqNullSafe(told["_u"]) & rows["class"].eqNullSafe(told["_c"])
        parts = [rows.join(told, same, "left_anti"), rows.join(told, same, "left_semi")]
    # a row's words, then each of them once, then a null for the row itself; a row without words has none of these (no filter, which would find the words twice)
    itself = F.when(F.size("w") > 0, F.array(F.lit(None).cast("string")))
    listed = parts[0].select("u", "class", F.size("w").alias("k"), F.posexplode(F.concat("w", F.array_distinct("w"), itself)).alias("i", "term"))
    once = (F.col("i") >= F.col("k")) & (F.col("term").isNotNull() | F.col("u").isNotNull())
    sums = [F.count(F.when(F.col("i") < F.col("k"), 1)).alias("occ_st"), F.count(F.when(once, 1)).alias("eff_st")]
    cells = listed.groupBy("class", "term").agg(*sums)
    if len(parts) > 1:
        counts = parts[1].select("u", "class", F.explode("w").alias("term")).groupBy("u", "class", "term").agg(F.count("*").alias("n"))
        more = counts.groupBy("class", "term").agg(F.sum("n").alias("occ_st"), F.count("*").alias("eff_st"))
        units = counts.groupBy("class").agg(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("occ_st"), F.countDistinct("u").alias("eff_st"))
        cells = cells.unionByName(more).unionByName(units).groupBy("class", "term").agg(F.sum("occ_st").alias("occ_st"), F.sum("eff_st").alias("eff_st"))
    cells = written(cells, "class-cells")
    size = cells.groupBy("class").agg(F.sum("occ_st").alias("_class"), F.sum(F.when(F.col("term").isNull(), F.col("eff_st"))).alias("_units"))
    return from_cells(cells.filter("term is not null"), size, with_p)


def from_cells(cell: DataFrame, size: DataFrame, with_p: bool) -> DataFrame:
    """The statistics from cells (class, term, occ_st, eff_st) and sizes (class, _class, _units)."""
    term = cell.groupBy("term").agg(F.sum("occ_st").alias("occ_total"), F.sum("eff_st").alias("eff_total"))
    # classes are few: their sizes, and the total, are broadcast
    total = size.agg(F.sum("_class").alias("_all"))
    rows = cell.join(term, "term").join(F.broadcast(size), "class").crossJoin(F.broadcast(total))
    a, b, c = F.col("occ_st").cast("double"), (F.col("occ_total") - F.col("occ_st")).cast("double"), (F.col("_class") - F.col("occ_st")).cast("double")
    d = (F.col("_all") - F.col("_class") - F.col("occ_total") + F.col("occ_st")).cast("double")
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    plain = F.when(margins > 0, F.col("_all") * F.pow(a * d - b * c, F.lit(2)) / margins).otherwise(0.0)
    expected = F.col("occ_total") * F.col("_class") / F.col("_all")
    sign = F.when(a >= expected, 1).otherwise(-1)
    out = rows.select(
        "class", "term", (sign * plain).alias("chi2"), (sign * g2(a, b, c, d)).alias("lr"), "occ_st", "occ_total", "eff_st", "eff_total",
        (100 * F.col("eff_st") / F.col("eff_total")).alias("share"), (F.col("occ_st") / F.col("_class")).alias("frequency"), (F.col("eff_st") / F.col("_units")).alias("docprop"),
    )
    return out.withColumn("p", chi2_p_column(F.abs("chi2"), F.lit(1))) if with_p else out


def class_view(stats: DataFrame, n: int = 20, least_chi2: float = 3.84, positive: bool = True) -> DataFrame:
    """The first n terms of each class by chi2, with rank; chi2 at or over the limit (in size, if negative ones are wanted)."""
    value = F.col("chi2") if positive else F.abs("chi2")
    order = Window.partitionBy("class").orderBy(F.desc("chi2"), F.desc("occ_st"), "term")
    return stats.filter(value >= least_chi2).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def class_sizes(units: DataFrame, cls: str, stats: DataFrame, n: int = 5) -> DataFrame:
    """class, units, terms: its size and first terms in one string."""
    best = class_view(stats, n).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    sizes = units.groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("units"))
    return sizes.join(best, "class", "left")
