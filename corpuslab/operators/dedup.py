"""Exact duplicates, repeated page headers and footers, page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T


def exact(docs: DataFrame, order: str = "doc_id", text_col: str = "text", short: int = 300) -> DataFrame:
    """docs with copy (an earlier one has the same text) and short (fewer words than the limit). The text's hash, not the text, is shuffled with the order."""
    digest = F.sha2(F.coalesce(text_col, F.lit("")), 256)
    keyed = docs.withColumn("_h", digest)
    first = keyed.groupBy("_h").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_h").withColumns({"copy": F.col(order) > F.col("_first"), "short": F.size(T.words(text_col)) < short}).drop("_h", "_first")


def page_lines(pages: DataFrame, doc: str, page: str, text_col: str = "text") -> DataFrame:
    """doc, page, from_top, from_end, line of non-empty lines."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(doc, page, F.size(lines).alias("_n"), F.posexplode(lines).alias("from_top", "line"))
    return rows.withColumn("from_end", F.col("_n") - 1 - F.col("from_top")).drop("_n")


def repeated_edges(lines: DataFrame, doc: str, page: str, longest: int = 3, ratio: float = 0.6) -> DataFrame:
    """doc, edge ("top" or "end"), k, block: runs of k first or last lines found on at least max(2, ratio * pages) pages."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("_pages"))
    out = None
    for edge, place in (("top", "from_top"), ("end", "from_end")):
        near = lines.filter(F.col(place) < longest).groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(place, "line"))).alias("_l"))
        runs = near.select(doc, page, F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("k"), "_l").select(doc, page, "k", F.array_join(F.transform(F.slice("_l", F.lit(1), F.col("k")), lambda x: x["line"]), "\n").alias("block"))
        found = runs.groupBy(doc, "k", "block").agg(F.count("*").alias("n")).join(pages, doc).filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(ratio * F.col("_pages"))))
        one = found.select(doc, F.lit(edge).alias("edge"), "k", "block", "n")
        out = one if out is None else out.union(one)
    return out


def without_edges(lines: DataFrame, edges: DataFrame, doc: str, page: str) -> DataFrame:
    """Lines without the longest repeated run at each edge of their page."""
    out = lines
    for edge, place in (("top", "from_top"), ("end", "from_end")):
        blocks = edges.filter(F.col("edge") == edge).select(doc, "k", "block")
        near = lines.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.when(F.col(place) < 10, F.struct(place, "line")))).alias("_l"))
        hit = near.join(blocks, doc).filter(F.array_join(F.transform(F.slice("_l", F.lit(1), F.col("k")), lambda x: x["line"]), "\n") == F.col("block"))
        cut = hit.groupBy(doc, page).agg(F.max("k").alias("_cut"))
        out = out.join(cut, [doc, page], "left").filter(F.col("_cut").isNull() | (F.col(place) >= F.col("_cut"))).drop("_cut")
    return out


def without_page_numbers(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """Lines without those of digits alone that lie, unbroken, at either edge of their page."""
    number = F.col("line").rlike("^[0-9]+$").cast("int")
    down = Window.partitionBy(doc, page).orderBy("from_top").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(doc, page).orderBy("from_end").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({"_a": F.min(number).over(down), "_b": F.min(number).over(up)}).filter("_a = 0 and _b = 0").drop("_a", "_b")
