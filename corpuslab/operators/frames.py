"""Small operators on frames of timed or plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suggested_columns(df: DataFrame, words: list[str]) -> list[str]:
    """Numeric columns whose name has one of the words; all numeric ones if none has."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    return [c for c in numeric if any(w in c.lower() for w in words)] or numeric


def without_repeats(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def capital_sentences(segments: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, start, end, sentence: sentences end before a capital; consecutive repeats go; the time of a segment is shared out evenly."""
    parts = F.split(F.trim(F.col(text)), r"(?U)(?<=[.!?])\s+(?=\p{Lu})")
    rows = segments.select(by, "start", "end", F.posexplode(parts).alias("k", "sentence"))
    rows = without_repeats(rows, [by], [F.col("start"), F.col("k")], "sentence")
    w = Window.partitionBy(by, "start", "end")
    each = (F.col("end") - F.col("start")) / F.count("*").over(w)
    place = F.row_number().over(w.orderBy("k")) - 1
    rows = rows.withColumns({"_a": F.col("start") + place * each, "_b": F.col("start") + (place + 1) * each})
    return rows.select(by, F.col("_a").alias("start"), F.col("_b").alias("end"), "sentence")
