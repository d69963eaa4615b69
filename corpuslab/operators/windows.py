"""Analytic columns: ranks, shares, runs, fills, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.ranges import last_known, numbered, running, with_group


def linear_scale(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """(v - min) / (max - min) within groups; a constant becomes 1/2."""
    rows = with_group(df, by, df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    lo, hi = F.col("_lo"), F.col("_hi")
    return rows.withColumn(name, F.when(hi == lo, 0.5).otherwise((F.col(value) - lo) / (hi - lo))).drop("_lo", "_hi")


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place in `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group; ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    peers = Window.partitionBy(*by, value)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(peers) - 1) / 2


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group, for many small groups; ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    peers = Window.partitionBy(*by, value)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(peers) - 1) / 2


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str, ties: str = "_ties") -> DataFrame:
    """df with the same rank for groups of any size, and the number of ties. Distinct values are counted, then ranked by ranges."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias(ties))
    mean = running(counts, by, [value], {"_upto": F.col(ties)}).select(*by, value, (F.col("_upto") - (F.col(ties) - 1) / 2).alias(name), ties)
    return with_group(df, [*by, value], mean)


def islands(df: DataFrame, flag: str, by: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Rows where the flag holds, with a number for each unbroken run: how many rows of the series before it lack the flag."""
    rows = running(df, by, order, {name: F.when(F.expr(flag), 0).otherwise(1).cast("long")})
    return rows.filter(flag)


def filled(df: DataFrame, value: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the last value known so far."""
    return last_known(df, by, order, F.col(value), name)


def with_share(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with each value's share of its group's sum."""
    rows = with_group(df, by, df.groupBy(*by).agg(F.sum(value).alias("_sum")))
    return rows.withColumn(name, F.col(value) / F.col("_sum")).drop("_sum")


def sampled(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n rows drawn without replacement by a hash of seed and key, so that the same seed draws the same rows anywhere."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


def spaced(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """n rows of each group at even distances, the first and the last among them."""
    rows = with_group(numbered(df, by, order, "_i"), by, df.groupBy(*by).agg(F.count("*").alias("_m")))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_m") - 1) / F.lit(max(1, n - 1))))
    return rows.filter(F.array_contains(at, F.col("_i") - 1)).drop("_i", "_m")


def by_quota(df: DataFrame, variable: str, order: list[Column], n: int) -> DataFrame:
    """n rows in all, each value of the variable having the same quota first, the rest by the order."""
    kinds = df.agg(F.countDistinct(variable)).first()[0]
    if kinds < 2:
        return df.orderBy(*order).limit(n)
    quota = max(1, n // kinds)
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(variable).orderBy(*order)))
    return rows.orderBy((F.col("_r") <= quota).desc(), *order).limit(n).drop("_r")
