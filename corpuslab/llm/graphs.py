"""Connected components of a link table, by hooking and pointer jumping in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch

#: Parts into which the rows of one root are dealt in joins, so that a component with a third of all nodes is not one task.
SALTS = 16


def components(links: DataFrame, out: Scratch) -> DataFrame:
    """node, root for all nodes of (a, b), root the least node of the component; written to out.

    Each round hooks every root to the least root among its neighbours, shortens the chains until all point to roots, and keeps the
    links between different roots. A node with very many links is one row for each task after the partial minimum. A round's tables are
    removed once the next one's are written.
    """
    kept = Scratch(links.sparkSession, "components")
    edges = kept.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = kept.cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        step, after = Scratch(links.sparkSession, "hooks"), Scratch(links.sparkSession, "components")
        hooks = step.cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
            longer = with_salts(hooks, "up", "node").join(all_salts(above, "_node"), ["_salt", "_key"], "left")
            moved = step.cut(longer.select("node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")))
            hooks = moved.select("node", "up")
            if moved.filter("moved").isEmpty():
                break
        labels = after.cut(_replaced(labels, "root", "node", hooks))
        edges = _replaced(_replaced(edges, "a", "b", hooks), "b", "a", hooks).filter("a <> b")
        edges = after.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        step.drop()
        kept.drop()
        kept = after
    labels = out.cut(labels)
    kept.drop()
    return labels


def with_salts(df: DataFrame, key: str, by: str) -> DataFrame:
    """df with its key as _key, and _salt: the part of the key's rows that this row lies in."""
    return df.withColumns({"_key": F.col(key), "_salt": F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")})


def all_salts(df: DataFrame, key: str) -> DataFrame:
    """df, with one row for each key, once for each part."""
    return df.withColumns({"_key": F.col(key), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})


def _replaced(df: DataFrame, column: str, by: str, hooks: DataFrame) -> DataFrame:
    up = all_salts(hooks.select(F.col("node").alias("_node"), F.col("up").alias("_up")), "_node")
    return with_salts(df, column, by).join(up, ["_salt", "_key"], "left").withColumn(column, F.coalesce("_up", column)).select(*df.columns)
