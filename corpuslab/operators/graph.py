"""Word graphs as vertex and edge tables: spanning trees, communities, ego networks, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.shared import written


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: rounds of a loop start from there, with a plan and a size of their own."""
    return written(df, "round")


def ego(edges: DataFrame, word: str) -> DataFrame:
    return edges.filter((F.col("src") == word) | (F.col("dst") == word))


def merged(graphs: list[DataFrame]) -> DataFrame:
    """src, dst, weight, origin: the largest weight of each edge over the graphs, and the first graph that has it."""
    both = None
    for k, g in enumerate(graphs):
        one = g.select("src", "dst", "weight", F.lit(k).alias("origin"))
        both = one if both is None else both.unionByName(one)
    best = F.min(F.struct((-F.col("weight")).alias("neg"), "origin"))
    return both.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", (-F.col("b.neg")).alias("weight"), F.col("b.origin").alias("origin"))


def vertices(edges: DataFrame) -> DataFrame:
    """id, degree, strength."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def pointed_to_roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with every up a root, by doubling."""
    while True:
        above = hooks.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        moved = kept(hooks.join(above, hooks["up"] == above["_n"], "left").select("node", F.coalesce("_u", "up").alias("up"), (F.col("_u") != F.col("up")).alias("m")))
        hooks = moved.select("node", "up")
        if moved.filter("m").isEmpty():
            return hooks


def maximum_tree(edges: DataFrame) -> DataFrame:
    """The edges of a maximum spanning forest, by rounds in which every component takes its best edge.

    Ties go to the smaller (src, dst), so that no cycle can close.
    """
    edges = kept(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).filter("src < dst"))
    labels = kept(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
    tree = edges.limit(0)
    while True:
        a, b = (labels.select(F.col("id").alias(e), F.col("c").alias(k)) for e, k in (("src", "ca"), ("dst", "cb")))
        across = kept(edges.join(a, "src").join(b, "dst").filter("ca <> cb").select("src", "dst", "weight", "ca", "cb"))
        if across.isEmpty():
            return tree
        key = F.struct((-F.col("weight")).alias("neg"), "src", "dst", "ca", "cb")
        sides = across.select(F.col("ca").alias("c"), key.alias("k")).union(across.select(F.col("cb").alias("c"), key.alias("k")))
        best = kept(sides.groupBy("c").agg(F.min("k").alias("k")).select("c", "k.*"))
        tree = kept(tree.union(best.select("src", "dst", (-F.col("neg")).alias("weight"))).distinct())
        other = best.select(F.col("c").alias("node"), F.when(F.col("c") == F.col("ca"), F.col("cb")).otherwise(F.col("ca")).alias("up"))
        # two components that chose each other: the lesser is the root
        back = other.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        mutual = other.join(back, (other["up"] == back["_n"]) & (other["node"] == back["_u"]), "left")
        hooks = kept(mutual.select("node", F.when(F.col("_n").isNotNull() & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
        roots = pointed_to_roots(hooks).select(F.col("node").alias("_c"), "up")
        labels = kept(labels.join(roots, labels["c"] == roots["_c"], "left").select("id", F.coalesce("up", "c").alias("c")))


def label_propagation(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, community: each vertex takes the label with the most weight among its neighbours and itself, the least of ties, all at once, until no label changes.

    Labels that come back to where they were two rounds before (vertices that swap for ever) end it as well: the lesser label of both rounds stays. It is an
    error if neither has happened after so many rounds.
    """
    both = kept(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")))
    loops = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    both = kept(both.union(loops.select("src", "dst", "weight")))
    labels = kept(both.select(F.col("src").alias("id")).distinct().withColumns({"community": F.col("id"), "before": F.col("id")}))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.round("w", 9)).alias("neg"), "community")).alias("b"))
        after = best.select(F.col("src").alias("id"), F.col("b.community").alias("next")).join(labels, "id")
        after = kept(after.select("id", F.col("next").alias("community"), F.col("community").alias("before"), (F.col("next") != F.col("community")).alias("moved"), (F.col("next") != F.col("before")).alias("new")))
        seen = after.agg(F.max("moved").alias("moved"), F.max("new").alias("new")).first()
        labels = after.select("id", "community", "before")
        if not seen["moved"] or not seen["new"]:
            return labels.select("id", F.least("community", "before").alias("community"))
    raise RuntimeError(f"labels still change after {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """communities, q of a labelling."""
    total = edges.agg(F.sum("weight").alias("m"))
    a, b = (labels.select(F.col("id").alias(e), F.col("community").alias(k)) for e, k in (("src", "ca"), ("dst", "cb")))
    inside = edges.join(a, "src").join(b, "dst").filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = edges.select("src", "weight").union(edges.select("dst", "weight")).join(a, "src").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("ends"))
    rows = ends.join(inside, "c", "left").fillna(0.0, ["inside"]).crossJoin(F.broadcast(total))
    return rows.agg(F.count("*").alias("communities"), F.sum(F.col("inside") / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), F.lit(2))).alias("q"))
