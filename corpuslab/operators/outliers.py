"""Outliers among vectors: local outlier factor and isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import vectors as V
from corpuslab.operators.ranges import quantiles
from corpuslab.operators.shared import Scratch, written


def neighbours(points: DataFrame, key: str, array_col: str, k: int) -> DataFrame:
    """key, other, d, rank: the k nearest others, by distance and key, found by comparing all with all."""
    near = V.all_pairs(points.select(F.col(key).alias("v"), F.col(array_col).cast("array<double>").alias("x")), k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("d", "other"))).withColumnRenamed("v", key)


def local_outlier_factor(points: DataFrame, key: str, array_col: str, k: int = 10, share: float = 0.05, exact: bool = True) -> DataFrame:
    """key, lof, outlier: density of the k nearest over one's own; the given share of the largest are outliers.

    Neighbours come from comparing all with all in blocks, or, not exact, from the index of vectors.py, whose recall falls where vectors fill many dimensions evenly. Equal vectors are each other's first neighbours, at distance 0; they
    are searched once and counted. A null key, vector or element leaves the row out; fewer than two vectors have no neighbours and no rows.
    """
    distinct = V.distinct_vectors(points, key, array_col)
    one = Scratch(points.sparkSession, "vectors")
    vectors = one.cut(distinct)
    near = V.all_pairs(vectors, k) if exact else V.index(vectors, max(k, V.KEPT))
    copies = vectors.select(F.col("v").alias("other"), F.col("copies").alias("n"))
    own = vectors.filter("copies > 1").select("v", F.col("v").alias("other"), F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("n"))
    rows = near.join(copies, "other").select("v", "other", "d", "n").unionByName(own)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("d", "other").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = one.cut(rows.withColumn("w", F.least(F.col("n"), k - before)).filter("w > 0").select("v", "other", "d", "w"))
    reach = near.groupBy("v").agg(F.max("d").alias("kd"))
    far = reach.select(F.col("v").alias("other"), F.col("kd").alias("other_kd"))
    mean = F.sum(F.col("w") * F.greatest("d", "other_kd")) / F.sum("w")
    density = one.cut(near.join(far, "other").groupBy("v").agg((1 / F.greatest(mean, F.lit(1e-12))).alias("lrd")))
    theirs = density.select(F.col("v").alias("other"), F.col("lrd").alias("other_lrd"))
    around = near.join(theirs, "other").groupBy("v").agg((F.sum(F.col("w") * F.col("other_lrd")) / F.sum("w")).alias("_l"))
    scored = vectors.join(around.join(density, "v").select("v", (F.col("_l") / F.col("lrd")).alias("lof")), "v").select("x", "lof")
    rows = points.select(F.col(key), F.col(array_col).cast("array<double>").alias("x")).filter(F.col(key).isNotNull())
    lof = written(rows.join(scored, "x").select(key, "lof"), "lof")
    one.drop()
    limit = quantiles(lof, [], "lof", 1 - share, "_limit")  # one row
    return lof.crossJoin(F.broadcast(limit)).select(key, "lof", (F.col("lof") > F.col("_limit")).alias("outlier"))


def isolation_forest(points: DataFrame, key: str, array_col: str, trees: int = 50, sample: int = 256, seed: int = 0) -> DataFrame:
    """key, score in (0, 1]: 2^(-mean depth / c). Each tree is grown in its own group from a sample drawn by hash; all points are then scored by all trees."""
    rows = points.select(F.col(key), F.col(array_col).cast("array<double>").alias("x"))
    n = rows.count()
    taken = min(1.0, sample / max(1, n))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(F.pmod(F.xxhash64(key, "tree", F.lit(seed)), F.lit(10**6)) < int(10**6 * taken))
    depth_limit = int(np.ceil(np.log2(max(2, sample))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(key)["x"].tolist())
        rnd = np.random.default_rng(seed * 1000 + int(pdf["tree"].iloc[0]))
        nodes: list[tuple[int, float, int, int, int]] = []

        def split(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, len(part)))
            lo, hi = part.min(0), part.max(0)
            wide = np.flatnonzero(hi > lo)
            if len(part) > 1 and depth < depth_limit and len(wide):
                j = int(rnd.choice(wide))
                cut = float(rnd.uniform(lo[j], hi[j]))
                left = split(part[part[:, j] < cut], depth + 1) if (part[:, j] < cut).any() else -1
                right = split(part[part[:, j] >= cut], depth + 1)
                if left >= 0:
                    nodes[at] = (j, cut, left, right, len(part))
            return at

        split(x, 0)
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "nodes": [[list(map(float, v)) for v in nodes]]})

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>").orderBy("tree").collect()  # `trees` rows of at most 2 * sample nodes
    model = [np.array(r["nodes"]) for r in forest]
    c = lambda m: 2 * (np.log(max(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / m if m > 1 else 0.0
    norm = max(c(min(sample, n)), 1e-9)

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist()).reshape(len(pdf), -1)
            depth = np.zeros(len(pdf))
            for nodes in model:
                at, level, live = np.zeros(len(pdf), int), np.zeros(len(pdf)), np.ones(len(pdf), bool)
                while live.any():
                    inner = live & (nodes[at, 0] >= 0)
                    rows_, j = np.flatnonzero(inner), nodes[at[inner], 0].astype(int)
                    live = inner.copy()
                    at[rows_] = np.where(x[rows_, j] < nodes[at[rows_], 1], nodes[at[rows_], 2], nodes[at[rows_], 3]).astype(int)
                    level[rows_] += 1
                depth += level + np.array([c(m) for m in nodes[at, 4]])
            yield pd.DataFrame({key: pdf[key], "score": 2 ** (-depth / max(1, len(model)) / norm)})

    return rows.mapInPandas(score, f"{key} {dict(points.dtypes)[key]}, score double")
