"""Communities of weighted graphs by the Louvain method, level by level.

A level moves vertices between communities until no move promises more than a least gain of modularity, and then folds each community into one
vertex of a smaller graph. At last the vertices of the first graph may move once more from where the levels have put them.

Moves of a round are made at once, and yet none can undo another. A community gives if the best of all moves at it leaves it, else it takes; the best
move of all is always possible. A move v: A -> B, A giving and B taking, is worth

    (k(v, B) - k(v, A)) / m + k(v) * (S(A) - k(v) - S(B)) / (2 * m^2)

(m the weight of all edges, k(v, C) that of the edges between v and C, k(v) that of all edges at v, S(C) the sum of k over C). Two moves that
share A or B change each other's worth by their edge, which never lowers it, and by - k(v) * k(u) / (2 * m^2). So with the moves of a community
ordered by worth, a move is made if its worth is still positive after k(v) * (sum of k over the earlier ones that leave A or enter B) / (2 * m^2)
has been taken off. The modularity of the graph then rises by at least the sum of these. Ties are ordered by vertex, so the result does not
depend on how rows are dealt out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpuslab.operators.ranges import running
from corpuslab.operators.shared import Scratch, written

#: Gain of modularity below which a round is the last of its level, and a level the last.
LEAST_GAIN = 1e-6
#: Edges of a graph whose rounds one task goes through.
IN_ONE_TASK = 200_000
#: Moves at one community that are ordered in one task; beyond it they are ordered by ranges.
MOST_IN_TASK = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, w: each edge in both directions, loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("w"))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")).unionByName(back)


def strengths(ways: DataFrame) -> DataFrame:
    """id, k: the weight at each vertex, loops twice."""
    return ways.groupBy(F.col("a").alias("id")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))


def proposals(ways: DataFrame, state: DataFrame, m: float) -> DataFrame:
    """id, k, c (own community), to, worth: the best move of each vertex that has a worthwhile one. state: id, k, c."""
    sums = state.groupBy("c").agg(F.sum("k").alias("s"))
    ends = state.select(F.col("id").alias("b"), F.col("c").alias("to"))
    own = state.join(sums, "c").select(F.col("id").alias("a"), "k", "c", F.col("s").alias("s_own"))
    near = ways.filter("a <> b").join(ends, "b").groupBy("a", "to").agg(F.sum("w").alias("kin")).join(own, "a")
    inside = near.filter("to = c").select("a", F.col("kin").alias("kin_own"))
    other = near.filter("to <> c").join(sums.withColumnRenamed("c", "to"), "to").join(inside, "a", "left")
    worth = (F.col("kin") - F.coalesce("kin_own", F.lit(0.0))) / m + F.col("k") * (F.col("s_own") - F.col("k") - F.col("s")) / (2 * m * m)
    best = other.withColumn("worth", F.round(worth, 12)).filter("worth > 0").groupBy("a", "k", "c").agg(F.min(F.struct((-F.col("worth")).alias("neg"), "to")).alias("b"))
    return best.select(F.col("a").alias("id"), "k", "c", F.col("b.to").alias("to"), (-F.col("b.neg")).alias("worth"))


def chosen(moves: DataFrame, m: float, many: bool) -> DataFrame:
    """id, to, sure: the moves of proposals that are made in this round, and what each adds at least. many: more than a task should order."""
    order = [F.desc("worth"), F.asc("id")]
    rank = F.struct((-F.col("worth")).alias("neg"), F.col("id"))
    leaves, enters = moves.groupBy("c").agg(F.min(rank).alias("out")), moves.groupBy(F.col("to").alias("c")).agg(F.min(rank).alias("in"))
    roles = leaves.join(enters, "c", "left").select("c", (F.col("in").isNull() | (F.col("out") <= F.col("in"))).alias("gives"))
    takes = roles.select(F.col("c").alias("to"), F.col("gives").alias("target_gives"))
    some = moves.join(roles.filter("gives").select("c"), "c").join(takes, "to", "left").filter(~F.coalesce("target_gives", F.lit(False))).drop("target_gives")
    if many:
        some = running(some, ["c"], order, {"out_before": F.col("k")}, inclusive=False)
        some = running(some, ["to"], order, {"in_before": F.col("k")}, inclusive=False)
    else:
        earlier = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        some = some.withColumns({"out_before": earlier("c"), "in_before": earlier("to")})
    sure = F.col("worth") - F.col("k") * (F.col("out_before") + F.col("in_before")) / (2 * m * m)
    return some.withColumn("sure", sure).filter("sure > 0").select("id", "to", "sure")


def told(df: DataFrame, scratch: Scratch, column: str) -> tuple[DataFrame, float, int]:
    """The rows, written, with the sum of a column and the number of rows that have it, counted in the same job."""
    seen = Observation()
    rows = scratch.cut(df.observe(seen, F.sum(column).alias("s"), F.count(column).alias("n")))
    return rows, seen.get.get("s") or 0.0, seen.get.get("n") or 0


def local_moves(ways: DataFrame, state: DataFrame, m: float, scratch: Scratch, least: float) -> tuple[DataFrame, float]:
    """state (id, k, c) after rounds of moves, and by how much modularity has risen at least."""
    risen = 0.0
    while True:
        moves, hoped, n = told(proposals(ways, state, m), scratch, "worth")
        if hoped <= least:
            return state, risen
        made = chosen(moves, m, n > MOST_IN_TASK)
        after, gain, _ = told(state.join(made, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), "sure"), scratch, "sure")
        state, risen = after.drop("sure"), risen + gain
        if gain <= 0:  # only rounding can bring this about: the best move is always made
            return state, risen


def moved_here(a: np.ndarray, b: np.ndarray, w: np.ndarray, c: np.ndarray, m: float, least: float) -> tuple[np.ndarray, float]:
    """The rounds of local_moves on arrays: communities c of vertices 0, 1, ... in their order, edges (a, b, w) both ways."""
    n = len(c)
    k = np.bincount(a, weights=np.where(a == b, 2 * w, w), minlength=n)
    a, b, w = a[a != b], b[a != b], w[a != b]
    risen = 0.0
    while True:
        s = np.bincount(c, weights=k, minlength=n)
        pair, at = np.unique(a * n + c[b], return_inverse=True)
        v, to = np.divmod(pair, n)
        kin = np.bincount(at, weights=w, minlength=len(pair))
        own = np.zeros(n)
        mine = to == c[v]
        own[v[mine]] = kin[mine]
        worth = np.round((kin - own[v]) / m + k[v] * (s[c[v]] - k[v] - s[to]) / (2 * m * m), 12)
        some = np.flatnonzero(~mine & (worth > 0))
        some = some[np.lexsort((to[some], -worth[some], v[some]))]
        some = some[np.r_[True, v[some][1:] != v[some][:-1]]] if len(some) else some
        if worth[some].sum() <= least:
            return c, risen
        some = some[np.lexsort((v[some], -worth[some]))]  # the best first
        place = np.arange(len(some))
        out, into = np.full(n, len(some)), np.full(n, len(some))
        np.minimum.at(out, c[v[some]], place)
        np.minimum.at(into, to[some], place)
        gives = (out < len(some)) & (out <= into)
        some = some[gives[c[v[some]]] & ~gives[to[some]]]
        left, entered, gain = np.zeros(n), np.zeros(n), 0.0
        after = c.copy()
        for e in some:
            x, source, target = v[e], c[v[e]], to[e]
            sure = worth[e] - k[x] * (left[source] + entered[target]) / (2 * m * m)
            left[source] += k[x]
            entered[target] += k[x]
            if sure > 0:
                after[x] = target
                gain += sure
        c, risen = after, risen + gain
        if gain <= 0:
            return c, risen


def solved_here(least: float, m: float):
    """All levels on one small graph, as a function from its edges (a, b, w) to (id, up)."""

    def solve(edges: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
        a, b, w = at[: len(edges)], at[len(edges) :], edges["w"].to_numpy()
        first = (a, b, w)
        label = np.arange(len(names))
        while True:
            n = int(max(a.max(), b.max())) + 1
            c, risen = moved_here(a, b, w, np.arange(n), m, least)
            if risen <= least:
                break
            used, c = np.unique(c, return_inverse=True)
            label = c[label]
            one = a <= b
            pair, group = np.unique(np.minimum(c[a], c[b])[one] * len(used) + np.maximum(c[a], c[b])[one], return_inverse=True)
            x, y = np.divmod(pair, len(used))
            sums = np.bincount(group, weights=w[one])
            loops = x == y
            a, b, w = np.r_[x, y[~loops]], np.r_[y, x[~loops]], np.r_[sums, sums[~loops]]
        label, _ = moved_here(*first, label, m, least)
        least_of = np.full(len(names), len(names))
        np.minimum.at(least_of, label, np.arange(len(names)))
        return pd.DataFrame({"id": names, "up": names[least_of[label]]})

    return solve


def louvain(edges: DataFrame, least: float = LEAST_GAIN, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """id, community (its least vertex), of an undirected graph with edges (src, dst, weight >= 0); vertices without edges are not in it.

    A level whose graph has at most in_one_task edges, counted, goes through the same rounds, and those of the levels above it, in one task. Edges that come twice count
    together, loops count at their vertex; null ends and weights of null or 0 are left out. An empty graph has no rows.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    graph = edges.filter("src is not null and dst is not null and weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    graph = scratch.cut(graph.agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    first = scratch.cut(both_ways(graph))
    m = first.agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("s")).first()["s"]
    labels = strengths(first).select("id", F.col("id").alias("c"))
    if m:
        m = m / 2
        ways, labels, levels = first, scratch.cut(labels), 0
        while True:
            if ways.count() <= 2 * in_one_task:
                kind = ways.schema["a"].dataType.simpleString()
                up = ways.groupBy(F.col("w") < 0).applyInPandas(solved_here(least, m), f"id {kind}, up {kind}").withColumnRenamed("id", "c")
                labels = scratch.cut(labels.join(up, "c").select("id", F.col("up").alias("c")))
                break
            levels += 1
            state = scratch.cut(strengths(ways).withColumn("c", F.col("id")))
            moved, risen = local_moves(ways, state, m, scratch, least)
            if risen <= least:
                break
            up = moved.select(F.col("id").alias("c"), F.col("c").alias("up"))
            labels = scratch.cut(labels.join(up, "c").select("id", F.col("up").alias("c")))
            a, b = up.select(F.col("c").alias("a"), F.col("up").alias("src")), up.select(F.col("c").alias("b"), F.col("up").alias("dst"))
            folded = ways.filter("a <= b").join(a, "a").join(b, "b").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            ways = scratch.cut(both_ways(folded.agg(F.sum("w").alias("weight"))))
        if levels:
            labels, _ = local_moves(first, scratch.cut(strengths(first).join(labels, "id")), m, scratch, least)
    names = labels.groupBy("c").agg(F.min("id").alias("community"))
    found = written(labels.join(names, "c").select("id", "community"), "communities")
    scratch.drop()
    return found
