"""Tests on grouped values and contingency tables. Statistics are aggregates; p-values are a column function on the result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import pvalues as P
from corpuslab.operators.ranges import numbered, running, running_extreme, with_group
from corpuslab.operators.shared import broadcast_if_small, written
from corpuslab.operators.windows import average_rank, with_average_rank


def cells(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Every cell of the table (absent ones as 0) with expected, residual, contribution and their sums by row; long form.

    Rows and columns of a contingency table are few.
    """
    rows, cols = counts.groupBy(row).agg(F.sum(n).alias("row_total")), counts.groupBy(column).agg(F.sum(n).alias("column_total"))
    total = counts.agg(F.sum(n).alias("total"))
    grid = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total))
    observed = counts.groupBy(row, column).agg(F.sum(n).alias("observed"))
    full = grid.join(observed, [row, column], "left").fillna(0, ["observed"]).withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("total"))
    o, e = F.col("observed"), F.col("expected")
    return full.withColumns({"residual": F.when(e > 0, (o - e) / F.sqrt(e)).otherwise(0.0), "contribution": F.when(e > 0, F.pow(o - e, F.lit(2)) / e).otherwise(0.0)})


def chi2(counts: DataFrame, row: str, column: str, n: str = "n", yates: str | bool = False, with_p: bool = True) -> DataFrame:
    """chi2, df, n, cramer_v (and p). yates: False, True, or "auto" for tables with one degree of freedom."""
    full = cells(counts, row, column, n)
    sums = full.agg(F.sum("contribution").alias("plain"), F.countDistinct(row).alias("r"), F.countDistinct(column).alias("c"), F.max("total").alias("n"), F.sum(F.when(F.col("expected") > 0, F.pow(F.greatest(F.lit(0.0), F.abs(F.col("observed") - F.col("expected")) - 0.5), F.lit(2)) / F.col("expected"))).alias("corrected"))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    corrected = F.lit(True) if yates is True else (df == 1) if yates == "auto" else F.lit(False)
    out = sums.select(F.when(corrected, F.col("corrected")).otherwise(F.col("plain")).alias("chi2"), df.alias("df"), "n", F.least(F.col("r"), F.col("c")).alias("_k"))
    out = out.withColumn("cramer_v", F.when((F.col("_k") > 1) & (F.col("n") > 0), F.sqrt(F.col("chi2") / (F.col("n") * (F.col("_k") - 1))))).drop("_k")
    return out.withColumn("p", P.chi2_p_column("chi2", "df")) if with_p else out


def long_export(counts: DataFrame, row: str, column: str) -> DataFrame:
    """All cell columns of the table as (row, column, section, value)."""
    full = cells(counts, row, column)
    names = ["observed", "expected", "residual", "contribution"]
    return full.select(row, column, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([row, column], names, "section", "value")


def column_stats(counts: DataFrame, row: str, column: str) -> DataFrame:
    """column, chi2, df, class of the largest residual."""
    full = cells(counts, row, column)
    best = F.min(F.struct((-F.col("residual")).alias("neg"), F.col(row).alias("r")))
    return full.groupBy(column).agg(F.sum("contribution").alias("chi2"), (F.count("*") - 1).alias("df"), best.alias("b")).select(column, "chi2", "df", F.col("b.r").alias("best"))


def anova(df: DataFrame, group: str, value: str, by: list[str] = (), with_p: bool = True) -> DataFrame:
    """by, f, df_between, df_within, eta2, n_total, n_used (and p). Nulls and NaN are counted in n_total only."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    per = df.groupBy(*by, group).agg(F.count("*").alias("_all"), F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    used = F.col("n") > 0
    s = per.groupBy(*by).agg(F.sum("_all").alias("n_total"), F.sum("n").alias("n_used"), F.count(F.when(used, 1)).alias("k"), F.sum(F.when(used, F.col("s") * F.col("s") / F.col("n"))).alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n_used"), F.col("q") - F.col("b")
    d1, d2 = F.col("k") - 1, F.col("n_used") - F.col("k")
    out = s.filter("k > 1 and n_used > k").select(*by, ((between / d1) / (within / d2)).alias("f"), d1.alias("df_between"), d2.alias("df_within"), (between / (between + within)).alias("eta2"), "n_total", "n_used")
    return out.withColumn("p", P.f_p_column("f", "df_between", "df_within")) if with_p else out


def ttests(df: DataFrame, group: str, value: str, pooled: bool = False, with_p: bool = True) -> DataFrame:
    """a, b, t, df (and p) for each pair of groups of two or more values; Welch unless pooled."""
    per = df.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n >= 2")
    x, y = (per.select(*[F.col(c).alias(f"{c}{k}") for c in per.columns]) for k in (1, 2))
    both = x.join(y, x["g1"] < y["g2"])  # groups are few
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if pooled:
        v = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, dof = F.sqrt(v * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        a, b = v1 / n1, v2 / n2
        se, dof = F.sqrt(a + b), F.pow(a + b, F.lit(2)) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    out = both.filter(se > 0).select(F.col("g1").alias("a"), F.col("g2").alias("b"), ((F.col("m1") - F.col("m2")) / se).alias("t"), dof.alias("df"))
    return out.withColumn("p", P.t_p_column("t", "df")) if with_p else out


def ranked(df: DataFrame, value: str, name: str = "_rank") -> DataFrame:
    """df with average ranks over the whole table, and _ties. Distinct values are counted and ranked by ranges, so ties cost nothing."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_ties"))
    mean = running(counts, [], ["_v"], {"_upto": F.col("_ties")}).select("_v", (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name), "_ties")
    return df.join(mean, df[value] == mean["_v"]).drop("_v")


def kruskal(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """h (with tie correction), df, n_total, n_used (and p); no row for fewer than two groups."""
    total = df.agg(F.count("*").alias("n_total"))
    rows = ranked(df.select(group, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)"), "_x")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("_rank").alias("s"), F.sum(F.col("_ties") * F.col("_ties") - 1).alias("t"))
    s = per.agg(F.sum("n").alias("n_used"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("t").alias("t"))
    n = F.col("n_used").cast("double")
    h = (12 / (n * (n + 1)) * F.col("b") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    out = s.filter("k > 1").crossJoin(total).select(h.alias("h"), (F.col("k") - 1).alias("df"), "n_total", "n_used")
    return out.withColumn("p", P.chi2_p_column("h", "df")) if with_p else out


def paired(df: DataFrame, block: str, model: str, value: str, how: str = "mean") -> DataFrame:
    """block, model, x for the blocks that have all models."""
    x = (F.avg if how == "mean" else F.median)(value)
    table = df.groupBy(F.col(block).alias("block"), F.col(model).alias("model")).agg(x.alias("x")).filter("x is not null")
    k = table.agg(F.countDistinct("model").alias("_k"))
    whole = table.groupBy("block").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(k)).filter("_n = _k").select("block")
    return table.join(whole, "block")


def friedman(table: DataFrame, with_p: bool = True) -> DataFrame:
    """chi2 (with tie correction), df, blocks, kendall_w (and p) of (block, model, x)."""
    rows = table.withColumn("_r", average_rank("x", ["block"])).withColumn("_t", F.count("*").over(Window.partitionBy("block", "x")))
    sums = rows.groupBy("model").agg(F.sum("_r").alias("s"), F.count("*").alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("t"))
    s = sums.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("t").alias("t"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    stat = (12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)) / (1 - F.col("t") / (n * k * (k * k - 1)))
    out = s.filter("k > 1").select(stat.alias("chi2"), (F.col("k") - 1).alias("df"), F.col("n").alias("blocks"))
    out = out.withColumn("kendall_w", F.col("chi2") / (F.col("blocks") * F.col("df")))
    return out.withColumn("p", P.chi2_p_column("chi2", "df")) if with_p else out


def wilcoxon(table: DataFrame, with_p: bool = True) -> DataFrame:
    """a, b, n, w (lesser signed-rank sum; zero differences go) (and p) for each pair of models of (block, model, x)."""
    x, y = (table.select("block", F.col("model").alias(m), F.col("x").alias(v)) for m, v in (("a", "xa"), ("b", "xb")))
    d = x.join(y, "block").filter("a < b and xa <> xb").select("a", "b", (F.col("xa") - F.col("xb")).alias("d"))
    d = d.withColumn("_abs", F.round(F.abs("d"), 12))
    d = with_average_rank(d, "_abs", ["a", "b"], "_r", "_t")
    out = d.groupBy("a", "b").agg(F.count("*").alias("n"), F.least(F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("_r")).otherwise(0.0))).alias("w"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
    return out.withColumn("p", P.wilcoxon_p_column("w", "n", "ties")) if with_p else out


def ks_pairs(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """a, b, d, at (first value of the largest gap), na, nb (and p) for each pair of groups (few): gaps of the two step functions."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("c"))
    size = rows.groupBy("g").agg(F.sum("c").alias("n"))
    x, y = (size.select(F.col("g").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = x.join(y, x["a"] < y["b"])
    steps = rows.join(broadcast_if_small(pairs), (rows["g"] == pairs["a"]) | (rows["g"] == pairs["b"]))
    moved = steps.groupBy("a", "b", "na", "nb", "v").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("c") / F.col("na")).otherwise(-F.col("c") / F.col("nb"))).alias("step"))
    best = running(moved, ["a", "b"], ["v"], {"gap": F.col("step")}).withColumn("gap", F.abs(F.round("gap", 12))).groupBy("a", "b", "na", "nb").agg(F.min(F.struct((-F.col("gap")).alias("neg"), "v")).alias("m"))
    out = best.select("a", "b", (-F.col("m.neg")).alias("d"), F.col("m.v").alias("at"), "na", "nb")
    return out.withColumn("p", P.ks_p_column("d", "na", "nb")) if with_p else out


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, v, share of values at most v."""
    counts = df.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    rows = running(counts, [group], ["v"], {"upto": F.col("c")})
    return with_group(rows, [group], counts.groupBy(group).agg(F.sum("c").alias("n"))).select(group, "v", (F.col("upto") / F.col("n")).alias("share"))


def drawn(good: np.ndarray, total: int, taken: int, seed: tuple[int, ...]) -> np.ndarray:
    """For each relabelling how many of `taken` items, out of total with `good` of the first group among them, are of that group: one hypergeometric draw each.

    Beyond what the generator takes, a thousand million, the draw is a normal one of the same mean and variance, rounded.
    """
    rnd = np.random.default_rng(seed)
    if total < 10**9:
        return rnd.hypergeometric(good, total - good, taken)
    share = good / total
    spread = np.sqrt(taken * share * (1 - share) * (total - taken) / max(1, total - 1))
    least, most = np.maximum(0, taken - (total - good)), np.minimum(taken, good)
    return np.clip(np.rint(taken * share + spread * rnd.standard_normal(len(good))), least, most).astype(np.int64)


def relabelled(n: int, seed: int, na: int, totals: list[int]):
    """A function from the rows (_part, _i, c) of one range of distinct values to (r, g), the widest gap of each relabelling within the range.

    The ranges are the leaves of a binary tree. At each node the first group's items are shared out between its halves, by a draw that depends on the seed and the node only; so
    every range finds its own numbers on the way down from the root, and all ranges agree.
    """
    ends = np.r_[0, np.cumsum(totals)]

    def gaps(rows: pd.DataFrame) -> pd.DataFrame:
        part, all_rows = int(rows["_part"].iloc[0]), int(ends[-1])
        lo, hi, good, before = 0, len(totals), np.full(n, na), np.zeros(n, np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = drawn(good, int(ends[hi] - ends[lo]), int(ends[mid] - ends[lo]), (seed, lo, hi))
            if part < mid:
                hi, good = mid, left
            else:
                lo, good, before = mid, good - left, before + left
        widest, seen, rest = np.zeros(n), int(ends[lo]), int(ends[hi] - ends[lo])
        for i, c in enumerate(rows.sort_values("_i")["c"].tolist()):
            x = drawn(good, rest, c, (seed, part, len(totals) + 1, i))
            good, before, rest, seen = good - x, before + x, rest - c, seen + c
            widest = np.maximum(widest, np.abs(before / na - (seen - before) / (all_rows - na)))
        return pd.DataFrame({"r": np.arange(1, n + 1), "g": widest})

    return gaps


def ks_permutation(df: DataFrame, group: str, value: str, n: int = 2000, seed: int = 0, buckets: int = 2048) -> DataFrame:
    """d, n, p: the share of n relabellings, drawn at random by the seed, whose gap is no smaller; for two groups.

    Rows are counted by distinct value first. A relabelling is a hypergeometric number of the first group for each value, drawn down a tree of ranges of values, so the work is
    distinct values times relabellings, whatever the number of rows, and ranges, of `buckets` values each, are independent tasks. Null and NaN values are left out.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    real = ks_pairs(rows, "g", "v", with_p=False).select("d", "na", "nb")
    counts = numbered(rows.groupBy("v").agg(F.count("*").alias("c")), [], ["v"], "_i")
    counts = written(counts.withColumn("_part", F.floor((F.col("_i") - 1) / buckets)).select("_part", "_i", "c"), "values")
    sizes = [r["c"] for r in counts.groupBy("_part").agg(F.sum("c").alias("c")).orderBy("_part").collect()]  # a number for each range
    one = real.first()
    if one is None:
        return real.select("d", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("p")).limit(0)
    gaps = counts.groupBy("_part").applyInPandas(relabelled(n, seed, one["na"], sizes), "r int, g double").groupBy("r").agg(F.max("g").alias("g"))
    d = F.lit(float(one["d"]))
    return gaps.agg(d.alias("d"), F.count("*").alias("n"), F.avg((F.col("g") >= d - 1e-12).cast("double")).alias("p"))


def corrected(df: DataFrame, p: str = "p", by: list[str] = ()) -> DataFrame:
    """df (rows of tests) with bonferroni, holm and bh."""
    by, order = list(by), [p, *[c for c in df.columns if c != p and c not in by]]
    rows = with_group(numbered(df, by, order, "_i"), by, df.groupBy(*by).agg(F.count("*").alias("_m")))
    one = F.lit(1.0)
    rows = running_extreme(rows, by, ["_i"], F.least(one, F.col(p) * (F.col("_m") - F.col("_i") + 1)), "holm")
    rows = running_extreme(rows, by, ["_i"], F.least(one, F.col(p) * F.col("_m") / F.col("_i")), "bh", most=False, forward=False)
    return rows.withColumn("bonferroni", F.least(one, F.col(p) * F.col("_m"))).drop("_m", "_i")


def variable_types(df: DataFrame) -> DataFrame:
    """column, kind: numeric; categorical (2 to 10 values, 10 or more known); or other."""
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias("distinct"), F.count(c).alias("known")).alias(f"_{k}") for k, c in enumerate(df.columns)])
    rows = one.select(F.explode(F.array(*[F.col(f"_{k}") for k in range(len(df.columns))])).alias("s")).select("s.*")
    few = (F.col("distinct").between(2, 10)) & (F.col("known") >= 10)
    return rows.withColumn("kind", F.when(few & ~F.col("column").isin(*numeric), "categorical").when(F.col("column").isin(*numeric), "numeric").otherwise("other"))


def auto_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, chi2, n, df, low_share (cells expected under 5) for all pairs of categorical columns, in one aggregate."""
    both = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    long = df.select(F.explode(F.array(*both)).alias("s")).select("s.*").filter("x is not null and y is not null")
    counts = long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    keys = ["a", "b"]
    rows, cols = counts.groupBy(*keys, "x").agg(F.sum("o").alias("r")), counts.groupBy(*keys, "y").agg(F.sum("o").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("o").alias("n"))
    full = rows.join(cols, keys).join(total, keys).join(counts, [*keys, "x", "y"], "left").fillna(0, ["o"]).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    return full.groupBy(*keys).agg(F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")).alias("chi2"), F.max("n").alias("n"), ((F.countDistinct("x") - 1) * (F.countDistinct("y") - 1)).alias("df"), F.avg((F.col("e") < 5).cast("double")).alias("low_share"))


def auto_means(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """num, cat, f, eta2, ... for all (numeric, categorical) pairs, in one aggregate."""
    both = [F.struct(F.lit(x).alias("num"), F.lit(y).alias("cat"), F.col(x).cast("double").alias("v"), F.col(y).cast("string").alias("g")) for x in numeric for y in categories]
    long = df.select(F.explode(F.array(*both)).alias("s")).select("s.*").filter("v is not null and g is not null")
    return anova(long, "g", "v", ["num", "cat"], with_p=False)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, pearson for all pairs of numeric columns with both values known."""
    both = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    long = df.select(F.explode(F.array(*both)).alias("s")).select("s.*").filter("x is not null and y is not null")
    return long.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson")).filter("n >= 3")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, spearman: the correlation of average ranks."""
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    rows = ranked(ranked(rows, "_x", "_rx").drop("_ties"), "_y", "_ry")
    return rows.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))
