"""Ordered work on series that may each hold a large part of all rows.

A window over a whole series, or over a whole table, is one task. Here the rows are dealt out by ranges of their order; what crosses a range
(sums so far, numbers, neighbours, the last value known) is carried by one row for each range of a series, or by copies of a few neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.shared import broadcast_if_small, written

#: Rows of a block of neighbours, at least.
BLOCK = 4096


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _part, the number of the range that a row lies in, written. Rows that the order does not tell apart lie in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def columns(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_state(rows: DataFrame, by: list[str], state: DataFrame) -> DataFrame:
    """rows with the columns of state (by, _part, ...), one row for each range of a series."""
    keys = [*by, "_part"]
    told = broadcast_if_small(state.withColumnsRenamed({c: f"_s{k}" for k, c in enumerate(keys)}))
    match = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(told[f"_s{k}"]) for k, c in enumerate(keys)])
    return rows.join(told, match).drop(*[f"_s{k}" for k in range(len(keys))])


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """df with each named sum over the rows of its series up to this one (or, not inclusive, before it)."""
    order = columns(order)
    rows = ranged(df.withColumns({f"_x{k}": x for k, x in enumerate(sums.values())}), [*columns(by), *order])
    state = rows.groupBy(*by, "_part").agg(*[F.sum(f"_x{k}").alias(f"_t{k}") for k in range(len(sums))])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(*by, "_part", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = with_state(rows, by, state).withColumns({name: F.col(f"_b{k}") + F.coalesce(F.sum(f"_x{k}").over(own), F.lit(0)) for k, name in enumerate(sums)})
    return out.drop("_part", *[f"_{a}{k}" for a in "xb" for k in range(len(sums))])


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with the place of each row in its series, from 1; the order should tell rows apart."""
    return running(df, by, order, {name: F.lit(1).cast("long")})


def carried(df: DataFrame, by: list[str], order: list[Column | str], value: Column, within: Callable, name: str, forward: bool = True) -> DataFrame:
    """df with `within` (an aggregate such as max, or last known) of the series' values up to this row: name_own within the row's range, name_far in those before it.

    Backward, the same is done in the reversed order, so that last known is the next value from this row on. Frames always grow from the first row: one that
    ends with the last row is added up anew for each row.
    """
    order = columns(order)
    rows = ranged(df.withColumn("_val", value), [*columns(by), *order])
    turned = lambda cs: cs if forward else [c.desc() for c in cs]
    w = Window.partitionBy(*by, "_part").orderBy(*turned(order))
    whole = Window.unboundedPreceding, Window.unboundedFollowing
    first = F.row_number().over(w)
    state = rows.select(*by, "_part", within(F.col("_val")).over(w.rowsBetween(*whole)).alias("_t"), first.alias("_k")).filter("_k = 1").drop("_k")
    before = Window.partitionBy(*by).orderBy(*turned([F.col("_part")])).rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(*by, "_part", within(F.col("_t")).over(before).alias("_b"))
    mine = within(F.col("_val")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return with_state(rows, by, state).withColumn("_mine", mine).drop("_val", "_part").withColumnsRenamed({"_b": f"{name}_far", "_mine": f"{name}_own"})


def last_known(df: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with the last value of its series that is known so far."""
    out = carried(df, by, order, value, lambda x: F.last(x, ignorenulls=True), name)
    return out.withColumn(name, F.coalesce(f"{name}_own", f"{name}_far")).drop(f"{name}_own", f"{name}_far")


def running_extreme(df: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str, most: bool = True, forward: bool = True) -> DataFrame:
    """df with the greatest (or least) value of its series so far (or from here on)."""
    out = carried(df, by, order, value, F.max if most else F.min, name, forward)
    return out.withColumn(name, (F.greatest if most else F.least)(f"{name}_own", f"{name}_far")).drop(f"{name}_own", f"{name}_far")


def with_neighbours(df: DataFrame, by: list[str], order: list[Column | str], before: int, after: int, made: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """df with columns made from an ordered window of which at least so many rows before and after each row can be seen.

    Series are cut into blocks with copies of the neighbours at their ends.
    """
    size = max(BLOCK, 4 * (before + after))
    rows = numbered(df, by, order, "_n")
    block = F.floor(F.col("_n") / size)
    near = F.array_distinct(F.array(F.floor((F.col("_n") - after) / size), block, F.floor((F.col("_n") + before) / size)))
    copies = rows.withColumns({"_own": block, "_block": F.explode(near)}).filter("_block >= 0")
    w = Window.partitionBy(*by, "_block").orderBy("_n")
    return copies.withColumns({name: f(w) for name, f in made.items()}).filter("_own = _block").drop("_n", "_own", "_block")


def quantiles(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by, name: the exact quantile of each series (between two values by proportion), from running counts of distinct values. Nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    rows = running(counts, by, ["_v"], {"_upto": F.col("_c")})
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_all"))
    place = (F.col("_all") - 1) * share
    at = lambda i: F.max(F.when((i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_c")), F.col("_v")))
    both = with_group(rows, by, total).groupBy(*by).agg(at(F.floor(place)).alias("_lo"), at(F.ceil(place)).alias("_hi"), F.max(place - F.floor(place)).alias("_f"))
    return both.select(*by, (F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f")).alias(name))


def with_group(df: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """df with the columns of groups, a table of one row for each series, matched also where a key is null."""
    told = broadcast_if_small(groups.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)}))
    match = reduce(lambda a, b: a & b, [df[c].eqNullSafe(told[f"_k{i}"]) for i, c in enumerate(by)], F.lit(True))
    return df.join(told, match).drop(*[f"_k{i}" for i in range(len(by))])
