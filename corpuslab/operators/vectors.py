"""Nearest neighbours among vectors: the exact search by pairs of cells (all_pairs), and a partitioned index by neighbour descent.

The index holds, for each distinct vector, the KEPT nearest that it knows of. It starts from cells of vectors on the same sides of random planes (large
cells are cut by hash, so no cell is unbounded), and improves in rounds: a vector's neighbours, and those whose neighbour it is, are likely near
to each other, so they meet in its group, and each of them learns of those that are nearer than what it has. Only pairs with a neighbour that is
new since the last round are compared. A round deals out, for each vector, at most 4 * MET vectors of half precision; the number of comparisons for
each vector does not depend on how many there are, and the number of rounds grows with their logarithm. Distances of the result are of full
precision. The index may miss neighbours: recall(), against a search of all vectors, says how many.

Equal vectors are one vertex with a count, so copies, however many, make no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.operators.shared import Scratch, written

#: Neighbours that the index keeps for each vector.
KEPT = 40
#: New and old neighbours, each way, that meet in a round.
MET = 12
#: Neighbours that a vector learns of in one group.
LEARNT = 5
#: Vectors of a first cell, about.
CELL = 100
#: A round that changes less than this share of the lists is the last.
SETTLED = 0.01
#: The exact search: numbers of a cell, distances of a strip, pairs that are measured by differences at a time.
CELL_NUMBERS = 1 << 21
STRIP = 1 << 21
PAIRS = 1 << 16


def distance(x: str, y: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def distinct_vectors(points: DataFrame, key: str, array_col: str) -> DataFrame:
    """v (least key), x, copies: a row for each distinct vector; vectors that are null or hold a null are left out."""
    rows = points.select(F.col(key).alias("v"), F.col(array_col).cast("array<double>").alias("x")).filter("v is not null and x is not null and not exists(x, e -> e is null)")
    return rows.groupBy("x").agg(F.min("v").alias("v"), F.count("*").alias("copies")).select("v", "x", "copies")


def nearer(v: np.ndarray, x: np.ndarray, fresh: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v, other, d: for each of one group the nearest others that are nearer than its limit, `most` each; at least one of a pair is fresh."""
    norm = (x * x).sum(1)
    d = np.sqrt(np.maximum(norm[:, None] + norm[None] - 2 * x @ x.T, 0))
    d[~(fresh[:, None] | fresh[None])] = np.inf
    np.fill_diagonal(d, np.inf)
    d[d >= limit[:, None]] = np.inf
    few = min(most, len(v))
    other = np.argpartition(d, few - 1, axis=1)[:, :few].ravel() if few < len(v) else np.tile(np.arange(len(v)), len(v))
    one = np.repeat(np.arange(len(v)), few)
    found = d[one, other]
    some = found < np.inf
    return v[one[some]], v[other[some]], found[some].astype(np.float64)


def meetings(rows: DataFrame, kind: T.StructType, most: int) -> DataFrame:
    """v, other, d of all groups g of rows (g, v, half, fresh, limit). Groups are small, so a task goes through many of them, sorted, a batch at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        rest = None
        for batch in chain(batches, [None]):
            if batch is None:
                if rest is None:
                    return
                table, ends = rest, [0, rest.num_rows]
            else:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                g = table.column("g").to_numpy()
                ends = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1]  # the last group may go on in the next batch
                rest = table.slice(int(ends[-1])).combine_chunks()
            v, fresh, limit = (table.column(c).to_numpy() for c in ("v", "fresh", "limit"))
            half = table.column("half").to_pylist()
            parts = [nearer(v[a:b], np.frombuffer(b"".join(half[a:b]), np.float16).reshape(b - a, -1).astype(np.float32), fresh[a:b], limit[a:b], most) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*parts, strict=True), out, strict=True)], schema=out)

    return rows.select("g", "v", "half", "fresh", "limit").repartition("g").sortWithinPartitions("g").mapInArrow(found, kind)


def halves(scale: float):
    @F.arrow_udf(T.BinaryType())
    def half(x: pa.Array) -> pa.Array:
        return pa.array([(np.array(a) / scale).astype(np.float16).tobytes() for a in x.to_pylist()], pa.binary())

    return half


def cells(planes: int, seed: int):
    """A function from vectors to the side of each plane that they are on, as one number."""

    @F.arrow_udf(T.LongType())
    def side(x: pa.Array) -> pa.Array:
        rows = np.array(x.to_pylist())
        normal = np.random.default_rng(seed).standard_normal((rows.shape[1], planes))
        return pa.array((rows @ normal > 0) @ (1 << np.arange(planes)) if planes else np.zeros(len(rows), np.int64), pa.int64())

    return side


def merged(lists: DataFrame, learnt: DataFrame, kept: int) -> DataFrame:
    """v, other, d, fresh, limit (of v's list) after what has been learnt; rows that were there are no longer fresh unless they have not met yet."""
    both = lists.select("v", "other", "d", "fresh").unionByName(learnt.select("v", "other", "d", F.lit(True).alias("fresh")))
    one = both.repartition("v").groupBy("v", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("v")
    rows = one.withColumn("_r", F.row_number().over(w.orderBy("d", "other"))).filter(F.col("_r") <= kept)
    full = F.when(F.count("*").over(w) >= kept, F.max("d").over(w)).otherwise(F.lit(float("inf")))
    return rows.withColumn("limit", full).drop("_r")


def sampled(rows: DataFrame, by: str, turn: int, most: int) -> DataFrame:
    """At most so many rows of each value of by, fresh and not, by hash; first within parts of a value, so that none is sorted as a whole."""
    order = F.xxhash64("v", "other", F.lit(turn))
    part = rows.withColumns({"_h": order, "_s": F.pmod(order, F.lit(64))})
    few = part.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_s", "fresh").orderBy("_h"))).filter(F.col("_r") <= most)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(by, "fresh").orderBy("_h"))).filter(F.col("_r") <= most).drop("_r", "_h", "_s")


def index(vectors: DataFrame, kept: int = KEPT, most_rounds: int = 20, seed: int = 0) -> DataFrame:
    """v, other, d: the kept nearest that neighbour descent finds for each of the distinct vectors (v, x), written.

    A set of fewer than two vectors has no rows. Lists may be shorter in tiny sets only.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "index")
    base = vectors.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda e: F.abs(e)))).alias("most")).first()
    kind = T.StructType([T.StructField("v", vectors.schema["v"].dataType), T.StructField("other", vectors.schema["v"].dataType), T.StructField("d", T.DoubleType())])
    if base["n"] < 2:
        return spark.createDataFrame([], kind)
    rows = scratch.cut(vectors.select("v", halves(base["most"] or 1.0)("x").alias("half"), cells(max(0, (base["n"] // CELL).bit_length() - 1), seed)("x").alias("cell")))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("_n"))
    dealt = rows.join(sizes, "cell").withColumn("_s", F.pmod(F.xxhash64("v"), F.ceil(F.col("_n") / (2 * CELL))))
    first = dealt.select(F.xxhash64("cell", "_s").alias("g"), "v", "half", F.lit(True).alias("fresh"), F.lit(float("inf")).alias("limit"))
    groups = meetings(first, kind, kept)
    # vectors that are alone in their cell begin with some others by hash
    spread = first.withColumn("g", F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(max(1, base["n"] // CELL))))
    none = spark.createDataFrame([], kind).withColumn("fresh", F.lit(True))
    lists = scratch.cut(merged(none, groups.unionByName(meetings(spread, kind, LEARNT)), kept))
    for turn in range(most_rounds):
        # what is told to whom: v's neighbours, and those that have v among theirs, meet at v
        forward = sampled(lists, "v", turn, MET)
        backward = sampled(lists.select("v", "other", "fresh"), "other", turn, MET)
        at = forward.select(F.col("v").alias("g"), F.col("other").alias("v"), "fresh").unionByName(backward.select(F.col("other").alias("g"), "v", "fresh"))
        at = at.groupBy("g", "v").agg(F.max("fresh").alias("fresh"))
        limits = lists.groupBy("v").agg(F.max("limit").alias("limit"))
        state = rows.select("v", "half").join(limits, "v", "left").fillna(float("inf"), ["limit"])
        meeting = meetings(at.join(state, "v"), kind, LEARNT)
        used = forward.filter("fresh").select("v", "other", F.lit(True).alias("used"))
        old = lists.join(used, ["v", "other"], "left").withColumn("fresh", F.col("fresh") & F.col("used").isNull())
        known = lists.select("v", "other", F.lit(True).alias("known"))
        after = merged(old, meeting, kept).join(known, ["v", "other"], "left")
        lists = scratch.cut(after.withColumn("new", F.col("known").isNull()).drop("known"))
        seen = lists.agg(F.avg(F.col("new").cast("int")).alias("share"), F.max("fresh").alias("more")).first()
        lists = lists.drop("new")
        if not seen["more"] or seen["share"] <= SETTLED:
            break
    x, y = vectors.select("v", "x"), vectors.select(F.col("v").alias("other"), F.col("x").alias("y"))
    exact = lists.select("v", "other").join(x, "v").join(y, "other").select("v", "other", distance("x", "y").alias("d"))
    found = written(exact, "neighbours")
    scratch.drop()
    return found


def nearest(x: np.ndarray, y: np.ndarray, own: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, other row, d: for each row of x the k nearest rows of y, by distance and place; own: y is x, and no row is its own neighbour.

    Squares of distances, without the row's own part, are first found by products of single precision, about a middle and to scale, which is off by a bounded
    error. Every pair that could be among the first k within it is measured by differences, so the result is exact. Rows with NaN or infinite numbers have no neighbours and are nobody's.
    """
    err, least, m = 2 * (x.shape[1] + 6) * np.finfo(np.float32).eps, 4 * x.shape[1] * np.finfo(np.float32).tiny, len(y)
    step = max(1, STRIP // max(1, m))
    with np.errstate(invalid="ignore", over="ignore"):
        sound = y[np.isfinite(y).all(1)]
        middle = sound.mean(0) if len(sound) else np.zeros(x.shape[1])
        scale = max((float(np.max(np.abs(z - middle), where=np.isfinite(z - middle), initial=0.0)) for z in (x, y)), default=0.0) or 1.0
        xs, ys = (((z - middle) / scale).astype(np.float32) for z in (x, y))
        nx, ny = (xs * xs).sum(1), (ys * ys).sum(1)
        turned, near, out = np.ascontiguousarray(-2 * ys.T), (1 - err) * ny, []
        for at in range(0, len(x), step):
            a, na = x[at : at + step], nx[at : at + step]
            low = xs[at : at + step] @ turned
            low += near
            if own:
                low[np.arange(len(a)), at + np.arange(len(a))] = np.nan
            some = low[:, : max(k, -(-m // 4))]  # the first k of some are a bound for the first k of all
            if some.shape[1] < k:
                limit = np.full(len(a), np.inf, np.float32)
            else:
                few = np.argpartition(some, k - 1, axis=1)[:, :k]
                high = np.take_along_axis(some, few, 1) + 2 * err * (2 * na[:, None] + ny[few]) + least
                limit = np.where(np.isnan(high), np.inf, high).max(1)
            r, c = np.divmod(np.flatnonzero(low <= limit[:, None]), m)
            d = np.concatenate([np.zeros(0), *(np.sqrt(((a[r[i : i + PAIRS]] - y[c[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(r), PAIRS))])
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((r[kept] + at, c[kept], d[kept]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, int) for i in range(3))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each g as one table, from batches sorted by g."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)] if len(g) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("g")[0].as_py() != g[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def packed(dtype: str):
    @F.arrow_udf(T.BinaryType())
    def pack(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(x), -1)
        return pa.array([r.tobytes() for r in rows], pa.binary())

    return pack


def all_pairs(vectors: DataFrame, kept: int, cells: int = 8) -> DataFrame:
    """v, other, d: the exact nearest, by distance and key; rows with a null key, vector or element are left out.

    Vectors are dealt into cells of at most CELL_NUMBERS numbers, about. Each pair of cells is compared in one task, both ways, a strip of distances at a time, so memory is
    bounded, and a vector is shuffled once for each cell: the comparisons grow with the square of the vectors, what is shuffled hardly faster than they do.
    """
    rows = vectors.select("v", "x").filter("v is not null and x is not null and not exists(x, e -> e is null)")
    lossless = F.min(F.forall("x", lambda e: e.cast("float").cast("double") == e))
    base = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), lossless.alias("short")).first()
    if base["least"] != base["most"]:
        raise ValueError("vectors differ in length")
    n, dims = base["n"], max(1, base["most"] or 0)
    cells, dtype = max(1, min(cells, -(-n // 256)), -(-n * dims // CELL_NUMBERS)), "float32" if base["short"] else "float64"
    kind = T.StructType([T.StructField("v", vectors.schema["v"].dataType), T.StructField("other", vectors.schema["v"].dataType), T.StructField("d", T.DoubleType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for table in grouped(batches):
            sides = []
            for cell in sorted({int(table.column("g")[0].as_py()) // cells, int(table.column("g")[0].as_py()) % cells}):
                side = table.filter(pc.equal(table.column("cell"), cell)).sort_by("v").combine_chunks()  # places are in the order of keys
                x = np.frombuffer(b"".join(side.column("x").to_pylist()), dtype).astype(np.float64)
                sides.append((side.column("v"), x.reshape(side.num_rows, -1) if side.num_rows else np.zeros((0, dims))))
            pairs = [(sides[0], sides[0])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]
            for (v, x), (other, y) in pairs:
                r, c, d = nearest(x, y, v is other, kept)
                columns = v.take(pa.array(r)).combine_chunks(), other.take(pa.array(c)).combine_chunks(), pa.array(d, pa.float64())
                yield pa.RecordBatch.from_arrays([k if isinstance(k, pa.Array) else pa.concat_arrays(k.chunks) for k in columns], schema=out)

    cell = F.pmod(F.xxhash64("v"), F.lit(cells))
    dealt = rows.select("v", packed(dtype)("x").alias("x"), cell.alias("cell")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    dealt = dealt.select((F.least("cell", "_c") * cells + F.greatest("cell", "_c")).alias("g"), "v", "x", "cell")
    first = dealt.repartition(cells * (cells + 1), "g").sortWithinPartitions("g").mapInArrow(found, kind)
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("d", "other"))).filter(F.col("_r") <= kept)
    return best.select("v", "other", "d")


def recall(found: DataFrame, vectors: DataFrame, k: int, every: int = 20) -> DataFrame:
    """asked, recall: the share of the k nearest that the index has, of each vector whose hash is divisible by `every`, against all vectors."""
    asked = vectors.filter(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("v", "x")
    pairs = asked.join(vectors.select(F.col("v").alias("other"), F.col("x").alias("y")), F.col("v") != F.col("other")).select("v", "other", distance("x", "y").alias("d"))
    nearest = lambda rows: rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("d", "other"))).filter(F.col("_r") <= k).select("v", "other")
    true = nearest(pairs)
    hits = true.join(nearest(found).withColumn("hit", F.lit(1)), ["v", "other"], "left")
    return hits.agg(F.countDistinct("v").alias("asked"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
