"""Descending hierarchical classification of binary unit-term tables.

Again and again the largest class is cut in two: its units are ordered by their score on the first axis of a correspondence analysis, the cut with the
largest chi-squared between the two column profiles is taken, single units are then moved while that raises it, and each side drops the columns
that are foreign to it. Units left without columns get class 0.

A unit is one row with the numbers of its terms, in two bytes each. The terms are the most frequent ones, `most_terms` at most, so what there is of a term
(its sum, its weight on the axis) is a short vector: it comes to the driver and goes out again with the tasks. A step of the power iteration is then one
pass over the units, without a join. The cut comes from ranks and running sums by ranges; no step holds all units in one task. A unit's score and side
follow from its terms and these vectors, so they are found anew in each pass and not written: a cut writes its two daughters once, and its mother goes.
Moves are decided against frozen column sums, all at once, and halved while they do not help: the end state has the same property as one move after
another (no single move helps), not always the same members.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.graph import kept
from corpuslab.operators.ranges import running
from corpuslab.operators.shared import Scratch, broadcast_if_small, list_slices, written
from corpuslab.operators.stats import cells

#: Columns found in at most so many units of a class play no part in its cut.
RARE = 3
#: Tasks whose vectors come to the driver; beyond them, tasks that add up the vectors of others.
FEW = 64
ADDERS = 8
#: Ranges of the score at most, and cells of one of them, about.
RANGES = 32
RANGE_CELLS = 1 << 22


def unit_rows(counts: DataFrame, unit: str, most_terms: int) -> tuple[DataFrame, list[str]]:
    """(unit, ts: numbers of its terms) and the terms by number, most frequent first."""
    cells = counts.select(F.col(unit).alias("unit"), "term").distinct()
    best = cells.groupBy("term").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "term").limit(most_terms)
    names = [r["term"] for r in best.collect()]  # at most most_terms
    number = counts.sparkSession.createDataFrame(list(enumerate(names)), "t int, term string")
    held = cells.join(broadcast_if_small(number, most_terms), "term").groupBy("unit").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return kept(held), names


def repeated(docs: DataFrame, unit: str) -> DataFrame | None:
    """The units with several rows, and the one without a name; nothing if there are none."""
    found = written(docs.groupBy(F.col(unit).alias("_twice")).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col("_twice").isNull()).select("_twice"), "repeated-units")
    return None if found.isEmpty() else broadcast_if_small(found)


def unit_words(docs: DataFrame, words: Column, unit: str = "doc_id") -> DataFrame:
    """unit, w: the distinct words of each unit; units with several rows are put together on a way of their own."""
    rows, twice = docs.select(F.col(unit).alias("unit"), F.array_distinct(words).alias("w")), repeated(docs, unit)
    if twice is None:
        return rows
    same = rows["unit"].eqNullSafe(twice["_twice"])
    several = rows.join(twice, same, "left_semi").groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    return rows.join(twice, same, "left_anti").unionByName(several)


def group_words(docs: DataFrame, words: Column, size: int, least: int, unit: str = "doc_id") -> DataFrame:
    """unit (text and group), w: the distinct words of a text's segments of `size` words, joined by size_merged to `least` words or more; least is a multiple of size.

    A text in one row is cut where it stands: groups start at multiples of `least`, a short rest is part of the last one.
    """
    if least % size:
        raise ValueError(f"{least} is no multiple of {size}")

    def cut(rows: DataFrame) -> DataFrame:
        last = F.greatest(F.lit(0), F.floor(F.size("w") / least).cast("int") - 1)
        rows = rows.select(F.col(unit).alias("_u"), words.alias("w")).filter(F.size("w") > 0).select("_u", "w", F.explode(F.sequence(F.lit(0), last)).alias("g"), last.alias("last"))
        part = F.slice("w", F.col("g") * least + 1, F.when(F.col("g") == F.col("last"), F.size("w")).otherwise(least))
        return rows.select(F.concat_ws("_", F.col("_u").cast("string"), F.col("g").cast("string")).alias("unit"), F.array_distinct(part).alias("w"))

    twice = repeated(docs, unit)
    if twice is None:
        return cut(docs)
    same = docs[unit].eqNullSafe(twice["_twice"])
    cuts = F.sequence(F.lit(0), F.ceil(F.size("w") / size).cast("int") - 1)
    segs = docs.join(twice, same, "left_semi").select(unit, words.alias("w")).filter(F.size("w") > 0).select(unit, "w", F.explode(cuts).alias("seg_no"))
    segs = size_merged(segs.select(unit, "seg_no", F.slice("w", F.col("seg_no") * size + 1, F.lit(size)).alias("w")), F.size("w"), least, unit)
    name = F.concat_ws("_", F.col(unit).cast("string"), F.col("group").cast("string")).alias("unit")
    return cut(docs.join(twice, same, "left_anti")).unionByName(segs.groupBy(name).agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w")))


def numbered(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """unit, ts: the numbers of a unit's terms, ascending, two bytes each; whether it has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in (part for b in batches for part in list_slices(b, "w")):
            lists = batch.column("w")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            at = pc.index_in(lists.flatten().cast(pa.string()), known)
            number = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
            unit = np.repeat(np.arange(len(lengths)), lengths)
            cells = np.sort(unit[number >= 0] << 16 | number[number >= 0])
            yield pa.RecordBatch.from_arrays([batch.column("unit"), packed(cells >> 16, cells & 0xFFFF, len(lengths))], names=["unit", "ts"])

    return run


def packed(unit: np.ndarray, ts: np.ndarray, n: int) -> pa.Array:
    """The terms of n units, ordered by unit, as binary."""
    ends = np.r_[0, np.cumsum(np.bincount(unit, minlength=n))].astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ts.astype("<u2").tobytes())])


class Words:
    """The words of units (unit, w), written once: tables for the classification follow from them."""

    def __init__(self, units: DataFrame):
        self.spark = units.sparkSession
        self.scratch = Scratch(self.spark, "unit-words")
        self.units = self.scratch.cut(units).filter(F.size("w") > 0)
        self.total = self.units.filter("unit is not null").count()
        self.tables: dict[tuple[str, ...], tuple[DataFrame, dict]] = {}
        self.df = written(self.units.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("c")), "terms-of-units")

    def table(self, min_docs: int = 1, max_share: float = 1.0, most_terms: int = 20_000) -> Table:
        """The units by the terms in min_docs units at least and a share of max_share of them at most, the most frequent ones; units with other such terms only have none."""
        if most_terms > 1 << 16:
            raise ValueError("a term's number has two bytes")
        common = self.df.filter((F.col("c") >= min_docs) & (F.col("c") <= max_share * self.total))
        names = [r["term"] for r in common.orderBy(F.desc("c"), "term").limit(most_terms).collect()]  # at most most_terms
        kind = dict(self.units.dtypes)["unit"]
        if tuple(names) not in self.tables:
            self.tables[tuple(names)] = kept(self.units.mapInArrow(numbered(names), f"unit {kind}, ts binary")), {}
        rows, found = self.tables[tuple(names)]
        some = F.length("ts") > 0
        left = rows.filter(~some).select("unit")
        if common.limit(most_terms + 1).count() > most_terms:  # units of rare terms only are few
            words = self.units.join(left.withColumnRenamed("unit", "_u").hint("merge"), F.col("unit").eqNullSafe(F.col("_u")), "left_semi").select("unit", F.explode("w").alias("term"))
            left = kept(words.join(common.select("term").hint("merge"), "term", "left_semi").select("unit").distinct())
        else:
            left = left.limit(0)
        return Table(rows.filter(some), names, left, found)

    def drop(self) -> None:
        self.scratch.drop()


class Table:
    """rows (unit, ts), names of the terms by number, left: units without any of these terms that are in class 0, and found: what tables of the same terms share, their classifications."""

    def __init__(self, rows: DataFrame, names: list[str], left: DataFrame, found: dict):
        self.rows, self.names, self.left, self.found = rows, names, left, found

    def classify(self, classes: int = 4, least: int = 5, unit: str = "doc_id", refine: int = 2) -> tuple[DataFrame, list[tuple[int, int]]]:
        """What classify gives."""
        how = classes, least, refine
        if how not in self.found:
            self.found[how] = divided(self.rows, self.names, *how)
        named, tree = self.found[how]
        named = named.unionByName(self.left.select("unit", F.lit(0).alias("leaf")))
        return named.select(F.col("unit").alias(unit), F.when(F.col("unit").isNotNull(), F.col("leaf")).otherwise(0).alias("leaf")), tree


def term_sums(size: int, made: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[np.ndarray]], known: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums by term, as `known` vectors in one row: made gives each unit's weights from the terms, the units that hold them, and the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((known, size))
        for batch in batches:
            unit, ts = held_terms(batch)
            for k, weights in enumerate(made(unit, ts, batch)):
                sums[k] += np.bincount(ts, weights[unit], size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

    return run


def held_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The units (rows) and terms of a batch's cells; terms are in lists, or in two bytes each."""
    lists = batch.column("ts")
    if pa.types.is_binary(lists.type) or pa.types.is_large_binary(lists.type):
        lengths = np.asarray(pc.fill_null(pc.binary_length(lists), 0)) // 2
        flat = np.frombuffer(b"".join(x for x in lists.to_pylist() if x), "<u2").astype(np.int32)
    else:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), flat


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of some tasks together, in the order of their numbers, so that reruns agree."""
    found = sorted((p, x) for b in batches for p, x in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True))
    if found:
        total = np.zeros(len(found[0][1]) // 8)
        for _, x in found:
            total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([found[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def summed(rows: DataFrame, size: int, made: Callable, known: int) -> np.ndarray:
    """The sums of all tasks: those of at most FEW tasks come to the driver as they are, of more tasks as ADDERS rows at most."""
    parts = rows.mapInArrow(term_sums(size, made, known), "part int, sums binary")
    if known > 4 or rows._jdf.rdd().getNumPartitions() > FEW:
        parts = parts.repartition(ADDERS, "part").mapInArrow(added, "part int, sums binary")
    found = sorted((r["part"], bytes(r["sums"])) for r in parts.collect())
    return sum((np.frombuffer(x).reshape(known, size) for _, x in found), np.zeros((known, size)))


def by_term(rows: DataFrame, size: int, **sums: Column) -> dict[str, np.ndarray]:
    """Sums over the units of each term, as vectors."""
    names = list(sums)
    long = rows.select("ts", *[v.cast("double").alias(k) for k, v in sums.items()])
    found = summed(long, size, lambda unit, ts, batch: [batch.column(k).to_numpy(zero_copy_only=False) for k in names], len(names))
    return dict(zip(names, found, strict=True))


def means(unit: np.ndarray, ts: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """The mean of v over the terms of each of n units."""
    return np.bincount(unit, v[ts], n) / np.maximum(np.bincount(unit, minlength=n), 1)


def first_axis(rows: DataFrame, names: list[str], steps: int = 15, close: float = 1e-5, c: np.ndarray | None = None) -> DataFrame:
    """rows with score: the first non-trivial axis of the table, by alternating means of scores (reciprocal averaging).

    Terms start from a hash of their name; each step takes the mean of terms over units and back, less the trivial part, until the axis stands still.
    c: the sums of the terms, 0 for those that are left out; units without others have no terms and no score.
    """
    c = by_term(rows, len(names), c=F.lit(1.0))["c"] if c is None else c
    v = np.array([zlib.crc32(n.encode()) % 2000 / 1000 - 1 for n in names]) * (c > 0)
    held = c > 0

    def step(v: np.ndarray) -> Callable:
        def made(unit: np.ndarray, ts: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
            some = held[ts]
            return [means(unit[some], ts[some], batch.num_rows, v)]

        return made

    for _ in range(steps):
        v = (v - (c @ v) / c.sum()) * (c > 0)
        v = v / (np.sqrt(c @ (v * v) / c.sum()) or 1.0)
        sums = summed(rows.select("ts"), len(names), step(v), 1)[0]
        before, v = v, np.divide(sums, c, out=np.zeros_like(sums), where=c > 0)
        w = v / (np.sqrt(c @ (v * v) / c.sum()) or 1.0)
        if np.sqrt(c @ np.square(w - before) / c.sum()) < close:
            break
    v = v / (np.sqrt(c @ (v * v) / c.sum()) or 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ts = held_terms(batch)
            some = held[ts]
            unit, ts, n = unit[some], ts[some], batch.num_rows
            score = pa.array(np.round(means(unit, ts, n, v), 12), mask=np.bincount(unit, minlength=n) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), packed(unit, ts, n), score], names=["unit", "ts", "score"])

    return rows.select("unit", "ts").mapInArrow(scored, f"unit {dict(rows.dtypes)['unit']}, ts binary, score double")


def chi2_from(a: np.ndarray, s: np.ndarray) -> float:
    """Chi-squared of two sides' column sums a and s - a."""
    t1, n = a.sum(), s.sum()
    q = np.divide(a * a, s, out=np.zeros_like(a), where=s > 0).sum()
    return float(n * (q / t1 + (n - 2 * t1 + q) / (n - t1)) - n) if 0 < t1 < n else 0.0


def side_sums(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns' sums on side 1, and on both."""
    sums = by_term(rows, size, a=(F.col("side") == 1).cast("double"), s=F.lit(1.0))
    return sums["a"], sums["s"]


def range_cuts(s: np.ndarray, before: np.ndarray, slice_cells: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """The best cut of a range of units, from the counts of the terms in the ranges before it: score and chi-squared of the cut after the last unit of that score."""
    n = float(s.sum())

    def run(rows: pa.Table) -> pa.Table:
        counts = before[rows.column("_part")[0].as_py()].astype(np.float64)
        a, t1 = float(np.divide(counts * counts, s, out=np.zeros_like(counts), where=s > 0).sum()), float(counts.sum())
        best: tuple[float, float] | None = None
        rows = rows.sort_by([("score", "ascending")])
        score, sizes = rows.column("score").to_numpy(), np.asarray(pc.binary_length(rows.column("ts"))).astype(np.int64) // 2
        last = np.r_[score[1:] != score[:-1], True]  # the last unit of its score
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // slice_cells)) + 1, len(score)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            t = np.frombuffer(b"".join(rows.column("ts").slice(i, j - i).to_pylist()), "<u2").astype(np.int32)
            # a unit that joins as the r-th holder of a term adds (2 r - 1) / s
            order = np.argsort(t, kind="stable")
            times = np.bincount(t, minlength=len(s))
            nth = np.empty(len(t), np.int64)
            nth[order] = np.arange(len(t)) - np.repeat(np.cumsum(times) - times, times)
            ends = np.cumsum(sizes[i:j])
            upto = a + np.r_[0.0, np.cumsum((2 * (counts[t] + nth) + 1) / s[t])][ends]
            held = t1 + ends
            ok = last[i:j] & (held > 0) & (held < n)
            if ok.any():
                x, h = upto[ok], held[ok].astype(np.float64)
                chi2 = np.round(n * (x / h + (n - 2 * h + x) / (n - h)) - n, 9)
                k = int(np.argmax(chi2))  # the first, of the least score
                if best is None or chi2[k] > best[0]:
                    best = float(chi2[k]), float(score[i:j][ok][k])
            a, t1 = float(upto[-1]), float(held[-1])
            counts += times
        return pa.table({"score": pa.array([best[1]] if best else [], pa.float64()), "chi2": pa.array([best[0]] if best else [], pa.float64())})

    return run


def sweep(rows: DataFrame, size: int, s: np.ndarray | None = None) -> DataFrame:
    """rows (with score) with the side of the cut with the largest chi-squared; all units at or under the cut score are on side 1, units without a score on side 0.

    With columns' sums s, a unit joining side 1 as the r-th holder of a term adds (2 r - 1) / s to the sum of squares over s, so all cuts follow
    from the counts of the terms so far: units are dealt out by ranges of the score, and a range starts from the counts of those before it.
    """
    s = by_term(rows, size, s=F.lit(1.0))["s"] if s is None else s
    ranges = int(np.clip(s.sum() // RANGE_CELLS + 1, 1, RANGES))
    scored = rows.filter("score is not null")
    bounds = np.unique(scored.approxQuantile("score", [k / ranges for k in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else np.zeros(0)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        return np.searchsorted(bounds, batch.column("score").to_numpy())

    before = np.zeros((len(bounds) + 1, size), np.int32)
    if len(bounds):

        def made(unit: np.ndarray, ts: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
            at = part(batch)
            return [(at == k).astype(np.float64) for k in range(len(bounds))]

        before[1:] = np.cumsum(summed(scored.select("ts", "score"), size, made, len(bounds)), axis=0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ts = held_terms(batch)
            yield pa.RecordBatch.from_arrays([pa.array(part(batch).astype(np.int32)), batch.column("score"), packed(unit, ts, batch.num_rows)], names=["_part", "score", "ts"])

    found = scored.select("ts", "score").mapInArrow(dealt, "_part int, score double, ts binary").groupBy("_part").applyInArrow(range_cuts(s, before), "score double, chi2 double").collect()
    best = max(((r["chi2"], -r["score"]) for r in found), default=None)
    side = F.lit(1) if best is None else F.when(F.col("score") <= -best[1], 1).otherwise(2)
    return rows.withColumn("side", F.when(F.col("score").isNotNull(), side).otherwise(0)).drop("score")


def with_moves(rows: DataFrame, moves: list[tuple[np.ndarray, np.ndarray, float, float, int]]) -> DataFrame:
    """rows after rounds of moves, each by column sums a and s, chi-squared then, a share of units and a number; good: whether a move would help in the last round."""
    if not moves:
        return rows.withColumn("good", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ts = held_terms(batch)
            size = np.bincount(unit, minlength=batch.num_rows)
            side = batch.column("side").to_numpy().copy()
            for a, s, now, share, k in moves:
                t1, n = float(a.sum()), float(s.sum())
                q = float(np.divide(a * a, s, out=np.zeros_like(a), where=s > 0).sum())
                sign = np.where(side == 1, -1, 1)
                u = t1 + sign * size
                p = q + np.bincount(unit, (2 * sign[unit] * a[ts] + 1) / s[ts], batch.num_rows)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = n * (p / u + (n - 2 * u + p) / (n - u)) - n - now
                good = (u > 0) & (u < n) & (gain > 1e-9) & (side > 0)
                drawn = batch.column(f"_d{k}").to_numpy() < int(share * 1_000_000)
                side = np.where(good & drawn, 3 - side, side)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), packed(unit, ts, batch.num_rows), pa.array(side.astype(np.int32)), pa.array(good)], names=["unit", "ts", "side", "good"])

    draws = [F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(1_000_000)).cast("int").alias(f"_d{k}") for *_, k in moves]
    return rows.select("unit", "ts", "side", *draws).mapInArrow(run, f"unit {dict(rows.dtypes)['unit']}, ts binary, side int, good boolean")


def side_counts(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, dict[int, int], int]:
    """The columns' sums on side 1, and on both; the units of each side; those that a move would help."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size + 4))
        for batch in batches:
            unit, ts = held_terms(batch)
            side = batch.column("side").to_numpy()
            sums[0, :size] += np.bincount(ts[(side == 1)[unit]], minlength=size)
            sums[1, :size] += np.bincount(ts, minlength=size)
            sums[2, :3] += np.bincount(side, minlength=3)
            sums[2, 3] += batch.column("good").to_numpy(zero_copy_only=False).sum()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

    parts = rows.select("ts", "side", "good").mapInArrow(run, "part int, sums binary")
    if rows._jdf.rdd().getNumPartitions() > FEW:
        parts = parts.repartition(ADDERS, "part").mapInArrow(added, "part int, sums binary")
    total = sum((np.frombuffer(x).reshape(3, size + 4) for _, x in sorted((r["part"], bytes(r["sums"])) for r in parts.collect())), np.zeros((3, size + 4)))
    return total[0, :size], total[1, :size], {k: int(total[2, k]) for k in (0, 1, 2)}, int(total[2, 3])


def refined(rows: DataFrame, size: int, rounds: int = 6) -> DataFrame:
    """rows (with side) after moves of single units that raise chi-squared."""
    moves: list[tuple[np.ndarray, np.ndarray, float, float, int]] = []
    a, s = side_sums(rows, size)
    now, share = chi2_from(a, s), 1.0
    for k in range(rounds):
        moved = [*moves, (a, s, now, share, k)]
        b, _, _, good = side_counts(with_moves(rows, moved), size)
        later = chi2_from(b, s)
        if later > now + 1e-9:
            moves, a, now = moved, b, later
        elif not good:
            break
        else:
            share /= 4
    return with_moves(rows, moves).drop("good")


def divided(rows: DataFrame, names: list[str], classes: int, least: int, refine: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(unit, leaf) of rows (unit, ts), which should stand in a table, and the tree's edges; as classify."""
    spark, size = rows.sparkSession, len(names)
    groups: dict[int, DataFrame] = {1: rows.select("unit", "ts")}
    sizes = {1: rows.count()}
    scratch: dict[int, Scratch] = {}  # where the daughters of a node stand
    tree: list[tuple[int, int]] = []
    lost: list[DataFrame] = []
    closed: set[int] = set()
    while len(groups) < classes and set(groups) - closed:
        largest = max(set(groups) - closed, key=lambda g: (sizes[g], -g))
        c = by_term(groups[largest], size, c=F.lit(1.0))["c"] if sizes[largest] >= 2 * least else np.zeros(size)
        c = np.where(c > RARE, c, 0.0)
        if not c.any():
            closed.add(largest)
            continue
        sides = sweep(first_axis(groups[largest], names, c=c), size, c)
        sides = refined(sides, size, refine) if refine else sides
        a, s, by_side, _ = side_counts(sides.withColumn("good", F.lit(False)), size)
        if min(by_side[1], by_side[2]) < least:
            closed.add(largest)
            continue
        expected = s * (a.sum() / s.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            contrast = np.where(s > 0, np.square(a - expected) * (1 / expected + 1 / (s - expected)), 0.0)
        foreign = np.where(np.nan_to_num(contrast) > 3.84, np.where(a < expected, 1, 2), 0)
        scratch[largest] = Scratch(spark, "daughters")
        clean = scratch[largest].cut(sides.mapInArrow(without(foreign), f"unit {dict(rows.dtypes)['unit']}, ts binary, side int"))
        left = {r["side"]: r["n"] for r in clean.groupBy("side").agg(F.count("*").alias("n")).collect()}
        del groups[largest]
        lost.append(kept(clean.filter("side = 0").select("unit")))
        for side in (1, 2):
            fresh = len(tree) + 2
            groups[fresh], sizes[fresh] = clean.filter(F.col("side") == side).select("unit", "ts"), left.get(side, 0)
            tree.append((largest, fresh))
        mother = next((m for m, d in tree if d == largest), None)
        if mother is not None and not any(d in groups for m, d in tree if m == mother):  # both daughters have been cut
            scratch.pop(mother).drop()
    named = [groups[g].select("unit", F.lit(g).alias("leaf")) for g in sorted(groups)] + [x.select("unit", F.lit(0).alias("leaf")) for x in lost]
    out = kept(reduce(DataFrame.unionByName, named))
    for x in scratch.values():
        x.drop()
    return out, tree


def without(foreign: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """unit, ts, side without the terms that are foreign to the side; units that lose all are on side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ts = held_terms(batch)
            side = batch.column("side").to_numpy()
            some = foreign[ts] != side[unit]
            unit, ts = unit[some], ts[some]
            side = np.where(np.bincount(unit, minlength=batch.num_rows) > 0, side, 0)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), packed(unit, ts, batch.num_rows), pa.array(side.astype(np.int32))], names=["unit", "ts", "side"])

    return run


def classify(counts: DataFrame, classes: int = 4, least: int = 5, unit: str = "doc_id", refine: int = 2, most_terms: int = 20_000) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(unit, leaf): the nodes of the tree that units end in (0 for units that lost all their columns), and the tree's edges (mother, daughter) from node 1.

    The number of leaves is a parameter, so is the number of jobs. From words, Words(...).table(...).classify() gives the same without a table of all (unit, term).
    """
    counts = kept(counts.select(unit, "term"))  # read three times
    rows, names = unit_rows(counts, unit, most_terms)
    named, tree = divided(rows, names, classes, least, refine)
    everyone = counts.select(F.col(unit).alias("unit")).distinct()
    named = named.withColumnRenamed("unit", "_u")
    return kept(everyone.join(named, everyone["unit"] == named["_u"], "left").select(F.col("unit").alias(unit), F.coalesce("leaf", F.lit(0)).alias("leaf"))), tree


def terminal(assigned: DataFrame, tree: list[tuple[int, int]], least: int | None = None, unit: str = "doc_id", double: bool = False) -> DataFrame:
    """(unit, class) from the leaves of a tree: classes 1, 2, ... by node.

    Leaves of at least so many units are classes (if not given: units / leaves, half of that for a double classification). Small leaves are one class in
    their mother where that is large enough, is not the whole tree and has no class under her; otherwise they, and units of leaf 0, are in
    class 0. Where fewer than two classes would be left, every leaf is one. The tree has twice as many nodes as leaves: it is worked on here.
    """
    sizes = {r["leaf"]: r["n"] for r in assigned.filter("leaf > 0").groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    daughters: dict[int, list[int]] = {}
    for a, b in tree:
        daughters.setdefault(a, []).append(b)

    def leaves(node: int) -> list[int]:
        return [x for d in daughters[node] for x in leaves(d)] if node in daughters else [node]

    limit = least if least is not None else sum(sizes.values()) // max(1, (2 if double else 1) * len(sizes))
    home = {leaf: leaf for leaf, n in sizes.items() if n >= limit}
    for node in sorted(daughters, reverse=True):  # daughters have higher numbers than their mother
        under = leaves(node)
        direct = any(d not in daughters for d in daughters[node])
        if node != 1 and direct and not home.keys() & set(under) and sum(sizes.get(x, 0) for x in under) >= limit:
            home |= dict.fromkeys(under, node)
    if len(set(home.values())) < 2:
        home = {leaf: leaf for leaf in sizes}
    number = {node: k for k, node in enumerate(sorted(set(home.values())), 1)}
    pairs = [x for leaf, node in home.items() for x in (F.lit(leaf), F.lit(number[node]))]
    found = F.coalesce(F.create_map(*pairs)[F.col("leaf")], F.lit(0)) if pairs else F.lit(0)
    return assigned.select(unit, found.alias("class"))


def crossed(first: DataFrame, second: DataFrame, unit: str = "doc_id", none: int | None = 0) -> DataFrame:
    """a, b, observed, expected, chi2 (signed: negative where fewer than expected) for each pair of classes of two classifications; units of class `none` are left out."""
    both = first.select(unit, F.col("class").alias("a")).join(second.select(unit, F.col("class").alias("b")), unit)
    if none is not None:
        both = both.filter((F.col("a") != none) & (F.col("b") != none))
    table = cells(both.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b")
    sign = F.when(F.col("observed") >= F.col("expected"), 1).otherwise(-1)
    return table.select("a", "b", "observed", "expected", (sign * F.col("contribution")).alias("chi2"))


def stable_classes(first: DataFrame, second: DataFrame, least_chi2: float = 3.84, unit: str = "doc_id") -> DataFrame:
    """(unit, class) of a double classification: pairs of classes over the limit, taken greedily by chi2, no class twice; other units get class 0.

    Pairs are at most the product of the two numbers of classes.
    """
    pairs = crossed(first, second, unit).filter(F.col("chi2") > least_chi2).orderBy(F.desc("chi2"), "a", "b").collect()
    used_a, used_b, chosen = set(), set(), []
    for r in pairs:
        if r["a"] not in used_a and r["b"] not in used_b:
            used_a.add(r["a"])
            used_b.add(r["b"])
            chosen.append((r["a"], r["b"]))
    both = first.select(unit, F.col("class").alias("a")).join(second.select(unit, F.col("class").alias("b")), unit)
    number = F.lit(0)
    for k, (a, b) in enumerate(chosen, 1):
        number = F.when((F.col("a") == a) & (F.col("b") == b), k).otherwise(number)
    return both.select(unit, number.alias("class"))


def size_merged(segments: DataFrame, words: Column, least: int, by: str = "doc_id", order: str = "seg_no") -> DataFrame:
    """segments with group: neighbouring segments of a text joined until each group has so many words, a short rest with the group before it.

    A group starts where the words so far in the text pass a multiple of the limit.
    """
    rows = running(segments.withColumn("_w", words), [by], [order], {"_upto": F.col("_w").cast("long")})
    total = segments.withColumn("_w", words).groupBy(F.col(by).alias("_by")).agg(F.sum("_w").alias("_all"))
    rows = rows.join(broadcast_if_small(total), rows[by].eqNullSafe(F.col("_by")))
    group = F.least(F.floor((F.col("_upto") - F.col("_w")) / least), F.greatest(F.lit(0), F.floor(F.col("_all") / least) - 1))
    return rows.withColumn("group", group.cast("int")).drop("_w", "_upto", "_by", "_all")
