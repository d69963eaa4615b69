"""Topics by latent Dirichlet allocation: batch variational Bayes over a table of sparse count rows.

Each step is one pass. A task takes its units' counts, a slice at a time, finds the units' topic weights by fixed-point iteration, and adds up the expected
counts of (topic, term); these sums are cut into blocks of terms and added over the tasks, each block in its own group, in the order of the tasks' numbers.
The driver holds the model only: topics times terms, the latter bounded by a parameter. A pass also sums the units' parts of the variational bound. With the
part of the topics it is the exact bound at the topics that the pass began with; steps end when it rises by less than a given share. It may not
fall, but for the tolerance of the fixed points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.shared import broadcast_if_small, list_slices, written

#: Terms of a block of sums, and count pairs that are worked on at a time.
BLOCK = 4096
SLICE = 100_000
#: Pairs of words that a task adds up at a time.
PAIRS = 1 << 20
#: Fixed-point iterations of a unit at most, and the change of its weights, as a share of them, at which it has settled.
INNER = 50
SETTLED = 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function for x > 0: six steps up, then the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= np.log(x)
        x = x + 1
    r = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def ngrams(words: Column, most: int) -> Column:
    """The words and their runs of up to so many words, joined by blanks. The words stand outside of the lambdas, so they are found a few times for each row, not for each run."""

    def runs(n: int) -> Column:
        parts = [F.slice(words, 1 + j, F.greatest(F.size(words) - (n - 1), F.lit(0))) for j in range(n)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), parts)

    return F.concat(words, *[runs(n) for n in range(2, most + 1)])


def counted(units: DataFrame, key: str, terms: Column, min_units: int, max_share: float, vocabulary: int) -> tuple[DataFrame, DataFrame]:
    """key, ids, n (arrays; empty for a unit without a kept term), and the vocabulary (id, term), terms by rank of the number of units (rows, where a unit has several).

    Terms are counted by hash, and spelt only where the hash is kept; no table of all (unit, term) is dealt out.
    """
    rows = units.select(key, terms.alias("_t"))
    total = units.count()
    freq = rows.select(F.explode(F.array_distinct(F.transform("_t", lambda x: F.xxhash64(x)))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    best = freq.filter((F.col("df") >= min_units) & (F.col("df") <= max_share * total)).orderBy(F.desc("df"), "h").limit(vocabulary)
    best = written(best, "vocabulary-hashes")
    spelt = rows.select(F.explode("_t").alias("term")).withColumn("h", F.xxhash64("term")).join(broadcast_if_small(best, vocabulary), "h")
    named = spelt.groupBy("h", "df").agg(F.min("term").alias("term"))
    names = written(named.select((F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("id"), "term"), "vocabulary")
    packed = rows.select(key, F.explode("_t").alias("term")).join(broadcast_if_small(names, vocabulary), "term").groupBy(key, "id").agg(F.count("*").alias("n"))
    packed = packed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("t")).select(key, F.col("t.id").alias("ids"), F.col("t.n").alias("n"))
    empty = units.select(key).distinct().join(packed, key, "left")
    return empty.select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("n", F.array().cast("array<bigint>")).alias("n")), names


def numbers_of(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number of each word of the lists; -1 for a word that is not known."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    number = np.asarray(pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), known), -1)).astype(np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), number


def pairs_of(row: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the code of each two known words that follow each other."""
    both = (row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
    return row[1:][both], number[:-1][both] << bits | number[1:][both]


def pair_counts(told, bits: int):
    """code, n: in how many rows each pair of known words is, added up for some millions of pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        held: list[np.ndarray] = []
        for batch in (part for b in batches for part in list_slices(b, "_words")):
            row, code = pairs_of(*numbers_of(batch.column("_words"), told.value), bits)
            held.append(np.unique(row << 2 * bits | code) & ((1 << 2 * bits) - 1))
            if sum(map(len, held)) > PAIRS:
                yield sent()
                held = []
        if held:
            yield sent()

    return run


def term_counts(told, bits: int, key: str):
    """key, ids, n: the terms of each row by their numbers. told: the words, the vocabulary's number of each (-1 if none), the codes of its pairs, sorted, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, one, codes, two = told.value
        for batch in (part for b in batches for part in list_slices(b, "_words")):
            row, number = numbers_of(batch.column("_words"), known)
            first, code = pairs_of(row, number, bits)
            some = number >= 0
            unit, ids = [row[some]], [one[number[some]]]
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                unit.append(first)
                ids.append(np.where(codes[at] == code, two[at], -1))
            unit, ids = np.concatenate(unit), np.concatenate(ids)
            cells, n = np.unique(unit[ids >= 0] << 32 | ids[ids >= 0], return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(cells >> 32, minlength=batch.num_rows))].astype(np.int32))
            ids, n = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cells & 0xFFFFFFFF).astype(np.int32), n.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids, n], names=[key, "ids", "n"])

    return run


def counted_words(spelt: DataFrame, key: str, most: int, min_units: int, max_share: float, vocabulary: int) -> tuple[DataFrame, DataFrame]:
    """What counted gives, from a table (key, _words), for words alone or for words and their pairs: no run is spelt out for each of its places.

    A pair is in no more rows than either of its words, so pairs are counted only of words that are in as many rows as the last one that could be kept if there were
    words alone: rarer pairs are none of the vocabulary.
    """
    spark = spelt.sparkSession
    total = spelt.count()
    words = written(spelt.select(F.explode(F.array_distinct("_words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_units), "topic-word-counts")
    if most > 2 or not words.filter(F.col("term").isNull() | (F.col("term") == "") | F.col("term").contains(" ")).isEmpty():
        return counted(spelt, key, ngrams(F.col("_words"), most), min_units, max_share, vocabulary)
    alone = words.filter(F.col("df") <= max_share * total)
    last = alone.orderBy(F.desc("df")).limit(vocabulary).agg(F.min("df").alias("df"), F.count("*").alias("n")).first()
    least = last["df"] if last["n"] == vocabulary else min_units
    table = words.filter(F.col("df") >= least).orderBy("term").select("term").toArrow()  # as many as the vocabulary, about
    known = table.column("term").combine_chunks().cast(pa.string())
    bits = max(1, len(known).bit_length())
    found = alone.filter(F.col("df") >= least).select("term", "df", F.lit(-1).cast("long").alias("code"))
    if most == 2:
        told = spark.sparkContext.broadcast(known)
        pairs = spelt.select("_words").mapInArrow(pair_counts(told, bits), "code long, n long").groupBy("code").agg(F.sum("n").alias("df"))
        pairs = pairs.filter((F.col("df") >= least) & (F.col("df") <= max_share * total))
        number = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(known))), "term": known}))
        x, y = (number.select(F.col("number").alias(n), F.col("term").alias(t)) for n, t in (("a", "t1"), ("b", "t2")))
        pairs = pairs.withColumns({"a": F.shiftright("code", bits), "b": F.col("code").bitwiseAND(F.lit((1 << bits) - 1))}).join(x.hint("merge"), "a").join(y.hint("merge"), "b")
        found = found.unionByName(pairs.select(F.concat_ws(" ", "t1", "t2").alias("term"), "df", "code"))
    best = written(found.orderBy(F.desc("df"), F.xxhash64("term")).limit(vocabulary), "vocabulary-terms")
    place = (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("id")
    names = written(best.select(place, "term", "code"), "vocabulary")
    kept = names.toArrow()
    ids, code = kept.column("id").to_numpy().astype(np.int64), kept.column("code").to_numpy()
    one = np.full(len(known), -1, np.int64)
    at = np.asarray(pc.index_in(kept.column("term").combine_chunks().cast(pa.string()), known).fill_null(-1))
    one[at[code < 0]] = ids[code < 0]
    order = np.argsort(code[code >= 0])
    told = spark.sparkContext.broadcast((known, one, code[code >= 0][order], ids[code >= 0][order]))
    kind = dict(spelt.dtypes)[key]
    counts = spelt.mapInArrow(term_counts(told, bits, key), f"`{key}` {kind}, ids array<int>, n array<bigint>")
    twice = written(spelt.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col("_k").isNull()).select("_k"), "repeated-units")
    if not twice.isEmpty():  # rows of one unit are added up; units without a name have no terms, as in counted
        told_twice = broadcast_if_small(twice)
        same = counts[key].eqNullSafe(told_twice["_k"])
        several = counts.join(told_twice, same, "left_semi")
        cells = several.filter(F.col(key).isNotNull()).select(key, F.inline(F.arrays_zip("ids", "n"))).groupBy(key, "ids").agg(F.sum("n").alias("n"))
        sums = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ids", "n"))).alias("t")).select(key, F.col("t.ids").alias("ids"), F.col("t.n").alias("n"))
        none = several.select(key).distinct().join(sums.select(key), key, "left_anti").select(key, F.array().cast("array<int>").alias("ids"), F.array().cast("array<bigint>").alias("n"))
        counts = counts.join(told_twice, same, "left_anti").unionByName(sums).unionByName(none)
    return counts, names.select("id", "term")


def weights(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, beta: np.ndarray, alpha: float, inner: int = INNER, settled: float = SETTLED) -> np.ndarray:
    """gamma of some units (none empty): ids and counts one unit after the other; beta: (term, topic) exp of the expected log probability."""
    k = beta.shape[1]
    gamma = np.full((len(lengths), k), alpha) + (np.add.reduceat(n, np.r_[0, np.cumsum(lengths)[:-1]]) / k)[:, None]
    live = np.arange(len(lengths))
    rows = beta[ids]
    for _ in range(inner):
        theta = np.exp(digamma(gamma[live]) - digamma(gamma[live].sum(1))[:, None])
        norm = np.einsum("ij,ij->i", np.repeat(theta, lengths, axis=0), rows) + 1e-100
        after = alpha + theta * np.add.reduceat(rows * (n / norm)[:, None], np.r_[0, np.cumsum(lengths)[:-1]], axis=0)
        moving = np.abs(after - gamma[live]).sum(1) > settled * after.sum(1)
        gamma[live] = after
        if not moving.any():
            break
        if moving.mean() < 0.7:  # go on with those that still move
            some = np.repeat(moving, lengths)
            live, lengths, n, rows = live[moving], lengths[moving], n[some], rows[some]
    return gamma


def unit_slices(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, cut so that each part has about SLICE pairs: the rows, ids, counts, lengths."""
    ids, n = batch.column("ids"), batch.column("n")
    lengths = np.array(pc.list_value_length(ids))
    ends = np.cumsum(lengths)
    flat_ids, flat_n = ids.flatten().to_numpy(), n.flatten().to_numpy().astype(np.float64)
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // SLICE)) + 1, len(lengths)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            part = slice(int(ends[a] - lengths[a]), int(ends[b - 1]))
            yield slice(a, b), flat_ids[part], flat_n[part], lengths[a:b]


def expected(beta: np.ndarray, alpha: float, inner: int, settled: float):
    """A pass over the counts: rows (part, block, sums), block -1 with the units' part of the bound."""
    k = beta.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros_like(beta), 0.0
        for batch in batches:
            for _, ids, n, lengths in unit_slices(batch):
                lengths = lengths[lengths > 0]
                if not len(lengths):
                    continue
                gamma = weights(ids, n, lengths, beta, alpha, inner, settled)
                log_theta = digamma(gamma) - digamma(gamma.sum(1))[:, None]
                rows = beta[ids]
                theta = np.repeat(np.exp(log_theta), lengths, axis=0)
                norm = np.einsum("ij,ij->i", theta, rows) + 1e-100
                share = theta * (n / norm)[:, None]
                for t in range(k):
                    total[:, t] += np.bincount(ids, weights=share[:, t], minlength=len(total))
                bound += float((n * np.log(norm)).sum() + ((alpha - gamma) * log_theta + log_gamma(gamma)).sum() - log_gamma(gamma.sum(1)).sum())
                bound += len(lengths) * float(log_gamma(np.array(k * alpha)) - k * log_gamma(np.array(alpha)))
        part = TaskContext.get().partitionId()
        total *= beta
        out = [(part, -1, np.array([bound]).tobytes())]
        out += [(part, b, np.ascontiguousarray(total[b * BLOCK : (b + 1) * BLOCK]).tobytes()) for b in range(-(-len(total) // BLOCK)) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "block", "sums"])

    return run


def added(group: pa.Table) -> pa.Table:
    """Sums of one block over the tasks."""
    order = np.argsort(group.column("part").to_numpy(), kind="stable")
    rows = group.column("sums").to_pylist()
    total = np.zeros(len(rows[0]) // 8)
    for k in order:
        total += np.frombuffer(rows[k])
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


class Model:
    """lam: (term, topic) weights; alpha, eta: priors; bounds: the bound of each step."""

    def __init__(self, lam: np.ndarray, alpha: float, eta: float, bounds: list[float]):
        self.lam, self.alpha, self.eta, self.bounds = lam, alpha, eta, bounds

    def log_beta(self) -> np.ndarray:
        return digamma(self.lam) - digamma(self.lam.sum(0))[None]

    def topics_bound(self) -> float:
        lam, eta = self.lam, self.eta
        inner = ((eta - lam) * self.log_beta() + log_gamma(lam)).sum() - lam.size * log_gamma(np.array(eta))
        return float(inner + lam.shape[1] * log_gamma(np.array(eta * lam.shape[0])) - log_gamma(lam.sum(0)).sum())


def fitted(counts: DataFrame, terms: int, k: int, most_steps: int = 30, rise: float = 1e-4, seed: int = 1, inner: int = INNER, settled: float = SETTLED) -> Model:
    """The model of counts (ids, n), which should stand in a table. At most so many steps; rise: the share of the bound under which they end."""
    alpha = eta = 1 / k
    model = Model(np.random.default_rng(seed).gamma(100.0, 0.01, (terms, k)), alpha, eta, [])
    for _ in range(most_steps):
        sums = counts.select("ids", "n").mapInArrow(expected(np.exp(model.log_beta()), alpha, inner, settled), "part int, block int, sums binary")
        found = {r["block"]: np.frombuffer(r["sums"]) for r in sums.groupBy("block").applyInArrow(added, "block int, sums binary").collect()}  # topics x terms in all
        model.bounds.append(float(found.pop(-1)[0]) + model.topics_bound() if -1 in found else model.topics_bound())
        lam = np.full((terms, k), eta)
        for b, x in found.items():
            lam[b * BLOCK : (b + 1) * BLOCK] += x.reshape(-1, k)
        model = Model(lam, alpha, eta, model.bounds)
        if len(model.bounds) > 1 and model.bounds[-1] - model.bounds[-2] <= rise * abs(model.bounds[-2]):
            break
    return model


def distributions(counts: DataFrame, key: str, model: Model) -> DataFrame:
    """key, terms (distinct kept terms), d (topic shares; equal ones for a unit without terms)."""
    beta, alpha, k = np.exp(model.log_beta()), model.alpha, model.lam.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = np.full((batch.num_rows, k), 1 / k)
            lengths_of = np.zeros(batch.num_rows, np.int64)
            for rows, ids, n, lengths in unit_slices(batch):
                some = np.flatnonzero(lengths)
                lengths_of[rows] = lengths
                if len(some):
                    gamma = weights(ids, n, lengths[some], beta, alpha)
                    shares[rows.start + some] = gamma / gamma.sum(1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths_of), pa.array(list(shares), pa.list_(pa.float64()))], [key, "terms", "d"])

    return counts.select(key, "ids", "n").mapInArrow(run, f"`{key}` {dict(counts.dtypes)[key]}, terms long, d array<double>")


def lda(units: DataFrame, words: Column, k: int = 4, most_steps: int = 30, min_units: int = 2, max_share: float = 0.95, most_words: int = 2, seed: int = 1, vocabulary: int = 20_000, key: str = "doc_id", top: int = 10, rise: float = 1e-4):
    """Topic terms (topic, rank, term, weight), units (key, topic, share, terms) and the model.

    Terms are runs of 1 to most_words words in min_units units at least and in a share of max_share of them at most, the `vocabulary` most frequent. There are no more
    topics than units. A unit's topic is the first of the greatest share, null where it kept no term (words null or empty too). Units of one key are one unit. Without units
    or terms there are no topic terms.
    """
    spark = units.sparkSession
    # found once and written, as each of the passes reads them
    spelt = written(units.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("_words")), "topic-words")
    counts, names = counted_words(spelt, key, most_words, min_units, max_share, vocabulary)
    counts = written(counts, "topic-counts")
    k = max(1, min(k, counts.count()))
    v = names.count()
    if not v:
        none = spark.createDataFrame([], "topic int, rank int, term string, weight double")
        return none, counts.select(key, F.lit(None).cast("int").alias("topic"), F.lit(None).cast("double").alias("share"), F.lit(0).cast("long").alias("terms")), None
    model = fitted(counts, v, k, most_steps, rise, seed)
    share = model.lam / model.lam.sum(0)
    best = np.lexsort((np.tile(np.arange(v), (k, 1)), -share.T), axis=1)[:, :top]
    rows = [(t, r + 1, int(w), float(share[w, t])) for t in range(k) for r, w in enumerate(best[t])]
    described = spark.createDataFrame(rows, "topic int, rank int, id int, weight double").join(names, "id").select("topic", "rank", "term", "weight")
    found = distributions(counts, key, model)
    most = F.array_max("d")
    topic = F.when(F.col("terms") > 0, (F.array_position("d", most) - 1).cast("int"))
    units_of = found.select(key, topic.alias("topic"), F.when(F.col("terms") > 0, most).alias("share"), "terms")
    return described, units_of, model
