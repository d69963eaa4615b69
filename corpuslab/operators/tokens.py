"""Token tables and the windows and n-grams cut from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.shared import Scratch, broadcast_if_small, written

#: Positions of a block when a long text's sliding windows are cut in parallel.
BLOCK = 2048
#: Buckets of hashes of runs, as a power of two, and words whose runs are hashed at a time.
BUCKET_BITS = 18
SLICE = 250_000
#: Odd multipliers of the hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)


def tokens(docs: DataFrame, keys: list[str] = ("doc_id",), text_col: str = "text", words: Column | None = None) -> DataFrame:
    """keys, pos, token."""
    return docs.select(*keys, F.posexplode(T.words_lower(text_col) if words is None else words).alias("pos", "token"))


def dfm(tokens: DataFrame, unit: list[str] = ("doc_id",)) -> DataFrame:
    """unit, term, n: the document-feature counts."""
    return tokens.groupBy(*unit, F.col("token").alias("term")).agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, unit: str = "doc_id", min_docs: int = 1, max_share: float = 1.0) -> DataFrame:
    """Counts of the terms found in at least min_docs units and at most max_share of them."""
    units = counts.agg(F.countDistinct(unit).alias("_u"))
    kept = counts.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(units)).filter((F.col("_df") >= min_docs) & (F.col("_df") <= max_share * F.col("_u")))
    return counts.join(kept.select("term"), "term", "left_semi")


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """term, total of the n most frequent terms."""
    return counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(n)


def segments_fixed(docs: DataFrame, size: int = 40, text_col: str = "text", keys: list[str] = ("doc_id",)) -> DataFrame:
    """keys, seg_no, n_words, segment: blocks of `size` words, the last one shorter."""
    words = T.words(text_col)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_w") / size).cast("int") - 1))
    rows = docs.withColumn("_w", words).filter(F.size("_w") > 0).select(*keys, "_w", F.explode(cuts).alias("seg_no"))
    part = F.slice("_w", F.col("seg_no") * size + 1, F.lit(size))
    return rows.select(*keys, "seg_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("segment"))


def segments_double(docs: DataFrame, first: int = 12, second: int = 14) -> DataFrame:
    """Two segmentations, told apart by suffix."""
    a, b = (segments_fixed(docs, n).withColumn("seg_id", F.concat_ws("", F.col("doc_id").cast("string"), F.lit("_seg"), F.col("seg_no").cast("string"), F.lit(s))) for n, s in ((first, "_rst1"), (second, "_rst2")))
    return a.unionByName(b)


def pieces(docs: DataFrame, pattern: str, least: int = 1, text_col: str = "text") -> DataFrame:
    """doc_id, seg_no, segment: trimmed pieces between matches of the pattern, of at least so many characters."""
    parts = F.filter(F.transform(F.split(text_col, pattern), lambda x: F.btrim(x, F.lit(" \n\t\r"))), lambda x: F.length(x) >= least)
    return docs.select("doc_id", F.posexplode(parts).alias("seg_no", "segment"))


def sliding_sets(tokens: DataFrame, k: int, pivot: str | None = None) -> DataFrame:
    """doc_id, pos, items: the distinct tokens within k places of each token (of the pivot, if given), sorted.

    A text is cut into blocks with k tokens of margin, so that a very long one is not one task's window.
    """
    block = F.floor(F.col("pos") / BLOCK)
    near = F.array_distinct(F.array(F.floor((F.col("pos") - k) / BLOCK), block, F.floor((F.col("pos") + k) / BLOCK)))
    rows = tokens.withColumn("_block", F.explode(near)).filter("_block >= 0")
    frame = Window.partitionBy("doc_id", "_block").orderBy("pos").rowsBetween(-k, k)
    out = rows.withColumn("items", F.array_sort(F.array_distinct(F.collect_list("token").over(frame)))).filter(F.col("_block") == block)
    if pivot is not None:
        out = out.filter(F.col("token") == pivot)
    return out.select("doc_id", "pos", "items")


def unit_sets(segments: DataFrame, words: Column) -> DataFrame:
    """doc_id, seg_no, items: the sorted set of words of each segment; empty ones go."""
    items = F.array_sort(F.array_distinct(words))
    return segments.select("doc_id", "seg_no", items.alias("items")).filter(F.size("items") > 0)


def runs(docs: DataFrame, low: int, high: int, keys: list[str], words: Column, made: Callable[[Column], list[Column]]) -> DataFrame:
    """keys, n and the columns that `made` makes of the array of words, for every run of low to high words."""
    base = docs.select(*keys, words.alias("_w"))
    rows = base.select(*keys, "_w", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).filter(F.size("_w") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1)
    found = F.transform(starts, lambda i: F.struct(*made(F.slice("_w", i, F.col("n")))))
    return rows.select(*keys, "n", F.inline(found))


def kept_words(stop: list[str] = (), text_col: str = "text") -> Column:
    """The words that n-grams are made of: stop words go first, so an n-gram may bridge them."""
    found = T.words_ngram(text_col)
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def ngrams(docs: DataFrame, low: int, high: int, keys: list[str] = ("doc_id",), words: Column | None = None) -> DataFrame:
    """keys, n, ngram for every run of low to high words."""
    return runs(docs, low, high, list(keys), kept_words() if words is None else words, lambda w: [F.array_join(w, " ").alias("ngram")])


def run_hashes(batch: pa.RecordBatch, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """n, and for every run of n words of some rows of the batch (words by hash, in the list column h): row, place in the row, two hashes of the run."""
    lists = batch.column("h")
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), np.cumsum(lengths)
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // SLICE)) + 1, len(lengths)]
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin = int(ends[first - 1]) if first else 0
        words = flat[begin : int(ends[last - 1])] if last > first else flat[:0]
        row = np.repeat(np.arange(first, last), lengths[first:last])
        place = np.arange(len(words)) + begin - (ends - lengths)[row]
        h1, h2 = words, words
        for n in range(2, high + 1):
            if len(h1) < 2:
                break
            h1, h2 = h1[:-1] * MIX[0] + words[n - 1 :], h2[:-1] * MIX[1] + words[n - 1 :]
            if n >= low:
                whole = place[: len(h1)] + n <= lengths[row[: len(h1)]]
                yield n, row[: len(h1)][whole], place[: len(h1)][whole], mixed(h1[whole]), mixed(h2[whole])
        if low == 1:
            yield 1, row, place, mixed(words), mixed(words * MIX[1])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[2]
    return h ^ (h >> np.uint64(29))


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_sums(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many runs a task has in each bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(1 << BUCKET_BITS, np.int64) for n in range(low, high + 1)}
        for batch in batches:
            for n, _, _, h1, _ in run_hashes(batch, low, high):
                sums[n] += np.bincount(bucket_of(h1), minlength=1 << BUCKET_BITS)
        for n, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(some), pa.array(s[some])], names=["n", "bucket", "c"])

    return run


def counted_runs(low: int, high: int, by: str, chosen: dict[int, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n, h1, h2, by, c of the runs in the chosen buckets (a bit for each), counted by slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {n: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for n, x in chosen.items()}
        for batch in batches:
            codes = batch.column(by).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for n, row, _, h1, h2 in run_hashes(batch, low, high):
                some = wanted[n][bucket_of(h1)]
                if some.any():
                    keys = np.stack([h1[some].view(np.int64), h2[some].view(np.int64), code[row[some]]])
                    keys = keys[:, np.lexsort(keys)]
                    starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
                    c = np.diff(np.r_[starts, keys.shape[1]])
                    k = keys[:, starts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), pa.array(k[0]), pa.array(k[1]), codes.dictionary.take(pa.array(k[2])), pa.array(c.astype(np.int64))], names=["n", "h1", "h2", by, "c"])

    return run


def spelt_runs(low: int, high: int, near: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n, h1, h2, ngram of the runs whose first hash is among the sorted ones given, once for each slice and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            for n, row, place, h1, h2 in run_hashes(batch, low, high):
                mine = np.flatnonzero(np.isin(h1, near.get(n, np.zeros(0, np.uint64))))
                if len(mine):
                    _, first = np.unique(np.stack([h1[mine], h2[mine]]), axis=1, return_index=True)
                    mine = mine[first]
                    text = [" ".join(words[int(r)].values[int(p) : int(p) + n].to_pylist()) for r, p in zip(row[mine], place[mine], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), n, np.int32)), pa.array(h1[mine].view(np.int64)), pa.array(h2[mine].view(np.int64)), pa.array(text, pa.string())], names=["n", "h1", "h2", "ngram"])

    return run


def named_hashes(grams: pa.Table) -> dict[int, dict[int, str]]:
    """n, and the n-grams of so many words by their first hash; grams: (n, ngram, h: its words' hashes)."""
    out: dict[int, dict[int, str]] = {}
    for batch in grams.to_batches():
        sizes, names = batch.column("n").to_pylist(), batch.column("ngram").to_pylist()
        lengths = pc.list_value_length(batch.column("h")).to_pylist()
        for n, row, _, h1, _ in run_hashes(batch, 1, max(lengths, default=1)):
            for r, h in zip(row.tolist(), h1.tolist(), strict=True):
                if sizes[r] == n == lengths[r]:
                    out.setdefault(n, {})[h] = names[r]
    return out


def holding_runs(low: int, high: int, asked: dict[int, dict[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text, _h, n, ngram: the rows that hold a run asked for, once for each row and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            for n, row, place, h1, _ in run_hashes(batch, low, high):
                names = asked.get(n, {})
                mine = np.flatnonzero(np.isin(h1, np.array(list(names), np.uint64)))
                if len(mine):
                    _, first = np.unique(np.stack([row[mine].astype(np.uint64), h1[mine]]), axis=1, return_index=True)
                    held = [(r, names[h]) for r, p, h in zip(row[mine[first]].tolist(), place[mine[first]].tolist(), h1[mine[first]].tolist(), strict=True) if " ".join(words[r].values[p : p + n].to_pylist()) == names[h]]
                    at = pa.array([r for r, _ in held], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("text").take(at), batch.column("_h").take(at), pa.array(np.full(len(held), n, np.int32)), pa.array([g for _, g in held], pa.string())], names=["text", "_h", "n", "ngram"])

    return run


def top_ngrams(docs: DataFrame, low: int, high: int, by: str, k: int, least: int = 1, stop: list[str] = ()) -> DataFrame:
    """n, ngram, freq, rank of the k most frequent of each size, and the modality of `by` that has most of them (`modality`, `in_modality`).

    They are counted by two 64-bit hashes; only those as frequent as the k-th of their size are then spelt out. No n-gram is more frequent than its bucket of
    hashes, so buckets are added up first: the fullest ones are counted run by run, which gives a frequency that k of a size have; then all buckets that
    reach it. What is left out cannot be among the first k, so the result is exact; if buckets do not tell, all are counted.
    """
    words = kept_words(list(stop))
    scratch = Scratch(docs.sparkSession, "runs")
    kind = dict(docs.dtypes)[by]
    hashed = scratch.cut(docs.select(F.col(by), F.transform(words, lambda w: F.xxhash64(w)).alias("h")))  # no filter, which would find the words twice
    sums = scratch.cut(hashed.select("h").mapInArrow(bucket_sums(low, high), "n int, bucket long, c long").groupBy("n", "bucket").agg(F.sum("c").alias("c")))

    def bits(buckets: DataFrame) -> dict[int, bytes]:
        out = {n: np.zeros(1 << BUCKET_BITS, bool) for n in range(low, high + 1)}
        found = buckets.select("n", "bucket").toArrow()  # at most 2 ** BUCKET_BITS for each size
        sizes, at = found.column("n").to_numpy(), found.column("bucket").to_numpy()
        for n in out:
            out[n][at[sizes == n]] = True
        return {n: np.packbits(x).tobytes() for n, x in out.items()}

    def totals(buckets: DataFrame) -> DataFrame:
        counts = hashed.select("h", by).mapInArrow(counted_runs(low, high, by, bits(buckets)), f"n int, h1 long, h2 long, `{by}` {kind}, c long")
        per = counts.groupBy("n", "h1", "h2", by).agg(F.sum("c").alias("c"))
        total = per.groupBy("n", "h1", "h2").agg(F.sum("c").alias("freq"), F.min(F.struct((-F.col("c")).alias("neg"), F.col(by).alias("m"))).alias("best"))
        return total.filter(F.col("freq") >= least)

    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("c"), "bucket"))
    fullest = sums.withColumn("_p", place).filter(F.col("_p") <= 4 * k)
    kth = Window.partitionBy("n").orderBy(F.desc("freq"))
    reached = totals(fullest).withColumn("_p", F.row_number().over(kth)).filter(F.col("_p") == k)
    limits = {r["n"]: r["freq"] for r in reached.select("n", "freq").collect()}
    limit = F.lit(least)
    for n, freq in limits.items():
        limit = F.when(F.col("n") == n, F.greatest(F.lit(freq), F.lit(least))).otherwise(limit)
    near = scratch.cut(totals(sums.filter(F.col("c") >= limit)).withColumn("_place", F.rank().over(kth)).filter(F.col("_place") <= k).drop("_place"))
    told = near.select("n", "h1").toArrow()  # k for each size, and ties with the last
    sizes, h1 = told.column("n").to_numpy(), told.column("h1").to_numpy().view(np.uint64)
    hashes = {n: np.sort(h1[sizes == n]) for n in range(low, high + 1)}
    listed = docs.select(words.alias("w")).select("w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    spelt = listed.mapInArrow(spelt_runs(low, high, hashes), "n int, h1 long, h2 long, ngram string").groupBy("n", "h1", "h2").agg(F.min("ngram").alias("ngram"))
    named = spelt.join(near, ["n", "h1", "h2"])
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("freq"), "ngram"))
    kept = named.withColumn("rank", rank).filter(F.col("rank") <= k)
    out = written(kept.select("n", "ngram", "freq", "rank", F.col("best.m").alias("modality"), (-F.col("best.neg")).alias("in_modality")), "top-ngrams")
    scratch.drop()
    return out


def contexts(docs: DataFrame, grams: DataFrame, longest: int = 240, stop: list[str] = (), header: Column | None = None) -> DataFrame:
    """n, ngram, context: for each (n, ngram) given and each text that has it, the first sentence that holds its words, distinct.

    Between the words any characters may stand that are no letters and digits; borders stand around them. Where no sentence holds them (an
    n-gram that bridges stop words or sentences) the text's start is taken. A header goes before; what is over the length is cut off. A null text has none.
    """
    asked = written(grams.select("n", "ngram").distinct(), "asked-ngrams")
    sizes = asked.agg(F.min("n"), F.max("n"), F.count("*")).first()
    if sizes[0] is None:
        return grams.select("n", "ngram", F.lit(None).cast("string").alias("context")).limit(0)
    rows = docs.select("text", (F.lit(None).cast("string") if header is None else F.trim(header)).alias("_h"), kept_words(list(stop)).alias("w"))
    if sizes[2] <= 20_000:  # told to every row, so that no text is dealt out
        rows = rows.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
        told = asked.select("n", "ngram", F.transform(F.split("ngram", " "), lambda w: F.xxhash64(w)).alias("h")).toArrow()
        both = rows.mapInArrow(holding_runs(sizes[0], sizes[1], named_hashes(told)), "text string, _h string, n int, ngram string")
    else:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        held = ngrams(rows, sizes[0], sizes[1], ["_row"], F.col("w")).join(asked, ["n", "ngram"]).distinct()
        both = rows.join(held.groupBy("_row").agg(F.collect_set(F.struct("n", "ngram")).alias("_g")), "_row").select("text", "_h", F.inline("_g"))
    quoted = F.transform(F.split("ngram", " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iU)\b"), F.array_join(quoted, r"[\W_]+"), F.lit(r"\b"))
    strip = lambda x: F.btrim(x, F.lit(" \n\t\r"))
    found = F.try_element_at(F.filter(F.split("text", r"(?<=[.!?;:])\s+"), lambda s: F.call_function("rlike", s, pattern)), F.lit(1))
    body = F.coalesce(strip(found), strip(F.substring(strip(F.col("text")), 1, longest)))
    context = F.when(F.col("_h") != "", F.concat_ws(" – ", "_h", F.nullif(body, F.lit("")))).otherwise(body)
    cut = F.when(F.length(context) > longest, F.concat(F.rtrim(F.substring(context, 1, longest)), F.lit("…"))).otherwise(context)
    return both.select("n", "ngram", cut.alias("context")).distinct()
