"""Scoring texts by a Katz backoff model that is learnt from the corpus itself.

A token is a word (A-Z lower-cased) or the end of a text. With c the count of an n-gram in the learnt texts, K = 5 and d the Good-Turing discounts

    p(w | h) = d(c(hw)) * c(hw) / c(h)          where hw has been seen,
               alpha(h) * p(w | h without its first word)    where h has been seen, hw not,
               p(w | h without its first word)               where h has not been seen.

A single word has d(c(w)) * c(w) / N; what is left over there belongs to one class of unknown words. alpha(h) is (1 - sum of p(w | h) over the
words seen after h) / (1 - sum of p(w | shorter h) over the same words), each sum taken exactly over all of them, so the probabilities after any
h sum to one. A context whose words are all frequent would have nothing left for others: counts above K are discounted too, by KEPT of one
count. The counts of counts are
smoothed by a power law; where they don't fall (tiny tables), half a count is taken off each.

How it runs. Documents are packed into blocks of some million tokens (a table with the words' hashes, the tokens as local numbers). For each order k
a block sends its distinct k-grams, each with its context and the counts of its shorter form, to buckets, which count, answer the blocks in the
order in which they asked, and add up the contexts. So an n-gram crosses the network once for each block that has it, whatever its count, and
the count tables of each order are written as Parquet, by bucket. A bucket is chosen by the context's hash; contexts with more than HOT
occurrences, known from the order before, are spread over buckets by their next word. Blocks then take the weights of the contexts that they need
from a join, and evaluate their tokens from the lowest order up. Nothing is capped, no n-gram is left out; the driver sees counts of counts only.

Hashes are 64 bits wide: two of n different n-grams share one with a probability of n * n / 2^65. Null texts are empty and have one token, the end.
Rows without an id are not held out. Repeated rows are scored, and learnt, each. An empty table gives an empty table; where nothing is learnt, every
token is unknown, with probability 1. Only the id and the text are read, other columns, of whatever name, are left out. A very long text is one
row, in a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.llm.common import Scratch, crc_of_id, fields, mix, word_hashes, words_of, written

#: Tokens of a block and n-grams of a bucket, about.
BLOCK_TOKENS = 2_200_000
BUCKET_KEYS = 1_000_000
#: Tokens of a block that are evaluated at a time.
STEP = 1 << 18
#: Occurrences of a context that one bucket takes.
HOT = 500_000
#: Counts up to K are discounted as Good and Turing say, those above by so much of one count.
K = 5
KEPT = 0.01

END = np.uint64(0x9E6C63D0676A9A99)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

SENT = "bucket int, block long, keys binary, contexts binary, n binary, num binary, den binary"
COUNTED = "block long, bucket int, counts binary, asked binary, contexts binary, sums binary, lower binary, histogram long[]"


def pack(a: np.ndarray) -> bytes:
    """The array's bytes by place, compressed: high bytes of small numbers and repeated numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""


def unpack(b: bytes | None, kind: type = np.uint64) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def packed_blocks(docs: DataFrame, learnt: Column, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """block, ids, learnt, lengths (of each document), words (hashes), tokens (local numbers of words): a row for each block."""
    id_type = docs.schema[id_col].dataType
    kind = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("learnt", T.ArrayType(T.BooleanType())),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def row(number, ids, learn, parts, known):
            tokens = np.concatenate(parts)
            often = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")  # frequent words get small numbers
            names = list(known)
            hashes = np.append(word_hashes(names[1:]), END)[np.r_[len(known) - 1, 0 : len(known) - 1]][often]
            number_of = np.empty(len(known), np.uint32)
            number_of[often] = np.arange(len(known), dtype=np.uint32)
            values = (place + number, ids, learn, [len(p) for p in parts], pack(hashes), pack(number_of[tokens]), len(known), len(tokens))
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, out, strict=True)], schema=out)

        number, ids, learn, parts, known, size = 0, [], [], [], {None: 0}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for key, learns, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    words = words_of(text)
                    parts.append(np.fromiter((known.setdefault(w, len(known)) for w in [*words, None]), np.uint32, len(words) + 1))
                    ids.append(key)
                    learn.append(learns)
                    size += len(words) + 1
                    if size >= block_tokens:
                        yield row(number, ids, learn, parts, known)
                        number, ids, learn, parts, known, size = number + 1, [], [], [], {None: 0}, 0
        if ids:
            yield row(number, ids, learn, parts, known)

    return docs.select(id_col, learnt.alias("_learnt"), text_col).mapInArrow(packed, kind)


def bucketed(blocks: DataFrame, name: str, path: str) -> DataFrame:
    """The blocks as a table that is bucketed by block: answers are brought to the blocks, which are never shuffled."""
    spark = blocks.sparkSession
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


class Block:
    """A block's n-grams: for each order the local number of the n-gram that ends at each token (-1: the text is too short before it)."""

    def __init__(self, row: pa.Table, hot: int):
        self.hot = hot
        one = {c: row.column(c)[0].as_py() for c in row.column_names}
        self.number, self.ids, self.words, self.tokens = one["block"], one["ids"], unpack(one["words"]), unpack(one["tokens"], np.uint32).view(np.int32)
        lengths = np.array(one["lengths"])
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]]
        self.lengths, self.learnt = lengths, np.repeat(np.array(one["learnt"], bool), lengths)
        # of order 1: number at each token, hashes, numbers of contexts
        self.at, self.hashes, self.contexts = [None, self.tokens], [None, self.words], [None, np.zeros(len(self.words), np.int64)]
        self.counts: list[np.ndarray | None] = [None]

    def grow(self) -> None:
        """One order more. Numbers take four bytes at each token, as a block's tokens are few enough."""
        k = len(self.at)
        deep = np.ones(len(self.tokens), bool)
        for j in range(k - 1):  # the first k - 1 tokens of each text
            deep[self.starts[self.lengths > j] + j] = False
        valid = np.flatnonzero(deep)
        pair = self.at[k - 1][valid - 1] * np.int64(len(self.words)) + self.tokens[valid]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
        pair, valid = pair[new], valid[order]
        del order
        at = np.full(len(self.tokens), -1, np.int32)
        at[valid] = np.cumsum(new, dtype=np.int32) - 1
        del valid, new
        context, word = np.divmod(pair, max(1, len(self.words)))
        self.at.append(at)
        self.contexts.append(context)
        self.hashes.append(mix(self.hashes[k - 1][context] * GOLDEN + self.words[word]))

    def asked(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of order k that are counted elsewhere, by bucket, and where each bucket begins. Those with an unseen context need no counting."""
        if k == 1:
            some, bucket = np.arange(len(self.words)), self.words % np.uint64(buckets)
        else:
            seen = self.counts[k - 1][self.contexts[k]]
            some = np.flatnonzero(seen > 0)
            spread = (seen[some] // self.hot + 1).astype(np.uint64)
            bucket = mix(self.hashes[k - 1][self.contexts[k][some]] + (self.hashes[k][some] >> np.uint64(20)) % spread * GOLDEN) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16 if buckets < 65536 else np.uint64)
        order = np.argsort(bucket, kind="stable")
        return some[order], np.searchsorted(bucket[order], np.arange(buckets + 1))

    def sent(self, k: int, buckets: int, total: int) -> Iterator[tuple]:
        """Rows of SENT."""
        some, bounds = self.asked(k, buckets)
        known = self.at[k] >= 0
        n = np.bincount(self.at[k][known & self.learnt], minlength=len(self.hashes[k]))
        if k > 1:
            # the shorter form of an n-gram ends at the same token: its number, and its own context's
            shorter = np.zeros(len(self.hashes[k]), np.int64)
            shorter[self.at[k][known]] = self.at[k - 1][known]
            num = self.counts[k - 1][shorter]
            den = self.counts[k - 2][self.contexts[k - 1][shorter]] if k > 2 else np.full(len(shorter), total)
        for b in np.flatnonzero(np.diff(bounds)):
            part = some[bounds[b] : bounds[b + 1]]
            more = (pack(self.hashes[k - 1][self.contexts[k][part]]), pack(num[part].astype(np.uint64)), pack(den[part].astype(np.uint64))) if k > 1 else (None,) * 3
            yield int(b), self.number, pack(self.hashes[k][part]), more[0], pack(n[part].astype(np.uint64)), *more[1:]

    def take(self, k: int, buckets: int, answers: dict[int, bytes]) -> None:
        """The counts of order k, as the buckets have answered."""
        some, bounds = self.asked(k, buckets)
        counts = np.zeros(len(self.hashes[k]), np.int64)
        for b, counted in answers.items():
            counts[some[bounds[b] : bounds[b + 1]]] = unpack(counted).astype(np.int64)
        self.counts.append(counts)


def told(block: pa.Table, answers: pa.Table, buckets: list[int], orders: int, hot: int) -> Block:
    """The block with its n-grams up to so many orders, and the counts of those that have been answered."""
    found: dict[int, dict[int, bytes]] = {}
    for k, b, counted in zip(*(answers.column(c).to_pylist() for c in ("k", "bucket", "counts")), strict=True):
        if counted is not None:
            found.setdefault(k, {})[b] = counted
    out = Block(block, hot)
    for k in range(1, orders + 1):
        if k > 1:
            out.grow()
        if k < len(buckets):
            out.take(k, buckets[k], found.get(k, {}))
    return out


def asking(k: int, buckets: list[int], here: int, total: int, hot: int):
    """Functions from a block (and its answers so far) to its rows of SENT for order k; buckets: of the orders before, here: of this one."""
    sent = to_arrow_schema(fields(SENT))

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = list(told(block, answers, buckets, k, hot).sent(k, here, total))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent) if rows else sent.empty_table()

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = to_arrow_schema(fields("k int, bucket int, counts binary")).empty_table()
        for batch in batches:
            for row in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(row, 1)]), none).to_batches()

    return ask, ask_first


def counter(discounts: np.ndarray | None):
    """The bucket's function: counts of n-grams, answers to the blocks, sums of the contexts, counts of counts. discounts: of the order below."""
    out = to_arrow_schema(fields(COUNTED))

    def counted(bucket: pa.Table) -> pa.Table:
        rows = {c: bucket.column(c).to_pylist() for c in bucket.column_names}
        keys = [unpack(x) for x in rows["keys"]]
        n = np.concatenate([unpack(x) for x in rows["n"]]).astype(np.int64)
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, inverse, n)
        seen = np.flatnonzero(counts)
        histogram = np.r_[np.bincount(np.minimum(counts[seen], K + 2), minlength=K + 3)[1 : K + 2], len(seen), counts.sum()]
        made = [(None, rows["bucket"][0], None, None, None, None, None, histogram.tolist())]
        ends = np.cumsum([len(x) for x in keys])
        contexts = np.concatenate([unpack(x) for x in rows["contexts"]]) if discounts is not None else None
        if contexts is not None:
            c = counts[seen]
            num, den = (np.concatenate([unpack(x) for x in rows[a]])[first[seen]].astype(np.float64) for a in ("num", "den"))
            names, group = np.unique(contexts[first[seen]], return_inverse=True)
            sums = [np.bincount(group, weights=np.where(c == r, 1, 0), minlength=len(names)) for r in range(1, K + 1)]
            sums += [np.bincount(group, weights=x, minlength=len(names)) for x in (np.where(c > K, c, 0), np.where(c > K, 1, 0))]
            lower = np.bincount(group, weights=kept_count(num, discounts) / den, minlength=len(names))
            made[0] = (None, rows["bucket"][0], None, None, pack(names), pack(np.concatenate(sums).astype(np.int64)), pack(lower), made[0][-1])
        for block, end, key in zip(rows["block"], ends, keys, strict=True):
            mine = slice(end - len(key), end)
            found = counts[inverse[mine]]
            asked = None if contexts is None else pack(np.unique(contexts[mine][found == 0]))
            made.append((block, rows["bucket"][0], pack(found.astype(np.uint64)), asked, None, None, None, None))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return counted


def good_turing(histogram: list[int]) -> np.ndarray:
    """d(r) for r = 0 .. K from the numbers n_r of n-grams seen once, twice, ... K + 1 times.

    n_r is smoothed to a power of r (least squares of the logarithms): counts of counts as they are don't fall evenly where texts are copied, and d would exceed 1.
    """
    r = np.array([r for r, n in enumerate(histogram[: K + 1], 1) if n])
    if len(r) > 1:
        x, y = np.log(r), np.log([histogram[k - 1] for k in r])
        power = 1 + ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        if power < 0:
            over = (K + 1.0) ** power
            return np.array([0.0, *[((1 + 1 / k) ** power - over) / (1 - over) for k in range(1, K + 1)]])
    return np.array([0.0, *[(k - 0.5) / k for k in range(1, K + 1)]])


def kept_count(c: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    c = np.asarray(c, np.float64)
    return np.where(c > K, c - KEPT, c * discounts[np.minimum(c, K).astype(np.int64)])


def context_weights(counted: DataFrame, discounts: np.ndarray) -> DataFrame:
    """block, context, alpha: the backoff weight of each context that a block has asked for."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, sums, lower in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, sums = unpack(names), unpack(sums, np.int64).reshape(K + 2, -1)
                r = np.arange(1, K + 1)[:, None]
                seen = (sums[:K] * r * discounts[1 : K + 1, None]).sum(0) + sums[K] - KEPT * sums[K + 1]
                total = (sums[:K] * r).sum(0) + sums[K]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total), pa.array(seen), pa.array(unpack(lower, np.float64))], ["context", "c", "seen", "lower"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = unpack(asked).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names)], ["block", "context"])

    parts = counted.filter("contexts is not null").select("contexts", "sums", "lower").mapInArrow(opened, fields("context long, c long, seen double, lower double"))
    sums = parts.groupBy("context").agg(*[F.sum(a).alias(a) for a in ("c", "seen", "lower")])
    alpha = (1 - F.col("seen") / F.col("c")) / (1 - F.col("lower"))
    asked = counted.filter("asked is not null").select("block", "asked").mapInArrow(listed, fields("block long, context long")).distinct()
    return asked.join(sums.select("context", alpha.alias("alpha")), "context").select("block", "context", "alpha")


def scores(docs: DataFrame, learnt: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS, hot: int = HOT) -> DataFrame:
    """id, learnt, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability): a row for each row of docs.

    learnt says which rows the model learns from; all are scored. base_score is that of counts of single words plus one.
    """
    id_type = docs.schema[id_col].dataType
    scratch = Scratch(docs.sparkSession, "op13")
    blocks = bucketed(packed_blocks(docs, learnt, id_col, text_col, block_tokens), name := f"op13_{uuid.uuid4().hex}", f"{scratch.path}/blocks")
    sizes = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    buckets, discounts, total, distinct = [0], [], 0, 0
    answers = weights = None
    for k in range(1, order + 1):
        here = max(1, -(-(sizes["words" if k == 1 else "tokens"] or 0) // bucket_keys))
        ask, ask_first = asking(k, list(buckets), here, total, hot)
        if k == 1:
            asked = blocks.mapInArrow(ask_first, fields(SENT))
        else:
            asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, fields(SENT))
        counted = scratch.cut(asked.groupBy("bucket").applyInArrow(counter(discounts[-1] if k > 1 else None), fields(COUNTED)))
        sums = counted.filter("histogram is not null").agg(*[F.sum(F.col("histogram")[j]).alias(f"h{j}") for j in range(K + 3)]).first()
        histogram = [x or 0 for x in sums]
        buckets.append(here)
        discounts.append(good_turing(histogram))
        if k == 1:
            distinct, total = histogram[K + 1 :]
            often = [distinct - sum(histogram[:K]), total - sum(r * n for r, n in enumerate(histogram[:K], 1))]  # words seen more than K times, and how often they are
            unknown = 1 - (sum(n * r * discounts[0][r] for r, n in enumerate(histogram[:K], 1)) + often[1] - KEPT * often[0]) / total if total else 1.0
        mine = counted.filter("block is not null").select("block", F.lit(k).alias("k"), "bucket", "counts", F.lit(None).cast("long").alias("context"), F.lit(None).cast("double").alias("alpha"))
        answers = mine if answers is None else answers.union(mine)
        if k > 1:
            more = context_weights(counted, discounts[-1]).select("block", F.lit(k).alias("k"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "context", "alpha")
            weights = more if weights is None else weights.union(more)
    kind = T.StructType([T.StructField(id_col, id_type), *fields("learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    out = to_arrow_schema(kind)

    def evaluate(row: pa.Table, answers: pa.Table) -> pa.Table:
        block = told(row, answers, buckets, order, hot)
        given = answers.filter(pc.is_valid(answers["context"]))
        at = {k: given.filter(pc.equal(given["k"], k)) for k in range(2, order + 1)}
        size = len(block.tokens)
        known, base, value = np.zeros(size, bool), np.zeros(size), np.zeros(size)
        names = [None, None, *[at[k]["context"].to_numpy().view(np.uint64) for k in range(2, order + 1)]]
        sorts = [None if x is None else np.argsort(x) for x in names]
        with np.errstate(divide="ignore", invalid="ignore"):
            for part in (slice(a, a + STEP) for a in range(0, size, STEP)):
                c = block.counts[1][block.tokens[part]]
                known[part], base[part] = c > 0, np.log10((c + 1) / (total + distinct + 1))
                value[part] = np.log10(np.where(c > 0, kept_count(c, discounts[0]) / max(1, total), unknown))
                for k in range(2, order + 1):
                    some = np.flatnonzero(block.at[k][part] >= 0)
                    gram = block.at[k][part][some]
                    context, some = block.contexts[k][gram], some + part.start
                    seen, before = block.counts[k][gram], block.counts[k - 1][context]
                    back = np.flatnonzero((seen == 0) & (before > 0))
                    value[some[seen > 0]] = np.log10(kept_count(seen[seen > 0], discounts[k - 1]) / before[seen > 0])
                    if len(back):
                        place = sorts[k][np.searchsorted(names[k], block.hashes[k - 1][context[back]], sorter=sorts[k])]
                        value[some[back]] += np.log10(at[k]["alpha"].to_numpy()[place])
        add = lambda x: np.add.reduceat(x, block.starts)
        columns = [block.ids, row.column("learnt")[0].as_py(), block.lengths, add(known.astype(np.int64)), np.full(len(block.ids), total), add(base), add(value)]
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, out, strict=True)], schema=out)

    told_all = answers if weights is None else answers.union(weights)
    result = written(blocks.groupBy("block").cogroup(told_all.groupBy("block")).applyInArrow(evaluate, kind), "op13")
    docs.sparkSession.sql(f"drop table {name}")
    scratch.drop()
    return result


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the decimal id leaves 2 by 7; a null id is not held out."""
    return F.coalesce(crc_of_id(doc_id) % 7 == 2, F.lit(False))
