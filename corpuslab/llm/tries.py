"""The prefix trie of conversations: which beginnings are shared, by how many, and how much text that saves.

A turn is a role and a text (null: empty), known by a 16-byte hash. A node is a distinct sequence of first turns; its key is hashed on from its
parent's key. Equal conversations are first collapsed to one sequence with its count and least id. Sequences are then sorted and dealt out by ranges
of their order, and each range is cut into shards of at most SHARD_TURNS turns, so neither a frequent first turn nor a group of copies makes a large
shard. A shard numbers its turns densely and packs its trie into a double array: the child of state s by turn id a is the slot BASE[s] + a, if
CHECK of that slot is s. All sequences walk through the arrays together, one turn a step, and leave their counts and least ids in the states; sums
over subtrees go up along CHECK.

Nodes on the path of a shard's first or last sequence may continue in the neighbouring shards (those above all others, the upper nodes, always
do); all others are complete. The former are merged over all shards: counts add up, and what hangs below them is summed through their
paths. These are at most two paths a shard.

Conversations of more than BAND turns are cut into bands of so many turns, so that no row and no path grows with a conversation; bands are solved
from the deepest upward, each handing the sums of its tries to the ends of the band above. A table whose longest conversation has one band needs
one pass. Turns are numbered by ranges of their order, so a conversation with a large part of all rows is many tasks, up to where its bands meet.

Rows without a conversation id are left out. Turns come by turn number, nulls first, then by role and text; repeated rows are repeated turns. An
empty table has no nodes. Only conv_id, turn, role and text are read, other columns, of whatever name, are left out. Long texts are hashed where
they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.llm.common import Scratch, crc_of_id, fields, written
from corpuslab.operators.ranges import numbered

BAND = 256
SHARD_TURNS = 250_000
#: Characters of ids that are hashed from one row.
CHUNK = 1 << 16

ROOT = bytes(16)
TAIL = ("t_children", "t_leaves", "t_saved")
NODE = "key binary, parent_key binary, end_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, bytes long, n_children long, n_leaves long, saved_tokens long, t_children long, t_leaves long, t_saved long, path binary[], edge boolean, top boolean"


def chained(before: Column, key: Column) -> Column:
    return F.unhex(F.md5(F.concat(before, key)))


def turns(table: DataFrame) -> DataFrame:
    """conv, pos (from 1), key, bytes (of the text): the turns of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = table.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    placed = numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos")
    return placed.select("conv", "pos", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))


def head_length(conv: Column) -> Column:
    return crc_of_id(conv) % 9


def rebuilt(rows: DataFrame) -> DataFrame:
    """The turns of every conversation c: the first h of c - c % 5, then its own after the first h. pos rises, with a gap where the other one is short."""
    conv = F.col("conv")
    ids = rows.select("conv").distinct()
    heads = rows.filter((conv % 5 == 0) & (F.col("pos") <= 8)).withColumn("c", F.explode(F.sequence(conv - 4, conv + 4)))
    heads = heads.filter((F.col("c") - F.col("c") % 5 == conv) & (F.col("pos") <= head_length(F.col("c")))).select(F.col("c").alias("conv"), "pos", "key", "bytes")
    own = rows.filter(F.col("pos") > head_length(conv))
    return heads.join(ids, "conv", "left_semi").unionByName(own)


def sequences(rows: DataFrame, ids: DataFrame, band: int) -> DataFrame:
    """conv, band, p (what comes before, as a key), above (turns before), keys, sizes, end_key, last: a row for each band of each conversation; band 0 may be empty."""
    marks = ids.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("bytes"))
    every = rows.unionByName(marks).withColumn("band", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / band))
    bands = every.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("t"))
    bands = bands.withColumn("t", F.filter("t", lambda x: x["key"].isNotNull())).withColumns({"keys": F.col("t.key"), "sizes": F.col("t.bytes")})
    bands = bands.withColumn("digest", F.unhex(F.md5(F.aggregate("keys", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)))))
    order = Window.partitionBy("conv").orderBy("band")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumns({
        "p": F.aggregate(F.collect_list("digest").over(before), F.lit(ROOT), chained),
        "above": F.coalesce(F.sum(F.size("keys")).over(before), F.lit(0)).cast("long"),
        "last": F.lead("band").over(order).isNull(),
    })
    return bands.select("conv", "band", "p", "above", "keys", "sizes", chained(F.col("p"), F.col("digest")).alias("end_key"), "last")


class DoubleArray:
    """A trie over sequences of numbers from 1, sorted so that equal beginnings are neighbours. State 0 is the root."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = -2
        self.free, self.size = 1, 1
        self.order = [(0, 0)]  # states and their turn ids, parents first
        todo = [(0, 0, len(starts), 0)]
        for state, lo, hi, depth in todo:
            if lengths[lo] == depth:  # the sequence that ends here is the first
                lo += 1
            if lo == hi:
                continue
            if hi - lo == 1:
                ids, bounds = flat[starts[lo] + depth : starts[lo] + depth + 1], [lo, hi]
            else:
                column = flat[starts[lo:hi] + depth]
                first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
                ids, bounds = column[first], [*(first + lo).tolist(), hi]
            base = self.place(ids)
            self.base[state] = base
            self.check[base + ids] = state
            for k, a in enumerate(ids.tolist()):
                self.order.append((base + a, a))
                todo.append((base + a, bounds[k], bounds[k + 1], depth + 1))

    def place(self, ids: np.ndarray) -> int:
        """A base at which the slots of all these ids are free."""
        least, most = int(ids.min()), int(ids.max())
        while self.free < self.size and self.check[self.free] != -1:
            self.free += 1
        at, tries = self.free, 0
        while True:
            if tries >= 32:
                at = max(at, self.size)
            base = at - least
            self.grow(base + most + 1)
            if (self.check[base + ids] == -1).all():
                break
            at += 1
            while at < self.size and self.check[at] != -1:
                at += 1
            tries += 1
        self.size = max(self.size, base + most + 1)
        return base

    def grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        after = self.base[states] + ids
        assert (self.check[after] == states).all()
        return after


def shard_nodes(rows: list[dict]) -> list[tuple]:
    """Rows of NODE of one shard: sorted sequences with p, above, keys, sizes, end_key, n, conv and the sums below their ends."""
    number: dict[bytes, int] = {}
    names: list[bytes] = [b""]
    flat, lengths = [], np.array([len(r["keys"]) + 1 for r in rows])
    for r in rows:
        for key in (r["p"], *r["keys"]):
            if key not in number:
                number[key] = len(names)
                names.append(key)
            flat.append(number[key])
    flat, starts = np.array(flat), np.r_[0, np.cumsum(lengths)[:-1]]
    sizes = np.fromiter((x for r in rows for x in (0, *r["sizes"])), np.int64, len(flat))
    trie = DoubleArray(flat, starts, lengths)
    slots = trie.size
    n, least, size, depth, edge = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max), np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
    count, conv, above = (np.array([r[c] for r in rows], np.int64) for c in ("n", "conv", "above"))
    state, end = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    edge[0] = True
    for d in range(int(lengths.max())):
        live = np.flatnonzero(lengths > d)
        state[live] = trie.step(state[live], flat[starts[live] + d])
        at = state[live]
        np.add.at(n, at, count[live])
        np.minimum.at(least, at, conv[live])
        size[at], depth[at] = sizes[starts[live] + d], above[live] + d
        edge[at[(live == 0) | (live == len(rows) - 1)]] = True
        if not d:
            edge[at] = True  # whatever begins a band is merged
        end[live] = at
    tail = np.zeros((3, slots), np.int64)
    end_key: dict[int, bytes] = {}
    for k, s in enumerate(end.tolist()):
        end_key[s] = rows[k]["end_key"]
        tail[:, s] = [rows[k][c] or 0 for c in TAIL]
    states = [s for s, _ in trie.order]
    children, leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for s in reversed(states[1:]):
        up = trie.check[s]
        if not edge[s]:
            children[s] += tail[0, s]
            leaves[s] += tail[1, s] if children[s] else 1
            saved[s] += tail[2, s] + (n[s] - 1) * size[s]
            children[up] += 1
            leaves[up] += leaves[s]
            saved[up] += saved[s]
    key, path, out = {0: b""}, {0: []}, []
    for s, a in trie.order[1:]:
        up = int(trie.check[s])
        key[s] = names[a] if not up else hashlib.md5(key[up] + names[a]).digest()
        if edge[s]:
            path[s] = path[up] + [key[s]]
        parent = None if edge[up] else int(least[up])
        told = (int(depth[s]), int(least[s]), parent, int(n[s]), int(size[s]), int(children[s]), int(leaves[s]), int(saved[s]), *map(int, tail[:, s]))
        out.append((key[s], key[up] or None, end_key.get(s), *told, path.get(s), bool(edge[s]), up == 0))
    return out


def shards(shard_turns: int):
    """A function from sorted sequences to their nodes, a shard at a time."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(fields(NODE))
        rows: list[dict] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*shard_nodes(rows), strict=True), out, strict=True)], schema=out)

        for batch in batches:
            for r in batch.to_pylist():
                if size + len(r["keys"]) + 1 > shard_turns and rows:
                    yield made()
                    rows, size = [], 0
                rows.append(r)
                size += len(r["keys"]) + 1
        if rows:
            yield made()

    return nodes


def merged(nodes: DataFrame) -> DataFrame:
    """One row for each node on the edge of a shard, with what hangs below it."""
    first = [F.first(c).alias(c) for c in ("parent_key", "depth", "bytes", "path", "top")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", *TAIL)]
    one = nodes.filter("edge").groupBy("key").agg(*first, F.max("end_key").alias("end_key"), F.min("conv_id").alias("conv_id"), *sums)
    below = one.filter(~F.col("top")).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    one = one.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)) + F.col("t_children"))
    leaves = F.col("n_leaves") + F.col("t_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + F.col("t_saved") + (F.col("n_convs") - 1) * F.col("bytes")
    one = one.withColumns({"n_leaves": leaves, "saved_tokens": saved})
    whole = one.select(F.explode("path").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return one.drop("n_leaves", "saved_tokens", "path", "more", *TAIL).join(whole, "key")


def hashed_ids(ends: DataFrame, chunk: int) -> DataFrame:
    """end_key, ends_sha256: SHA-256 of the decimal ids of each end, ascending, comma-joined. Ids are joined in many tasks; one hashes their chunks one after the other."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, rows = None, [], 0, []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size > chunk:
                    if ids:
                        rows.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids, size = k, [], 0
                ids.append(c)
                size += len(str(c)) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["end_key", "least", "ids"])
                rows = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["end_key", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["end_key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["end_key", "ends_sha256"])

    parts = ends.repartitionByRange(n, "end_key", "conv").sortWithinPartitions("end_key", "conv").mapInArrow(chunks, fields("end_key binary, least long, ids string"))
    return parts.repartition(n, "end_key").sortWithinPartitions("end_key", "least").mapInArrow(digests, fields("end_key binary, ends_sha256 string"))


def prefix_trie(rows: DataFrame, ids: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS, chunk: int = CHUNK) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    rows: conv, pos (rising), key, bytes; ids: conv, all conversations, those without turns too.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "op11")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seqs = scratch.cut(sequences(rows, ids, band))
    bands = (seqs.agg(F.max("band").alias("b")).first()["b"] or 0) + 1
    same = seqs.groupBy("band", "end_key").agg(*[F.first(c).alias(c) for c in ("p", "above", "keys", "sizes")], F.count("*").alias("n"), F.min("conv").alias("conv"))
    same = scratch.cut(same)
    tails, whole, known = None, None, None
    for k in range(bands - 1, -1, -1):
        part = same.filter(F.col("band") == k)
        if tails is None:
            part = part.withColumns({c: F.lit(None).cast("long") for c in TAIL})
        else:
            part = part.join(tails, "end_key", "left")
        dealt = part.drop("band").repartitionByRange(n, "p", "keys").sortWithinPartitions("p", "keys")
        nodes = scratch.cut(dealt.mapInArrow(shards(shard_turns), fields(NODE)))
        upper = scratch.cut(merged(nodes))
        columns = ["parent_key", "end_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        mine = nodes.filter(~F.col("edge")).select(*columns)
        mine = mine.unionByName(upper.filter(~F.col("top") if k else F.lit(True)).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
        names = upper.filter(~F.col("top") if k else F.lit(True)).select("key", F.col("conv_id").alias("up"))
        if tails is not None:  # ends that go on below are the parents of what begins there
            names = names.unionByName(mine.join(tails.select("end_key"), "end_key", "left_semi").select(F.col("end_key").alias("key"), F.col("conv_id").alias("up")))
        tails = upper.filter("top").select(F.col("key").alias("end_key"), F.col("n_children").alias("t_children"), F.col("n_leaves").alias("t_leaves"), F.col("saved_tokens").alias("t_saved"))
        whole, known = (mine, names) if whole is None else (whole.unionByName(mine), known.unionByName(names))
    lost = whole.filter("parent_conv_id is null and depth > 0").drop("parent_conv_id").join(known.withColumnRenamed("key", "parent_key"), "parent_key").withColumnRenamed("up", "parent_conv_id")
    every = whole.filter("parent_conv_id is not null or depth = 0").unionByName(lost)
    ends = hashed_ids(seqs.filter("last").select("end_key", "conv"), chunk)
    out = every.join(ends, "end_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    result = written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "op11")
    scratch.drop()
    return result


def rebuilt_trie(table: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations of a table with conv_id, turn, role and text."""
    rows = written(turns(table), "op11-turns")
    return prefix_trie(rebuilt(rows), rows.select("conv").distinct(), band, shard_turns, chunk)
