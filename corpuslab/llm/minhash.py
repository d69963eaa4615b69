"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct shingles of n words. Documents are linked where 100 * intersection >= threshold * union.

Tables. Two collections of ``bands`` half keys are made, each half key from ``rows`` minhashes; table (i, j) is keyed by half key i
of the first collection with half key j of the second. So 2 * bands * rows minhashes serve bands^2 tables of 2 * rows minhashes each,
for which plain banding computes bands^2 * 2 * rows. A pair of similarity s meets in some table with probability
(1 - (1 - s^rows)^bands)^2: for 16 bands of 4 rows 0.99998 at 0.85, more above.

Classes. Documents with the same set are one class, whose key is a 128-bit hash of the set; copies are never paired.

Candidates. Half keys of one class alone are dropped first, so a class without neighbours makes no table keys. Links matter only
for what they connect, so groups are not expanded into pairs:

1. in each table bucket every class is paired with one pivot of the bucket (least key; then, in a second round, most links so far);
   candidates are confirmed on full sets, links give components;
2. in what remains, every class that is not in the component of its bucket's pivot is paired with all classes of its bucket in other
   components. After this each candidate pair either was confirmed or rejected, or lies within one component, so the components
   are those of all candidate pairs. No bucket is capped.

Confirmation reads the full sets, made again from the texts of candidates only. Before that, pairs are dropped whose sizes exclude
the threshold and pairs that differ in too many of 1024 parity bits to reach it. Both bounds are exact.

Documents with fewer words than a shingle have one shingle, their whole sequence; those without words have an empty set, are linked
with nothing and are components of their own. A null text has no words. Null ids are carried: a component's id is its least id that is
not null. Repeated rows are copies. An empty table gives an empty table. Only the named columns are read, others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, broadcast_if_small, map_rows, mix, windows, word_hashes, words_of, written
from corpuslab.llm.graphs import all_salts, components, with_salts

#: Shingles hashed at a time; bounds the worker's memory on very long texts.
BLOCK = 4096

#: Candidates of up to so many rows of 32 bytes are broadcast to find their texts; more are joined by shuffle.
SMALL_NODES = 500_000

#: Classes of a bucket in one part of the exact round, about.
BUCKET_ROWS = 1024


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(words) < n:
        return windows(h, len(words))
    return np.unique(windows(h, n))


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    at = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at[:count, None], at[count:, None] | np.uint64(1)


def minhashes(hashes: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        h = (hashes[None, at : at + BLOCK] ^ masks) * factors
        np.minimum(least, h.min(axis=1), out=least)
    return least


def parities(hashes: np.ndarray) -> np.ndarray:
    """1024 bits: whether a 1024th of the hash range holds an odd number of the set's shingles.

    Each bit in which two sets differ stands for a shingle at least that only one of them has.
    """
    odd = np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (16 bytes, null for an empty set), odd (see parities), left and right (half keys)."""

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        masks, factors = seeds(2 * bands * rows)
        for doc_id, text_key, text in it:
            hashes = shingle_set(text, n)
            if not len(hashes):
                yield doc_id, text_key, 0, None, None, None, None
                continue
            least = minhashes(hashes, masks, factors)
            keys = np.zeros(2 * bands, np.uint64)
            for k in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[k::rows])
            keys = keys.view(np.int64).tolist()
            yield doc_id, text_key, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), parities(hashes).tolist(), keys[:bands], keys[bands:]

    read = docs.select(docs[id_col].cast("long"), F.xxhash64(docs[text_col]), docs[text_col])
    return map_rows(read, made, "doc_id long, text_key long, n_shingles long, node binary, odd long[], left long[], right long[]")


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """node, shingles (sorted) of the (node, text_key, rep_id) given, from the text of that row alone: copies are not read again."""

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        for node, text in it:
            yield node, shingle_set(text, n).view(np.int64).tolist()

    texts = docs.select(docs[id_col].cast("long").alias("_id"), F.xxhash64(docs[text_col]).alias("_key"), docs[text_col].alias("_text"))
    wanted = broadcast_if_small(nodes.select("node", "text_key", "rep_id"), SMALL_NODES)
    few = texts.join(wanted, (texts["_key"] == wanted["text_key"]) & texts["_id"].eqNullSafe(wanted["rep_id"]))
    one = few.groupBy("node").agg(F.first("_text").alias("_text"))  # repeated rows have one text
    return map_rows(one, made, "node binary, shingles long[]")


def may_reach(percent: int, n1: Column, n2: Column, odd1: Column, odd2: Column) -> Column:
    """Whether the sets' sizes and parities leave the threshold within reach; never false for a linked pair."""
    apart = F.aggregate(F.zip_with(odd1, odd2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 100 * (n1 + n2 - apart) >= percent * (n1 + n2 + apart)


def short(node: Column) -> Column:
    """Eight bytes for a node where it only narrows candidates: two nodes that share them are compared, not merged."""
    return F.xxhash64(node)


def with_neighbours(signed: DataFrame) -> DataFrame:
    """One row for each class that shares a half key with another class in both collections, with the numbers of the shared keys as bits."""
    out = None
    for side in ("left", "right"):
        rows = signed.select(short(F.col("node")).alias("h"), F.posexplode(side).alias("i", "x"))
        shared = rows.groupBy("i", "x").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("i", "x")
        bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias(f"{side}_bits")
        found = rows.join(shared.hint("merge"), ["i", "x"]).groupBy("h").agg(bits)
        out = found if out is None else out.join(found, "h")
    rows = signed.withColumn("h", short(F.col("node"))).join(out, "h")
    one = rows.groupBy("node").agg(F.min_by(F.struct("text_key", F.col("doc_id").alias("rep_id"), F.col("n_shingles").alias("n"), "odd", "left", "right", "left_bits", "right_bits"), F.struct("text_key", "doc_id")).alias("s"))
    return one.select("node", "s.*")


class Linker:
    """The candidate rounds over classes with neighbours; each method is a few DataFrame steps.

    Table rows hold three numbers: the bucket, the class's rank (few links last, then by hash) and eight bytes of its component. They are
    made from the classes whenever needed and never kept; they meet by shuffle at any size, so a plan of a small table is that of a large one.
    A bucket's pivot is its least rank. The tables of a round are removed after it.
    """

    def __init__(self, docs: DataFrame, near: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.percent, self.near, self.kept = percent, near, Scratch(docs.sparkSession, "op2-links")
        self.sets = self.kept.cut(sets_of(docs, near, id_col, text_col, n))
        self.round = Scratch(docs.sparkSession, "op2-round")

    def ranked(self, roots: DataFrame | None, links: DataFrame | None) -> DataFrame:
        """The classes with root and rank."""
        out = self.near.drop("text_key", "rep_id")
        out = out.withColumn("root", F.col("node")) if roots is None else out.join(roots, "node")
        degree = F.lit(0).cast("long")
        if links is not None:
            ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
            out, degree = out.join(ends, "node", "left"), F.coalesce("degree", F.lit(0).cast("long"))
        few = (1 << 20) - F.least(degree, F.lit((1 << 20) - 1))
        rank = F.shiftleft(few, 42).bitwiseOR(F.shiftrightunsigned(short(F.col("node")), 22))
        return self.round.cut(out.withColumn("rank", rank).drop("degree"))

    @staticmethod
    def table_rows(info: DataFrame, *more: str) -> DataFrame:
        """bucket, rank, r of each class and each table in which it may meet another."""
        has = lambda bits, i: F.call_function("getbit", F.col(bits), F.col(i)) == 1
        rows = info.select("rank", short(F.col("root")).alias("r"), *more, "left_bits", "right_bits", "right", F.posexplode("left").alias("i", "x")).filter(has("left_bits", "i"))
        rows = rows.select("rank", "r", *more, "right_bits", "i", "x", F.posexplode("right").alias("j", "y")).filter(has("right_bits", "j"))
        return rows.select(F.xxhash64("i", "j", "x", "y").alias("bucket"), "rank", "r", *more)

    def linked(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """Of the pairs of ranks (a, b) those across components that are linked, as nodes, confirmed on full sets."""
        a, b = (info.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rank", "node", "root", "n", "odd")]) for p in "ab")
        both = pairs.join(a, pairs["a"] == a["a_rank"]).join(b, pairs["b"] == b["b_rank"]).filter("a_root <> b_root")
        both = both.filter(100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n"))
        both = both.filter(may_reach(self.percent, F.col("a_n"), F.col("b_n"), F.col("a_odd"), F.col("b_odd")))
        near = self.round.cut(both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
        asked = broadcast_if_small(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), SMALL_NODES)
        sets = self.sets.join(asked, "node", "left_semi")
        x, y = (sets.select(F.col("node").alias(f"{p}_node"), F.col("shingles").alias(f"{p}_set")) for p in "ab")
        full = near.join(x, near["a"] == x["a_node"]).join(y, near["b"] == y["b_node"])
        common = F.size(F.array_intersect("a_set", "b_set"))
        return self.kept.cut(full.filter(100 * common >= self.percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b"))

    def roots(self, links: DataFrame) -> DataFrame:
        """node, root of all classes with neighbours; a class without links is its own root."""
        found = components(links, self.kept).withColumnRenamed("node", "_node")
        nodes = self.near.select("node")
        return self.kept.cut(nodes.join(found, nodes["node"] == found["_node"], "left").select("node", F.coalesce("root", "node").alias("root")))

    def star_round(self, info: DataFrame) -> DataFrame:
        """Every class with the pivot of each of its buckets that holds several components."""
        pivots = self.table_rows(info).groupBy("bucket").agg(F.min("rank").alias("pivot"), F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo <> hi").select("bucket", "pivot")
        pairs = self.table_rows(info).join(pivots.hint("merge"), "bucket").filter("rank <> pivot").select(F.col("rank").alias("a"), F.col("pivot").alias("b")).distinct()
        return self.linked(pairs, info)

    def exact_round(self, info: DataFrame) -> DataFrame:
        """All candidate pairs across components that can be linked.

        Of its shingles, a class shares at most ``most`` with any other class in an open bucket: those that some other such class holds. So a
        pair's intersection is at most the lesser ``most``, which rules out, exactly, nearly all pairs of a large group whose members
        differ too much; only the others are paired, if their parities allow. A bucket of many classes is dealt into parts by one side.
        """
        buckets = self.table_rows(info).groupBy("bucket").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo <> hi").select("bucket")
        open_ranks = self.round.cut(self.table_rows(info).join(buckets.hint("merge"), "bucket").select("rank").distinct())
        some = info.join(open_ranks, "rank")
        held = self.sets.join(broadcast_if_small(some.select("node"), SMALL_NODES), "node").select(short(F.col("node")).alias("h"), F.explode("shingles").alias("s"))
        single = held.groupBy("s").agg(F.count("*").alias("c"), F.min("h").alias("h")).filter("c = 1").groupBy("h").agg(F.count("*").alias("own"))
        some = some.withColumn("h", short(F.col("node"))).join(single, "h", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
        some = some.filter(100 * F.col("most") >= self.percent * F.col("n")).drop("h", "own")
        some = self.round.cut(some)
        rows = self.table_rows(some, "n", "most", "odd")
        state = rows.groupBy("bucket").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.min("n").alias("least"), F.min(F.struct("rank", "r")).alias("p"), F.count("*").alias("c")).filter("lo <> hi")
        parts = (F.floor(F.col("c") / BUCKET_ROWS) + 1).alias("parts")
        rows = rows.join(state.select("bucket", "least", F.col("p.r").alias("pivot_r"), parts).hint("merge"), "bucket")
        rows = rows.filter(100 * F.col("most") >= self.percent * (F.col("n") + F.greatest("least", "most") - F.col("most")))
        rows = self.round.cut(rows.select("bucket", "rank", "r", "n", "most", "pivot_r", "parts", "odd"))
        out = rows.filter("r <> pivot_r").withColumn("part", F.pmod(F.xxhash64("rank"), F.col("parts")))
        out = out.select("bucket", "part", *[F.col(c).alias(f"u_{c}") for c in ("rank", "r", "n", "most", "odd")])
        inside = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        both = F.least("most", "u_most")
        meet = (F.col("u_r") != F.col("r")) & (100 * both >= self.percent * (F.col("n") + F.col("u_n") - both))
        meet = meet & ((F.col("r") == F.col("pivot_r")) | (F.col("u_rank") < F.col("rank")))  # a pair is made once if both sides are outside
        meet = meet & may_reach(self.percent, F.col("n"), F.col("u_n"), F.col("odd"), F.col("u_odd"))
        pairs = out.join(inside.hint("merge"), ["bucket", "part"]).filter(meet).select(F.least("u_rank", "rank").alias("a"), F.greatest("u_rank", "rank").alias("b")).distinct()
        return self.linked(pairs, some)

    def next_round(self) -> None:
        self.round.drop()
        self.round = Scratch(self.near.sparkSession, "op2-round")

    def all_roots(self) -> DataFrame:
        links = self.star_round(self.ranked(None, None))
        self.next_round()
        links = self.kept.cut(links.union(self.star_round(self.ranked(self.roots(links), links))))
        self.next_round()
        links = links.union(self.exact_round(self.ranked(self.roots(links), links)))
        roots = self.roots(links)
        self.round.drop()
        return roots


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 16, rows: int = 4
) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), node, n_shingles, component_id, kept; one row for each row of docs.

    component_id is the least id in the document's component; kept marks one (id, text) of it: that id, of several texts under it the one
    of the least node, then text_key. So ids that are null or repeated save no further text; repeated rows of that id and text are marked alike.
    """
    signed = written(signatures(docs, id_col, text_col, shingle_words, bands, rows), "op2-signed")
    full = signed.filter("node is not null")
    near = written(with_neighbours(full), "op2-near")
    roots = Linker(docs, near, id_col, text_col, shingle_words, percent).all_roots()
    classes = full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("s"))
    placed = classes.select("node", "s").join(roots, "node", "left").select("node", "s", F.coalesce("root", "node").alias("root"))
    first = F.struct("s.no_id", "s.doc_id", "node", "s.text_key")
    placed = placed.withColumn("own", first)
    several = placed.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("c")).filter("c > 1").select(F.col("root").alias("_root"), "first")
    found = with_salts(placed, "root", "node").join(all_salts(several, "_root"), ["_salt", "_key"], "left").withColumn("first", F.coalesce("first", "own"))
    kept_key = F.when(F.col("node") == F.col("first.node"), F.col("first.text_key"))
    ids = found.select("node", F.col("first.doc_id").alias("component_id"), kept_key.alias("kept_key"))
    out = signed.select("doc_id", "text_key", "node", "n_shingles").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_key").eqNullSafe(F.col("kept_key")))
    return out.select("doc_id", "text_key", "node", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns; of repeated rows of one id and text, one."""
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.withColumn("_text_key", F.xxhash64(docs[text_col]))
    match = rows[id_col].cast("long").eqNullSafe(kept["_id"]) & (rows["_text_key"] == kept["_key"])
    return rows.join(kept, match, "left_semi").dropDuplicates([id_col, "_text_key"]).select(*docs.columns)
