"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring lower-cased words (the last word also alone), weighted by their number. Each term's 128-bit hash votes
on every bit, 1 for and 0 against; a bit of the fingerprint is 1 if more than half of the weight votes for it. The votes of all bits are
64 sums: adding (hash >> i) & 0x100000001 counts bits i and i + 32 in the two halves of one number, which no text can overflow.

Search: bits are cut into blocks, and a table is kept for each choice of ``blocks - radius`` of them, permuted to the front as its key. Two
fingerprints within the radius differ in at most ``radius`` blocks, so they agree on the key of some table, and none is missed.

A text without words has the fingerprint 0; equal texts have equal fingerprints. A null text counts as empty. Everything is
DataFrame expressions.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import SPACES, broadcast_if_small, written
from corpuslab.llm.graphs import SALTS

LANES = 0x0000000100000001
BLANKS = " \t\n\x0b\x0c\r"
LEAST_LONG = -(2**63)

#: Rows of a range of neighbours, about, and the number of ranges at most (their bounds are literals of the plan).
RANGE_ROWS = 1024
MOST_RANGES = 2000

#: The search's radius in bits and number of blocks; fingerprints of a key in one part of it, about.
RADIUS = 4
BLOCKS = 6
BUCKET_ROWS = 1024


def terms(text: Column) -> Column:
    """Array of (first, second) words; second is null for the last word."""
    words = F.split(F.btrim(F.lower(text), F.lit(BLANKS)), f"[{SPACES}]+")
    return F.arrays_zip(words.alias("first"), F.slice(words, F.lit(2), F.greatest(F.lit(1), F.size(words))).alias("second"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, hi, lo (the two halves of the fingerprint) for each distinct value of the keys; rows with equal keys vote together."""
    pairs = texts.select(*keys, F.explode(terms(texts[text_col])).alias("_t"))
    first, second = F.col("_t.first"), F.col("_t.second")
    hashed = pairs.select(*keys, F.xxhash64(first, second).alias("_hi"), F.xxhash64(second, first, F.lit(1)).alias("_lo"), (first != "").cast("long").alias("_w"))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"{h}{i}") for h in ("_hi", "_lo") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.sum("_w").alias("_n"), *sums)

    def half(h: str) -> Column:
        bits = [F.when(2 * F.col(f"{h}{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("_n"), F.lit(1 << i)).otherwise(0) for i in range(32)]
        bits += [F.when(2 * F.shiftrightunsigned(f"{h}{i}", 32) > F.col("_n"), F.lit(1 << (i + 32) if i < 31 else LEAST_LONG)).otherwise(0) for i in range(32)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0].cast("long")

    return votes.select(*keys, half("_hi").alias("hi"), half("_lo").alias("lo"))


def written_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def block_masks(blocks: int) -> list[tuple[int, int]]:
    """For each block of bits its masks in hi and lo, as signed numbers."""
    edges = [128 * k // blocks for k in range(blocks + 1)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    whole = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [(signed(m >> 64), signed(m & (2**64 - 1))) for m in whole]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, queries: DataFrame | None = None) -> DataFrame:
    """a_hi, a_lo, b_hi, b_lo, distance: pairs of different fingerprints within the radius, each once.

    Without queries all such pairs, smaller one first; else all (query, fingerprint) pairs. Equal fingerprints are one row before the search,
    so groups of copies cost nothing. Keys that one fingerprint has alone, or no query, are dropped first. A key with very many
    fingerprints is dealt into parts by one side. A pair that shares several tables is made in the first of them only.
    """
    if not 0 < radius < blocks <= 16:
        raise ValueError("give a radius under the number of blocks, and at most 16 of these")
    masks = block_masks(blocks)
    chosen = list(combinations(range(blocks), blocks - radius))
    named = prints.select("hi", "lo").distinct().withColumn("asked", F.lit(queries is None))
    if queries is not None:
        both = named.unionByName(queries.select("hi", "lo", F.lit(True).alias("asked")))
        named = both.groupBy("hi", "lo").agg(F.max("asked").alias("asked"))
    named = written(named, "op10-prints")

    def key(t: int, table: tuple[int, ...]) -> Column:
        hi = sum(masks[k][0] % 2**64 for k in table)
        lo = sum(masks[k][1] % 2**64 for k in table)
        kept = lambda c, m: F.col(c).bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))
        return F.xxhash64(F.lit(t), kept("hi", hi), kept("lo", lo))

    rows = named.select("hi", "lo", "asked", F.posexplode(F.array(*[key(t, c) for t, c in enumerate(chosen)])).alias("t", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("asked").alias("asked")).filter("c > 1 and asked")
    shared = written(shared.select("key", (F.floor(F.col("c") / BUCKET_ROWS) + 1).alias("parts")), "op10-keys")
    rows = rows.join(broadcast_if_small(shared), "key")
    part = F.pmod(F.xxhash64("hi", "lo"), F.col("parts"))
    a = rows.filter("asked").select("key", "t", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    b = rows.select("key", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), part.alias("part"))
    apart = distance(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo"))
    equal = sum(
        F.when((F.col("a_hi").bitwiseXOR(F.col("b_hi")).bitwiseAND(F.lit(hi)) == 0) & (F.col("a_lo").bitwiseXOR(F.col("b_lo")).bitwiseAND(F.lit(lo)) == 0), 1 << k).otherwise(0)
        for k, (hi, lo) in enumerate(masks)
    )
    first = [next((t for t, c in enumerate(chosen) if all(e >> k & 1 for k in c)), -1) for e in range(1 << blocks)]
    wanted = (F.col("a_hi") < F.col("b_hi")) | ((F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo")))
    if queries is not None:
        wanted = (F.col("a_hi") != F.col("b_hi")) | (F.col("a_lo") != F.col("b_lo"))
    met = (F.element_at(F.array(*[F.lit(t) for t in first]), (equal + 1).cast("int")) == F.col("t")) & (apart <= radius) & wanted
    return a.join(b, ["key", "part"]).filter(met).select("a_hi", "a_lo", "b_hi", "b_lo", apart.alias("distance"))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text (the text that follows by descending id, after the last the first), _id, _hash, next_id, next_hash (which rows these are).

    Rows of one id follow each other by a hash of their text; null ids come last. The table is cut into ranges of about RANGE_ROWS rows by
    quantiles of the id, an id with very many rows also by the hash. Each range ends with a copy of the next one's first row, so one
    shuffle of the texts is enough. The first rows of the ranges, at most MOST_RANGES, are found from ids and hashes and are literals.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(LEAST_LONG)), "_hash": F.xxhash64("text")})
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, math.ceil(n / RANGE_ROWS)))
    bounds = rows.agg(F.percentile_approx("_id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("b")).first().b if n and ranges > 1 else []
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    below = F.size(F.filter(held, lambda b: b < F.col("_id")))
    same = F.size(F.filter(held, lambda b: b == F.col("_id")))
    share = F.least(same - 1, F.floor((F.col("_hash") / float(2**64) + 0.5) * same).cast("int"))
    ranged = rows.withColumn("_range", below + F.when(same > 1, share).otherwise(0))
    firsts = ranged.groupBy("_range").agg(F.max(F.struct("_id", "_hash")).alias("f")).orderBy(F.desc("_range")).collect()
    guards = [(firsts[k - 1]["_range"], r["f"]["_id"], r["f"]["_hash"]) for k, r in enumerate(firsts)]
    # the first of all follows the last range, as firsts[-1] is the last
    held = F.array(*[F.struct(F.lit(t).alias("_to"), F.lit(i).cast("long").alias("_gid"), F.lit(h).cast("long").alias("_ghash")) for t, i, h in guards or [(0, 0, 0)]])
    guard = docs.sparkSession.range(1).select(F.inline(held))
    copies = rows.join(F.broadcast(guard), (rows["_id"] == guard["_gid"]) & (rows["_hash"] == guard["_ghash"]))
    both = ranged.withColumn("_guard", F.lit(0)).unionByName(copies.select("doc_id", "text", "_id", "_hash", F.col("_to").alias("_range"), F.lit(1).alias("_guard")))
    order = Window.partitionBy("_range").orderBy("_guard", F.desc("_id"), F.desc("_hash"))
    following = {f"next_{c.strip('_')}": F.lead(c).over(order) for c in ("text", "_id", "_hash")}
    return both.withColumns(following).filter("_guard = 0").select("doc_id", "text", "next_text", "_id", "_hash", "next_id", "next_hash")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: str = "doc_id % 20 = 0") -> DataFrame:
    """For each row its fingerprint, that of its edited text (its last half replaced by the start of the next document), and their likeness.

    Likeness is the share of equal bits. n_near: for the rows asked for (null for others), how many other fingerprints of the table lie within
    RADIUS bits. Repeated rows are rows of their own. A single document follows itself. An empty table gives an empty table. Only the
    named columns are read, others cannot clash.
    """
    pair = with_next_text(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    named = pair.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "_id", "_hash", "next_id", "next_hash")
    named = named.withColumns({"edited_sha256": F.sha2("edited", 256), "_uid": F.monotonically_increasing_id()})
    keys = ["_uid", "doc_id", "n_chars", "edited_sha256", "_id", "_hash", "next_id", "next_hash"]
    two = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("t")) for k, c in enumerate(("text", "edited"))])
    texts = named.select(*keys, F.explode(two).alias("_x")).select(*keys, "_x.which", F.col("_x.t").alias("text"))
    prints = fingerprints(texts, [*keys, "which"])
    sides = [F.max(F.when(F.col("which") == k, F.col(h))).alias(f"{h}{k}") for k in range(2) for h in ("hi", "lo")]
    row = written(prints.groupBy(*keys).agg(*sides).drop("_uid"), "op10-rows")
    # the next document's fingerprint is the one it has as itself: texts of one id and hash are equal
    own = row.groupBy(F.col("_id").alias("next_id"), F.col("_hash").alias("next_hash")).agg(F.first("hi0").alias("hi2"), F.first("lo0").alias("lo2"))
    found = links(row.select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")), queries=row.filter(asked).select(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")))
    near = found.groupBy(F.col("a_hi").alias("hi0"), F.col("a_lo").alias("lo0")).agg(F.count("*").alias("n_near"))
    out = row.join(own, ["next_id", "next_hash"], "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # copies share a fingerprint: they are dealt into parts
    out = out.join(near, ["hi0", "lo0", "_salt"], "left")

    def likeness(k: int) -> Column:
        return 1 - distance(F.col("hi0"), F.col("lo0"), F.col(f"hi{k}"), F.col(f"lo{k}")) / F.lit(128.0)

    return out.select(
        "doc_id", "n_chars", "edited_sha256", written_hex(F.col("hi0"), F.col("lo0")).alias("fingerprint"), written_hex(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        likeness(1).alias("near_edited"), likeness(2).alias("near_next"), F.when(F.expr(asked), F.coalesce("n_near", F.lit(0))).alias("n_near"),
    )
