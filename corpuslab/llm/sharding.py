"""Jump consistent hashing: a key's shard follows from the key and the number of shards alone.

Adding a shard at the end moves 1/(n+1) of the keys, all of them into the new shard, and no table of a ring is kept.
The generator is the 64-bit linear congruential one of the published algorithm, in exact decimal arithmetic, as
BIGINT products overflow. All of it is DataFrame expressions: assigning a shard needs no shuffle.

Keys: integers as they are (negative ones as their unsigned 64-bit value), other types by xxhash64; a null key counts
as 0. Repeated rows go to one shard. An empty table gives an empty table. Columns with the names of added ones are replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD64 = 2**64
MULTIPLIER = 2862933555777941757

#: Rows of a numbering bucket, about.
BUCKET_ROWS = 256

#: Rows of one array when copies are counted out.
COPIES_AT_ONCE = 4096


def unsigned_key(key: Column, kind: T.DataType) -> Column:
    """The key as decimal(20,0) in [0, 2^64)."""
    whole = key.cast("long") if isinstance(kind, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key))
    value = F.coalesce(whole, F.lit(0)).cast("decimal(20,0)")
    return F.when(value < 0, value + F.lit(Decimal(WORD64)).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def jump(key: Column, n_shards: int) -> Column:
    """Shard in [0, n_shards) of an unsigned key.

    A jump goes from shard b to a later shard j, so n_shards steps end every walk; a step after the end does nothing.
    """
    word = F.lit(Decimal(WORD64)).cast("decimal(20,0)")

    def step(at: Column, _: Column) -> Column:
        state = ((at["key"] * F.lit(Decimal(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % word).cast("decimal(20,0)")
        # 2^31 / ((state >> 33) + 1), on doubles as published
        high = F.floor(state / F.lit(Decimal(2**33)).cast("decimal(11,0)")).cast("double")
        target = F.floor((at["j"] + 1).cast("double") * (F.lit(float(2**31)) / (high + F.lit(1.0))))
        return F.when(at["j"] < n_shards, F.struct(at["j"].alias("b"), target.alias("j"), state.alias("key"))).otherwise(at)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.alias("key"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards + 1)), start, step, lambda at: at["b"].cast("int"))


def with_shard(df: DataFrame, key_col: str = "doc_id", n_shards: int = 16, name: str = "shard") -> DataFrame:
    """df with its shard; a narrow projection."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    return df.withColumn(name, jump(unsigned_key(df[key_col], df.schema[key_col].dataType), n_shards))


def with_slots(df: DataFrame, shard_col: str = "shard", name: str = "slot") -> DataFrame:
    """df with places 0, 1, 2, ... in each shard, without gaps, the same on each run.

    Equal rows are counted together first, so a row that fills a third of the table is one row in the shuffle. The rest are
    numbered in buckets of about BUCKET_ROWS rows, by hash; a bucket's first place is the sum of those before it. The table
    of bucket sizes has one row for about BUCKET_ROWS rows, and its running sum is taken within blocks of buckets, then over blocks.
    """
    columns = [c for c in df.columns if c not in (name, "_n", "_bucket", "_block", "_first", "_start", "_before", "_from")]
    once = df.select(*columns).groupBy(*columns).agg(F.count("*").alias("_n"))
    rows = df.select(shard_col).groupBy(shard_col).agg(F.count("*").alias("_rows"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / BUCKET_ROWS))
    known = rows.select(F.col(shard_col).alias("_shard"), buckets.alias("_buckets"))
    spread = once.join(F.broadcast(known), F.col(shard_col) == F.col("_shard")).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.col("_buckets"))).drop("_shard", "_buckets")
    sizes = spread.groupBy(shard_col, "_bucket").agg(F.sum("_n").alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / 1024))
    blocks = sizes.groupBy(shard_col, "_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select(shard_col, "_block", (F.sum("_n").over(Window.partitionBy(shard_col).orderBy("_block")) - F.col("_n")).alias("_before"))
    starts = sizes.join(blocks, [shard_col, "_block"]).select(
        shard_col, "_bucket", (F.col("_before") + F.sum("_n").over(Window.partitionBy(shard_col, "_block").orderBy("_bucket")) - F.col("_n")).alias("_from")
    )
    within = Window.partitionBy(shard_col, "_bucket").orderBy(*[F.col(c) for c in columns])
    placed = spread.withColumn("_first", F.sum("_n").over(within) - F.col("_n")).join(starts, [shard_col, "_bucket"])
    placed = placed.withColumn("_first", F.col("_first") + F.col("_from"))
    runs = placed.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    last = F.least(F.col("_start") + COPIES_AT_ONCE, F.col("_n")) - 1
    return runs.select(*columns, F.explode(F.sequence(F.col("_first") + F.col("_start"), F.col("_first") + last)).alias(name))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", n_shards: int = 16) -> None:
    """One folder for each shard; rows go to files where they stand, without a shuffle."""
    with_shard(df, key_col, n_shards).write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, n_shards: int = 16, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1 and the crc32 of nothing, 0."""
    key = docs[key_col]
    kind = docs.schema[key_col].dataType
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump(unsigned_key(key, kind), n_shards).alias("shard"), jump(unsigned_key(key, kind), n_shards + 1).alias("grown_shard"),
    )
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
