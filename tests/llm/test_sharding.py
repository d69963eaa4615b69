import zlib

from corpuslab.llm import sharding


def jump_by_hand(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


DOCS = [(0, "a"), (1, "a"), (2, None), (None, "x"), (None, "x"), (7, "été"), (7, "été"), (7, ""), (-5, "neg"), (2**62, "big"), (123456789, "q" * 70000)]


def test_jump_equals_the_published_walk(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    for n in (1, 2, 16, 17, 100):
        for r in sharding.with_shard(df, n_shards=n).collect():
            assert r.shard == jump_by_hand(r.doc_id or 0, n)


def test_table(spark):
    df = spark.createDataFrame([(*d, 1) for d in DOCS] + [(k, "t", 2) for k in range(1000, 3000)], "doc_id long, text string, slot int")
    rows = sharding.shard_table(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0.03 < moved / len(rows) < 0.09
    found = {(r.doc_id, r["size"], r.text_crc32) for r in rows}
    for i, t in DOCS:
        assert (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) in found


def test_a_hot_row_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "same")], "doc_id long, text string")
    hot = df.join(spark.range(10_000), how="cross").drop("id")
    assert sorted(r.slot for r in sharding.shard_table(hot).collect()) == list(range(10_000))
    assert sharding.shard_table(df.limit(0)).collect() == []
