import base64
import random
from collections import Counter

import public_tokenizers
import regex
import tiktoken

from corpuslab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(3)
    parts = ["'re", "'", "'ll", " ", "  ", "\n", "\n\n", "\t ", "word", "été", "ß", "12", " 9", "###", "日本語", "🙂", "é", " ", "<|endoftext|>", "x" * 30]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    return texts + ["", None, "a" * 500, " " * 400, "a" * 130 + " b" * 100, "\n" * 90 + "z" + " \n" * 70]


def test_stitching_equals_whole_texts(spark):
    enc, rows = reference(), list(enumerate(odd_texts()))
    rows += rows[:5] + [(None, "null id " * 20), (rows[3][0], "same id, other text " * 9)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    for chunk, overlap in ((20, 10), (64, 8), (100, 40)):
        got = bpe.encode(df, PATH, PATTERN, ("n_tokens", "ids", "decoded"), chunk=chunk, overlap=overlap).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        assert all(r.n_tokens == len(r.ids) for r in got)
        assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((i, (t or "").encode()) for i, t in rows)


def test_stitch_helper():
    find = regex.compile(PATTERN)
    assert bpe.stitch(find, "aaaa bbbb cccc dddd eeee", 12) == 14
    assert bpe.stitch(find, "a" * 50, 20) is None


def test_decode_and_nothing(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df, PATH, PATTERN)
    assert {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(ids, PATH, PATTERN).collect()} == {(1, "héllo wörld".encode()), (2, b"")}
    assert bpe.encode(df.limit(0), PATH, PATTERN).collect() == []


def test_remembered_pieces_take_little_memory():
    """Six workers beside an executor's heap: what each remembers must stay small (tuples of numbers took over 100 bytes a piece)."""
    import sys

    c = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = " ".join(f"qz{i * 7919 % 100_003}xv" for i in range(5000))
    assert c.decode(c.encode(text)).decode() == text and len(c.known) > 3000
    size = sum(sys.getsizeof(ids) + sum(map(sys.getsizeof, ids if isinstance(ids, tuple) else ())) for ids in c.known.values())
    assert size / len(c.known) < 80 and bpe.REMEMBERED <= 100_000


def test_ids_are_arrays_and_slices_are_bounded_in_bytes():
    """A worker that held 256 long texts' ids as Python numbers took some 250 MB: what is turned into objects at a time is bounded by its bytes."""
    import hashlib

    import pyarrow as pa

    from corpuslab.llm import common

    c, enc = bpe.Coder(PATH, PATTERN), reference()
    text = "a word, 12 été! " * 20_000
    ids = c.encode(text)
    assert ids.nbytes == 4 * len(ids) and len(ids) > bpe.BLOCK
    assert ids.tolist() == enc.encode_ordinary(text) and c.decode(ids) == text.encode()
    assert c.ids_digest(ids) == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
    assert c.decoded_digest(ids) == hashlib.sha256(text.encode()).hexdigest()
    assert c.ids_digest(ids[:0]) == c.decoded_digest(ids[:0]) == hashlib.sha256(b"").hexdigest()
    texts = ["x" * (100_000 if k % 9 else 3_000_000) for k in range(40)] + ["short"] * 700
    parts = list(common.slices(pa.RecordBatch.from_pydict({"text": texts})))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows <= common.SLICE_ROWS and (p.num_rows == 1 or p.nbytes <= common.SLICE_BYTES) for p in parts) and len(parts) < 60
