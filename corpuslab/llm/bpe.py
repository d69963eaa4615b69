"""Byte-level BPE over whole texts, by the ranks of a given vocabulary.

A text is split by a pattern whose matches tile it; each match (a piece) is merged on its own. Long texts are cut into overlapping
chunks that are split in parallel. A match depends only on the characters from its start on, so once two neighbouring chunks have a
boundary in common, they agree from there: the chunks are stitched at the first boundary that the later chunk shares with the trusted
part of the earlier one (matches near its cut end could have run on, and are not trusted). Then the pieces of each chunk, from its stitch to
the next, are encoded. A text whose overlap holds no common boundary, such as one run of letters longer than it, is encoded whole.

A null text counts as empty and has no ids; special tokens are never produced. Repeated rows give repeated results. Null ids pass through.
An empty table gives an empty table. Only the named columns are read, others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import broadcast_if_small, map_rows, written

#: Code points of a chunk, and of its overlap with the next; texts no longer than a chunk are encoded where they stand.
CHUNK = 32_768
OVERLAP = 1_024

#: A piece's end is trusted if so many characters after its start, and one after its end, are in the chunk: no alternative of the
#: patterns looks further ahead.
AHEAD = 3

#: Pieces whose ids a worker remembers, each as the bytes of its ids: tuples of numbers take three times the memory.
REMEMBERED = 100_000

#: Ids that are numbers of Python's, or text, at a time; otherwise they are arrays.
BLOCK = 65_536


class Coder:
    """Encodes pieces and decodes ids with one vocabulary; a worker keeps one."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.text_of = {b: str(b) for b in ranks.values()}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.encoding._encode_single_piece(piece), np.int32).tobytes()
            if len(piece) < 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.piece, pieces)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_pieces(self.pattern.findall(text))

    def blocks(self, ids: np.ndarray, of: dict[int, str] | dict[int, bytes]) -> Iterator[list]:
        for at in range(0, len(ids), BLOCK):
            yield [of[x] for x in ids[at : at + BLOCK].tolist()]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(b"".join(x) for x in self.blocks(ids, self.bytes_of))

    def decoded_digest(self, ids: np.ndarray) -> str:
        h = hashlib.sha256()
        for x in self.blocks(ids, self.bytes_of):
            h.update(b"".join(x))
        return h.hexdigest()

    def ids_digest(self, ids: np.ndarray) -> str:
        h = hashlib.sha256()
        for number, x in enumerate(self.blocks(ids, self.text_of)):
            h.update((" " * (number > 0) + " ".join(x)).encode())
        return h.hexdigest()


@lru_cache(2)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


def stitch(pattern: regex.Pattern, chunk: str, next_start: int) -> int | None:
    """Where, in a chunk, the next one takes over, if it begins at next_start; None if they share no trusted boundary."""
    mine: set[int] = set()
    for m in pattern.finditer(chunk):
        if m.end() >= len(chunk) or m.start() + AHEAD > len(chunk):
            break
        mine.add(m.end())
    if next_start in mine:
        return next_start
    ends = (next_start + m.end() for m in pattern.finditer(chunk[next_start:]))
    return next((e for e in ends if e in mine), None)


def pieces_between(pattern: regex.Pattern, chunk: str, start: int, stop: int) -> Iterator[str]:
    """The matches that begin in [start, stop), with the chunk's text beyond stop in sight."""
    for m in pattern.finditer(chunk, start):
        if m.start() >= stop:
            break
        yield m.group()


#: Outputs of encode(): kind, and value from the coder and the ids.
OUTPUTS: dict[str, tuple[str, Callable[[Coder, np.ndarray], object]]] = {
    "ids": ("int[]", lambda c, ids: ids),
    "n_tokens": ("long", lambda c, ids: len(ids)),
    "ids_sha256": ("string", Coder.ids_digest),
    "decoded": ("binary", Coder.decode),
    "decoded_sha256": ("string", Coder.decoded_digest),
}


class Files:
    """The vocabulary's place on a worker: the path itself where it is on every machine, else the copy that Spark ships."""

    def __init__(self, docs: DataFrame, ranks_path: str):
        self.path, self.name = ranks_path, ranks_path.rsplit("/", 1)[-1]
        docs.sparkSession.sparkContext.addFile(ranks_path)

    def coder(self, pattern: str) -> Coder:
        return coder(SparkFiles.get(self.name), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and the outputs named (see OUTPUTS) of each row of docs."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    files = Files(docs, ranks_path)
    schema = ", ".join(f"{name} {OUTPUTS[name][0]}" for name in outputs)
    makers = [OUTPUTS[name][1] for name in outputs]

    def short(it: Iterator[tuple]) -> Iterator[tuple]:
        c = files.coder(pattern)
        for doc_id, text in it:
            ids = c.encode(text)
            yield doc_id, *[make(c, ids) for make in makers]

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        c = files.coder(pattern)
        for doc_id, ids in it:
            ids = np.array(ids, np.int32)
            yield doc_id, *[make(c, ids) for make in makers]

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    stand = map_rows(rows.filter(F.length("text") <= chunk), short, f"doc_id long, {schema}")
    long = rows.filter(F.length("text") > chunk)
    return stand.unionByName(map_rows(long_ids(long, files, pattern, chunk, overlap), made, f"doc_id long, {schema}"))


def long_ids(long: DataFrame, files: Files, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, ids of long texts, split in parallel and stitched. Repeated rows are encoded once and counted out at the end."""

    def split(it: Iterator[tuple]) -> Iterator[tuple]:
        find = files.coder(pattern).pattern
        for doc_id, key, copies, number, last, text in it:
            at = None if last else stitch(find, text, chunk)
            yield doc_id, key, copies, number, last, text, len(text) if last else -1 if at is None else at

    def encoded(it: Iterator[tuple]) -> Iterator[tuple]:
        c = files.coder(pattern)
        for doc_id, key, copies, number, text, start, stop in it:
            yield doc_id, key, copies, number, c.encode_pieces(pieces_between(c.pattern, text, start, stop))

    def whole(it: Iterator[tuple]) -> Iterator[tuple]:
        c = files.coder(pattern)
        for doc_id, key, copies, text in it:
            yield doc_id, key, copies, 0, c.encode(text)

    once = written(long.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", F.sha2("text", 256).alias("key"), "copies", "text"), "op1-long")
    pieces = F.ceil(F.length("text") / chunk).cast("int")
    cut = once.withColumn("last", pieces - 1).select("doc_id", "key", "copies", "last", "text", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("number"))
    cut = cut.select("doc_id", "key", "copies", "number", (F.col("number") == F.col("last")).alias("last"), F.substring("text", F.col("number") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    cut = cut.repartition("key", "number")  # neighbouring chunks are split in different tasks
    flat = "doc_id long, key string, copies long, number int, "
    chunks = written(map_rows(cut, split, flat + "last boolean, text string, stop int"), "op1-chunks")
    document = Window.partitionBy("key", "doc_id")
    stitched = chunks.withColumn("start", F.coalesce(F.lag("stop").over(document.orderBy("number")) - chunk, F.lit(0))).withColumn("apart", F.min("stop").over(document) < 0)
    sound = map_rows(stitched.filter("not apart").select("doc_id", "key", "copies", "number", "text", "start", "stop"), encoded, flat + "ids int[]")
    # rows of one document are in one task, as they will be again below: no more is shuffled
    apart = broadcast_if_small(stitched.filter("apart and number = 0").select(F.col("key").alias("_key")).distinct())
    rest = map_rows(once.join(apart, once["key"] == apart["_key"], "left_semi").select("doc_id", "key", "copies", "text"), whole, flat + "ids int[]")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("number", "ids"))), lambda x: x["ids"])
    ids = sound.unionByName(rest).groupBy("doc_id", "key", "copies").agg(F.flatten(parts).alias("ids"))
    return ids.select("doc_id", "ids", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "ids")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (bytes): the tokens' bytes, one after another. Null ids count as none."""
    files = Files(tokens, ranks_path)

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        c = files.coder(pattern)
        for doc_id, ids in it:
            yield doc_id, c.decode(np.array(ids or [], np.int32))

    return map_rows(tokens.select(tokens[id_col].cast("long"), tokens[ids_col]), made, "doc_id long, decoded binary")
