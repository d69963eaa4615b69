"""What the operators of this subpackage share: words, row maps over Arrow batches; tables in the shared folder come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.operators.shared import Scratch, broadcast_if_small, written  # noqa: F401

#: A word is a longest run of characters other than these.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"

#: Rows that a Python worker turns into Python objects at a time, and bytes of them in Arrow; a row of more stands alone.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z lower-cased; bytes.split() cuts at the same six characters as SPACES."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit sways all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of so many neighbouring words."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1))
    return out


KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(spec: str) -> T.StructType:
    """A schema from "name kind, ..."; a kind may be one of KINDS or kind[]. Workers can build it, as no session is needed."""
    pairs = [x.split() for x in spec.split(",")]
    return T.StructType([T.StructField(n, T.ArrayType(KINDS[k[:-2]]) if k.endswith("[]") else KINDS[k]) for n, k in pairs])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and SLICE_BYTES bytes: long texts, and numbers as Python objects, take many times their size."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, SLICE_ROWS)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_rows(df: DataFrame, f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """A narrow map: f gets the rows of a slice as tuples and yields rows of the schema."""
    kind = fields(schema)
    out = to_arrow_schema(kind)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                rows = list(f(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                columns = zip(*rows, strict=True) if rows else ([] for _ in out)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(batches, kind)


def crc_of_id(column: Column) -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(column.cast("string"))


def text_udf(schema: str):
    """A column function from a slice of texts to one struct for each; the other columns of a row never leave the JVM."""
    kind = fields(schema)
    out = pa.struct(list(to_arrow_schema(kind)))

    def made(f: Callable[[str | None], tuple]):
        names = kind.names

        @F.arrow_udf(kind)
        def column(texts: pa.Array) -> pa.Array:
            rows = [f(t) for at in range(0, len(texts), SLICE_ROWS) for t in texts.slice(at, SLICE_ROWS).to_pylist()]
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], out.field(k).type) for k in range(len(names))], fields=list(out))

        return column

    return made
