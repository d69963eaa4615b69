"""What operators share: tables in the folder that all executors see, broadcasts behind a count, the package for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary folder stands in on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "corpuslab-checkpoints")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one step of a loop, in one folder of the shared folder, removed together once what follows from them is written elsewhere.

    Tables rather than checkpoint(), as a checkpointed frame keeps the size estimate of its plan: in a loop of self-joins that estimate, a
    product, has twice the digits after each round, until the planner does nothing else. Lost executors cost no more than their own tasks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it is counted to have so many rows at most; else hinted for a shuffled join, so that no estimate sends it through the driver."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def list_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose lists hold about so many values; a list is not cut."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0)).astype(np.int64))
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // most)) + 1, len(ends)].tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            yield batch.slice(i, j - i)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="corpuslab-"), "corpuslab.zip")
    with zipfile.ZipFile(name, "w") as out:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
