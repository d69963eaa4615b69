"""From raw documents to token ids in five stages, each over all that the one before it kept.

Quality rules drop documents, near-dedup keeps one of each group, personal data are replaced in the texts, sources are mixed to target
weights by whole copies, and the texts are encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, hostrules, minhash, mixing, pii
from corpuslab.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep. Each text is measured once: the documents are written with their measures, which hosts and documents then read.

    Null and empty texts fail the first rule and go; null sources are one host; repeated rows are judged each. An empty table stays empty.
    The documents travel as one struct, so that columns named like a measure keep their values.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["source"].alias("host"), docs["text"].alias("text"))
    rows = written(hostrules.measured(rows).drop("text"), "stage-measured")
    hosts = written(hostrules.host_verdicts(rows, "host"), "stage-hosts")
    return hostrules.judged(rows, hosts, "host").filter("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts are linked with nothing and stay, one row of each id; a group whose ids are null or repeated keeps one row. Only doc_id
    and text are read, all columns pass through. An empty table stays empty.
    """
    return minhash.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kind; n_chars follows, of its own type. Null texts stay null, with a null n_chars.

    All other columns pass through. Repeated rows are changed alike; an empty table stays empty.
    """
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its tilt says: 0, 1 or 2 times, with all its columns, whatever they are called.

    Null texts have size 0, null sources are one source, ties are ordered by id, repeated rows are drawn each. An empty table stays empty.
    """
    sizes = written(docs.select("source", mixing.word_count(F.col("text")).alias("size")), "stage-sizes")
    return mixing.mixed(docs, sizes)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of what they decode to. Null texts have no ids; repeated rows are encoded each; other columns are not read."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: The later stages have no SQL; tests/llm/test_pipeline.py holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
