"""Quality rules judged by host.

Each document is measured once. Rule failures are counted by host, each host's failure rate is shrunk
towards the corpus by a beta prior that is itself estimated from the hosts (empirical Bayes, by moments),
and the host's verdict is joined back to its documents:

* ``reject``: the shrunk rate is over ``bad_rate``; all documents of the host go;
* ``trust``: the shrunk rate is at most ``trusted_rate``; only documents that fail a hard rule go;
* ``judge``: between the two; documents that fail a hard or a soft rule go.

Hard rules: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
Soft rules: over one symbol of ``#*$%&|<>`` for 10 words, or 3 lines or more, and over 30 % of all, repeat an earlier line.

A null text counts as empty and fails the first rule. Documents without a host form one host of their own.
Repeated rows are separate documents. An empty table gives an empty table. All other columns pass through;
those with the names of added columns are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import broadcast_if_small, text_udf, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, ...]:
    """The columns of MEASURES for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(data.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which the text holds twice or more."""
    seen = windows(word_hashes(words), WINDOW)
    if len(seen) < 2:
        return 0
    order = np.argsort(seen, kind="stable")
    same = seen[order[1:]] == seen[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(seen), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


measures = text_udf(MEASURES)(measure)


def hard_failure() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failure() -> Column:
    return (10 * F.col("n_symbols") > F.col("n_words")) | ((F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, those of MEASURES, base_failed and soft_failed."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = [c for c in docs.columns if c not in {*names, "_m", "base_failed", "soft_failed"}]
    rows = docs.select(*[docs[c] for c in kept], measures(docs[text_col]).alias("_m")).select(*kept, *[F.col(f"_m.{n}") for n in names])
    return rows.withColumns({"base_failed": hard_failure(), "soft_failed": soft_failure()})


def host_verdicts(rows: DataFrame, host_col: str = "source", bad_rate: float = 0.5, trusted_rate: float = 0.005) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_verdict from measured rows.

    Counts are partial sums before the shuffle, so a host with a third of all rows is one row for each task.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"), F.count("*").alias("hosts"))
    mean = total.select("docs", "hosts", (F.col("failed") / F.col("docs")).alias("mu"))
    # two one-row tables: their broadcast has the size of a row
    spread = hosts.crossJoin(F.broadcast(mean)).agg(
        F.max("mu").alias("mu"), F.max(F.col("hosts") / F.col("docs")).alias("thin"), (F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("mu"), 2)) / F.sum("n_docs")).alias("s2")
    )
    noise = F.col("mu") * (1 - F.col("mu"))
    rho = F.when(noise <= 0, F.lit(0.0)).otherwise((F.col("s2") - noise * F.col("thin")) / noise)
    prior = spread.select("mu", (1 / F.greatest(F.lit(0.001), F.least(F.lit(0.5), rho)) - 1).alias("strength"))
    rate = (F.col("n_failed") + F.col("mu") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.crossJoin(F.broadcast(prior))
        .withColumn("host_rate", rate)
        .select("host", "n_docs", "n_failed", "host_rate", F.when(rate > bad_rate, "reject").when(rate <= trusted_rate, "trust").otherwise("judge").alias("host_verdict"))
    )


def judged(rows: DataFrame, hosts: DataFrame, host_col: str = "source") -> DataFrame:
    """Measured rows with host_verdict and kept."""
    known = hosts.select(F.col("host").alias("_host"), "host_verdict")
    rows = rows.drop("host_verdict", "kept", "_host")
    known = broadcast_if_small(known)
    joined = rows.join(known, rows[host_col].eqNullSafe(known["_host"]), "left").drop("_host")
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & (~F.col("soft_failed") | (F.col("host_verdict") == "trust"))
    return joined.withColumn("kept", kept)
