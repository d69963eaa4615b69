"""Document quality by a generalised additive model with pairwise interactions.

A text has fixed measures (FEATURES). Each is cut into quantile bins, and the model is a table of log-odds for each measure and for a few pairs
of measures, learned by cyclic boosting: round after round, measure after measure, a shallow tree is fitted to the gradient over the bins and a
fraction of it added to the measure's table; then likewise for the pairs that promise most. A score is a sum of table entries, looked up
for a whole batch at once.

The model is fitted on the driver from a sample of labelled rows whose expected size is at most ``most_labelled`` (chosen by a hash of the
id, so the same on each run); everything else covers all documents. Text alone enters a score. A null text counts as empty and
gets a score like any other; a null id is never held out and never learned from. Without labels of both kinds all scores are the share of ones,
or 1/2. Repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.llm.common import crc_of_id, fields, map_rows
from corpuslab.llm.hostrules import repeated_words

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "digit_share", "upper_share", "punctuation_per_word", "repeated_lines", "repeated_windows",
    "distinct_words", "marks_per_word", "short_lines", "same_as_previous", "words_per_line", "non_ascii", "ended_lines", "one_letter_words",
)

BINS = 32
PAIR_BINS = 8
UPPER, DIGITS = re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")


def measure(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size, k = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    letters = sum(map(len, words))
    count = lambda chars: sum(map(data.count, chars))
    return [
        math.log1p(len(words)),
        letters / n,
        count((b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / n,
        sum(map(len, DIGITS.findall(data))) / size,
        sum(map(len, UPPER.findall(data))) / size,
        count((b".", b",", b";", b":", b"?", b"!")) / n,
        (len(lines) - len(set(lines))) / k,
        repeated_words(words) / n,
        len(set(words)) / n,
        count((b"!", b"?")) / n,
        sum(len(x) < 30 for x in lines) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        math.log1p(len(words) / k),
        1 - len(text or "") / size,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / k,
        sum(len(w) == 1 for w in words) / n,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in it:
            yield doc_id, measure(text)

    return map_rows(docs.select(docs[id_col].cast("long"), docs[text_col]), made, "doc_id long, x double[]")


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out


def gain(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of the best tree of so many leaves over bins with gradient sums g and Hessian sums h."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-12, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            won = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            at = int(won.argmax())
            if won[at] > best[0]:
                best = (won[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each axis of a table into two, and the values by cell of the four parts."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    q = [(cg[:-1, :-1], ch[:-1, :-1])]
    q += [(top_g - q[0][0], top_h - q[0][1]), (left_g - q[0][0], left_h - q[0][1])]
    q += [(cg[-1, -1] - q[0][0] - q[1][0] - q[2][0], ch[-1, -1] - q[0][1] - q[1][1] - q[2][1])]
    total = sum(gain(*x) for x in q)
    i, j = np.unravel_index(total.argmax(), total.shape)
    out = np.zeros_like(g)
    for (a, b), (s, t) in zip(q, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        out[s, t] = a[i, j] / (b[i, j] + 1.0)
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, pairs: int = 6) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for j in range(x.shape[1]):
        quantiles = lambda n, v=x[:, j]: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
        model.edges.append(quantiles(BINS))
        model.coarse.append(quantiles(PAIR_BINS))
        model.tables.append(np.zeros(len(model.edges[j]) + 1))
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    odds = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(fine):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(at, g, n), np.bincount(at, h, n))
            model.tables[j] += step
            odds += step[at]
    g, h = slopes()

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return coarse[a] * shape[1] + coarse[b], shape

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        at, shape = cells(a, b)
        return np.bincount(at, v, shape[0] * shape[1]).reshape(shape)

    promise = []
    for a, b in combinations(range(x.shape[1]), 2):
        if len(model.coarse[a]) and len(model.coarse[b]):
            promise.append((quadrants(table(a, b, g), table(a, b, h))[0], (a, b)))
    model.pairs = [p for _, p in sorted(promise, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros(cells(a, b)[1]) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * quadrants(table(a, b, g), table(a, b, h))[1]
            model.pair_tables[k] += step
            odds += step[coarse[a], coarse[b]]
    return model


def learned(measured: DataFrame, labels: DataFrame, most_labelled: int = 20_000, label_col: str = "quality") -> Model:
    """The model from labelled rows whose crc32(id) mod 3 is not 1."""
    known = labels.select(labels["doc_id"].alias("_id"), labels[label_col].cast("double").alias("y")).filter("_id is not null and y is not null")
    known = known.filter(crc_of_id(F.col("_id")) % 3 != 1)
    n = known.count()
    some = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, most_labelled / max(1, n)))
    # the labelled side is bounded by the sample
    rows = measured.join(F.broadcast(some), measured["doc_id"] == some["_id"]).select("_id", "x", "y").dropDuplicates().orderBy("_id", "y", "x").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy())


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of label 1."""
    schema = fields("doc_id long, score double")
    out = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=out)

    return measured.select("doc_id", "x").mapInArrow(batches, schema)
