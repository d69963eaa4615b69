"""Runs: stretches of words that repeat with a period, found through string synchronising sets.

A run is a longest stretch of words with smallest period q (words q apart are the same) and at least three periods long. Short periods, up to
DIRECT, are found by comparing the text with itself, shifted. The others belong to dyadic scales t = DIRECT / 2, DIRECT, 2 * DIRECT, ..., scale t
having the periods 2t < p <= 4t. At each scale, every place gets a hash of the t words from there on; a place is in the synchronising set if
the least hash among the t + 1 places from it is its own or the last one's. Places whose t words lie in a run of period t / 3 or less take
no part (their hashes are not distinct); these highly periodic regions are known from the smaller scales. Membership depends on the
next 2t words only, and wherever the text isn't highly periodic, each t neighbouring places have a member. So in a run of period p the members
repeat p words later, with the same words after them: neighbouring members with equal contexts of 3t words (for 2t < p <= 3t) or 4t words (for
3t < p <= 4t) propose their distance as a period. As a context is at least p words long, it does not come back sooner inside of the run; as a
run is 3p long, it holds a member with its context and the next one. Proposals are extended both ways by comparing hashes of dyadic
length, kept if the stretch has three periods, and checked word by word. Of equal stretches the smallest period stays.

All documents of a batch are laid end to end, a separator that occurs once between them, so that each step is one array operation over some
hundred thousand words; at scale t only documents of more than 6t words are laid out. Work grows as words times the number of scales, the
logarithm of the longest text. A text is one row and is never cut; its arrays take some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslab.llm.common import fields, mix

#: Periods found by shifting; a power of two, 4 at least.
DIRECT = 8
#: Words laid end to end at a time.
BATCH_WORDS = 250_000
#: Least length of a run that is reported, and least number of periods of any run.
SHORTEST, PERIODS = 24, 3

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def joined(hashes: np.ndarray, by: int) -> np.ndarray:
    """Hashes of stretches twice as long, from those of length `by` at each place; shorter at the end by `by` places."""
    return mix(hashes[: len(hashes) - by] * GOLDEN + hashes[by:]) if len(hashes) > by else hashes[:0]


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours, by doubling."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def shifted_runs(text: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all longest stretches with period p, at least PERIODS * p long."""
    same = np.flatnonzero(text[p:] != text[:-p]) if len(text) > p else np.zeros(0, np.int64)
    if len(text) <= p:
        return same, same
    edges = np.r_[-1, same, len(text) - p]
    some = np.flatnonzero(np.diff(edges) - 1 >= (PERIODS - 1) * p)
    return edges[some] + 1, edges[some + 1] + p


class Scales:
    """Hashes of all dyadic lengths of one laid-out text, made when needed."""

    def __init__(self, text: np.ndarray):
        self.text = text
        self.levels = [mix(text.astype(np.uint64) * GOLDEN + np.uint64(1))]

    def of(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            self.levels.append(joined(self.levels[-1], 1 << (len(self.levels) - 1)))
        return self.levels[level]

    def agree(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from places a and b on (way 1), or before them (way -1)."""
        n = np.zeros(len(a), np.int64)
        top = 0
        live = np.arange(len(a))
        while len(live):  # longer and longer steps while everything agrees
            ok = self.step(a[live], b[live], n[live], top, way)
            n[live[ok]] += 1 << top
            live = live[ok]
            top += 1
        for level in range(top - 1, -1, -1):
            n[self.step(a, b, n, level, way)] += 1 << level
        return n

    def step(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, level: int, way: int) -> np.ndarray:
        h, size = self.of(level), 1 << level
        x, y = (a + n, b + n) if way > 0 else (a - n - size, b - n - size)
        inside = (x >= 0) & (y >= 0) & (x < len(h)) & (y < len(h))
        ok = np.zeros(len(a), bool)
        ok[inside] = h[x[inside]] == h[y[inside]]
        return ok


def proposals(scales: Scales, level: int, periodic: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and periods that neighbouring members with equal contexts propose at scale t = 2 ** level. periodic: places left out."""
    t = 1 << level
    h = scales.of(level)
    if len(h) <= 2 * t:
        return []
    value = h.copy()
    value[periodic[: len(h)]] = MOST
    least = least_of(value, t + 1)
    members = np.flatnonzero((least != MOST) & ((least == value[: len(least)]) | (least == value[t:])))
    out = []
    for third in (True, False):
        context = 3 * t if third else 4 * t
        at = members[members + context <= len(scales.text)]
        key = mix(mix(h[at] * GOLDEN + h[at + t]) * GOLDEN + h[at + 2 * t]) if third else scales.of(level + 2)[at]
        order = np.argsort(key, kind="stable")  # places of one context stay in order
        at, key = at[order], key[order]
        apart = np.diff(at)
        some = np.flatnonzero((key[1:] == key[:-1]) & (apart > (2 if third else 3) * t) & (apart <= (3 if third else 4) * t))
        out.append((at[some], apart[some]))
    return out


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, an array of word numbers from 0, its runs (start, length, period) in order; all of at least PERIODS periods."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    which = [k for k, t in enumerate(texts) if len(t) >= PERIODS]
    scale = 0  # 0: shifts
    while which:
        sizes = np.array([len(texts[k]) for k in which])
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        text = np.empty(int(sizes.sum() + len(sizes)), np.int64)
        for k, at, n in zip(which, starts, sizes, strict=True):
            text[at : at + n] = texts[k]
        text[starts + sizes] = -1 - np.arange(len(which))
        if not scale:
            made = [(*shifted_runs(text, p), np.int64(p)) for p in range(1, DIRECT + 1)]
            made = [(s, e, np.full(len(s), p)) for s, e, p in made]
        else:
            made = extended(text, scale, found, which, starts)
        for s, e, p in made:
            doc = np.searchsorted(starts, s, side="right") - 1
            for d, a, b, q in zip(doc.tolist(), (s - starts[doc]).tolist(), (e - starts[doc]).tolist(), p.tolist(), strict=True):
                known = found[which[d]]
                known[a, b] = min(known.get((a, b), q), q)  # a multiple of a run's period is no smallest period
        scale = 2 * scale or DIRECT // 2
        which = [k for k, n in zip(which, sizes, strict=True) if n > 2 * PERIODS * scale]
    return [sorted((a, b - a, q) for (a, b), q in runs.items()) for runs in found]


def extended(text: np.ndarray, t: int, found: list[dict], which: list[int], starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and periods of the runs that scale t finds in the laid-out text."""
    edge = np.zeros(len(text) + 1, np.int64)
    for k, at in zip(which, starts.tolist(), strict=True):
        for (a, b), q in found[k].items():
            if 3 * q <= t <= b - a:
                edge[at + a] += 1
                edge[at + b - t + 1] -= 1
    periodic = np.cumsum(edge[:-1]) > 0
    scales = Scales(text)
    out = []
    for at, p in proposals(scales, t.bit_length() - 1, periodic):
        if not len(at):
            continue
        before, after = scales.agree(at, at + p, -1), scales.agree(at, at + p, 1)
        some = np.flatnonzero(before + after >= (PERIODS - 1) * p)
        rows = np.unique(np.stack([at[some] - before[some], at[some] + p[some] + after[some], p[some]], 1), axis=0)
        exact = [np.array_equal(text[s : e - q], text[s + q : e]) for s, e, q in rows]  # the words themselves, as hashes may collide
        rows = rows[np.array(exact, bool)]
        out.append((rows[:, 0], rows[:, 1], rows[:, 2]))
    return out


def planted(words: np.ndarray, key: int | None) -> np.ndarray:
    """The words with the stretch that the id (its crc32) prescribes repeated to the end; most ids, and null, prescribe nothing."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def digest(runs: list[tuple[int, int, int]], words: np.ndarray, spelt: list[bytes], shortest: int) -> tuple:
    """n_runs, the run of the greatest exponent (start, length, period, thousandths), digests of all runs and of the text without repetitions."""
    runs = [r for r in runs if r[1] >= max(shortest, PERIODS * r[2])]
    best: tuple = (None,) * 4
    keep = np.ones(len(words) + 1, np.int64)
    for start, length, period in runs:
        keep[start + period : start + length] = 0
        if best[0] is None or length * best[2] > best[1] * period:  # runs come by start and period
            best = (start, length, period, 1000 * length // period)
    text = b" ".join([spelt[w] for w in words[np.flatnonzero(keep[:-1])].tolist()])
    told = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, shortest: int = SHORTEST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs (start, length, period one after the other): a row for each row of docs.

    plant: repeat stretches first, as the ids prescribe. Null texts have no words and no runs; texts shorter than three words neither. Of runs with equal
    exponents the first is told, then that of the smaller period. Repeated rows are treated each; a null id plants nothing. An empty table stays
    empty. Only the id and the text are read, other columns, of whatever name, are left out. A very long text is laid out alone.
    """
    kind = fields("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs long[]")
    kind[0].name, kind[0].dataType = id_col, docs.schema[id_col].dataType
    kind.names[0] = id_col
    out = to_arrow_schema(kind)

    def solved(ids: list, texts: list[np.ndarray], spelt: list[bytes]) -> pa.RecordBatch:
        rows = []
        for key, words, runs in zip(ids, texts, runs_of(texts), strict=True):
            told = digest(runs, words, spelt, shortest)
            rows.append((key, *told, [x for r in runs if r[1] >= max(shortest, PERIODS * r[2]) for x in r]))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, known, size = [], [], {}, 0
            for at in range(0, batch.num_rows, 256):
                for key, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    spelt = (text or "").encode("utf-8", "surrogatepass").split()
                    words = np.fromiter((known.setdefault(w, len(known)) for w in spelt), np.int64, len(spelt))
                    ids.append(key)
                    texts.append(planted(words, key) if plant else words)
                    size += len(words)
                    if size >= batch_words:
                        yield solved(ids, texts, list(known))
                        ids, texts, known, size = [], [], {}, 0
            if ids:
                yield solved(ids, texts, list(known))

    return docs.select(id_col, text_col).mapInArrow(found, kind)
