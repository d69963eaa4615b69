"""Language of texts by a linear-chain conditional random field over words.

Each word of a text has a hidden language. A word's features are its affixes, letter n-grams and whole form (hashed into a table of weights) and
its mark in a lexicon of words typical of one language; transitions between the languages of neighbouring words are learned with them. The
forward-backward algorithm gives each word's language probabilities in the whole text, so a code-switched text has its share of each; the
text's language is the one with the largest mean share, and the score is that share.

Training data are snippets cut at hash-chosen places from a sample of labelled documents, about ``docs_per_lang`` for each language (the same
on each run), half of them spliced with snippets of other languages so that switches are seen. The model is fitted on the driver from that
bounded sample; every text is then read whole. Forward-backward runs on blocks of words: the products of their transfer matrices pass the
messages from block to block, so it is exact and vectorised over all blocks of a slice of documents.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was labelled. Ties go to the language first in code
point order. A null id is never held out and never learned from. Repeated rows get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import crc_of_id, map_rows

WORDS = re.compile(r"[^\W\d_]+")
HASHED = 1 << 15
BLOCK = 32
SNIPPET = 40

#: Words whose scores a worker remembers, and words in one forward-backward call.
REMEMBERED = 400_000
AT_ONCE = 100_000


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if there is no letter."""
    words = WORDS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def hashed_features(word: str) -> list[int]:
    """Numbers of the word's affixes, n-grams and form."""
    b = f"^{word}$"
    parts = ["w" + word, *["p" + word[:n] for n in (1, 2, 3)], *["s" + word[-n:] for n in (1, 2, 3, 4)]]
    parts += [b[k : k + 2] for k in range(len(b) - 1)] + [b[k : k + 3] for k in range(len(b) - 2)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % HASHED for p in parts]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (HASHED + languages, languages); the last rows are those of the lexicon's marks
    transitions: np.ndarray
    lexicon: dict[str, int]

    def score(self, word: str) -> np.ndarray:
        at = hashed_features(word)
        if word in self.lexicon:
            at.append(HASHED + self.lexicon[word])
        return self.weights[at].sum(0)


def snippets(docs: DataFrame, docs_per_lang: int, each: int) -> DataFrame:
    """lang, words: snippets of the sampled labelled documents."""
    known = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null")
    known = known.filter(crc_of_id(F.col("doc_id")) % 5 != 0)
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, words string")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))])
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])
    one = some.groupBy("doc_id", "lang", F.xxhash64("text").alias("_key")).agg(F.first("text").alias("text"))  # repeated rows count once
    some = one.select("doc_id", "lang", "text")

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, lang, text in it:
            words = words_in(text)
            for k in range(each if words else 0):
                at = zlib.crc32(f"{doc_id}/{k}".encode()) % max(1, len(words) - SNIPPET + 1)
                yield lang, " ".join(words[at : at + SNIPPET])

    return map_rows(some, made, "lang string, words string")


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.25, lexicon_words: int = 400) -> Model:
    """Fitted by AdaGrad on the log-likelihood, on sequences of SNIPPET words."""
    langs = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    size = len(langs)
    model = Model(langs, np.zeros((HASHED + size, size)), np.zeros((size, size)), {})
    if not langs:
        return model
    seen = {k: Counter() for k in range(size)}
    for lang, words in rows:
        seen[number[lang]].update(words.split(" "))
    total = {k: max(1, sum(c.values())) for k, c in seen.items()}
    for k, c in seen.items():
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            if n / total[k] > 3 * max((seen[j][w] / total[j] for j in seen if j != k), default=0):
                model.lexicon[w] = k
    rnd = np.random.default_rng(0)
    streams = [[w for at in rnd.permutation(len(rows)) if number[rows[at][0]] == k for w in rows[at][1].split(" ")] for k in range(size)]
    sequences: list[tuple[list[str], list[int]]] = []
    for k, stream in enumerate(streams):
        sequences += [(part, [k] * SNIPPET) for a in range(0, len(stream) - SNIPPET + 1, SNIPPET) if (part := stream[a : a + SNIPPET])]
    for n in range(len(sequences) if size > 1 else 0):  # as many spliced ones
        words, tags = [], []
        while len(words) < SNIPPET:
            k, length = int(rnd.integers(size)), int(rnd.integers(5, 20))
            at = int(rnd.integers(max(1, len(streams[k]) - length)))
            part = streams[k][at : at + length]
            words, tags = words + part, tags + [k] * len(part)
        sequences.append((words[:SNIPPET], tags[:SNIPPET]))
    if not sequences:
        return model
    known = {w: k for k, w in enumerate(sorted({w for s, _ in sequences for w in s}))}
    lists = [hashed_features(w) + ([HASHED + model.lexicon[w]] if w in model.lexicon else []) for w in known]
    flat, ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    x = np.array([[known[w] for w in s] for s, _ in sequences])
    y = np.array([t for _, t in sequences])
    sq_w, sq_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(epochs):
        for at in np.array_split(rnd.permutation(len(x)), max(1, len(x) // 256)):
            scores = np.add.reduceat(model.weights[flat], np.r_[0, ends[:-1]])[x[at]]
            p, pairs = posterior(scores, model.transitions)
            want = np.eye(size)[y[at]]
            by_word = np.stack([np.bincount(x[at].ravel(), (want - p)[..., k].ravel(), len(known)) for k in range(size)], 1)
            grad = np.stack([np.bincount(flat, by_word[owner, k], len(model.weights)) for k in range(size)], 1) - 1e-3 * model.weights
            seen_pairs = np.zeros_like(model.transitions)
            np.add.at(seen_pairs, (y[at][:, :-1].ravel(), y[at][:, 1:].ravel()), 1)
            for w, g, sq in ((model.weights, grad, sq_w), (model.transitions, seen_pairs - pairs, sq_t)):
                sq += g * g
                w += rate * g / np.sqrt(sq)
    return model


def posterior(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, t, l) of sequences of equal length, and the expected number of each transition."""
    e = np.exp(scores - scores.max(-1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    n, t, size = e.shape
    forward, backward = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    for k in range(1, t):
        f = (forward[:, k - 1] @ a) * e[:, k]
        forward[:, k] = f / f.sum(-1, keepdims=True)
    backward[:, -1] = 1 / size
    for k in range(t - 2, -1, -1):
        b = (backward[:, k + 1] * e[:, k + 1]) @ a.T
        backward[:, k] = b / b.sum(-1, keepdims=True)
    p = forward * backward
    p /= p.sum(-1, keepdims=True)
    joint = forward[:, :-1, :, None] * a * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    return p, (joint / joint.sum((-1, -2), keepdims=True)).sum((0, 1))


def shares(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Mean marginals of each document; the scores of their words stand one document after another. All lengths are at least 1."""
    size = scores.shape[1]
    a = np.exp(transitions - transitions.max())
    blocks = -(-lengths // BLOCK)
    first_block = np.r_[0, np.cumsum(blocks)[:-1]]
    doc_of = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(doc_of)) - first_block[doc_of]
    start = (np.r_[0, np.cumsum(lengths)[:-1]])[doc_of] + nth * BLOCK
    filled = np.minimum(BLOCK, lengths[doc_of] - nth * BLOCK)
    at = start[:, None] + np.arange(BLOCK)
    used = np.arange(BLOCK) < filled[:, None]
    e = np.exp(scores - scores.max(1, keepdims=True))[np.where(used, at, 0)]
    ones = np.ones((size, size))
    opening = np.where((nth == 0)[:, None, None], ones, a)  # no transition leads to a document's first word
    product = np.tile(np.eye(size), (len(doc_of), 1, 1))
    for k in range(BLOCK):
        moved = (product @ (opening if k == 0 else a)) * e[:, k][:, None, :]
        moved /= moved.sum((1, 2), keepdims=True)
        product = np.where(used[:, k][:, None, None], moved, product)
    into, out_of = np.full((len(doc_of), size), 1 / size), np.full((len(doc_of), size), 1 / size)
    for k in range(1, int(blocks.max())):
        b = first_block[blocks > k] + k
        m = np.einsum("bi,bij->bj", into[b - 1], product[b - 1])
        into[b] = m / m.sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        b = first_block[blocks > k + 1] + k
        m = np.einsum("bij,bj->bi", product[b + 1], out_of[b + 1])
        out_of[b] = m / m.sum(1, keepdims=True)
    forward = np.empty_like(e)
    message = into
    for k in range(BLOCK):
        m = (np.einsum("bi,bij->bj", message, opening) if k == 0 else message @ a) * e[:, k]
        m /= m.sum(1, keepdims=True)
        message = np.where(used[:, k][:, None], m, message)
        forward[:, k] = message
    total = np.zeros((len(doc_of), size))
    message = out_of
    for k in range(BLOCK - 1, -1, -1):
        p = forward[:, k] * message
        total += np.where(used[:, k][:, None], p / p.sum(1, keepdims=True), 0)
        m = (message * e[:, k]) @ a.T  # a block's first word is left only by its own opening, which is in the product
        message = np.where(used[:, k][:, None], m / m.sum(1, keepdims=True), message)
    return np.add.reduceat(total, first_block) / lengths[:, None]


class Scorer:
    """Word scores of a model, remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((1024, len(model.langs)))

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        at = []
        for t in texts:
            for w in t:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    if k >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[k] = self.model.score(w)
                at.append(k)
        return shares(self.table[at], np.array([len(t) for t in texts]), self.model.transitions)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""

    kept: list[Scorer] = []  # filled on the worker, once for a task

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        if not kept:
            kept.append(Scorer(model))
        scorer = kept[0]
        ids: list = []
        texts: list[list[str]] = []
        words = 0

        def flush() -> Iterator[tuple]:
            share = scorer.shares(texts)
            for doc_id, s in zip(ids, share, strict=True):
                best = int(s.argmax())
                yield doc_id, model.langs[best], float(min(1.0, s[best]))

        for doc_id, text in it:
            found = words_in(text) if model.langs else []
            if not found:
                yield doc_id, "und", 0.0
                continue
            ids.append(doc_id)
            texts.append(found)
            words += len(found)
            if words > AT_ONCE:
                yield from flush()
                ids, texts, words = [], [], 0
        if ids:
            yield from flush()

    return map_rows(docs.select(docs[id_col].cast("long"), docs[text_col]), made, "doc_id long, lang_pred string, score double")


def learned(docs: DataFrame, docs_per_lang: int = 400, each: int = 3) -> Model:
    """The model from documents whose crc32(id) mod 5 is not 0."""
    rows = snippets(docs, docs_per_lang, each).orderBy("lang", "words").collect()  # about languages * docs_per_lang * each rows of SNIPPET words
    return fit([(r["lang"], r["words"]) for r in rows])
