"""Personal data by weak supervision.

Base spans are what fixed patterns and checks find: e-mail addresses, IP addresses, card numbers and international telephone numbers;
they are always kept. Candidates for more are weaker forms: addresses written with "at" and "dot" or with blanks round the @, IPv6
addresses, card-like numbers whose check digit fails, national telephone numbers.

Labelers vote on every span, for, against or not at all: patterns (is it a base span; are its separators of one kind), gazetteers (top-level
domains, country calling codes, card issuers) and contexts (a cue word before it that names such data, or one that names other numbers).
Spark counts the vote patterns of the whole corpus; their number is bounded by the labelers, not by the corpus. On those counts
expectation-maximisation estimates the share of real spans and each labeler's reliability for each kind, and the final span classifier, a
logistic regression on votes, kind and shape, is trained on the posteriors. Candidates that it scores at 1/2 or more are added.

Texts are read whole; all patterns take time in proportion to the text. Offsets are code points, ends exclusive. A null text has no
spans, an empty table gives an empty table (and a classifier that adds nothing), repeated rows repeated results, null ids pass through.
Only the named columns are read for spans; redact() passes all columns through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import map_rows, text_udf

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns; the look-behind and the possessive run only spare retries inside a run of digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Weaker forms.
SPELT = re.compile(r"[\[( ]at[\]) ] ?[A-Za-z0-9-]+(?: ?[\[( ]dot[\]) ] ?[A-Za-z0-9-]+)+")
SPACED = re.compile(r" @ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")

# Gazetteers and cues.
DOMAINS_TOP = frozenset("com org net edu gov mil int info biz eu uk us ca au de fr es it nl be ch at pt pl se no dk fi ie br mx ar jp cn in ru io ai app dev".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "351", "352", "353", "358", "420", "421", "971", "972")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]")
CUES = {
    "email": re.compile(r"e-?mail|contact|courriel|correo|kontakt|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|carte|karte|tarjeta|paid|pay", re.I),
    "phone": re.compile(r"\btel|phone|call|fax|mobile|whatsapp|telefon|tél|llama", re.I),
}
OTHER_NUMBERS = re.compile(r"version|licen[cs]e|isbn|issn|order|invoice|chapter|section|figure|table|price|token|sha|id\b|no\.", re.I)
CONTEXT = 40

LABELERS = 6

#: Prior votes of each labeler, right and wrong; a check digit or an octet count that fails says more than a prefix.
PRIOR_VOTES = ((8.0, 2.0), (8.0, 2.0), (60.0, 1.0), (6.0, 4.0), (8.0, 2.0), (8.0, 2.0))


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern: each @ with the longest run of local characters before it, from the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find_spans(text: str) -> list[Span]:
    """Base spans, then the candidates that touch none of them."""
    out: list[Span] = []
    weak: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [Span(0, a, b, True) for a, b in emails(text)]
        weak += [(0, local_start(text, m.start()), m.end()) for m in SPACED.finditer(text)]
    if "dot" in text:
        weak += [(0, local_start(text, m.start()), m.end()) for m in SPELT.finditer(text)]
    if text.count(":") >= 7:
        weak += [(1, m.start(), m.end()) for m in IPV6.finditer(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(Span(1, m.start(), m.end(), True))
        for m in CARD.finditer(text):
            digits = digits_of(m.group()) if m.end() - m.start() < 40 else ""
            if 13 <= len(digits) <= 19:
                if luhn(digits):
                    out.append(Span(2, m.start(), m.end(), True))
                else:
                    weak.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    out.append(Span(3, m.start(), m.end(), True))
        weak += [(3, m.start(), m.end()) for m in NATIONAL.finditer(text)]
    if weak:
        out += untouched(weak, [(s.start, s.end) for s in out])
    return out


def untouched(weak: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[Span]:
    """Of the candidates by start, longest first, those that touch no base span and no candidate before them; one sweep over both lists."""
    ends: list[tuple[int, int]] = []
    for a, b in sorted(taken):  # base spans of several kinds may overlap: merged
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    out, at, done = [], 0, 0
    for kind, a, b in sorted(weak, key=lambda w: (w[1], -w[2])):
        while at < len(ends) and ends[at][1] <= a:
            at += 1
        if a < b and a >= done and not (at < len(ends) and ends[at][0] < b):
            out.append(Span(kind, a, b, False))
            done = b
    return out


def local_start(text: str, at: int) -> int:
    start = at
    while start and text[start - 1] in LOCAL:
        start -= 1
    return start


def votes(text: str, s: Span) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    body, before = text[s.start : s.end], text[max(0, s.start - CONTEXT) : s.start]
    kind = KINDS[s.kind]
    digits = digits_of(body)
    if kind == "email":
        top = re.split(r"[^A-Za-z0-9]+", body)[-1].lower()
        known, whole = (1 if top in DOMAINS_TOP else -1), (1 if len(body) < 80 else -1)
    elif kind == "ip":
        known, whole = (-1 if body.startswith(("0.", "255.")) else 1), (1 if ":" in body or body.count(".") == 3 else -1)
    elif kind == "card":
        known, whole = (1 if ISSUERS.match(digits) else -1), (1 if luhn(digits) else -1)
    else:
        known = (1 if digits.startswith(CALLING_CODES) else -1) if body.startswith("+") else 0
        whole = 1 if 9 <= len(digits) <= 15 else -1
    separators = set(re.findall(r"[ .-]", body)) if s.kind >= 2 else set()
    cue, other = CUES[kind].search(before) is not None, OTHER_NUMBERS.search(before) is not None
    return (1 if s.base else 0, known, whole, -1 if len(separators) > 2 else 1 if s.kind >= 2 else 0, 1 if cue else 0, -1 if other else 0)


def shape(text: str, s: Span) -> int:
    """Length of the span in four classes, and whether letters or digits touch it."""
    touched = (s.start > 0 and text[s.start - 1].isalnum()) or (s.end < len(text) and text[s.end].isalnum())
    return min(3, (s.end - s.start) // 10) * 2 + int(touched)


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, votes, shape, n: how often each vote pattern occurs in the corpus."""

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict[tuple, int] = {}
        for (text,) in it:
            for s in find_spans(text or ""):
                key = s.kind, ",".join(map(str, votes(text, s))), shape(text, s)
                seen[key] = seen.get(key, 0) + 1
        for key, n in seen.items():
            yield *key, n

    rows = map_rows(docs.select(docs[text_col]), made, "kind int, votes string, shape int, n long")
    return rows.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def posteriors(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(real) of each vote pattern by EM; labelers are independent given the truth, with their own rates of each vote for each kind."""
    p = 1 / (1 + np.exp(-1.5 * vote.sum(axis=1)))
    for _ in range(rounds):
        score = np.zeros(len(n))
        for k in np.unique(kind):
            own = kind == k
            w1, w0 = n[own] * p[own], n[own] * (1 - p[own])
            score[own] = np.log((w1.sum() + 1) / (w0.sum() + 1))
            for j in range(vote.shape[1]):
                for v in (-1, 1):  # an abstention says nothing
                    at = vote[own, j] == v
                    cast = vote[own, j] != 0
                    right, wrong = PRIOR_VOTES[j] if v > 0 else PRIOR_VOTES[j][::-1]
                    r1 = (w1[at].sum() + right) / (w1[cast].sum() + right + wrong)
                    r0 = (w0[at].sum() + wrong) / (w0[cast].sum() + right + wrong)
                    score[np.flatnonzero(own)[at]] += np.log(r1 / r0)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


def inputs(kind: int, vote: tuple[int, ...], form: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * LABELERS + 8)
    x[0] = x[1 + kind] = 1
    for j, v in enumerate(vote):
        if v:
            x[1 + len(KINDS) + 2 * j + (v > 0)] = 1
    x[1 + len(KINDS) + 2 * LABELERS + form] = 1
    return x


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Weights of the span classifier. At most len(KINDS) * 3^LABELERS * 8 counts come to the driver."""
    rows = vote_counts(docs, text_col).orderBy("kind", "votes", "shape").collect()
    size = len(inputs(0, (0,) * LABELERS, 0))
    if not rows:
        return [-10.0] + [0.0] * (size - 1)
    cast = [tuple(map(int, r["votes"].split(","))) for r in rows]
    kind, n = np.array([r["kind"] for r in rows]), np.array([r["n"] for r in rows], float)
    target = posteriors(kind, np.array(cast), n)
    x = np.array([inputs(r["kind"], v, r["shape"]) for r, v in zip(rows, cast, strict=True)])
    w, weight = np.zeros(size), n / n.sum() * min(n.sum(), 1000.0)
    for _ in range(40):  # Newton's steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (target - p)) - 0.1 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(size)
        w = w + np.linalg.solve(hess, grad) * 0.7
    return w.tolist()


def accepted(text: str | None, weights: np.ndarray) -> list[Span]:
    """Base spans and the candidates that the classifier accepts, by kind and start."""
    text = text or ""
    found = [s for s in find_spans(text) if s.base or inputs(s.kind, votes(text, s), shape(text, s)) @ weights >= 0]
    return sorted(found, key=lambda s: (s.kind, s.start))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def annotate(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 of the base spans as written, and all spans as written."""

    def made(it: Iterator[tuple]) -> Iterator[tuple]:
        w = np.array(weights)
        for doc_id, text in it:
            spans = accepted(text, w)
            base = [s for s in spans if s.base]
            yield doc_id, *[sum(s.kind == k for s in base) for k in range(len(KINDS))], hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_rows(docs.select(docs[id_col].cast("long"), docs[text_col]), made, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, weights: list[float], text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; of spans that overlap, the first covers. Null texts stay null."""

    def masked(text: str | None) -> tuple[str | None]:
        if text is None:
            return (None,)
        parts, done = [], 0
        for s in sorted(accepted(text, np.array(weights)), key=lambda s: (s.start, -s.end)):
            if s.start >= done:
                parts += [text[done : s.start], f"<{KINDS[s.kind].upper()}>"]
            done = max(done, s.end)
        return ("".join(parts) + text[done:],)

    return docs.withColumn(text_col, text_udf("masked string")(masked)(docs[text_col])["masked"])
