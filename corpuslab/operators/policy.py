"""Segments that end at punctuation, and descending trees of merges: small sequential rules, many documents at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

UNIT = re.compile(r"[\w'’-]+|[^\w\s]", re.UNICODE)
STRENGTH = {".": 0, "!": 0, "?": 0, "…": 0, ";": 1, ":": 1, ",": 2}


def cut_by_policy(text: str, size: int) -> list[str]:
    """Runs of words: when `size` words are reached, the best place from size // 2 words on is cut: strongest mark, then nearest to size, then latest."""
    out: list[str] = []
    run: list[tuple[int, int, bool]] = []  # start, end, word
    words = 0
    for m in UNIT.finditer(text):
        word = m.group()[0].isalnum() or m.group()[0] == "_"
        run.append((m.start(), m.end(), word))
        words += word
        if words < size:
            continue
        best, count = None, 0
        for k, (a, b, w) in enumerate(run):
            count += w
            if count >= max(1, size // 2):
                strength = 3 if w else STRENGTH.get(text[a:b], 3)
                rank = (strength, abs(size - count), -k)
                best = min(best, (rank, k)) if best else (rank, k)
        at = best[1] + 1
        out.append(text[run[0][0] : run[at - 1][1]])
        run = run[at:]
        words = sum(w for _, _, w in run)
    if run:
        out.append(text[run[0][0] : run[-1][1]])
    return out


def segments_policy(docs: DataFrame, size: int = 40, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, seg_no, segment."""

    def made(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, n, s) for k, t in zip(pdf[key], pdf[text_col], strict=True) for n, s in enumerate(cut_by_policy(t or "", size))]
            yield pd.DataFrame(rows, columns=[key, "seg_no", "segment"])

    return docs.select(key, text_col).mapInPandas(made, f"{key} long, seg_no int, segment string")


def average_linkage(names: list[str], distance: dict[tuple[str, str], float]) -> list[tuple[str, str, float, int]]:
    """Merges (a, b, height, size) by mean distance; a cluster is named by its first member. For the few modalities of a variable."""
    members = {n: [n] for n in names}
    d = lambda a, b: sum(distance[min(x, y), max(x, y)] for x in members[a] for y in members[b]) / (len(members[a]) * len(members[b]))
    out = []
    while len(members) > 1:
        height, a, b = min((d(a, b), a, b) for a in members for b in members if a < b)
        members[a] += members.pop(b)
        out.append((a, b, height, len(members[a])))
    return out
