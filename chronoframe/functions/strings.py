"""Similarity of strings, as Arrow-batched functions for label search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters with a weight of 0.1 if above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    swapped = sum(x != y for x, y in zip(matched, (c for j, c in enumerate(b) if taken[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def subsequence(pattern: str, text: str) -> float:
    """How well a pattern runs through a text in order: squares of the runs, less the gaps' share of the text.

    1 for equal strings, 0 if the pattern doesn't occur in order; of all starts the best counts.
    """
    if not pattern or pattern == text:
        return 1.0
    if len(pattern) > len(text):
        return 0.0
    best = -1.0
    start = text.find(pattern[0])
    while start >= 0:
        at, runs = start, []
        for c in pattern:
            at = text.find(c, at)
            if at < 0:
                break
            if runs and runs[-1][1] == at:
                runs[-1][1] = at + 1
            else:
                runs.append([at, at + 1])
            at += 1
        if at < 0:
            break
        gaps = runs[0][0] + sum(b[0] - a[1] for a, b in zip(runs, runs[1:], strict=False))
        score = sum((e - s) ** 2 for s, e in runs) - gaps / len(text) - (len(text) - runs[-1][1]) / (2 * len(text))
        best = max(best, score)
        start = text.find(pattern[0], start + 1)
    return 0.999 * best / len(pattern) ** 2 if best >= 0 else 0.0


def similarity(value: Column, term: str, algorithm: str) -> Column:
    """Similarity of a string column with a term by ``jarowinkler`` or ``subsequence``."""
    score = {"jarowinkler": jaro_winkler, "subsequence": subsequence}[algorithm]

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: score(term, v), na_action="ignore")

    return run(value)
