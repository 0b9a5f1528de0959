"""Fuzzy similarity as vectorised functions: Indel ratio by bit-parallel longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

ALGORITHMS = ["ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"]


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, cut windows at its ends included."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    known = set(a)
    best = 0.0
    for start in range(-(n - 1), len(b)):
        window = b[max(0, start) : start + n]
        # a best window begins and ends with characters of the shorter text, or at an end of the longer
        if start > 0 and window[0] not in known or start + n < len(b) and window[-1] not in known:
            continue
        best = max(best, ratio(a, window))
        if best == 100.0:
            break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def score(algorithm: str):
    """(pattern, text) -> similarity from 0 to 100; an unknown name means ratio."""
    one = {"partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}.get(algorithm, ratio)

    @F.pandas_udf("double")
    def similarity(pattern: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", t or "") for p, t in zip(pattern, text)])

    return similarity
