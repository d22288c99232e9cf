"""Fuzzy ratios (0 to 100) over Arrow batches; no built-in expression gives them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio())


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter text with a stretch of its length of the longer."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return round(100 * best)


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0
    common = " ".join(sorted(x & y))
    left, right = (f"{common} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max(ratio(common, left), ratio(common, right), ratio(left, right))


def address_score(a: str, b: str) -> int:
    """Ratio and partial ratio of two normalized addresses added up; above 100 they are taken as the same."""
    return ratio(a, b) + partial_ratio(a, b)


def subsequence_span(small: list, large: list) -> tuple[int, int] | None:
    """First place where a subsequence begins and the last place that its last item has."""
    at, start = 0, None
    for i, x in enumerate(large):
        if at < len(small) and x == small[at]:
            start = i if start is None else start
            at += 1
    return (start, len(large) - 1 - large[::-1].index(small[-1])) if small and at == len(small) else None


def _udf(f):
    @F.pandas_udf(IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")

    return run


ratio_udf, partial_ratio_udf, token_sort_udf, token_set_udf, address_udf = (_udf(f) for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, address_score))
