"""Fuzzy string scores, 0 to 100."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternqa.functions.text import normalize_for_match


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine add per character
    of the shorter string (bit-parallel, Hyyro 2004)."""
    if len(a) < len(b):
        a, b = b, a
    same = 0
    while same < len(b) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    masks = {ch: 0 for ch in b}
    if len(a) <= 1024:
        for i, ch in enumerate(a):
            if ch in masks:
                masks[ch] |= 1 << i
    else:
        bits = {ch: bytearray(len(a) // 8 + 1) for ch in masks}
        for i, ch in enumerate(a):
            if ch in bits:
                bits[ch][i >> 3] |= 1 << (i & 7)
        masks = {ch: int.from_bytes(mask, "little") for ch, mask in bits.items()}
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks[ch]
        row = ((row + hit) | (row - hit)) & full
    return same + len(a) - row.bit_count()


def _share(common: int, total: int) -> int:
    """The formula, written as the public scorer rounds it: 1 - distance/total, half to even. It grows with `common`."""
    return round(100 * (1.0 - (total - 2 * common) / total))


def ratio(a: str, b: str, least: int = 0) -> int:
    """Equal texts score 100, an empty one 0 against any other.

    A score that cannot exceed `least` is given as `least`: no common
    subsequence has more of a character than either text has.
    """
    if a == b:
        return 100
    if not a or not b:
        return least
    total = len(a) + len(b)
    if least:
        if _share(min(len(a), len(b)), total) <= least:
            return least
        if _share((Counter(a) & Counter(b)).total(), total) <= least:
            return least
    return max(least, _share(common_subsequence(a, b), total))


def sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str, least: int = 0) -> int:
    """Best ratio among shared words, shared + rest of a, shared + rest of b; `least` if none exceeds it.

    The shared words begin both of the longer texts, so what they have in common
    with these is their own length; only the last ratio may need the full work.
    """
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return least
    shared = sorted(left & right)
    core = " ".join(shared)
    one = " ".join(shared + sorted(left - right))
    two = " ".join(shared + sorted(right - left))
    best = least
    for whole in (one, two):
        if core:
            best = max(best, 100 if core == whole else _share(len(core), len(core) + len(whole)))
    return best if best == 100 else ratio(one, two, best)


def _column(score):
    @F.pandas_udf(T.IntegerType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="int32")

    return scored


@F.pandas_udf(T.IntegerType())
def _best_set_ratio(a: pd.Series, options: pd.Series) -> pd.Series:
    def best(x: str | None, texts) -> int | None:
        if texts is None:
            return None
        top = 0
        for y in texts if x is not None else ():
            if y is not None and top < 100:
                top = set_ratio(x, y, top)
        return top

    return pd.Series([best(x, texts) for x, texts in zip(a, options)], dtype="Int32")


def best_token_set_ratio(a: Column, options: Column) -> Column:
    """The best token-set ratio of a text and any text of an array, worked out in the row."""
    return _best_set_ratio(normalize_for_match(a), F.transform(options, normalize_for_match))


def similarity_ratio(a: Column, b: Column) -> Column:
    """Share of characters in a longest common subsequence."""
    return _column(ratio)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Ratio of the normalized texts with their words sorted."""
    return _column(sort_ratio)(normalize_for_match(a), normalize_for_match(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the normalized texts' shared words and either side's rest with them."""
    return _column(set_ratio)(normalize_for_match(a), normalize_for_match(b))
