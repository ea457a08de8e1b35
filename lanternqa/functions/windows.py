"""Keyword-in-context cuts for many keywords in one pass over a text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = pa.struct([("kw_no", pa.int32()), ("keyword", pa.string()), ("match_no", pa.int32()), ("window", pa.string())])
CUTS = T.ArrayType(
    T.StructType()
    .add("kw_no", T.IntegerType()).add("keyword", T.StringType()).add("match_no", T.IntegerType())
    .add("window", T.StringType())
)
AUTOMATA = 64


class Keywords:
    """An automaton of a keyword list; a text is read once however many keywords there are."""

    def __init__(self, keywords: list[str | None]) -> None:
        self.keywords = keywords
        # A keyword holding a newline lies on no line.
        wanted = dict.fromkeys(k for k in keywords if k and "\n" not in k)
        self.automaton = ahocorasick.Automaton()
        for keyword in wanted:
            self.automaton.add_word(keyword, keyword)
        if wanted:
            self.automaton.make_automaton()
        self.any = bool(wanted)

    def cuts(self, text: str, n: int) -> list[dict]:
        """All windows, in the order of the list and then of the text."""
        if not self.any:
            return []
        places: dict[str, list[int]] = {}
        for end, keyword in self.automaton.iter(text):
            places.setdefault(keyword, []).append(end + 1 - len(keyword))
        if not places:
            return []
        breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
        windows = {keyword: windows_of(text, len(keyword), at, breaks, n) for keyword, at in places.items()}
        return [
            {"kw_no": kw_no, "keyword": keyword, "match_no": match_no, "window": window}
            for kw_no, keyword in enumerate(self.keywords)
            for match_no, window in enumerate(windows.get(keyword, ()))
        ]


def windows_of(text: str, size: int, places: list[int], breaks: list[int], n: int) -> list[str]:
    """What a matcher of up to `n` characters, the keyword and up to `n` characters finds, line by line.

    The first place left on a line fixes where a window starts; of the places
    that can still follow within `n` characters, the last is taken.
    """
    out, i, free = [], 0, 0
    while i < len(places):
        line = bisect_left(breaks, places[i])
        start = max(free, breaks[line - 1] + 1, places[i] - n)
        last = bisect_right(places, min(start + n, breaks[line] - size)) - 1
        free = min(places[last] + size + n, breaks[line])
        out.append(text[start:free])
        i = bisect_left(places, free)
    return out


@F.arrow_udf(CUTS)
def _cuts(texts: pa.Array, keywords: pa.Array, sizes: pa.Array) -> pa.Array:
    automata: dict[tuple, Keywords] = {}
    out = []
    for text, wanted, n in zip(texts.to_pylist(), keywords.to_pylist(), sizes.to_pylist()):
        if text is None or wanted is None or n is None:
            out.append(None)
            continue
        key = tuple(wanted)
        if key not in automata:
            if len(automata) == AUTOMATA:
                automata.clear()
            automata[key] = Keywords(wanted)
        out.append(automata[key].cuts(text, n))
    return pa.array(out, pa.list_(CUT))


def many_keyword_windows(text: Column, keywords: Column, n: Column) -> Column:
    """array<struct<kw_no, keyword, match_no, window>> of literal keywords; null where an argument is null."""
    return _cuts(text, keywords, n)
