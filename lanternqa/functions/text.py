"""Text columns: cleaning, transcript lines, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternqa.functions.windows import many_keyword_windows

# Above this many keywords one pass by an automaton costs less than a scan for each; it changes no result.
FEW_KEYWORDS = 8

TOKEN = r"[^ \t\n\r\f\x0B]+"
WORD = r"[\p{L}\p{N}_]+"

# Fixed value: all code points that count as blanks at the ends of a text, Unicode ones included.
BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Markers of a reasoning transcript and of an instruction turn.
FOLLOW_UP = "Follow up:"
INTERMEDIATE = "Intermediate answer:"
FINAL = "So the final answer is: "
NO_FOLLOW_UP = "No.\n"
TURN_END = "[/INST]"


def tokens(x: Column) -> Column:
    """Whitespace-separated tokens, in order."""
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def words(x: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def delete_space_pairs(x: Column) -> Column:
    return F.replace(x, F.lit("  "), F.lit(""))


def clean_whitespace(x: Column, collapse: bool = False) -> Column:
    """Newline, tab and CR become spaces, then each pair of spaces is deleted.

    Deleting pairs can glue two words; `collapse=True` keeps one space instead.
    """
    spaced = F.translate(x, "\n\t\r", "   ")
    return F.regexp_replace(spaced, " +", " ") if collapse else delete_space_pairs(spaced)


def strip(x: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+\z", "")


def clean_reply(x: Column) -> Column:
    """The model's part of a generated turn, on one line."""
    reply = F.get(F.split(x, r"\[/INST\]", -1), F.lit(1))
    return delete_space_pairs(F.replace(strip(reply), F.lit("\n"), F.lit(" ")))


def wrap_chat_turn(x: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), x, F.lit(" " + TURN_END))


def last_line(x: Column) -> Column:
    """Last non-empty line after the first; the first line only if it is alone."""
    lines = F.split(x, "\n", -1)
    later = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda line: line != "")
    return F.when(F.contains(x, F.lit("\n")), F.coalesce(F.try_element_at(later, F.lit(-1)), F.lit(""))).otherwise(x)


def followup_question(x: Column) -> Column:
    """The question the last line asks next, or null."""
    line = last_line(x)
    question = F.regexp_replace(F.substring_index(line, ":", -1), "^ ", "")
    return F.when(F.contains(line, F.lit(FOLLOW_UP)) & question.endswith("?"), question)


def final_answer(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(FINAL), F.lit("")), F.lit(NO_FOLLOW_UP), F.lit(""))


def truncate_at_stop(x: Column, stops: str | list[str]) -> Column:
    """Cut a completion where the first of the stop strings begins."""
    places = [F.instr(x, F.lit(stop)) for stop in ([stops] if isinstance(stops, str) else stops)]
    first = F.array_min(F.filter(F.array(*places), lambda place: place > 0))
    return F.when(first.isNotNull(), F.left(x, first - 1)).otherwise(x)


def normalize_for_match(x: Column) -> Column:
    """Drop U+0080-U+00FF, turn other non-word characters into spaces, lower, trim."""
    ascii_only = F.regexp_replace(x, r"[\x{80}-\x{FF}]", "")
    return F.trim(F.lower(F.regexp_replace(ascii_only, r"[^\p{L}\p{N}_]", " ")))


def quote_pattern(x: Column) -> Column:
    """Make a keyword literal inside a regular expression."""
    return F.regexp_replace(x, r"(\p{Punct})", r"\\$1")


def keyword_windows(
    text: Column, keywords: Column | list[str], n: int | Column = 100, regex: bool = False, few: int = FEW_KEYWORDS
) -> Column:
    """Keyword-in-context cuts of one text.

    For each keyword in list order: every non-overlapping match of up to `n`
    characters, the keyword, up to `n` characters. Matching is case-sensitive
    and a window stops at a newline. Gives array<struct<kw_no, keyword,
    match_no, window>>.

    Up to `few` keywords, and regular expressions, are matched one by one in the
    plan itself, on the lines that hold them; more are found in one pass over the
    text. Both give the same windows.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    if isinstance(keywords, list):
        listed = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
        if regex or len(keywords) <= few:
            return _each_keyword(text, listed, n, regex)
        return many_keyword_windows(text, listed, n.cast("int"))
    if regex:
        return _each_keyword(text, keywords, n, regex)
    # A text goes only where its windows are cut.
    short = F.size(keywords) <= few
    return F.when(short, _each_keyword(F.when(short, text), keywords, n, regex)).otherwise(
        many_keyword_windows(F.when(~short, text), keywords, n.cast("int"))
    )


def _each_keyword(text: Column, keywords: Column, n: Column, regex: bool) -> Column:
    def cuts(keyword: Column) -> Column:
        pattern = F.concat(
            F.lit("(?d).{0,"), n.cast("string"), F.lit("}"),
            F.concat(F.lit("(?:"), keyword, F.lit(")")) if regex else quote_pattern(keyword),
            F.lit(".{0,"), n.cast("string"), F.lit("}"),
        )
        if regex:
            return F.regexp_extract_all(text, pattern, F.lit(0))
        lines = F.filter(F.split(text, "\n", -1), lambda line: F.contains(line, keyword))
        return F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, pattern, F.lit(0))))

    def numbered(keyword: Column, kw_no: Column) -> Column:
        return F.transform(
            F.when(keyword == "", F.array().cast("array<string>")).otherwise(cuts(keyword)),
            lambda window, match_no: F.struct(
                kw_no.alias("kw_no"), keyword.alias("keyword"), match_no.alias("match_no"), window.alias("window")
            ),
        )

    return F.flatten(F.transform(keywords, numbered))


def merge_windows(windows: Column, sep: str = "---") -> Column:
    """Join the windows of one text in keyword order, then match order."""
    return F.array_join(F.transform(windows, lambda w: w["window"]), sep)


def chunk_budget(limit: int, prompt: Column, reserve: int = 0) -> Column:
    """Chunk size left beside a prompt: a token limit less the prompt's characters."""
    return F.greatest(F.lit(limit) - F.length(prompt) - F.lit(reserve), F.lit(1))
