"""Text functions as column expressions."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from re import _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word or a single other character, with the white space before it.
SPACED_TOKEN = r"\s*(?:[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_])"
WORD = r"[\p{L}\p{M}\p{N}_]+"

#: Fixed list of words that ranking leaves out.
STOPWORDS = (
    "a an and are as at be by can do does for from how i if in is it me my of on or should that the their this to use "
    "what when where which who with would must need required please"
).split()
#: Fixed expansions of question words.
EXPANSIONS = {
    "sspr": "source selection price reasonableness form", "bid": "competitive bidding", "bidding": "competitive bid",
    "quotes": "quotations proposals", "quote": "quotations proposals", "federally": "federal",
}


def needed(pieces) -> frozenset[str] | None:
    """Literals of which each match of a parsed pattern holds at least one; None where the pattern has none of two characters."""
    options, run = [], ""
    for op, of in [*pieces, (None, None)]:
        if op is _constants.LITERAL and 32 <= of < 127:
            run += chr(of).lower()
            continue
        options, run = [*options, frozenset([run])], ""
        if op is _constants.SUBPATTERN:
            options.append(needed(of[3]))
        elif op is _constants.BRANCH:
            branches = [needed(b) for b in of[1]]
            options.append(frozenset().union(*branches) if all(branches) else None)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and of[0] > 0:
            options.append(needed(of[2]))
    known = [o for o in options if o and min(map(len, o)) > 1]
    return max(known, key=lambda o: (min(min(map(len, o)), 4), -len(o), sorted(o)), default=None)


@functools.cache
def stems(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which any text that a pattern is in, in any case, holds one; none where that isn't known."""
    try:
        found = needed(_parser.parse(f"(?i){pattern}")) or ()
    except re.error:  # other engines' syntax
        found = ()
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def said(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern is in a text, in any case; false for null. It is looked for only in texts with one of its stems.

    low: the text in lower case, or that of a longer text around it, which callers with many patterns compute once.
    """
    low = F.lower(text) if low is None else low
    held = [F.contains(low, F.lit(s)) for s in stems(pattern)]
    found = text.rlike(f"(?i){pattern}")
    return F.coalesce(functools.reduce(operator.or_, held) & found if held else found, F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def terms(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that aren't stop words, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~F.array_contains(stop, w))


def search_terms(text: Column) -> Column:
    """terms() with the expansions of those that have one behind them."""
    found = terms(text)
    more = F.create_map(*(F.lit(x) for pair in EXPANSIONS.items() for x in pair))
    return F.concat(found, F.flatten(F.transform(F.filter(found, lambda w: F.map_contains_key(more, w)), lambda w: F.split(F.element_at(more, w), " "))))


def chunk_terms(text: Column) -> Column:
    """Lower-case words of two characters or more, where all but word characters, white space and $ separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s$]", " "), r"\s+"), lambda w: F.length(w) > 1)


def token_spans(text: Column) -> Column:
    """(start, end) of each word or other visible character, in code points."""
    pieces = F.regexp_extract_all(text, F.lit(SPACED_TOKEN), F.lit(0))
    place = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))).alias("start"), (s["at"] + F.length(p)).alias("end")))).alias("out")),
    )
    return place["out"]


def heading_level(line: Column) -> Column:
    """1 or 2 for a line that is a heading, else null."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (
        F.when((F.length(text) > 180) | text.rlike(r"\.{3,}\s*\d+\s*$"), None)
        .when(text.rlike(r"^(?i:ARTICLE|PART|SECTION)\s+(?i:\d+|[IVX]+)\b") | text.rlike(r"^[IVXLCDM]{1,6}\.\s+[A-Z]"), 1)
        .when(text.rlike(r"^[A-Z]\.\s+[A-Z]"), 2)
        .when((F.length(text) >= 6) & text.rlike(r"^[A-Z][A-Z &/()\-:]{4,}$"), 2)
    )


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """SHA-1 of a text modulo a number, digit by digit, so that 160 bits never have to fit anywhere."""
    digits = F.transform(F.split(F.sha1(key.cast("binary")), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda a, d: (a * 16 + d) % buckets)


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


DOLLARS = r"\$\s*([\d,]+(?:\.\d+)?)"


def dollar_amounts(text: Column) -> Column:
    """The distinct amounts after a dollar sign, ascending."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOLLARS), F.lit(1))
    values = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.array_compact(values)))


#: Fixed words for numbers.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}


def number(word: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in NUMBERS.items() for x in p)), F.lower(word)), word.try_cast("int"))


def duration_days(text: Column, low: Column | None = None) -> Column:
    """Days of the first duration in days, weeks of 7 or months of 30, else null. low as in said()."""
    pattern = rf"(?i)\b(\d+|{'|'.join(NUMBERS)})[\s-]*(day|week|month)s?\b"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    size = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30)
    return F.when(said(text, "day|week|month", low), number(F.regexp_extract(text, pattern, 1)) * size)


def labelled_date(text: Column, label: str) -> Column:
    """The date after a label as ISO text, to the month where the day is missing; null where there is none or it isn't a date."""
    raw = F.regexp_extract(text, rf"(?i)\b(?:{label})\s*[:.\-]?\s*(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}|\d{{1,2}}[-/.]\d{{4}})\b", 1)
    month = F.regexp_extract(raw, r"^(\d{1,2})[-/.](\d{4})$", 1).try_cast("int")
    day = F.coalesce(*(F.try_to_date(raw, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "M.d.yyyy")))
    return F.when(month.between(1, 12), F.concat(F.right(raw, F.lit(4)), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(day.cast("string"))


def page_range(pages: Column) -> Column:
    """"p" or "low-high" of an array of page numbers; null where it is empty."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
