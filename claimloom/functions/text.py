"""String expressions with the semantics of Unicode-aware regular expressions.

Patterns get the flags U (Unicode classes) and d (only line feeds end lines),
and i where case does not count; none of them may match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))  # what SPACE matches
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return f"(?{'i' if ignore_case else ''}Ud){pattern}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once, also where lambdas inside ``use`` refer to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """``text`` stripped, with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, rx(rf"{SPACE}+"), " "))


def normalised(text: Column) -> Column:
    return collapse(F.lower(text))


def lines(text: Column) -> Column:
    """The lines of ``text``, stripped, without the blank ones."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def count_lines(lines_: Column, pattern: str) -> Column:
    return F.size(F.filter(lines_, lambda x: x.rlike(pattern)))


def holds(text: Column, *signs: str) -> Column:
    """Whether ``text`` holds one of ``signs`` as it is written."""
    held = F.contains(text, F.lit(signs[0]))
    for sign in signs[1:]:
        held = held | F.contains(text, F.lit(sign))
    return held


def find_all(text: Column, pattern: str, *signs: str, low: bool = False) -> Column:
    """All matches as array<struct<start, end, text>>, in characters from 0.

    The offsets are running sums of the lengths of the gaps and matches. The
    pattern is tried only on texts that hold one of ``signs``, if any are given:
    each match must hold one of them as it is written, or in lower case if ``low``.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    pairs = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"), found.alias("match"))

    def step(acc: Column, pair: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(pair["gap"])
        row = F.struct(at.alias("start"), (at + F.length(pair["match"])).alias("end"), pair["match"].alias("text"))
        return F.concat(acc, F.array(row))

    tried = text.rlike(pattern)
    if signs:
        held = let(F.lower(text), lambda x: holds(x, *signs)) if low else holds(text, *signs)
        tried = F.when(held, tried).otherwise(False)
    return F.when(tried, F.aggregate(pairs, none, step)).otherwise(none)


def inside(ranges: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) lies within one of ``ranges``."""
    return F.exists(ranges, lambda r: (r["start"] <= start) & (end <= r["end"]))


def blocked(ranges: Column, start: Column, end: Column) -> Column:
    """Whether a new range begins or ends inside an earlier one.

    A range that strictly contains an earlier one is not blocked.
    """
    return F.exists(ranges, lambda r: ((r["start"] <= start) & (start < r["end"])) | ((r["start"] < end) & (end <= r["end"])))


def occurrences(rows: Column, *same: str) -> Column:
    """Per element of ``rows``, how many up to and with it agree in the fields ``same``."""

    def alike(a: Column, b: Column) -> Column:
        equal = a[same[0]].eqNullSafe(b[same[0]])
        for name in same[1:]:
            equal = equal & a[name].eqNullSafe(b[name])
        return equal

    def numbers(bound: Column) -> Column:
        return F.transform(bound, lambda row, i: F.size(F.filter(F.slice(bound, F.lit(1), i + 1), lambda x: alike(x, row))))

    return let(rows, numbers)


def quoted(text: Column) -> Column:
    """``text`` in quotes, as a programmer would write it: double ones if it holds only single ones."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(sign), F.lit(written))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.isNull(), F.lit("None")).when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)
