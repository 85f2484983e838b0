"""Value normalisation as Column functions: text of spreadsheet cells to numbers, types, scales and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Texts that stand for a missing value, and factors of unit words.
SENTINELS = ["", "…", "...", "..", "-", "–", "—", "n/a", "na", "n.a.", ".", "x", "x)", "해당없음", "없음", "*", "**", "ns"]
UNITS = {"십억원": 10**9, "백만원": 10**6, "억원": 10**8, "천만원": 10**7, "천원": 10**3, "만원": 10**4, "조원": 10**12, "천명": 10**3, "만명": 10**4, "billion": 10**9, "million": 10**6, "thousand": 10**3, "천": 10**3, "백만": 10**6, "억": 10**8, "조": 10**12}
ERRORS = ["#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NUM!", "#NULL!", "#SPILL!", "#CALC!", "#GETTING_DATA"]

_LONGEST_FIRST = sorted(UNITS, key=len, reverse=True)
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　\xa0"
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "


def ascii_digits(x: Column) -> Column:
    """Full-width forms to ASCII, zero-width characters dropped."""
    return F.translate(x, FULL + "​‌‍﻿", ASCII)


def sentinel(x: Column) -> Column:
    """The missing-value text that a cell holds, or null."""
    t = F.lower(F.trim(ascii_digits(x)))
    return F.when(t.isin(SENTINELS), t)


def is_identifier(x: Column) -> Column:
    """Digits with a leading zero are a code and not a number."""
    return F.trim(x).rlike(r"^0\d+$")


def unit_scale(label: Column) -> Column:
    """The factor of the longest unit word in a label; 1 for per cent, currencies and others."""
    return F.coalesce(*(F.when(F.lower(label).contains(u), F.lit(UNITS[u])) for u in _LONGEST_FIRST), F.lit(1)).cast("long")


#: How a text with a unit behind it ends.
_UNIT_END = "[" + "".join(sorted({u[-1] for u in UNITS})) + r"]\s*\)?\s*$"


def split_scale(x: Column) -> Column:
    """Body and factor of a number with a unit behind it."""
    pattern = r"^(.*\d[\d,.]*\)?)\s*(" + "|".join(_LONGEST_FIRST) + r")\s*(\)?)\s*$"
    body, unit = F.concat(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 3)), F.regexp_extract(x, pattern, 2)
    # The long pattern is for texts that end like a unit alone: it goes back and forth over all others.
    unit = F.when(x.rlike(_UNIT_END), unit).otherwise("")
    return F.struct(F.when(unit == "", x).otherwise(body).alias("body"), F.when(unit == "", F.lit(1)).otherwise(unit_scale(unit)).cast("long").alias("scale"))


#: A number as it may stand: brackets only as a pair around the whole, one sign, no blanks between digits.
_DIGITS = r"(?:[\d,]*\.?\d+(?:[eE][+-]?\d+)?|[\d,]*\d\.)"
NUMBER = rf"^(?:\(\s*[△▲−-]?\s*[₩$€£]?\s*{_DIGITS}\s*%?\s*\)|[△▲−+-]?\s*[₩$€£]?\s*{_DIGITS}\s*(?:\(-\))?)\s*%?$"


#: Digits with a point and a minus at most, and no code.
PLAIN = r"^(?!0\d+$)-?\d+(?:\.\d+)?$"


def number(x: Column) -> Column:
    """Value, scale and whether a mark made it negative, from text; signs, brackets, commas, per cent and units.
    A bracket without its fellow, or a blank between digits, makes it text."""

    def read(s: Column) -> Column:
        t = s["body"]
        negative = t.rlike(r"^\(.*\)$|^[△▲−-]|\(-\)$")
        percent = t.contains("%")
        bare = F.regexp_replace(t, r"\(-\)\s*%?$|[(),△▲−%\s₩$€£+]|^-", "")
        value = F.when(s["there"] & ~is_identifier(t) & t.rlike(NUMBER), F.regexp_replace(bare, "^-", "")).try_cast("double")
        scale, parts = F.when(percent, F.lit(1)).otherwise(s["scale"]), F.when(percent, F.lit(100)).otherwise(F.lit(1))
        return F.struct((value * scale * F.when(negative, -1).otherwise(1) / parts).alias("value"), scale.alias("scale"), negative.alias("negative"))

    def marked(t: Column) -> Column:
        split = split_scale(t)
        there = F.coalesce(~F.lower(t).isin(SENTINELS), F.lit(True))
        return held(F.struct(split["body"].alias("body"), split["scale"].alias("scale"), there.alias("there")), read)

    def held(value: Column, then: Callable[[Column], Column]) -> Column:
        """An array of one holds what is used more than once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    # Plain digits need none of the marks.
    plain = lambda t: F.struct(t.try_cast("double").alias("value"), F.lit(1).cast("long").alias("scale"), t.startswith("-").alias("negative"))
    return held(F.trim(ascii_digits(x)), lambda t: F.when(t.rlike(PLAIN), plain(t)).otherwise(marked(t)))


def format_scale(number_format: Column) -> Column:
    """The factor that trailing commas or a quoted unit in a number format imply."""
    commas = F.length(F.regexp_extract(number_format, r"[0#](,+)(?:[^,0#]|$)", 1))
    return F.greatest(F.pow(F.lit(1000.0), commas), unit_scale(F.regexp_extract(number_format, r'"([^"]+)"', 1)).cast("double")).cast("long")


def strip_footnote(x: Column) -> Column:
    """Trailing footnote marks off, but never to nothing."""
    t = F.regexp_replace(x, r"(\s*([¹²³⁰⁴-⁹]+|[*†‡§]+\d*|\((주)?\d{1,2}\)|주\d{1,2}\)))+\s*$", "")
    return F.when(F.trim(t) == "", x).otherwise(t)


def indent_level(x: Column) -> Column:
    """Leading white space as levels: two blanks are one, a tab or an ideographic blank counts four blanks."""
    lead = F.regexp_extract(x, "^([ \t　\xa0]*)", 1)
    return F.floor(F.length(F.regexp_replace(lead, "[\t　]", "    ")) / 2).cast("int")


def value_kind(x: Column) -> Column:
    """DATE, PCT, NUM or TEXT of one value; null where it is missing. With a point, as in 2024.03, a date needs a
    year and month that exist: other such texts are amounts."""
    t = F.trim(ascii_digits(x))
    return (
        F.when(x.isNull() | sentinel(x).isNotNull(), F.lit(None))
        .when(t.rlike(r"^(\d{4}[-/]\d{1,2}|(19|20)\d{2}\.(0?[1-9]|1[0-2]))([-./]\d{1,2})?$"), "DATE")
        .when(t.rlike(r"^[△▲−(-]?[\d,.]+\)?\s*%\)?$"), "PCT")
        .when(t.rlike(PLAIN) | number(x)["value"].isNotNull(), "NUM")
        .otherwise("TEXT")
    )


def column_type(table: DataFrame, keys: list[str], value: str, threshold: float = 0.7) -> DataFrame:
    """Keys and the type that at least the threshold of a column's values has, missing ones left out; else MIXED, and
    TEXT for a column without values. Ties go to the type that comes first in the alphabet."""
    g = table.withColumn("_k", value_kind(C(value))).groupBy(*keys, "_k").agg(F.count("*").alias("_n"))
    top = F.max_by(F.when(C("_k").isNotNull(), C("_k")), F.when(C("_k").isNotNull(), F.struct(C("_n"), -F.ascii("_k"))))
    s = g.groupBy(*keys).agg(top.alias("_t"), F.max(F.when(C("_k").isNotNull(), C("_n"))).alias("_m"), F.sum(F.when(C("_k").isNotNull(), C("_n")).otherwise(0)).alias("_all"))
    kind = F.when(C("_all") == 0, "TEXT").when(C("_m") / C("_all") >= threshold, C("_t")).otherwise("MIXED")
    return s.select(*keys, kind.alias("type"))


def to_integer(x: Column) -> Column:
    """Whole numbers only; thousands commas must stand in threes."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0+)?$"), F.regexp_replace(F.regexp_replace(t, ",", ""), r"\.0+$", "")).try_cast("long")


def to_double(x: Column) -> Column:
    """Finite numbers, with an optional currency sign and commas in threes."""
    t = F.regexp_replace(F.trim(x), r"^([+-]?)[₩$€£¥]", "$1")
    return F.when(t.rlike(r"^[+-]?(\d+|\d{1,3}(,\d{3})+)?(\.\d+)?([eE][+-]?\d+)?$") & t.rlike(r"\d"), F.regexp_replace(t, ",", "")).try_cast("double")


def to_day(x: Column) -> Column:
    """A date in one of seven forms."""
    t = F.trim(x)
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyy-MM")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in forms))


def to_flag(x: Column) -> Column:
    """Words for true and false."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("true", "yes", "y", "1", "t"), True).when(t.isin("false", "no", "n", "0", "f"), False)


def year_month(x: Column) -> Column:
    """Months since year 0 of `YYYY-MM[-DD]`, `YYYY년 M월` and `YYYYQn` (first month of the quarter)."""
    pattern = r"^\s*(\d{4})\s*[-./년]\s*(\d{1,2})"
    quarter = r"^\s*(\d{4})\s*-?[Qq]([1-4])\s*$"
    year, month = F.regexp_extract(x, pattern, 1).try_cast("int"), F.regexp_extract(x, pattern, 2).try_cast("int")
    qy, q = F.regexp_extract(x, quarter, 1).try_cast("int"), F.regexp_extract(x, quarter, 2).try_cast("int")
    return F.coalesce(F.when(month.between(1, 12), year * 12 + month - 1), qy * 12 + 3 * (q - 1))


def lenient(x: Column) -> Column:
    """A number, or 0."""
    return F.coalesce(number(x)["value"], F.lit(0.0))


def is_period(x: Column) -> Column:
    """Year, month, quarter or half, with or without its year, in English and Korean forms."""
    year, of_year = r"(19|20)\d{2}", r"((19|20)\d{2}\s*[-./년]?\s*)?"
    forms = [rf"{year}(년)?", rf"{year}\s*[-./년]\s*\d{{1,2}}(월)?", rf"{year}\s*-?\s*[QqHh][1-4]", rf"{of_year}[1-4]\s*/\s*4", rf"{of_year}[1-4]\s*[Qq]", rf"{of_year}[1-4]\s*분기", rf"{of_year}[상하]반기", r"\d{1,2}월"]
    return F.trim(x).rlike("^(" + "|".join(forms) + ")$")
