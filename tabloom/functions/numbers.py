"""Numbers and partial dates in text, as column expressions.

A numeric value is struct<type,f,year,month,day>: type is 'number' or 'date' and
any date part may be null. Dates are never cast to DateType, because most of
them are partial.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "number"
DATE = "date"
VALUE_TYPE = "struct<type:string,f:double,year:int,month:int,day:int>"

# Words that stand for numbers. Both spellings of the fifth ordinal are accepted.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
ORDINAL_WORDS = {
    "zeroth": 0, "first": 1, "second": 2, "third": 3, "fourth": 4, "fith": 5, "fifth": 5, "sixth": 6,
    "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12,
}
ORDINAL_SUFFIX = "(st|nd|rd|th)$"
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MIN_YEAR, MAX_YEAR = 1700, 2016
DEFAULT_YEAR = 1900
MAX_DATE_WORDS = 5

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MONTH = "(" + "|".join(f"{m}|{m[:3]}" if m != "may" else m for m in MONTHS) + ")"
_WEEKDAY = "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_DAY, _NUM_MONTH, _YEAR = r"(\d{1,2})", r"(\d{1,2})", r"(\d{4})"

# Fixed formats: the shapes a date may have, with the order of the parts in the pattern.
DATE_SHAPES = (
    ("(" + "|".join(MONTHS) + ")", "m"),
    (_YEAR, "y"),
    (_YEAR + "s", "y"),
    (_MONTH + r"\s+" + _YEAR, "my"),
    (_MONTH + r"\s+" + _DAY, "md"),
    (_DAY + r"\s+" + _MONTH, "dm"),
    (_MONTH + r"\s+" + _DAY + r",\s+" + _YEAR, "mdy"),
    (_DAY + r"\s+" + _MONTH + r"\s+" + _YEAR, "dmy"),
    (_NUM_MONTH + "-" + _DAY + "-" + _YEAR, "mdy"),
    (_YEAR + "-" + _NUM_MONTH + "-" + _DAY, "ymd"),
    (_YEAR + "-" + _NUM_MONTH, "ym"),
    (_DAY + r"\." + _NUM_MONTH + r"\." + _YEAR, "dmy"),
    (_WEEKDAY + r",\s+" + _MONTH + r"\s+" + _DAY, "md"),
)


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def to_double(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal, inf or nan literal is null."""
    text = F.lower(F.trim(c))
    named = (
        F.when(text.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(text.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(text.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )
    # Of what is no decimal, only texts with one of these are looked at by the other patterns.
    return F.when(text.rlike(_FLOAT), text.try_cast("double")).when(F.contains(text, F.lit("inf")) | F.contains(text, F.lit("nan")), named)


def convert_to_float(c: Column) -> Column:
    """Lenient number reader that guesses the role of ',' and '.'; null when it fails."""
    has_comma, has_dot = F.contains(c, F.lit(",")), F.contains(c, F.lit("."))
    no_commas, no_dots = F.replace(c, F.lit(",")), F.replace(c, F.lit("."))
    n_commas, n_dots = F.length(c) - F.length(no_commas), F.length(c) - F.length(no_dots)
    thousands = F.exists(F.split(c, ","), lambda part: F.length(part) == 3)
    # Most texts have no comma, and those are done after two looks at them.
    return (
        F.when(~has_comma, F.when(has_dot & (n_dots > 1), to_double(no_dots)).otherwise(to_double(c)))
        .when(has_dot | thousands, to_double(no_commas))
        .when(n_commas == 1, to_double(F.replace(c, F.lit(","), F.lit("."))))
        .otherwise(to_double(no_commas))
    )


def is_number(c: Column) -> Column:
    value = convert_to_float(c)
    return value.isNotNull() & ~F.isnan(value)


def to_float32(c: Column) -> Column:
    return c.cast("float")


def numeral(c: Column) -> Column:
    """The digits of a cardinal or ordinal number as a double, or null."""
    return to_double(F.replace(F.regexp_replace(c, ORDINAL_SUFFIX, ""), F.lit(",")))


def parse_number(c: Column, digits: Column | None = None) -> Column:
    """One cardinal or ordinal number, digits or word; null when it is neither or not finite upward.

    digits is the numeral of c where that is a column already.
    """
    digits = numeral(c) if digits is None else digits
    finite = F.when(~F.isnan(digits) & (digits != float("inf")), digits)
    word = _lookup({**NUMBER_WORDS, **ORDINAL_WORDS})[c].cast("double")
    return F.coalesce(finite, word)


def is_ordinal(c: Column) -> Column:
    digits = numeral(c)
    counts = digits.isNotNull() & ~F.isnan(digits) & (digits != float("inf")) & (digits != 0)
    return c.isin(*ORDINAL_WORDS) | (F.coalesce(counts, F.lit(False)) & c.rlike(ORDINAL_SUFFIX))


def _parts_pattern() -> tuple[str, str]:
    """All date shapes in one pattern, and what takes its groups apart: year;month's name;month's number;day."""
    places, group = {"y": "", "name": "", "m": "", "d": ""}, 0
    for shape, order in DATE_SHAPES:
        for part in order:
            group += 1
            places["name" if part == "m" and "jan" in shape else part] += f"${group}"
    return "^(?:" + "|".join(shape for shape, _ in DATE_SHAPES) + r")$\R?", ";".join(places.values())


def date_parts(c: Column) -> Column:
    """[year, month's name, month's number, day] as texts, absent ones empty; null for what has no date shape.

    A text has one shape at most, so all shapes are matched at once.
    """
    text = F.lower(F.regexp_replace(c, r"Sept\b", "Sep"))
    pattern, parts = _parts_pattern()
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, parts), ";"))


def date_from(parts: Column) -> Column:
    """struct<year,month,day> of date_parts with absent parts null; null for days that do not exist."""
    month_no = _lookup({name: i for i, m in enumerate(MONTHS, 1) for name in {m, m[:3]}})
    year, number, day = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 2, 3))
    month = F.coalesce(number, month_no[F.get(parts, F.lit(1))])
    full_year = F.coalesce(year, F.lit(DEFAULT_YEAR))
    whole = F.concat_ws("-", full_year.cast("string"), F.coalesce(month, F.lit(1)).cast("string"), F.coalesce(day, F.lit(1)).cast("string"))
    valid = parts.isNotNull() & full_year.between(MIN_YEAR, MAX_YEAR) & whole.try_cast("date").isNotNull()
    return F.when(valid, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def parse_date(c: Column) -> Column:
    """The date that a text reads as, as struct<year,month,day> with absent parts null."""
    return date_from(date_parts(c))


def number_value(c: Column) -> Column:
    """Wrap a double as a numeric value."""
    none = F.lit(None).cast("int")
    return F.struct(F.lit(NUMBER).alias("type"), c.alias("f"), none.alias("year"), none.alias("month"), none.alias("day"))


def date_value(c: Column) -> Column:
    """Wrap struct<year,month,day> as a numeric value."""
    return F.struct(
        F.lit(DATE).alias("type"),
        F.lit(None).cast("double").alias("f"),
        *[c[p].alias(p) for p in ("year", "month", "day")],
    )


def reads_as_number(c: Column) -> Column:
    """Whether a whole cell has the shape of one number or word."""
    return c.rlike(r"^[+-]?(\.\d+|\d+(,\d\d\d)*(\.\d*)?)$") | ~c.rlike(r"[^\p{L}\p{N}]")


def held_values(number: Column, day: Column) -> Column:
    """The values of a cell: its number, then its date, each if there is one.

    Both are named several times here, so give columns that are computed already.
    """
    as_number, as_date = number_value(number), date_value(day)
    return (
        F.when(number.isNotNull() & day.isNotNull(), F.array(as_number, as_date))
        .when(number.isNotNull(), F.array(as_number))
        .when(day.isNotNull(), F.array(as_date))
        .otherwise(F.array().cast(f"array<{VALUE_TYPE}>"))
    )


def cell_values(c: Column) -> Column:
    """Values of a cell that holds one number or one date: numbers first, then dates.

    Stays in the JVM; cells with several values or running text need text_values.
    """
    return held_values(F.when(reads_as_number(c), parse_number(c)), parse_date(c))


_DIGITS, _WORDS = re.compile(r"\d+"), re.compile(r"[^\W_]+")
_DATE_REGEXES = [(re.compile(f"{shape}$"), order) for shape, order in DATE_SHAPES]
_DATE_WORD = re.compile(rf"(\d{{4}}s?|{_MONTH})$")
_MONTH_NUMBER = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])}
_WORD_NUMBER = {**NUMBER_WORDS, **ORDINAL_WORDS}


def _finite(text: str) -> float | None:
    """The number that a literal stands for, unless it is none or beyond all bounds."""
    try:
        value = float(text.replace(",", ""))
    except ValueError:
        return None
    return value if value < float("inf") else None


def _literals(text: str) -> Iterator[tuple[int, int, float]]:
    """Digit runs grown into numbers: groups of three after commas, a fraction, a sign after a blank.

    A walk over the runs from left to right. `free` is where the next number may start; digits
    that a group of three leaves over start a number of their own.
    """
    free = 0
    for run in _DIGITS.finditer(text):
        at, stop = max(run.start(), free), run.end()
        while at < stop:
            begin, end = at, stop
            if begin > free and text[begin - 1] == "." and begin == run.start():
                begin -= 1  # a bare fraction takes neither groups nor a further point
            else:
                while text[end : end + 1] == "," and (group := _DIGITS.match(text, end + 1, end + 4)) and group.end() == end + 4:
                    end += 4
                if text[end : end + 1] == ".":
                    fraction = _DIGITS.match(text, end + 1)
                    end = fraction.end() if fraction else end + 1
            if begin > free and text[begin - 1] in "+-" and (begin == 1 or begin - 2 >= free and text[begin - 2].isspace()):
                begin -= 1 if begin == 1 else 2
            value = _finite(text[begin:end])
            if value is not None:
                yield begin, end, value
            free = at = end


def _date_of(text):
    for regex, order in _DATE_REGEXES:
        hit = regex.match(text)
        if not hit:
            continue
        got = {p: _MONTH_NUMBER.get(g) or int(g) for p, g in zip(order, hit.groups())}
        try:
            whole = date(got.get("y", DEFAULT_YEAR), got.get("m", 1), got.get("d", 1))
        except ValueError:
            continue
        if MIN_YEAR <= whole.year <= MAX_YEAR:
            return got
    return None


def _candidates(text: str) -> Iterator[tuple[int, int, tuple]]:
    """Every span that reads as a number or a date, with its value: (kind, number, year, month, day).

    Numerals come from the digits, the rest from one walk over the words. The walk keeps the last
    words as possible starts of a date that ends at the current one, and asks for a date only
    where the stretch holds a year or a month.
    """
    numerals = set()
    for begin, end, value in _literals(text):
        numerals.add((begin, end))
        yield begin, end, (NUMBER, value, None, None, None)
    starts: deque[int] = deque(maxlen=MAX_DATE_WORDS)
    dated: deque[bool] = deque(maxlen=MAX_DATE_WORDS)
    for hit in _WORDS.finditer(text):
        (begin, end), word = hit.span(), hit.group()
        if (begin, end) not in numerals:
            value = _WORD_NUMBER.get(word)
            if value is None and word[0].isdigit():
                value = _finite(re.sub(ORDINAL_SUFFIX, "", word))
            if value is not None:
                yield begin, end, (NUMBER, float(value), None, None, None)
        starts.append(begin)
        dated.append(bool(_DATE_WORD.match(word.lower())))
        held = False
        for start, anchor in zip(reversed(starts), reversed(dated)):
            held = held or anchor
            parts = _date_of(text[start:end].lower()) if held else None
            if parts:
                yield start, end, (DATE, None, parts.get("y"), parts.get("m"), parts.get("d"))


def _value_spans(text):
    """Spans with their values, in text order; a span inside a longer one is dropped.

    A span lies in no other exactly if, by start and then by falling end, it ends behind all before it.
    """
    if text is None:
        return None
    values: dict[tuple[int, int], list[tuple]] = {}
    for begin, end, value in _candidates(text):
        values.setdefault((begin, end), []).append(value)
    kept, reached = [], -1
    for begin, end in sorted(values, key=lambda span: (span[0], -span[1])):
        if end > reached:
            kept.append((begin, end, values[begin, end]))
            reached = end
    return kept


def _spans_batch(texts: pd.Series) -> pd.Series:
    names = ("type", "f", "year", "month", "day")
    return texts.map(
        lambda t: None
        if t is None
        else [{"begin": b, "end": e, "values": [dict(zip(names, v)) for v in vs]} for b, e, vs in _value_spans(t)]
    )


def value_spans(c: Column) -> Column:
    """Numeric value spans of running text; longest spans win and nested ones are dropped."""
    return F.pandas_udf(_spans_batch, f"array<struct<begin:int,end:int,values:array<{VALUE_TYPE}>>>")(c)


def text_values(c: Column) -> Column:
    """All values of running text in order, as an array of numeric values."""
    return F.flatten(F.transform(value_spans(c), lambda s: s["values"]))


def sort_key(value: Column, use_year: Column, use_month: Column, use_day: Column) -> Column:
    """Comparable array of a numeric value, restricted to the date parts allowed by the flags."""
    blank = F.lit(None).cast("double")
    return F.when(value["type"] == NUMBER, F.array(value["f"])).otherwise(
        F.array(
            F.when(use_year, value["year"].cast("double")).otherwise(blank),
            F.when(use_month, value["month"].cast("double")).otherwise(blank),
            F.when(use_day, value["day"].cast("double")).otherwise(blank),
        )
    )


def format_number(c: Column) -> Column:
    """Integers bare, other numbers with two decimals."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(
        F.replace(F.format_number(c, 2), F.lit(","))
    )


def geometric_mean(c: Column) -> Column:
    """Aggregate: geometric mean of positive values."""
    return F.exp(F.avg(F.ln(c)))
