"""Date functions on columns of text.

Texts are `YYYY-MM-DD`, or a date and a time after a space or a `T`, with or without seconds; times after
a `T` may have a fraction. What arithmetic gives has the precision of its input. Times have no zone
and count as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.errors import FunctionError

_SHAPE = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2})?|T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
DATE, DATE_TIME = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
# strftime's letters as patterns of Spark.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD",
    "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "f": "SSSSSSSSS", "Z": "'UTC'",
}
UNITS = ("year", "month", "day", "hour", "minute", "second")


def java_pattern(strftime: str) -> str:
    out, text, i = [], "", 0

    def literal() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'")
            text = ""

    while i < len(strftime):
        c = strftime[i]
        if c == "%":
            i += 1
            letter = strftime[i : i + 1]
            if letter in ("%", "n", "t"):
                text += {"%": "%", "n": "\n", "t": "\t"}[letter]
            elif letter in STRFTIME:
                literal()
                out.append(STRFTIME[letter])
            else:
                raise FunctionError(f"unknown date pattern %{letter} in {strftime!r}")
        else:
            text += c
        i += 1
    literal()
    return "".join(out)


def _unit(unit: str) -> str:
    name = unit[:-1] if unit.endswith("s") else unit
    if name not in UNITS:
        raise FunctionError(f"unknown unit {unit!r}")
    return name


def parsed(v: Column) -> Column:
    """The moment of a text, without a zone; an error if it isn't a date."""
    moment = F.when(v.rlike(_SHAPE), v.try_cast("timestamp_ntz"))
    return F.when(v.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(moment, F.raise_error(F.concat(F.lit("not a date: "), v)).cast("timestamp_ntz")))


def _timed(v: Column) -> Column:
    return F.char_length(v) > 10


def _as(v: Column, moment: Column) -> Column:
    return F.when(_timed(v), F.date_format(moment, DATE_TIME)).otherwise(F.date_format(moment, DATE))


def now(pattern: str = "%Y-%m-%d") -> Column:
    return F.date_format(F.localtimestamp(), java_pattern(pattern))


def today() -> Column:
    return F.date_format(F.current_date(), DATE)


def tomorrow() -> Column:
    return F.date_format(F.date_add(F.current_date(), 1), DATE)


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), DATE)


def from_timestamp(seconds: Column, pattern: str = "%Y-%m-%d") -> Column:
    moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.date_format(moment, java_pattern(pattern))


def date_format(v: Column, pattern: str) -> Column:
    return F.date_format(parsed(v), java_pattern(pattern))


def timestamp(v: Column) -> Column:
    """Seconds since 1970."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), parsed(v))


def date_add(v: Column, n: int, unit: str = "days") -> Column:
    return _as(v, F.timestamp_add(_unit(unit).upper(), F.lit(n), parsed(v)))


def date_sub(v: Column, n: int, unit: str = "days") -> Column:
    return date_add(v, -n, unit)


def _whole(n: int) -> int:
    if n < 0:
        raise FunctionError(f"not a count: {n}")
    return n


def add_days(v: Column, n: int) -> Column:
    return date_add(v, _whole(n), "days")


def sub_days(v: Column, n: int) -> Column:
    return date_add(v, -_whole(n), "days")


def add_months(v: Column, n: int) -> Column:
    return date_add(v, _whole(n), "months")


def sub_months(v: Column, n: int) -> Column:
    return date_add(v, -_whole(n), "months")


def add_years(v: Column, n: int) -> Column:
    return date_add(v, _whole(n), "years")


def sub_years(v: Column, n: int) -> Column:
    return date_add(v, -_whole(n), "years")


def start_of_month(v: Column) -> Column:
    """The first of the month at the same time of day."""
    m = parsed(v)
    return _as(v, F.timestamp_add("DAY", 1 - F.dayofmonth(m), m))


def end_of_month(v: Column) -> Column:
    m = parsed(v)
    return _as(v, F.timestamp_add("DAY", F.dayofmonth(F.last_day(m)) - F.dayofmonth(m), m))


def weekday(v: Column) -> Column:
    """Monday is 0."""
    return F.weekday(parsed(v))


def date_diff(v: Column, other: Column, unit: str = "days", whole: bool | None = None) -> Column:
    """From v to `other`, in a unit: positive where `other` is later.

    Whole calendar years and months, whatever the time of day. Of the other units: with `whole`, units that are complete, as
    a long; without it (False) the exact number, as a double. A column has one type, so by default (None) it
    is a double that is exact where both texts have a time and whole where one has none.
    """
    a, b, name = parsed(v), parsed(other), _unit(unit)
    if name in ("year", "month"):
        return F.timestamp_diff(name.upper(), F.date_trunc("DAY", a).cast("timestamp_ntz"), F.date_trunc("DAY", b).cast("timestamp_ntz"))
    seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[name]
    exact = F.timestamp_diff("MICROSECOND", a, b) / 1_000_000 / seconds
    complete = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
    if whole is not None:
        return complete if whole else exact
    return F.when(_timed(v) & _timed(other), exact).otherwise(complete.cast("double"))


def _utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def is_past(v: Column) -> Column:
    return parsed(v) < _utc_now()


def is_future(v: Column) -> Column:
    return parsed(v) > _utc_now()


def is_leap_year(v: Column) -> Column:
    """Of a year as a number or a date as text."""
    year = F.when(v.cast("string").rlike(r"^-?\d{1,6}$"), v.cast("string").try_cast("int")).otherwise(F.year(parsed(v.cast("string"))))
    return (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
