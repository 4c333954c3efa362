"""What a string looks like: date, timestamp, datetime, integer, float, boolean, in that order, or string.

Each test exists as a column expression and as a Python function; both follow the same patterns (fixed values: they
decide which strings count).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, DAY = r"(?:[0-9]{4}|\+[0-9]{3}|-000)", r"(?:0[1-9]|1[0-2]|\+[1-9])", r"(?:0[1-9]|[12][0-9]|3[01]|\+[1-9])"
HOUR, SIXTY = r"(?:[01][0-9]|2[0-3]|\+[0-9]|-0)", r"(?:[0-5][0-9]|\+[0-9]|-0)"
DATE = rf"{YEAR}-{MONTH}-{DAY}"
#: Whatever follows the seconds does not matter.
DATETIME = rf"{DATE}[T ]{HOUR}:{SIXTY}:{SIXTY}"
TIMESTAMP = r"([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.,][0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-4]):(?:[0-5][0-9]|60))"
INTEGER = r"[+-]?[0-9]+"
DIGITS = r"[0-9]+(?:_[0-9]+)*"
DECIMAL = rf"[+-]?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?"
HEX = r"[+-]?0[xX]_?(?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?[0-9]+"
NAMED = r"(?i:[+-]?inf(?:inity)?|nan)"
BOOLEANS = ("true", "false", "1", "0", "t", "f")

INT64 = (-(2**63), 2**63 - 1)
TOKENS = ("DATE", "TIMESTAMP", "DATETIME", "INTEGER", "FLOAT", "BOOLEAN", "STRING")

_date, _datetime, _timestamp = re.compile(DATE), re.compile(DATETIME), re.compile(TIMESTAMP)
_integer, _decimal, _hex, _named = re.compile(INTEGER), re.compile(DECIMAL), re.compile(HEX), re.compile(NAMED)


def _days(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def token_of(s: str) -> str:
    if _date.fullmatch(s):
        return "DATE"
    if (m := _timestamp.fullmatch(s)) and int(m[3]) <= _days(int(m[1]), int(m[2])):
        return "TIMESTAMP"
    if _datetime.match(s):
        return "DATETIME"
    if _integer.fullmatch(s) and (len(s) < 19 or INT64[0] <= int(s) <= INT64[1]):
        return "INTEGER"
    if _named.fullmatch(s) or _hex.fullmatch(s) or (_decimal.fullmatch(s) and abs(float(s)) != float("inf")):
        return "FLOAT"
    return "BOOLEAN" if s.lower() in BOOLEANS else "STRING"


def _whole(col: Column, pattern: str) -> Column:
    return col.rlike(rf"\A(?:{pattern})\z")


def is_date(col: Column) -> Column:
    return _whole(col, DATE)


def is_datetime(col: Column) -> Column:
    return col.rlike(rf"\A{DATETIME}")


def is_timestamp(col: Column) -> Column:
    """As RFC 3339 with a zone, `T` or a space in the middle, on a day that the calendar has."""
    part = lambda k: F.try_element_at(F.split(F.substring(col, 1, 10), "-"), F.lit(k)).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(_whole(col, TIMESTAMP), F.coalesce(day <= last, F.lit(False))).otherwise(False)


def is_integer(col: Column) -> Column:
    return F.when(_whole(col, INTEGER), F.regexp_replace(col, "^\\+", "").try_cast("bigint").isNotNull()).otherwise(False)


def is_float(col: Column) -> Column:
    number = F.regexp_replace(col, "_", "").try_cast("double")
    fits = F.coalesce(F.abs(number) != float("inf"), F.lit(False))
    return _whole(col, NAMED) | _whole(col, HEX) | F.when(_whole(col, DECIMAL), fits).otherwise(False)


def is_boolean(col: Column) -> Column:
    return F.lower(col).isin(*BOOLEANS)


def classify(col: Column) -> Column:
    """The token of a string column; null for null."""
    tests = (is_date, is_timestamp, is_datetime, is_integer, is_float, is_boolean)
    cases = reduce(lambda c, t: c.when(t[0](col), t[1]), zip(tests[1:], TOKENS[1:], strict=False), F.when(tests[0](col), TOKENS[0]))
    return F.when(col.isNotNull(), cases.otherwise("STRING"))
