"""Types of objects: classification of lexical forms, canonical values, and decoding.

A lexical object is an integer, a real, a datetime or else a code (a name or plain string), by the
first expression that matches it.  Quotes and blanks around it don't count.  In dates, signs # stand for
an unknown part, taken as 1; what looks like a date but isn't one stays a code.
"""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED, CODE, INTEGER, REAL, DATETIME, STRING = range(6)
NAMES = ("undefined", "code", "integer", "real", "datetime", "string")
#: The forms of typed literals.
HEAD, TAIL = r'^[\s\t"]*', r'[\s\t"]*$'
INTEGER_FORM = r"-?[0-9]+"
REAL_FORM = r"-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?"
DATE_FORM = r"([0-9]+)(-|/)([0-9#]+)(-|/)([0-9#]+)(\s+([0-9]+):([0-9]+)(:([0-9]+))?)?"
#: Seconds from year 0 to 1970.
EPOCH = 62_167_219_200


def _bare(lexical: Column) -> Column:
    return F.regexp_replace(lexical, r'^[\s"]+|[\s"]+$', "")


def _date(lexical: Column) -> Column:
    """The timestamp of a lexical date, null if it is none."""
    part = lambda i: F.regexp_extract(lexical, HEAD + DATE_FORM + TAIL, i)
    day = lambda i: F.when(part(i).contains("#"), "1").otherwise(part(i))
    number = lambda c: F.expr("null").cast("string") if c is None else F.when(c == "", "0").otherwise(c)
    text = F.concat(F.lpad(part(1), 4, "0"), F.lit("-"), F.lpad(day(3), 2, "0"), F.lit("-"), F.lpad(day(5), 2, "0"), F.lit(" "), F.lpad(number(part(7)), 2, "0"), F.lit(":"), F.lpad(number(part(8)), 2, "0"), F.lit(":"), F.lpad(number(part(10)), 2, "0"))
    whole = F.length(part(1)) <= 4
    for i in (3, 5, 7, 8, 10):
        whole = whole & ((F.length(part(i)) <= 2) | part(i).contains("#"))
    return F.when(lexical.rlike(HEAD + DATE_FORM + TAIL) & whole, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def typed_columns(lexical: Column) -> dict[str, Column]:
    """oty, o (canonical), o_int, o_real, o_ts of a lexical object."""
    bare = _bare(lexical)
    whole = F.when(lexical.rlike(HEAD + INTEGER_FORM + TAIL), bare.try_cast("long"))
    real = F.when(lexical.rlike(HEAD + REAL_FORM + TAIL), bare.try_cast("double"))
    stamp = _date(lexical)
    kind = F.when(lexical.isNull(), UNDEFINED).when(whole.isNotNull(), INTEGER).when(real.isNotNull(), REAL).when(stamp.isNotNull(), DATETIME).otherwise(CODE)
    return {
        "oty": kind.cast("short"),
        "o": F.coalesce(whole.cast("string"), real.cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), lexical),
        "o_int": whole,
        "o_real": real,
        "o_ts": stamp,
    }


def decoded(oty: Column, o: Column, o_real: Column) -> Column:
    """The form shown to users: reals with at most four decimals, all else canonical."""
    short = F.regexp_replace(F.format_string("%.4f", o_real), r"(\.[0-9])0+$|(\.[0-9]*[1-9])0+$", "$1$2")
    return F.when(oty == REAL, short).otherwise(o)


def classify(value: Any) -> tuple[int, Any]:
    """(type, value) of a constant, by the rules for lexical objects."""
    if isinstance(value, bool):
        raise TypeError("no boolean objects")
    if isinstance(value, int):
        return INTEGER, value
    if isinstance(value, float):
        return REAL, value
    if isinstance(value, datetime.datetime):
        return DATETIME, value
    bare = re.sub(r'^[\s"]+|[\s"]+$', "", value)
    if re.fullmatch(INTEGER_FORM, bare, re.A) and -(2**63) <= int(bare) < 2**63:
        return INTEGER, int(bare)
    if re.fullmatch(REAL_FORM, bare, re.A):
        return REAL, float(bare)
    m = re.fullmatch(DATE_FORM, bare, re.A)
    if m and len(m[1]) <= 4 and all(len(m[i] or "") <= 2 or "#" in m[i] for i in (3, 5, 7, 8, 10)):
        try:
            month, day = (1 if "#" in m[i] else int(m[i]) for i in (3, 5))
            return DATETIME, datetime.datetime(int(m[1]), month, day, *(int(m[i] or 0) for i in (7, 8, 10)))
        except ValueError:
            pass
    return CODE, value


def constant(value: Any, kind: str | None = None) -> tuple[int, Any]:
    """classify, or the given type."""
    if kind is None:
        return classify(value)
    number = NAMES.index(kind)
    if number == INTEGER:
        return number, int(value)
    if number == REAL:
        return number, float(value)
    if number == DATETIME and isinstance(value, str):
        found = classify(value)
        if found[0] != DATETIME:
            raise ValueError(f"not a datetime: {value!r}")
        return found
    return number, value
