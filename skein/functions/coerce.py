"""Tolerant type coercion of text values (numbers, booleans, dates) and ISO output formatting.

Every function is a pure Column expression, so coercion stays inside whole-stage codegen and
never leaves the JVM. ANSI mode is on in Spark 4, hence ``try_*`` everywhere: a value that does
not parse becomes null instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings accepted for booleans and the date shapes accepted on input.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
# Words a *sample* must use to be inferred as boolean (codify); single letters and digits are
# accepted only when a field is declared boolean.
INFER_TRUE_WORDS = ["true"]
INFER_FALSE_WORDS = ["false"]

# two-digit years from this value on belong to the previous century
YY_PIVOT = 2050

_ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _numeric_text(c: Column) -> Column:
    """Trim and drop thousands separators: ``" 1,000,000"`` -> ``1000000`` (a character
    deletion, not a regex)."""
    return F.translate(_text(c), ",", "")


# Shapes checked before casting. Under ANSI mode a failing try_cast raises and catches an
# exception per row, which is ~50x slower than a regex test, so text that cannot parse must
# never reach the cast.
_INT_TEXT = r"^[+-]?0*\d{1,19}$"
_WHOLE_DECIMAL_TEXT = r"^[+-]?0*\d{1,19}\.0*$"
_NUM_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_integer(c: Column) -> Column:
    """``"1,000,000"`` -> 1000000, ``"+19"`` -> 19, ``" 789"`` -> 789; a whole-valued decimal
    text (``"3.0"``) is accepted, anything else is null."""
    s = _numeric_text(c)
    return (F.when(s.rlike(_INT_TEXT), s.try_cast("bigint"))
            .when(s.rlike(_WHOLE_DECIMAL_TEXT), F.regexp_extract(s, r"^([+-]?\d+)", 1).try_cast("bigint")))


def to_number(c: Column) -> Column:
    """``"4,000.3"`` -> 4000.3; non-numbers are null."""
    s = _numeric_text(c)
    return F.when(s.rlike(_NUM_TEXT), s.try_cast("double"))


def to_boolean(c: Column, true_words=None, false_words=None) -> Column:
    s = F.lower(_text(c))
    tw = true_words or TRUE_WORDS
    fw = false_words or FALSE_WORDS
    return F.when(s.isin(tw), F.lit(True)).when(s.isin(fw), F.lit(False))


def to_timestamp(c: Column) -> Column:
    """Parse the accepted date shapes to a timestamp.

    ISO date-only values are UTC midnight; ISO values with ``Z`` or an offset are that instant;
    every other shape (no zone given) is midnight / wall clock in the session time zone.
    Month comes first in the numeric short forms (``10-08-18`` is October 8).
    """
    s = _text(c)
    # every accepted shape starts with a digit: one cheap test rejects most non-dates
    return F.when(s.rlike(r"^\d"), _parse_date_shapes(s))


def _two_digit_year(ts: Column) -> Column:
    """Two-digit years 50-99 are 1950-1999 and 00-49 are 2000-2049 (the pattern ``yy`` alone
    would put every one in 20xx). Measured faster than rewriting the text before parsing."""
    return F.when(F.year(ts) >= YY_PIVOT, ts - F.expr("INTERVAL 100 YEARS")).otherwise(ts)


# what a character class string of a date looks like (digits 9, letters A) -> parser; fixed values
_SHAPES = {
    "us4": ("9/9/9999", "99/9/9999", "9/99/9999", "99/99/9999"),
    "us2": ("9/9/99", "99/9/99", "9/99/99", "99/99/99", "9-9-99", "99-9-99", "9-99-99", "99-99-99"),
    "mon2": ("9-AAA-99", "99-AAA-99"),
    "mon4": ("9-AAA-9999", "99-AAA-9999"),
    "mon2t": ("9-AAA-99 9:99:99", "99-AAA-99 9:99:99", "9-AAA-99 99:99:99", "99-AAA-99 99:99:99"),
}
_FROM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = "9" * 10 + "A" * 52


def _parse_date_shapes(s: Column) -> Column:
    """The shape is computed once, by one character translation, and compared as a whole; only the
    parser of that shape then runs."""
    shape = F.translate(F.substring(s, 1, 40), _FROM, _TO)

    def parse(x: Column, kind: Column) -> Column:
        return (
            F.when(kind.isin(*_SHAPES["us2"]), _two_digit_year(F.try_to_timestamp(F.translate(x, "-", "/"), F.lit("M/d/yy"))))
            .when(kind.isin(*_SHAPES["us4"]), F.try_to_timestamp(x, F.lit("M/d/yyyy")))
            .when(kind == "9999-99-99", F.try_to_timestamp(F.concat(x, F.lit("T00:00:00Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
            .when(kind.isin(*_SHAPES["mon2"]), _two_digit_year(F.try_to_timestamp(F.initcap(x), F.lit("d-MMM-yy"))))
            .when(kind.isin(*_SHAPES["mon4"]), F.try_to_timestamp(F.initcap(x), F.lit("d-MMM-yyyy")))
            .when(kind.isin(*_SHAPES["mon2t"]), _two_digit_year(F.try_to_timestamp(F.initcap(x), F.lit("d-MMM-yy H:mm:ss"))))
            .when((F.substring(kind, 1, 10) == "9999-99-99") & x.rlike(_ISO_DATETIME), x.try_cast("timestamp"))
        )

    return parse(s, shape)


def missing_to_null(c: Column, token: str | None) -> Column:
    """Whole-cell missing-value token (``*``) becomes null; ``big data*`` is kept."""
    if token is None:
        return c
    return F.when(F.trim(c.cast("string")) == F.lit(token), F.lit(None)).otherwise(c)


# --- output formatting --------------------------------------------------------------------

def utc_wall_clock(ts: Column) -> Column:
    """The UTC wall clock of an instant as ``timestamp_ntz``, independent of session zone and DST."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=(F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)"))


def iso_utc(ts: Column) -> Column:
    """``2018-10-10T19:13:30.000Z`` -- ISO-8601, milliseconds, UTC."""
    return F.date_format(utc_wall_clock(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_utc_short(ts: Column) -> Column:
    """As :func:`iso_utc`, but an instant at UTC midnight prints as the date alone (CSV form)."""
    w = utc_wall_clock(ts)
    return F.when(w == F.date_trunc("day", w), F.date_format(w, "yyyy-MM-dd")).otherwise(
        F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def number_text(c: Column) -> Column:
    """Doubles print without a trailing ``.0`` when whole (``1.0`` -> ``1``) and without exponent
    (``12345678.5``, not ``1.23456785E7``) while 17 digits show them; beyond that as Spark prints them."""
    plain = F.abs(c) < F.lit(1e15)
    whole = F.when(plain & (c == F.floor(c)), c.cast("decimal(20,0)").cast("string"))
    small = plain & (F.abs(c) >= F.lit(1e-3))
    return F.coalesce(whole, F.when(small & F.contains(c.cast("string"), F.lit("E")),
                                    F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"0+$", "")), c.cast("string"))
