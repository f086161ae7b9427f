"""Column functions for lenient coercion, calendar keys and bounded arithmetic.

Missing values are NULL everywhere; NaN and the infinities become NULL where a
value enters the library, so that Spark aggregates skip them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the logistic base of the rate-cut probability (not e).
CUT_PROBABILITY_BASE = 2.71828
NULL_TOKEN = "__NULL__"


def finite(value: Column) -> Column:
    """NaN and the infinities become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def to_number(text: Column) -> Column:
    """Text to double; anything unreadable is NULL."""
    return finite(text.try_cast("double"))


def to_whole(text: Column) -> Column:
    return text.try_cast("bigint")


def to_day(text: Column) -> Column:
    return text.try_cast("date")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value, keeping NULL (greatest and least would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


# --- calendar -------------------------------------------------------------------------


def month_end(day: Column, lag: Column | int = 0) -> Column:
    """Last day of the month `lag` months after the month of `day`."""
    return F.last_day(F.add_months(F.trunc(day, "month"), lag))


def release_lag_months(text: Column, default: int = 1) -> Column:
    """Months in an ISO period such as P2M."""
    digits = F.regexp_extract(text, r"^P(\d+)M$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(default))


def epoch_millis_day(millis: Column) -> Column:
    """UTC day of an epoch-millisecond stamp, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86400000).cast("int"))


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_week_key(day: Column) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def iso_week_monday(key: Column) -> Column:
    """Monday of an ISO week key: 4 January always lies in week 01."""
    year = F.substring(key, 1, 4).cast("int")
    week = F.substring(key, 6, 2).cast("int")
    first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.date_add(first, (week - 1) * 7)


def monday_week_key(day: Column) -> Column:
    """Year and Monday-based week number; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string")
    return F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(week, 2, "0"))


def monday_week_thursday(key: Column) -> Column:
    """Thursday of a Monday-based week key."""
    year = F.substring(key, 1, 4).cast("int")
    week = F.substring(key, 6, 2).cast("int")
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    first_monday = F.date_add(new_year, (7 - F.weekday(new_year)) % 7)
    return F.date_add(first_monday, (week - 1) * 7 + 3)


def iso_week_thursday(key: Column) -> Column:
    return F.date_add(iso_week_monday(key), 3)


def partition_day(key: Column, kind: str) -> Column:
    """Comparable day of a partition key: day, ISO week (Monday) or month (first)."""
    if kind == "week":
        return iso_week_monday(key)
    if kind == "month":
        return F.concat(key, F.lit("-01")).cast("date")
    return key.cast("date")


# --- rates ----------------------------------------------------------------------------


def cut_probability(rate: Column, front: Column) -> Column:
    exponent = (rate - front) * 100
    return 1 / (1 + F.pow(F.lit(CUT_PROBABILITY_BASE), exponent))


# --- names ----------------------------------------------------------------------------


def contract_tag(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("_net"), F.lit("")), F.lit(" "), F.lit("_"))


def instrument_tag(name: Column) -> Column:
    return F.replace(name, F.lit("_price"), F.lit(""))


def prefixed(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), name)


# --- row text -------------------------------------------------------------------------


def canonical_text(schema: T.StructType, columns: Sequence[str]) -> Column:
    """One text per row: NULL token, 12 significant digits, ISO dates.

    A text field is preceded by its length, so that no two different rows share a text,
    whatever commas or NULL tokens their fields hold.
    """
    parts = []
    for name in columns:
        kind = schema[name].dataType
        value = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            text = F.format_string("%.11e", value.cast("double"))
            text = F.when(value.isNotNull(), text)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(kind, T.StringType):
            text = F.concat(F.char_length(value), F.lit(":"), value)
        else:
            text = value.cast("string")
        parts.append(F.coalesce(text, F.lit(NULL_TOKEN)))
    return F.concat_ws(",", *parts)


def hex_lane(digest: Column, start: int) -> Column:
    """Fifteen hex digits of a digest as a whole number (60 bits)."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")
