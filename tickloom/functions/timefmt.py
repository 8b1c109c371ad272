"""Times, calendar units and periods: on the driver for arguments, as columns for data.

Column functions take ``time_ns`` (nanoseconds since 1970, UTC) and assume a UTC session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.pin import pin

NS = 10**9
YEARS = (1900, 2100)

# Period forms, in order: year, quarter, month, day. Fixed values.
YEAR_FORM = r"(\d{4})"
QUARTER_FORM = r"(\d{4})[Qq](\d)"
MONTH_FORM = r"(\d{4})-(\d{1,2})"
DAY_FORM = r"(\d{4})-(\d{1,2})-(\d{1,2})"


# Times told to the year, month, day, hour and minute.
TOLD = ("%Y", "%Y-%m", "%Y-%m-%d", "%Y-%m-%dT%H", "%Y-%m-%dT%H:%M")


# -- arguments -------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    """Half-open time range ``[start, end)`` in UTC."""

    start: pd.Timestamp
    end: pd.Timestamp

    def __str__(self) -> str:
        return f"{short_text(self.start)}/{short_text(self.end)}"


def instant(value: pd.Timestamp | str | int) -> pd.Timestamp:
    """A UTC timestamp from a timestamp, an ISO text (``Z`` allowed) or epoch nanoseconds.

    >>> instant("2022-08-09T10Z")
    Timestamp('2022-08-09 10:00:00+0000', tz='UTC')
    >>> instant(1_000_000_000_000_000_000)
    Timestamp('2001-09-09 01:46:40+0000', tz='UTC')
    """
    if isinstance(value, str):
        value = value.replace("Z", "")
    stamp = pd.Timestamp(value)
    return stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")


def short_text(stamp: pd.Timestamp) -> str:
    """ISO text without its zero tail.

    >>> short_text(instant("2022-08-09 10:00"))
    '2022-08-09T10Z'
    >>> short_text(instant("2019-01-01"))
    '2019Z'
    """
    if stamp.second or stamp.microsecond or stamp.nanosecond:
        return stamp.tz_localize(None).isoformat() + "Z"
    lowest = (1, 1, 0, 0)
    fields = (stamp.month, stamp.day, stamp.hour, stamp.minute)
    told = max((k for k, field in enumerate(fields, 1) if field != lowest[k - 1]), default=0)
    return stamp.strftime(TOLD[told]) + "Z"


def _unit_span(text: str) -> Span | None:
    for form, unit in (
        (YEAR_FORM, pd.DateOffset(years=1)),
        (QUARTER_FORM, pd.DateOffset(months=3)),
        (MONTH_FORM, pd.DateOffset(months=1)),
        (DAY_FORM, pd.DateOffset(days=1)),
    ):
        if re.fullmatch(form, text):
            start = instant(text)
            return Span(start, start + unit)
    return None


def period(value: Span | str) -> Span:
    """``2020``, ``2020Q3``, ``2020-11``, ``2020-11-02`` or ``a/b``.

    The right end of ``a/b`` includes its calendar unit; a full timestamp there is exact.

    >>> str(period("2019Q2"))
    '2019-04Z/2019-07Z'
    >>> str(period("2022-02-27/2022-02-28"))
    '2022-02-27Z/2022-03Z'
    """
    if isinstance(value, Span):
        return value
    left, slash, right = value.partition("/")
    first = _unit_span(left)
    if not slash:
        if first is None:
            raise ValueError(f"Unknown period format: {value!r}")
        return first
    last = _unit_span(right)
    return Span(first.start if first else instant(left), last.end if last else instant(right))


# -- columns ---------------------------------------------------------------------------


def whole(number: Column, by: int) -> Column:
    """Integer division; ``/`` would go through a double."""
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def to_time(time_ns: Column) -> Column:
    """TIMESTAMP of a nanosecond count (the part below a microsecond is cut)."""
    return F.timestamp_micros(whole(time_ns - F.pmod(time_ns, F.lit(1000)), 1000))


def day_of(time_ns: Column) -> Column:
    """UTC calendar day, also right before 1970."""
    return F.to_date(to_time(time_ns))


def iso_short(time_ns: Column) -> Column:
    """Column form of :func:`short_text`."""
    below = F.pmod(time_ns, F.lit(NS))
    nine = F.lpad(below.cast("string"), 9, "0")
    part = (
        F.when(below == 0, F.lit(""))
        .when(F.pmod(below, F.lit(1000)) == 0, F.concat(F.lit("."), F.substring(nine, 1, 6)))
        .otherwise(F.concat(F.lit("."), nine))
    )
    time = to_time(time_ns)
    text = (
        F.when(below + F.second(time) != 0, F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), part))
        .when(F.minute(time) != 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm"))
        .when(F.hour(time) != 0, F.date_format(time, "yyyy-MM-dd'T'HH"))
        .when(F.dayofmonth(time) != 1, F.date_format(time, "yyyy-MM-dd"))
        .when(F.month(time) != 1, F.date_format(time, "yyyy-MM"))
        .otherwise(F.date_format(time, "yyyy"))
    )
    return F.concat(text, F.lit("Z"))


def iso_full(time_ns: Column) -> Column:
    """ISO text with nine decimals."""
    return F.concat(
        F.date_format(to_time(time_ns), "yyyy-MM-dd'T'HH:mm:ss."),
        F.lpad(F.pmod(time_ns, F.lit(NS)).cast("string"), 9, "0"),
        F.lit("Z"),
    )


def is_unit(start_ns: Column, end_ns: Column, unit: str) -> Column:
    """Is ``[start, end)`` exactly one calendar ``year``, ``month`` or ``day``?"""
    step = {
        "year": F.expr("interval 1 year"),
        "month": F.expr("interval 1 month"),
        "day": F.expr("interval 1 day"),
    }[unit]
    start, end = to_time(start_ns), to_time(end_ns)
    exact = (F.pmod(start_ns, F.lit(1000)) == 0) & (F.pmod(end_ns, F.lit(1000)) == 0)
    return exact & (F.date_trunc(unit, start) == start) & (end == start + step)


def span_text(start_ns: Column, end_ns: Column, short: bool = True) -> Column:
    """``2020``, ``2020-03`` or ``2020-03-24`` for one calendar unit, else both full texts."""
    both = F.concat_ws("/", iso_full(start_ns), iso_full(end_ns))
    if not short:
        return both
    start = to_time(start_ns)
    return (
        F.when(is_unit(start_ns, end_ns, "year"), F.date_format(start, "yyyy"))
        .when(is_unit(start_ns, end_ns, "month"), F.date_format(start, "yyyy-MM"))
        .when(is_unit(start_ns, end_ns, "day"), F.date_format(start, "yyyy-MM-dd"))
        .otherwise(both)
    )


# ISO text, cut off after any part. Fixed value.
ISO_FORM = (
    r"\A\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?)?)?)?\z"
)


def parse_time(text: Column) -> Column:
    """TIMESTAMP of an ISO text or a quarter, cut-off tails and ``Z`` allowed; null if unreadable."""
    bare = F.replace(text, F.lit("Z"), F.lit(""))
    month = F.substring(bare, 6, 1).try_cast("int") * 3 - 2
    return F.coalesce(
        F.when(
            bare.rlike(rf"\A{QUARTER_FORM}\z"),
            F.concat(F.substring(bare, 1, 4), F.lit("-"), month.cast("string")),
        ),
        F.when(bare.rlike(r"[T ]\d{1,2}\z"), F.concat(bare, F.lit(":00"))),
        F.when(bare.rlike(ISO_FORM), bare),
    ).try_cast("timestamp")


def _after(text: Column, start: Column) -> Column:
    """End of the calendar unit a text names; its time if it names none."""
    return F.coalesce(
        *[
            F.when(text.rlike(rf"\A{form}\z"), start + F.expr(f"interval {step}"))
            for form, step in (
                (YEAR_FORM, "1 year"),
                (QUARTER_FORM, "3 months"),
                (MONTH_FORM, "1 month"),
                (DAY_FORM, "1 day"),
            )
        ],
        start,
    )


def periods(rows: DataFrame, text: str) -> DataFrame:
    """Add ``start`` and ``end`` TIMESTAMP of a period text, null if unreadable."""
    left = F.substring_index(text, "/", 1)
    right = F.substring_index(text, "/", -1)
    parts = pin(rows, _left=left, _right=right)
    times = pin(
        parts, start=parse_time(F.col("_left")), _last=parse_time(F.col("_right"))
    )
    end = _after(F.col("_right"), F.col("_last"))
    # Without a slash both sides are the same text, and it must name a unit.
    good = F.contains(F.col(text), F.lit("/")) | (end > F.col("_last"))
    whole = good & F.col("start").isNotNull() & end.isNotNull()
    return times.select(
        *rows.columns,
        F.when(whole, F.col("start")).alias("start"),
        F.when(whole, end).alias("end"),
    )


def year_in_range(year: Column) -> Column:
    return year.between(*YEARS)


def calendar_text(time_ns: Column, unit: str) -> Column:
    """``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``; null outside the years 1900 to 2100."""
    form = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit]
    time = to_time(time_ns)
    return F.when(year_in_range(F.year(time)), F.date_format(time, form))


def calendar_parts(text: Column) -> Column:
    """Year, month and day of an ISO calendar text; null if malformed or out of range."""
    first = F.when(text.rlike(r"\A\d{4}(-\d{2}(-\d{2})?)?\z"), text).try_cast("date")
    size = F.length(text)
    return F.when(
        first.isNotNull() & year_in_range(F.year(first)),
        F.struct(
            F.year(first).alias("year"),
            F.when(size >= 7, F.month(first)).alias("month"),
            F.when(size == 10, F.day(first)).alias("day"),
        ),
    )
