"""Scaled decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(units: Column, scale: Column) -> Column:
    return F.struct(units.cast("bigint").alias("int"), scale.cast("int").alias("scale"))


def as_double(decimal: Column) -> Column:
    """``int / 10^scale``."""
    return decimal["int"] / F.pow(F.lit(10.0), decimal["scale"])


# Zeros that an exponent adds at most: no number with more digits fits 64 bits.
MOST_ZEROS = 60


def without_exponent(text: Column) -> Column:
    """Digits moved past the point as the exponent says; other texts come back as they are."""
    form = r"\A([+-]?)(\d*)\.?(\d*)[eE]([+-]?\d{1,6})\z"

    def moved(t: Column) -> Column:
        sign, whole, part, exponent = (F.regexp_extract(t, form, g) for g in (1, 2, 3, 4))
        digits = F.concat(whole, part)
        point = F.length(whole) + exponent.cast("int")
        zeros = lambda n: F.repeat(F.lit("0"), F.least(n, F.lit(MOST_ZEROS)))
        text = (
            F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
            .when(point >= F.length(digits), F.concat(digits, zeros(point - F.length(digits))))
            .otherwise(F.concat_ws(".", F.substring(digits, F.lit(1), point), F.substring(digits, point + 1, F.length(digits))))
        )
        return F.when((digits != "") & t.rlike(form), F.concat(sign, text)).otherwise(t)

    # In a lambda the text is one variable, and the long expression stays out of generated code.
    return F.transform(F.array(text), moved)[0]


def to_units(text: Column, scale: Column) -> Column:
    """Decimal text as an integer of ``10^-scale`` units, cut toward zero; null if unreadable.

    Works on the digits, also with an exponent, so no digit is rounded away before the cut.
    """
    plain = F.trim(text)
    plain = F.when(plain.rlike("[eE]"), without_exponent(plain)).otherwise(plain)
    form = r"\A([+-]?)(\d*)(?:\.(\d*))?\z"
    sign, whole, part = (F.regexp_extract(plain, form, g) for g in (1, 2, 3))
    digits = F.concat(whole, F.rpad(F.substring(part, F.lit(1), scale), scale, F.lit("0")))
    units = F.when(plain.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)\z"), digits.try_cast("bigint"))
    return F.when(sign == "-", -units).otherwise(units)


def seconds_to_ns(seconds: Column) -> Column:
    """Epoch seconds in a double, rounded half-even to five decimals, as nanoseconds.

    The binary value decides ties, not its shortest decimal text. From 1970-01-13 on, a
    double's fraction is a whole number of 2^-32 seconds, so integers carry it exactly; earlier
    times with a finer fraction give null.
    """
    whole = F.floor(seconds)
    fine = (seconds - whole) * F.lit(float(1 << 32))
    units = F.when(fine == F.floor(fine), fine.cast("bigint")) * F.lit(100_000)
    half = F.lit(1 << 31)
    quotient = F.shiftright(units, 32)
    rest = units - F.shiftleft(quotient, 32)
    up = (rest > half) | ((rest == half) & (F.pmod(quotient, F.lit(2)) == 1))
    return whole * F.lit(10**9) + (quotient + up.cast("bigint")) * F.lit(10_000)
