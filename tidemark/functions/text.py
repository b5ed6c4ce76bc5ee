"""Number text and trimming in the forms the change rows use."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space at either end of a text.
_SPACE = r"[\s\x{0085}\p{Z}]+"


def trim_space(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_SPACE}|{_SPACE}$", "")


def _digits(value: Column) -> tuple[Column, Column, Column]:
    """Sign, digits without zeros at the ends, and decimal exponent of the first digit.

    Taken from Spark's shortest text, which is plain or has the form ``1.5E-7``.
    """
    text = value.cast("double").cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    body = F.split(F.regexp_replace(text, "^-", ""), "E")
    mantissa, power = F.get(body, F.lit(0)), F.coalesce(F.try_element_at(body, F.lit(2)).cast("int"), F.lit(0))
    whole, rest = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    every = F.concat(whole, rest)
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    return sign, digits, F.length(whole) - 1 - lead + power


def _number(value: Column, low: int, high: int) -> Column:
    """Plain digits where the exponent is in [low, high), else the form ``1.5e+06``."""
    sign, digits, power = _digits(value)
    size = F.length(digits)
    fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), power + 1 - size))
    middle = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size))
    plain = F.when(power < 0, fraction).when(size <= power + 1, whole).otherwise(middle)
    tail = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
    short = F.concat(
        F.substring(digits, F.lit(1), F.lit(1)), tail, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    number = value.cast("double")
    text = F.when((power >= low) & (power < high), plain).otherwise(short)
    return (
        F.when(F.isnan(number), "NaN").when(number == float("inf"), "+Inf").when(number == float("-inf"), "-Inf")
        .when(number == 0, F.when(F.startswith(number.cast("string"), F.lit("-")), "-0").otherwise("0"))
        .when(number.isNotNull(), F.concat(sign, text))
    )


def _fast(value: Column, low: float, high: float, other: Column) -> Column:
    """Spark's own text where it is plain, as it is for nearly all numbers."""
    number = value.cast("double")
    plain = (number == 0) | ((F.abs(number) >= low) & (F.abs(number) < high))
    return F.when(plain, F.regexp_replace(number.cast("string"), r"\.0$", "")).otherwise(other)


def general_number(value: Column) -> Column:
    """The shortest text of a double, with an exponent from a million on and below 0.0001."""
    return _fast(value, 1e-3, 1e6, _number(value, -4, 6))


def json_number(value: Column) -> Column:
    """The JSON form: an exponent from 1e21 on and below 1e-6, with no zero in front of one digit."""
    return _fast(value, 1e-3, 1e7, F.regexp_replace(_number(value, -6, 21), "e-0", "e-"))


def general_text(number: float) -> str:
    """What :func:`general_number` gives for a number that is known when the plan is made."""
    number = float(number)
    if math.isnan(number):
        return "NaN"
    if math.isinf(number):
        return "+Inf" if number > 0 else "-Inf"
    sign = "-" if math.copysign(1, number) < 0 else ""
    _, digits, exponent = Decimal(repr(abs(number))).normalize().as_tuple()
    text = "".join(map(str, digits))
    power = len(text) + exponent - 1
    if number == 0:
        return f"{sign}0"
    if not -4 <= power < 6:
        tail = f".{text[1:]}" if len(text) > 1 else ""
        return f"{sign}{text[0]}{tail}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{text}"
    whole, rest = text[:power + 1].ljust(power + 1, "0"), text[power + 1:]
    return f"{sign}{whole}.{rest}" if rest else f"{sign}{whole}"
