"""Number handling: raw text to numbers, whole-number codes, number text."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in raw text (rules out '1f', 'NaN', 'inf').
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

_LARGEST = 1.7976931348623157e308


def finite(name: str) -> str:
    """SQL of a numeric column as DOUBLE; NaN and the infinities become NULL."""
    number = f"CAST(`{name}` AS DOUBLE)"
    return f"CASE WHEN abs({number}) <= {_LARGEST!r}D THEN {number} END"


def to_number(name: str) -> str:
    """SQL of a text column as DOUBLE; anything that is not a finite number is NULL."""
    number = f"try_cast(`{name}` AS DOUBLE)"
    return f"CASE WHEN `{name}` RLIKE r'{NUMBER_PATTERN}' AND abs({number}) <= {_LARGEST!r}D THEN {number} END"


def infinite(name: str, text: bool) -> str:
    """SQL of the infinity a column holds, as a word or beyond the largest DOUBLE; NULL for everything else."""
    number = f"try_cast(`{name}` AS DOUBLE)" if text else f"CAST(`{name}` AS DOUBLE)"
    if not text:
        return f"CASE WHEN abs({number}) > {_LARGEST!r}D AND NOT isnan({number}) THEN {number} END"
    word = f"trim(`{name}`) RLIKE '(?i)^[+-]?inf(inity)?$'"
    signed = f"IF(startswith(trim(`{name}`), '-'), -double('Infinity'), double('Infinity'))"
    return f"CASE WHEN {word} OR (`{name}` RLIKE r'{NUMBER_PATTERN}' AND abs({number}) > {_LARGEST!r}D) THEN {signed} END"


def filled(template: str, **parts: Column) -> Column:
    """A template's text with columns in place of its ``{names}``."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def is_whole(value: Column) -> Column:
    return value == F.floor(value)


def whole_code(value: Column) -> Column:
    """The integer code, or NULL when the value is not a whole number."""
    return F.when(is_whole(value), value.cast("int"))


def _wide_text(size: Column, decimals: int) -> Column:
    """Text of 1e15 and more, up to 9e18: such numbers have eighths at most, so both parts are exact."""
    whole, scale = F.floor(size).cast("bigint"), 10**decimals
    units = F.rint((size - F.floor(size)) * float(scale)).cast("bigint")  # half-even
    digits = F.lpad((units % scale).cast("string"), max(decimals, 1), "0")
    text = (whole + F.floor(units / scale).cast("bigint")).cast("string")
    return F.concat(text, F.lit("."), digits) if decimals else text


def fixed_text(value: Column, decimals: int) -> Column:
    """Decimal text of a double's exact value with half-even rounding, no separators.

    Two cases need help. Half a unit of the last digit, as 0.0005 with three
    decimals, counts by what its binary form is, a little more or less than the
    half. Numbers from 1e15 on have more digits than the shortest form that tells
    them apart.
    """
    usual = F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")
    half = float(f"5e-{decimals + 1}")
    above = Fraction(half) > Fraction(5, 10 ** (decimals + 1))
    unit = f"{10.0**-decimals if above else 0.0:.{decimals}f}"
    return (
        F.when(size == half, F.concat(sign, F.lit(unit)))
        .when((size >= 1e15) & (size < 9e18), F.concat(sign, _wide_text(size, decimals)))
        .otherwise(usual)
    )


def grouped_text(value: Column, decimals: int = 0) -> Column:
    """Decimal text with thousands separators."""
    return F.format_number(value, decimals)


def signed_text(value: Column, decimals: int) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed_text(value, decimals))


def percent_text(share: Column, decimals: int = 1) -> Column:
    return F.concat(fixed_text(share * 100, decimals), F.lit("%"))


def number_text(value: Column) -> Column:
    """Whole numbers without a point, others with six significant digits."""
    digits = 5 - F.floor(F.log10(F.abs(value))).cast("int")
    # rounding up to the next power of ten (9.999999) needs one decimal less,
    # which stripping the trailing zeros covers
    fractional = F.regexp_replace(
        F.replace(F.call_function("format_number", value, digits), F.lit(","), F.lit("")),
        r"\.0+$|(\.\d*?)0+$",
        "$1",
    )
    small = F.abs(value) < 0.0001
    large = F.abs(value) >= 1000000
    return (
        F.when(is_whole(value) & ~(F.abs(value) >= 1e15), value.cast("bigint").cast("string"))
        .when(is_whole(value), value.cast("decimal(38,0)").cast("string"))
        .when(
            small | large,
            F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e"),
        )
        .otherwise(fractional)
    )
