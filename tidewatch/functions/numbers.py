"""Guarded numeric parsing and number text.

A plain cast is too forgiving for counters (``'1.5'`` rounds, ``' 7 '`` trims),
so every parse checks the text first and yields NULL when it does not fit.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # fixed value: 2^27 + 1, cuts a double in half
U64 = "decimal(20,0)"
U64_MAX = 18446744073709551615  # fixed value: largest unsigned 64-bit integer

_FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"


def parse_u64(c: Column) -> Column:
    """Unsigned 64-bit counter as DECIMAL(20,0), NULL when the text is not one."""
    value = F.when(c.rlike(r"^\+?[0-9]+\z"), c).try_cast(U64)
    return F.when(value <= F.lit(str(U64_MAX)).cast(U64), value)


def parse_i64(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c).try_cast("bigint")


def is_number(c: Column) -> Column:
    return c.rlike(_FLOAT)


def parse_double(c: Column) -> Column:
    return F.when(is_number(c), c).try_cast("double")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def fixed(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value.

    What prints as a tie (3.255) is usually a little above or below it in
    binary. The exact side comes from splitting the number into two halves
    whose products with a small integer are exact; real ties go to even.
    """
    v = c.cast("double")
    scale = 10**digits
    dec = v.try_cast("decimal(38,12)")
    below = F.floor(dec, F.lit(digits))
    looks_tied = (dec - below) == F.lit(Decimal(5).scaleb(-digits - 1))
    high = v * SPLIT - (v * SPLIT - v)
    tie = F.round(below.cast("double") * scale) * 2 + 1
    side = (high * (2 * scale) - tie) + (v - high) * (2 * scale)
    rounded = (
        F.when(looks_tied & (side < 0), below)
        .when(looks_tied & (side > 0), below + F.lit(Decimal(1).scaleb(-digits)))
        .otherwise(F.bround(dec, digits))
    )
    return rounded.cast(f"decimal(38,{digits})").cast("string")


def number_text(c: Column) -> Column:
    """A double or float as people write it: no exponent, no trailing ``.0``, and read back equal.

    The cast to text has as many digits as the value needs; only its exponent is written out.
    """
    text = c.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    parts = r"^-?(\d)\.(\d+)E(-?\d+)\z"
    fraction = F.regexp_replace(F.regexp_extract(text, parts, 2), r"^0\z", "")
    digits = F.concat(F.regexp_extract(text, parts, 1), fraction)
    power = F.regexp_extract(text, parts, 3).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    rest = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    return F.when(power.isNull(), F.regexp_replace(text, r"\.0\z", "")).otherwise(
        F.concat(sign, F.when(power < 0, small).otherwise(large))
    )
