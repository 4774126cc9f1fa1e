"""Keyed pseudo-random draws.

Every draw is a pure function of its key parts, so a lost executor recomputes the
same numbers and another SQL engine can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO32 = 4294967296.0


def _key(parts: tuple) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _hex_digits(digits: int, parts: tuple) -> Column:
    return F.conv(F.substring(F.md5(_key(parts)), 1, digits), 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    """First 32 bits of md5 over the '|'-joined key parts, as bigint."""
    return _hex_digits(8, parts)


def hash60(*parts) -> Column:
    """First 60 bits of the same md5: for draws of a place in a group, which may have more than 2^32 rows."""
    return _hex_digits(15, parts)


def coin(*parts) -> Column:
    """Is hash32 odd?  Its last hex digit says so, and no number is made."""
    return F.substring(F.md5(_key(parts)), 8, 1).isin(*"13579bdf")


def order_key(*parts) -> Column:
    """Text that sorts as hash32 does: its hex digits, without making a number of them."""
    return F.substring(F.md5(_key(parts)), 1, 8)


def digits_below(p: float) -> str:
    """For p below 1: uniform is below p just where order_key is below these digits."""
    return format(math.ceil(p * TWO32 - 0.5), "08x")


def uniform(*parts) -> Column:
    """Uniform number in (0, 1)."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(TWO32)


def normal(*parts) -> Column:
    """Standard normal draw (Box-Muller on two keyed uniforms)."""
    u1, u2 = uniform(*parts, F.lit("u1")), uniform(*parts, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
