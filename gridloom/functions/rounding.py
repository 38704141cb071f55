"""Rounding as presented values need it: half to even, judged on the double's binary value and not on its shortest decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles from here on have no digits behind the point.
_WHOLE = float(2**53)
#: 2^27 + 1 parts a double into two halves whose products are exact.
_SPLIT = float(2**27 + 1)


def round_binary(x: Column, digits: int = 0) -> Column:
    """``x`` (double) to ``digits`` (0 to 22) decimals, as the nearest double to the decimal nearest to x's exact binary value; halfway goes to the even digit.

    ``bround`` and casts to decimal judge the shortest text, so 2.675 gives 2.68 there and 2.67 here (it is a little less than it reads). The
    product with the power of ten and its error are told apart exactly (Dekker's product); only a product that looks like a half needs the error. Null, NaN and infinities stay, and so does the sign of 0.
    """
    if not 0 <= digits <= 22:
        raise ValueError("digits go from 0 to 22")
    x = x.cast("double")
    if digits == 0:
        return F.rint(x)
    scale = 10.0**digits
    p = x * scale

    def halves(v: Column) -> tuple[Column, Column]:
        t = v * _SPLIT
        high = t - (t - v)
        return high, v - high

    s = float(scale) * _SPLIT
    s_high = s - (s - scale)
    s_low = scale - s_high
    high, low = halves(x)
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    near = F.rint(p)
    floor = F.floor(p).cast("double")
    told = F.when(p - floor != 0.5, near).when(error > 0, floor + 1.0).when(error < 0, floor).otherwise(near)
    signed = F.when(told == 0, near * 0.0).otherwise(told)  # rint keeps the sign that adding loses
    return F.when(x.isNull() | F.isnan(x) | (F.abs(p) >= _WHOLE), x).otherwise(signed / scale)


def exact_mean(x: Column) -> Column:
    """An aggregate: the mean of doubles, their sum rounded once, so that the order of rows has no say in it. Values are parted into two integers, in units of 2^-26 and 2^-62; their sums
    are exact for values of under 4,096 (degrees, probabilities) and 30 million rows a group, and keep all of a value's bits from 2^-10 on."""
    x = x.cast("double")
    scaled = x * float(2**26)
    high = F.rint(scaled)
    low = F.rint((scaled - high) * float(2**36))
    return (F.sum(high.cast("long")) + F.sum(low.cast("long")) / float(2**36)) / float(2**26) / F.count(x)


def present(df, digits: dict[str, int]):
    """``df`` with each named column rounded for presentation."""
    return df.withColumns({c: round_binary(df[c], d) for c, d in digits.items()})
