"""Numeric expressions and aggregates with the missing-value contract built in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c) -> Column:
    """NaN becomes NULL, the one missing value this library knows."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    c = no_nan(c)
    return F.when((c < F.lit(float("inf"))) & (c > F.lit(float("-inf"))), c)


def publish(c, places: int = 6) -> Column:
    """Round for publication: no NaN, no infinity, no negative zero."""
    return F.round(finite(c), places) + F.lit(0.0)


def strict_sum(c, expected) -> Column:
    """The sum when all ``expected`` members are present, else NULL."""
    c = _c(c)
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    return F.when(F.count(c) == expected, F.sum(c))


def ratio(num, den) -> Column:
    """Division that answers NULL, not an error or infinity, at a zero denominator."""
    den = _c(den)
    return _c(num) / F.when(den != 0, den)


def within(c, low, high) -> Column:
    """Domain bound; a missing value passes."""
    c = _c(c)
    return c.isNull() | c.between(low, high)


def interval_position(value, low, high, n) -> Column:
    """inside / above / below the prior range, or none when the range is empty."""
    value, low, high, n = _c(value), _c(low), _c(high), _c(n)
    return (
        F.when((n == 0) | value.isNull(), "none")
        .when(value > high, "above")
        .when(value < low, "below")
        .otherwise("inside")
    )


def zero_class(low, high) -> Column:
    low, high = _c(low), _c(high)
    return (
        F.when(low.isNull() | high.isNull(), None)
        .when((low <= 0) & (high >= 0), "includes_zero")
        .when(low > 0, "above_zero")
        .otherwise("below_zero")
    )


def zero_share(low, high) -> Column:
    """Distance from zero as a percent of the width; NULL when zero is inside."""
    low, high = _c(low), _c(high)
    width = high - low
    return F.when(low > 0, 100 * ratio(low, width)).when(high < 0, 100 * ratio(-high, width))


# Coefficients of a published double-precision rational approximation of the normal
# distribution function, highest power first, and the bound from which its continued fraction holds.
NORMAL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752
)
NORMAL_SPLIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631


def normal_cdf_text(x: str) -> str:
    """The standard normal distribution function as SQL; only arithmetic and ``exp``, since Spark has no erf."""
    z, tail = f"abs({x})", f"exp(-({x}) * ({x}) / 2e0)"

    def horner(coefficients):
        out = f"{coefficients[0]!r}e0"
        for c in coefficients[1:]:
            out = f"({out} * {z} + {c!r}e0)"
        return out

    fraction = f"({z} + 0.65e0)"
    for k in (4, 3, 2, 1):
        fraction = f"({z} + {k}e0 / {fraction})"
    small = f"{tail} * {horner(NORMAL_TOP)} / {horner(NORMAL_BOTTOM)}"
    large = f"{tail} / {fraction} / {ROOT_TWO_PI}e0"
    upper = f"(case when {z} > 37 then 0e0 when {z} < {NORMAL_SPLIT}e0 then {small} else {large} end)"
    return f"(case when ({x}) > 0 then 1e0 - {upper} else {upper} end)"


def normal_cdf(x: str) -> Column:
    """Standard normal distribution function of a column named or written as SQL."""
    return F.expr(normal_cdf_text(f"cast(({x}) as double)"))


def newey_west_lag(n) -> Column:
    """max(3, floor(4 (n/100)^(2/9)))."""
    return F.greatest(F.lit(3), F.floor(4.0 * F.pow(_c(n) / 100.0, F.lit(2.0 / 9.0))).cast("int"))
