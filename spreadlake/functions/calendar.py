"""Calendar expressions: month floors, ISO weeks, period anchors, month distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: grain -> (anchor expression name, step interval)
GRAINS = ("daily", "weekly", "monthly", "annual")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    return F.trunc(_c(c), "MM")


def month_index(c) -> Column:
    """Months since year zero, so calendar distance is a subtraction."""
    return F.year(_c(c)) * 12 + F.month(_c(c)) - 1


def iso_year(c) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(c))


def iso_week(c) -> Column:
    return F.weekofyear(_c(c))


def iso_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def month_label(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM")


def is_weekday(c) -> Column:
    # dayofweek: 1 is Sunday, 7 is Saturday
    return ~F.dayofweek(_c(c)).isin(1, 7)


def anchor(c, grain: str) -> Column:
    """The first day of the period a date belongs to; weeks start on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")
    c = _c(c)
    if grain == "daily":
        return F.to_date(c)
    if grain == "weekly":
        return F.to_date(F.date_trunc("week", c))
    if grain == "monthly":
        return F.trunc(c, "MM")
    return F.trunc(c, "YEAR")


def step(grain: str) -> Column:
    return F.expr(
        {
            "daily": "interval 1 day",
            "weekly": "interval 7 days",
            "monthly": "interval 1 month",
            "annual": "interval 1 year",
        }[grain]
    )


def shift(c, grain: str, n: int) -> Column:
    """The period n steps away from a period anchor."""
    c = _c(c)
    if grain == "daily":
        return F.date_add(c, n)
    if grain == "weekly":
        return F.date_add(c, 7 * n)
    if grain == "monthly":
        return F.add_months(c, n)
    return F.add_months(c, 12 * n)


def month_of_label(c) -> Column:
    """``2026M08`` to the first of that month, NULL for any other text."""
    c = F.trim(_c(c))
    year = F.regexp_extract(c, r"^(\d{4})M(\d{2})$", 1)
    month = F.regexp_extract(c, r"^(\d{4})M(\d{2})$", 2)
    return F.to_date(
        F.when((year != "") & month.between("01", "12"), F.concat_ws("-", year, month, F.lit("01")))
    )


def provisional_by_calendar(period, as_of) -> Column:
    """A month is provisional only while it is the month of ``as_of``."""
    return F.trunc(_c(period), "MM") == F.trunc(_c(as_of), "MM")
