"""Unit-checked spreads: conversion with refusal, aligned legs, slate margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.frames import split_rejects
from spreadlake.functions.numeric import ratio, strict_sum

UNITS = ("usd_bbl", "usd_t")
WINDOWS = ("daily", "weekly", "monthly")


def unit_reason(unit: str = "unit", factor: str = "bbl_per_t") -> Column:
    """Why a price must not be converted, NULL when it may be."""
    u, f = F.col(unit), F.col(factor)
    return (
        F.when(u.isNull() | ~u.isin(*UNITS), "unknown_unit")
        .when((u == "usd_bbl") & f.isNotNull(), "factor_on_per_barrel_price")
        .when((u == "usd_t") & f.isNull(), "factor_missing")
        .when((u == "usd_t") & (f == 0), "factor_zero")
    )


def convert(
    df: DataFrame, price: str = "price", unit: str = "unit", factor: str = "bbl_per_t", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Prices per barrel, and the rows a unit rule refused."""
    good, bad = split_rejects(df, unit_reason(unit, factor), strict)
    per_barrel = F.when(F.col(unit) == "usd_t", F.col(price) / F.col(factor)).otherwise(F.col(price))
    return good.withColumn("usd_bbl", per_barrel), bad


def quote_reason(value: str, unit: str, window: str, date: str) -> Column:
    """Validity of a quote record: enums, ISO date, a number."""
    return (
        F.when(F.col(unit).isNull() | ~F.col(unit).isin(*UNITS), "bad_unit")
        .when(F.col(window).isNull() | ~F.col(window).isin(*WINDOWS), "bad_window")
        .when(
            F.col(date).isNull()
            | ~F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$")
            | F.col(date).try_cast("date").isNull(),
            "bad_date",
        )
        .when(F.col(value).isNotNull() & F.col(value).cast("string").try_cast("double").isNull(), "not_a_number")
    )


def spread(product: DataFrame, benchmark: DataFrame, on: Sequence[str], price: str, bench: str) -> DataFrame:
    """Product less benchmark on exactly shared periods; a missing leg is a missing spread."""
    return product.join(benchmark, list(on), "inner").withColumn("spread", F.col(price) - F.col(bench))


def aligned_join(
    product: DataFrame, benchmark: DataFrame, keys: Sequence[str], date: str = "date", window: str = "window"
) -> tuple[DataFrame, DataFrame]:
    """Legs that share keys, date and window, and the product legs that do not.

    Mismatches are refused with the rule they broke, never silently dropped.
    """
    windows = benchmark.groupBy(*keys, date).agg(F.count("*").alias("_windows"))
    reason = (
        F.when(F.col(window).isNull() | F.col(date).isNull(), "leg_without_window_or_date")
        .when(F.col("_windows").isNull(), "no_benchmark_on_date")
        .when(F.col("_hit").isNull(), "window_differs")
    )
    hit = benchmark.withColumn("_hit", F.lit(1))
    matched = product.join(hit, [*keys, date, window], "left").join(windows, [*keys, date], "left")
    good, bad = split_rejects(matched, reason)
    drop = ["_hit", "_windows"]
    return good.drop(*drop), bad.drop(*drop)


def mass_to_volume_yield(mass_yield, product_factor, crude_factor) -> Column:
    """Tonnes per tonne to barrels per barrel; a zero crude factor has no answer."""
    return ratio(F.col(mass_yield) * F.col(product_factor), crude_factor)


def slate_margin(spreads: DataFrame, yields: DataFrame, keys: Sequence[str], n_products: int) -> DataFrame:
    """Sum of yield times spread over the slate, strict: one missing leg, no margin."""
    rows = spreads.join(yields.select("product", "yield"), "product")
    contribution = F.col("yield") * F.col("spread")
    return rows.groupBy(*keys).agg(
        strict_sum(contribution, n_products).alias("attributed"),
        F.sum("yield").alias("covered_yield"),
        F.max("bench").alias("bench"),
    )
