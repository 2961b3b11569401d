"""The margin model on long rows: yields, contributions, decomposition, breakevens, scenarios.

A slate is one row per (entity, period, product); everything about one margin
is an ordinary aggregate by (entity, period).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions.frames import by, keyed, split_rejects, unkeyed
from spreadlake.functions.numeric import ratio, strict_sum

MMBTU_PER_MWH = 3.412141633  # Fixed value: million British thermal units in one MWh.


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- gas -------------------------------------------------------------------


def gas_price(ttf, eurusd, published) -> Column:
    """The published price where there is one, else the exchange path."""
    return F.coalesce(_c(published), _c(ttf) * _c(eurusd) / MMBTU_PER_MWH)


def gas_basis(ttf, eurusd, published) -> Column:
    return F.when(_c(published).isNotNull(), "published").when(
        _c(ttf).isNotNull() & _c(eurusd).isNotNull(), "ttf"
    )


def ttf_of_gas(gas, eurusd) -> Column:
    return ratio(_c(gas) * MMBTU_PER_MWH, eurusd)


def intensity(parts: Sequence[tuple[str, float]], denominator) -> Column:
    """Energy bought per barrel from several reported quantities."""
    total = reduce(lambda a, b: a + b, [F.col(c) * f for c, f in parts])
    return ratio(total, denominator)


def gas_wedge(gas, embedded: float, study: float) -> dict[str, Column]:
    """Two intensities priced at one gas price; nothing is deducted from any margin."""
    g = _c(gas)
    return {
        "embedded_cost": embedded * g,
        "study_cost": study * g,
        "wedge": study * g - embedded * g,
        "intensity_ratio": ratio(F.lit(study), F.lit(embedded)),
    }


# --- yields ----------------------------------------------------------------

YIELD_BASES = ("crude_intake", "total_feed")


def observed_yields(
    output: DataFrame, denominator: DataFrame, keys: Sequence[str], basis: str, value: str = "output", products: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Output by product over a named denominator, with its total and the normalised share.

    A zero denominator is refused with its reason; a missing one gives missing yields. With
    ``products`` declared, the total is missing where one of them has no row or no value.
    """
    if basis not in YIELD_BASES:
        raise ValueError(f"basis must be one of {YIELD_BASES}, not {basis!r}")
    rows = output.join(denominator.select(*keys, "denominator"), list(keys), "left")
    good, bad = split_rejects(rows, F.when(F.col("denominator") == 0, "zero_denominator"))
    total = good.groupBy(*keys).agg(strict_sum(value, _expected(products)).alias("_total"))
    out = good.join(total, list(keys))
    return (
        out.withColumn("yield", F.col(value) / F.col("denominator"))
        .withColumn("yield_total", F.col("_total") / F.col("denominator"))
        .withColumn("share", ratio(value, "_total"))
        .withColumn("basis", F.lit(basis))
        .drop("_total")
    ), bad


# --- margin ----------------------------------------------------------------


def _expected(products: Sequence[str]) -> Column:
    """Members a complete sum has: the products declared, or else the rows there are."""
    return F.lit(len(products)) if products else F.count("*")


def _missing(products: Sequence[str], product: str, c: Column) -> Column:
    """The declared products without a contribution, by name."""
    wanted = F.array(*[F.lit(p) for p in sorted(products)]).cast("array<string>")
    return F.array_except(wanted, F.collect_set(F.when(c.isNotNull(), F.col(product))))


def double_count_reason(basis: str = "margin_basis", cost: str | Column = "gas_cost") -> Column:
    """A margin already net of gas must be handed a cost of exactly zero; a missing cost fails too."""
    exact = F.coalesce(_c(cost) == 0, F.lit(False))
    return (
        F.when(~F.col(basis).isin("net_of_gas", "gross_of_gas") | F.col(basis).isNull(), "unknown_basis")
        .when((F.col(basis) == "net_of_gas") & ~exact, "gas_counted_twice")
    )


def evaluate(
    slate: DataFrame, facts: DataFrame, keys: Sequence[str], product: str = "product", products: Sequence[str] = (), own: str | None = None
) -> DataFrame:
    """Margin line by line from slate rows (product, yield, spread) and one fact row per key.

    ``facts`` carries residual, gas_intensity, gas, other_cost and threshold, and may carry
    ``margin_basis``: a margin net of gas that is charged for gas again, or an unknown basis, is
    refused, its lines NULL and the reason in ``reason``.

    ``products`` declares the slate. A product without a row, a yield or a spread is listed in
    ``missing`` and leaves a hole; without a declaration the rows present are the slate. The carrier
    is the largest present contribution. With ``own``, the sum of the other products and that
    product's yield come along, which is what its breakeven needs.
    """
    c = F.col("yield") * F.col("spread")
    order = F.when(c.isNotNull(), F.struct((-c).alias("a"), F.col(product).alias("b")))
    sums = [
        strict_sum(c, _expected(products)).alias("attributed"),
        F.sum("yield").alias("covered_yield"),
        F.min_by(product, order).alias("carrier"),
        F.max(c).alias("carrier_contribution"),
        _missing(products, product, c).alias("missing"),
    ]
    if own is not None:
        other = F.col(product) != own
        n = F.lit(len(products) - 1) if products else F.count_if(other)
        sums.append(strict_sum(F.when(other, c), n).alias("others"))
        sums.append(F.max(F.when(~other, F.col("yield"))).alias("own_yield"))
    agg = slate.groupBy(*keys).agg(*sums)
    out = facts.join(agg, list(keys), "left") if products else agg.join(facts, list(keys), "left")
    if products:
        every = F.array(*[F.lit(p) for p in sorted(products)])
        out = out.withColumn("missing", F.coalesce("missing", every))
    refused = F.lit(None).cast("string")
    if "margin_basis" in facts.columns:
        charged = F.col("gas_intensity") * F.col("gas")
        refused = double_count_reason(cost=charged)
    incomplete = F.when(F.col("attributed").isNull(), "slate_incomplete")
    out = out.withColumn("reason", F.coalesce(refused, incomplete))
    out = out.withColumn("attributed", F.when(refused.isNull(), F.col("attributed")))
    gross = F.col("attributed") + F.col("residual")
    return (
        out.withColumn("gross", gross)
        .withColumn("gas_cost", F.col("gas_intensity") * F.col("gas"))
        .withColumn("after_gas", F.col("gross") - F.col("gas_cost") - F.col("other_cost"))
        .withColumn("headroom", F.col("after_gas") - F.col("threshold"))
        .withColumn("threshold_identified", F.col("threshold").isNotNull())
    )


def decompose(
    slate: DataFrame, official: DataFrame, keys: Sequence[str], how: str = "inner", product: str = "product", products: Sequence[str] = ()
) -> DataFrame:
    """A published margin attributed to products; the rest stays on its own line.

    With ``products`` declared, one of them without a contribution is listed in ``missing`` and no
    part of the margin is taken for the whole: its share must not end in the residual.
    """
    c = F.col("yield") * F.col("spread")
    agg = slate.groupBy(*keys).agg(
        strict_sum(c, _expected(products)).alias("attributed"),
        F.sum("yield").alias("covered_yield"),
        _missing(products, product, c).alias("missing"),
    )
    out = official.join(agg, list(keys), how)
    residual = F.col("official") - F.col("attributed")
    reason = (
        F.when(F.col("official").isNull(), "no_official_margin")
        .when(F.col("covered_yield").isNull(), "no_spreads")
        .when(F.col("attributed").isNull(), "a_spread_is_missing")
    )
    return (
        out.withColumn("residual", residual)
        .withColumn("residual_share", ratio("residual", "official"))
        .withColumn("reason", reason)
    )


def replicate(
    prices: DataFrame,
    slate: Mapping[str, float],
    facts: DataFrame,
    keys: Sequence[str],
    crude_factor: float,
    loss_rate: float = 0.003,
    bar: float = 0.5,
) -> DataFrame:
    """Recompute a published margin from what is published, and say what is missing.

    ``prices``: (keys, product, price) per tonne; ``slate``: product to
    mass yield; ``facts``: crude, freight, gas_cost and official per key.
    """
    items = [F.struct(F.lit(p).alias("product"), F.lit(float(y)).alias("mass_yield")) for p, y in slate.items()]
    asked = facts.select(*keys, F.inline(F.array(*items)))
    rows = asked.join(prices, [*keys, "product"], "left")
    y, p = F.col("mass_yield"), F.col("price")
    agg = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(y * p), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum(F.when(p.isNotNull(), y)), F.lit(0.0)).alias("covered_mass_yield"),
        F.array_sort(F.collect_set(F.when(p.isNull(), F.col("product")))).alias("_missing"),
    )
    out = agg.join(facts, list(keys))
    extra = F.array_compact(
        F.array(F.when(F.col("freight").isNull(), "freight"), F.when(F.col("gas_cost").isNull(), "gas_cost"))
    )
    # what the barrel delivered costs, and what the published figures allow without freight and gas
    landed = F.col("crude") + F.col("freight")
    bills = [landed, loss_rate * landed, F.col("gas_cost")]
    full = (F.col("revenue") - reduce(lambda a, b: a + b, bills)) / crude_factor
    partial = (F.col("revenue") - (1 + loss_rate) * F.col("crude")) / crude_factor
    out = out.withColumn("missing", F.concat("_missing", extra)).drop("_missing")
    complete = F.size("missing") == 0
    return (
        out.withColumn("margin", F.when(complete, full))
        .withColumn("partial", partial)
        .withColumn("error", F.col("margin") - F.col("official"))
        .withColumn("partial_error", F.col("partial") - F.col("official"))
        .withColumn("within_bar", F.coalesce(F.abs("error") <= bar, F.lit(False)))
    )


# --- breakevens ------------------------------------------------------------


def breakeven_gas() -> Column:
    """Gas price at which the margin meets the threshold; NULL where gas has no leverage."""
    return F.when(
        F.col("margin_basis") != "net_of_gas",
        ratio(F.col("gross") - F.col("other_cost") - F.col("threshold"), "gas_intensity"),
    )


def breakeven_ttf() -> Column:
    leverage = F.col("gas_intensity") * F.col("eurusd")
    return F.when(
        (F.col("margin_basis") != "net_of_gas") & (F.col("gas_basis") == "ttf"),
        ratio((F.col("gross") - F.col("other_cost") - F.col("threshold")) * MMBTU_PER_MWH, leverage),
    )


def breakeven_spread() -> Column:
    """Spread of the product ``evaluate(own=...)`` was given at which the margin meets the threshold.

    Only the other products' contributions enter, so its own spread may be missing.
    """
    earned = F.col("others") + F.col("residual")
    owed = F.col("threshold") + F.col("gas_cost") + F.col("other_cost")
    return ratio(owed - earned, "own_yield")


# --- waterfall and scenarios -----------------------------------------------


def waterfall(df: DataFrame, keys: Sequence[str], name: str, contribution: str) -> DataFrame:
    """Running start and end of each step, largest contribution first, ties by name."""
    df, k = keyed(df, keys)
    w = by(k, F.col(contribution).desc(), name)
    run = F.sum(contribution).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return unkeyed(keys, 
        df.withColumn("step", F.row_number().over(w))
        .withColumn("end", run)
        .withColumn("start", F.col("end") - F.col(contribution))
    )


def incomplete_slates(df: DataFrame, keys: Sequence[str], name: str, contribution: str, products: Sequence[str]) -> DataFrame:
    """Periods whose declared slate lacks a contribution: how many legs there are and which are ``missing``."""
    legs = F.array_sort(F.collect_set(F.when(F.col(contribution).isNotNull() & F.col(name).isin(*products), F.col(name))))
    declared = F.array(*[F.lit(p) for p in sorted(products)])
    found = df.groupBy(*keys).agg(legs.alias("_legs"))
    out = found.select(*keys, F.size("_legs").alias("legs"), F.array_except(declared, F.col("_legs")).alias("missing"))
    return out.filter(F.size("missing") > 0)


def complete_slates(df: DataFrame, keys: Sequence[str], name: str, contribution: str, products: Sequence[str]) -> DataFrame:
    """Rows of the declared slate in periods where all of it is there.

    A waterfall over part of a slate would show the missing leg as unexplained; there is none for such
    a period, and ``incomplete_slates`` says why.
    """
    own = df.filter(F.col(name).isin(*products))
    return own.join(incomplete_slates(own, keys, name, contribution, products).select(*keys), list(keys), "left_anti")


#: name -> (column, edit) applied to the wide inputs of one entity and period
Edit = Mapping[str, Column]


def scenario_grid(inputs: DataFrame, scenarios: Mapping[str, Edit]) -> DataFrame:
    """Every input row under every named edit.

    The edits are literal expressions, so the grid is one generator over an
    array of structs: no join and no shuffle, whatever the number of rows.
    """
    columns = inputs.columns
    variants = []
    for name, edit in scenarios.items():
        fields = [F.lit(name).alias("scenario")]
        fields += [edit.get(c, F.col(c)).alias(c) for c in columns]
        variants.append(F.struct(*fields))
    return inputs.select(F.inline(F.array(*variants)))


def compute_model(inputs: DataFrame, products: Sequence[str], target: float, breakeven_product: str) -> DataFrame:
    """The model for edited inputs held wide: y_<product>, s_<product> and the gas facts.

    A product with a missing yield or spread is left out and listed. A missing
    gas input blocks the margin and is listed.
    """
    y = {p: F.col(f"y_{p}") for p in products}
    s = {p: F.col(f"s_{p}") for p in products}
    has = {p: y[p].isNotNull() & s[p].isNotNull() for p in products}
    contribution = {p: F.when(has[p], y[p] * s[p]) for p in products}
    zero = F.lit(0.0)
    attributed = reduce(lambda a, b: a + b, [F.coalesce(contribution[p], zero) for p in products])
    covered = reduce(lambda a, b: a + b, [F.when(has[p], y[p]).otherwise(0.0) for p in products])
    gas_inputs = ("ttf", "eurusd", "gas_intensity", "other_cost")
    blocked = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in gas_inputs]))
    best = F.greatest(*[contribution[p] for p in products])
    carrier = F.coalesce(*[F.when(contribution[p] == best, p) for p in sorted(products)])
    out = inputs.withColumn("included", F.array_compact(F.array(*[F.when(has[p], p) for p in products])))
    out = out.withColumn("excluded", F.array_compact(F.array(*[F.when(~has[p], p) for p in products])))
    out = out.withColumn("blocked_by", blocked).withColumn("attributed", attributed).withColumn("carrier", carrier)
    out = out.withColumn("covered_yield", covered)
    free = F.size("blocked_by") == 0
    gas = F.when(free, F.col("ttf") * F.col("eurusd") / MMBTU_PER_MWH)
    out = out.withColumn("gas", gas).withColumn("gas_cost", F.col("gas_intensity") * F.col("gas"))
    out = out.withColumn("after_gas", F.col("attributed") - F.col("gas_cost") - F.col("other_cost"))
    room = F.col("attributed") - F.col("other_cost") - target
    out = out.withColumn("breakeven_gas", F.when(free, ratio(room, "gas_intensity")))
    out = out.withColumn(
        "breakeven_ttf", F.when(free, ratio(room * MMBTU_PER_MWH, F.col("gas_intensity") * F.col("eurusd")))
    )
    b = breakeven_product
    rest = F.col("attributed") - contribution[b]
    out = out.withColumn(
        "breakeven_spread", F.when(free & has[b], ratio(target + F.col("gas_cost") + F.col("other_cost") - rest, y[b]))
    )
    return out.withColumn("residual", F.col("official") - F.col("attributed"))


def strict_preset(df: DataFrame, wanted: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Mean over a set of months, only when every month has a value; else NULL and the missing list.

    ``wanted`` holds the preset's months per key, so the list is bounded by it.
    """
    joined = wanted.join(df.select(*keys, period, value), [*keys, period], "left")
    miss = F.when(F.col(value).isNull(), F.date_format(period, "yyyy-MM"))
    return joined.groupBy(*keys).agg(
        F.when(F.count(value) == F.count("*"), F.avg(value)).alias("value"),
        F.count(value).alias("months_used"),
        F.array_sort(F.collect_set(miss)).alias("missing_months"),
    )


def fuel_switch(gas: Column, fuel_price: Column, heat_content: float, intensity_value: float) -> dict[str, Column]:
    """The same energy bought as gas or as fuel oil, and the gap between the two bills."""
    fuel = fuel_price / heat_content
    return {
        "gas_cost": intensity_value * gas,
        "fuel_cost": intensity_value * fuel,
        "gap": intensity_value * gas - intensity_value * fuel,
    }
