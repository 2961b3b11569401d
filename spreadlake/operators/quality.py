"""Validation, profiling and provenance as set-level checks.

Refusals are data: each check returns counts or rows with a reason, and only a
verdict row is ever collected (see ``guarded_append``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import by, keyed, row_hash, unkeyed
from spreadlake.operators import calendar_ops


@dataclass(frozen=True)
class Spec:
    """What a series must look like before it may replace the stored one."""

    date: str = "date"
    required: Sequence[str] = ()
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    min_rows: int = 1
    min_observations: Mapping[str, int] = field(default_factory=dict)
    position: str | None = None
    unique_dates: bool = True


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def observed(c: str, df: DataFrame) -> Column:
    """A cell that is neither missing nor blank text."""
    if dict(df.dtypes)[c] == "string":
        return F.col(c).isNotNull() & (F.trim(c) != "")
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def order_breaks(df: DataFrame, keys: Sequence[str], date: str, position: str, width: int = 1_000_000) -> DataFrame:
    """How often a row's date is before the date of the row ingested just before it.

    Raw rows of one key may not fit one task, so the position axis is cut into
    slices of ``width`` rows. Neighbours inside a slice are compared there;
    across slices only each slice's first and last row are compared.
    """
    df, k = keyed(df, keys)
    rows = df.filter(F.col(date).isNotNull()).withColumn("_slice", F.floor(F.col(position) / width))
    w = by([*k, "_slice"], position)
    inside = rows.withColumn("_prev", F.lag(date).over(w))
    per_slice = inside.groupBy(*k, "_slice").agg(
        F.count_if(F.col(date) < F.col("_prev")).alias("_breaks"),
        F.min_by(date, position).alias("_first"),
        F.max_by(date, position).alias("_last"),
    )
    edge = F.lag("_last").over(by(k, "_slice"))
    edges = per_slice.withColumn("_edge", (F.col("_first") < edge).cast("int"))
    return unkeyed(keys, 
        edges.groupBy(*k).agg((F.sum("_breaks") + F.coalesce(F.sum("_edge"), F.lit(0))).alias("order_breaks"))
    )


def parsed_date(df: DataFrame, spec: Spec) -> Column:
    return F.col(spec.date).try_cast("date") if dict(df.dtypes)[spec.date] == "string" else F.to_date(spec.date)


def date_counts(df: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """Rows and violations per key and date: sums, so counts of parts of a table add up to those of the whole."""
    parsed = parsed_date(df, spec)
    counts = [
        F.count("*").alias("_rows"),
        F.count_if(F.col(spec.date).isNotNull() & parsed.isNull()).alias("_bad_date"),
    ]
    for c, (lo, hi) in spec.bounds.items():
        number = F.col(c).try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
        counts.append(F.count_if(~number.between(lo, hi) & ~F.isnan(number)).alias(f"_out_{c}"))
        counts.append(F.count_if(F.col(c).isNotNull() & number.isNull()).alias(f"_text_{c}"))
    for c in spec.min_observations:
        counts.append(F.count_if(observed(c, df)).alias(f"_obs_{c}"))
    return df.groupBy(*keys, parsed.alias("_date")).agg(*counts)


def added(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Date counts of several parts of a table as those of all of them."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c.startswith("_") and c != "_date" and c not in keys]
    return counts.groupBy(*keys, "_date").agg(*sums)


def tallied(per_date: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """One row per key from its date counts."""
    dated = F.col("_date").isNotNull()
    out = [
        F.sum("_rows").alias("rows"),
        F.sum("_bad_date").alias("unparseable_dates"),
        F.coalesce(F.sum(F.when(~dated, F.col("_rows"))), F.lit(0)).alias("empty_dates"),
        F.count_if(dated & (F.col("_rows") > 1)).alias("duplicate_dates"),
    ]
    out += [F.sum(f"_out_{c}").alias(f"outside_{c}") for c in spec.bounds]
    out += [F.sum(f"_text_{c}").alias(f"non_numeric_{c}") for c in spec.bounds]
    out += [F.sum(f"_obs_{c}").alias(f"observations_{c}") for c in spec.min_observations]
    return per_date.groupBy(*keys).agg(*out)


def with_problems(result: DataFrame, spec: Spec) -> DataFrame:
    """The list of broken rules beside the counts."""
    problems = [
        F.when(F.col("rows") < spec.min_rows, "too_few_rows"),
        F.when(F.col("unparseable_dates") > 0, "unparseable_dates"),
        F.when(F.col("empty_dates") > 0, "empty_dates"),
    ]
    if spec.unique_dates:
        problems.append(F.when(F.col("duplicate_dates") > 0, "duplicate_dates"))
    if spec.position:
        problems.append(F.when(F.col("order_breaks") > 0, "dates_not_increasing"))
    for c in spec.bounds:
        problems.append(F.when(F.col(f"outside_{c}") > 0, f"outside_bounds_{c}"))
        problems.append(F.when(F.col(f"non_numeric_{c}") > 0, f"non_numeric_{c}"))
    for c, floor in spec.min_observations.items():
        problems.append(F.when(F.col(f"observations_{c}") < floor, f"too_few_observations_{c}"))
    return result.withColumn("problems", F.array_compact(F.array(*problems)))


def validate(df: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """One row per key: the counts behind every rule and the list of problems.

    Duplicate dates and all other counts come from one aggregate by (keys,
    date) followed by one by keys, so the first shuffle already carries
    pre-aggregated rows.
    """
    absent = missing_columns(df, [spec.date, *spec.required])
    df, k = keyed(df, keys)
    if absent:
        # nothing else can be said about a frame without its columns
        lacking = F.array(*[F.lit(f"missing_column_{c}") for c in absent])
        return unkeyed(keys, df.groupBy(*k).agg(F.count("*").alias("rows")).withColumn("problems", lacking))
    result = tallied(date_counts(df, k, spec), k, spec)
    if spec.position:
        breaks = order_breaks(df.withColumn("_d", parsed_date(df, spec)), k, "_d", spec.position)
        result = result.join(breaks, k, "left").withColumn("order_breaks", F.coalesce("order_breaks", F.lit(0)))
    return unkeyed(keys, with_problems(result, spec))


def shrink_check(new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row and observation counts of a candidate against the stored version, per key."""
    new, k = keyed(new, keys)
    old, _ = keyed(old, keys)

    def counted(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*k).agg(
            F.count("*").alias(f"rows_{tag}"), *[F.count_if(observed(c, df)).alias(f"{c}_{tag}") for c in columns]
        )

    both = counted(old, "old").join(counted(new, "new"), k, "full_outer")
    shrunk = [F.when(F.coalesce("rows_new", F.lit(0)) < F.col("rows_old"), "rows")]
    shrunk += [F.when(F.coalesce(f"{c}_new", F.lit(0)) < F.col(f"{c}_old"), c) for c in columns]
    return unkeyed(keys, both.withColumn("shrunk", F.array_compact(F.array(*shrunk))))


def late_start(df: DataFrame, declared: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Series whose first observation is later than declared, or absent."""
    first = df.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), F.col(date))).alias("first_observation"))
    out = declared.join(first, list(keys), "left")
    late = F.col("first_observation").isNull() | (F.col("first_observation") > F.col("declared_first"))
    return out.withColumn("late", late)


def unknown_codes(df: DataFrame, code: str, domain: DataFrame) -> DataFrame:
    """Rows whose code is not in the domain, counted per code."""
    return (
        df.groupBy(code).agg(F.count("*").alias("rows")).join(domain.select(code), code, "left_anti")
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def profile(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    grain: str,
    stale_before: str | None = None,
    vintage: str | None = None,
    flag: str | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """One provenance row per series: counts, dates, gaps, a status word and what is known of its origin.

    ``vintage`` names a column whose largest value among observed rows is the series' vintage. A period
    is provisional if ``flag`` holds for any of its observed rows; ``provisional_from`` begins the
    trailing run of such periods. ``declared`` has what a registry says of a series, its ``method`` for
    one, by some or all of the keys. What is not given is NULL.
    """
    df, k = keyed(df, keys)
    ok = observed(value, df)
    newest = F.max(F.when(ok, F.col(vintage))) if vintage else F.lit(None).cast("string")
    base = df.groupBy(*k).agg(
        F.count("*").alias("file_rows"),
        F.count_if(ok & F.col(date).isNotNull()).alias("observations"),
        F.min(F.when(ok, F.to_date(date))).alias("first_date"),
        F.max(F.when(ok, F.to_date(date))).alias("last_date"),
        newest.alias("vintage"),
    )
    holes = calendar_ops.gaps(df.filter(ok), k, date, grain).groupBy(*k).agg(
        F.count("*").alias("gap_count"), F.min("gap").alias("first_gap"), F.max("gap").alias("last_gap")
    )
    out = base.join(holes, k, "left").withColumn("gap_count", F.coalesce("gap_count", F.lit(0)))
    if flag:
        periods = df.filter(ok & F.col(date).isNotNull()).groupBy(*k, F.to_date(date).alias("_p")).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("_f"))
        out = out.join(provisional_from(periods, k, "_p", "_f"), k, "left")
    else:
        out = out.withColumn("provisional_from", F.lit(None).cast("date"))
    if declared is None:
        out = out.withColumn("method", F.lit(None).cast("string"))
    else:
        out = out.join(declared, [c for c in k if c in declared.columns], "left")
    stale = F.lit(False) if stale_before is None else F.col("last_date") < F.lit(stale_before).cast("date")
    status = F.when(F.col("observations") == 0, "failed").when(stale, "stale").otherwise("ok")
    return unkeyed(keys, out.withColumn("status", status))


def upsert(current: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace rows by key, keep the others."""
    return current.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


# The words of a registry for how a series stands and how it came to exist.
STATUSES = ("ok", "stale", "failed")
METHODS = ("published", "computed", "reconstructed", "hand_seeded")


def register(current: DataFrame, entries: DataFrame, key: str = "series") -> tuple[DataFrame, DataFrame]:
    """The registry with the entries that keep its rules, and the others with the first rule they break.

    An entry names its series, once. ``status`` and ``method`` are words of the vocabulary,
    ``publish`` is yes or no and not missing, a series no machine fetched has no ``fetched_at``, and
    one that is withheld says why in ``withheld_reason``. A refused entry leaves the stored row.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    one_of = lambda c, words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    repeated = F.count("*").over(Window.partitionBy(key)) > 1
    reason = (
        F.when(blank(key), "no_series")
        .when(repeated, "series_given_twice")
        .when(~one_of("status", STATUSES), "unknown_status")
        .when(~one_of("method", METHODS), "unknown_method")
        .when(F.col("publish").isNull(), "publish_not_stated")
        .when(~F.coalesce(F.col("machine_fetched"), F.lit(True)) & F.col("fetched_at").isNotNull(), "fetch_time_on_a_hand_made_series")
        .when(~F.col("publish") & blank("withheld_reason"), "withheld_without_a_reason")
    )
    judged = entries.withColumn("reason", reason)
    good = judged.filter("reason is null").drop("reason")
    return upsert(current, good, [key]), judged.filter("reason is not null")


def carry_forward(new: DataFrame, previous: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Unknown fields restated from the previous row of the same key."""
    old = previous.select(*key, *[F.col(c).alias(f"_old_{c}") for c in fields])
    joined = new.join(old, list(key), "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_old_{c}")))
    return joined.drop(*[f"_old_{c}" for c in fields])


def changed_rows(new: DataFrame, old: DataFrame, key: Sequence[str], volatile: Sequence[str] = ()) -> DataFrame:
    """Added, removed and changed keys, volatile columns ignored."""
    stable = [c for c in new.columns if c not in (*key, *volatile)]

    def hashed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*key, row_hash(stable).alias(f"_{tag}"))

    both = hashed(new, "new").join(hashed(old, "old"), list(key), "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_new") != F.col("_old"), "changed")
    )
    return both.withColumn("change", change).filter("change is not null").select(*key, "change")


def provisional_from(df: DataFrame, keys: Sequence[str], period: str, flagged: str) -> DataFrame:
    """Start of the trailing unbroken run of flagged periods, NULL when the last is clean."""
    df, k = keyed(df, keys)
    clean = df.groupBy(*k).agg(F.max(F.when(~F.col(flagged), F.col(period))).alias("_clean"))
    run = df.filter(F.col(flagged)).join(clean, k).filter(F.col("_clean").isNull() | (F.col(period) > F.col("_clean")))
    starts = run.groupBy(*k).agg(F.min(period).alias("provisional_from"))
    return unkeyed(keys, clean.select(*k).join(starts, k, "left"))


def status_word(period: str, provisional_from_col: str, method: str) -> Column:
    return (
        F.when(F.col(provisional_from_col).isNotNull() & (F.col(period) >= F.col(provisional_from_col)), "provisional")
        .when(F.col(method) == "reconstructed", "reconstructed")
        .otherwise("final")
    )


def digest(df: DataFrame, date: str, columns: Sequence[str]) -> DataFrame:
    """Row count, first and last value per column and an order-free content hash."""
    aggs = [F.count("*").alias("rows"), F.sum(row_hash(df.columns).cast("decimal(38,0)")).alias("content_hash")]
    for c in columns:
        present = F.when(F.col(c).isNotNull(), F.col(date))
        aggs += [F.min_by(c, present).alias(f"first_{c}"), F.max_by(c, present).alias(f"last_{c}")]
    return df.agg(*aggs)


def anchors_reproduced(anchors: DataFrame, table: DataFrame, key: Sequence[str], value: str, places: int = 2) -> DataFrame:
    """Each printed anchor against the table rounded the way it is printed (half to even)."""
    out = anchors.join(table.select(*key, value), list(key), "left")
    rounded = F.bround(F.col(value), places)
    verdict = (
        F.when(F.col(value).isNull(), "absent").when(rounded == F.col("printed"), "reproduced").otherwise("differs")
    )
    return out.withColumn("rounded", rounded).withColumn("verdict", verdict)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Two sources of one series: shared dates, largest difference and its date, one-sided dates."""
    left, k = keyed(left, keys)
    right, _ = keyed(right, keys)
    both = left.select(*k, date, F.col(value).alias("_a")).join(
        right.select(*k, date, F.col(value).alias("_b")), [*k, date], "full_outer"
    )
    diff = F.abs(F.col("_a") - F.col("_b"))
    order = F.when(diff.isNotNull(), F.struct((-diff).alias("d"), F.col(date).alias("t")))
    return unkeyed(keys, 
        both.groupBy(*k).agg(
            F.count(diff).alias("shared"),
            F.max(diff).alias("max_abs_diff"),
            F.min_by(date, order).alias("worst_date"),
            F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("left_only"),
            F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("right_only"),
        )
    )


def calendar_disagreement(left: DataFrame, right: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Over shared dates: both published, only one, or neither."""
    left, k = keyed(left, keys)
    right, _ = keyed(right, keys)
    j = left.select(*k, date, F.col(value).alias("_a")).join(
        right.select(*k, date, F.col(value).alias("_b")), [*k, date], "inner"
    )
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return unkeyed(keys, 
        j.groupBy(*k).agg(
            F.count_if(a & b).alias("both"),
            F.count_if(a & ~b).alias("left_only"),
            F.count_if(~a & b).alias("right_only"),
            F.count_if(~a & ~b).alias("neither"),
        )
    )


def tolerance_check(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Row-level agreement within a tolerance; aggregate or filter the result as needed."""
    j = left.select(*on, F.col(value).alias("left_value")).join(
        right.select(*on, F.col(value).alias("right_value")), list(on), "inner"
    )
    return j.withColumn("difference", F.col("left_value") - F.col("right_value")).withColumn(
        "within", F.abs("difference") <= tolerance
    )


def extreme_prints(df: DataFrame, keys: Sequence[str], date: str, value: str, bound: float) -> DataFrame:
    """Days below a bound, per year: how many, first, last, lowest."""
    df, k = keyed(df.filter(F.col(value) < bound), keys)
    return unkeyed(keys, 
        df.groupBy(*k, F.year(date).alias("year")).agg(
            F.count("*").alias("days"), F.min(date).alias("first"), F.max(date).alias("last"), F.min(value).alias("low")
        )
    )


def flat_bars(df: DataFrame, keys: Sequence[str], o="o", h="h", l="l", c="c", vol="vol", date="date") -> DataFrame:  # noqa: E741
    """Settlements repeated into all four fields, zero-volume bars, first shaped and traded bar."""
    df, k = keyed(df, keys)
    flat = F.coalesce((F.col(o) == F.col(h)) & (F.col(h) == F.col(l)) & (F.col(l) == F.col(c)), F.lit(False))
    idle = F.coalesce(F.col(vol) == 0, F.lit(False))
    return unkeyed(keys, 
        df.groupBy(*k).agg(
            F.count_if(flat).alias("flat_bars"),
            F.count_if(idle).alias("zero_volume_bars"),
            F.min(F.when(~flat, F.col(date))).alias("first_non_flat_bar"),
            F.min(F.when(~idle, F.col(date))).alias("first_bar_with_volume"),
        )
    )


def roll_jumps(df: DataFrame, keys: Sequence[str], date: str, close: str, threshold: float) -> DataFrame:
    """Session moves at or above a percent threshold, with sessions left in the month."""
    df, k = keyed(df.dropna(subset=[date, close]), keys)
    w = by(k, date)
    month = by([*k, "_m"], F.col(date).desc())
    out = (
        df.withColumn("_m", cal.month_start(date))
        .withColumn("previous_date", F.lag(date).over(w))
        .withColumn("previous_close", F.lag(close).over(w))
        .withColumn("sessions_to_month_end", F.row_number().over(month) - 1)
        .withColumn("percent", 100.0 * (F.col(close) - F.col("previous_close")) / F.col("previous_close"))
    )
    return unkeyed(keys, out.filter(F.abs("percent") >= threshold).drop("_m"))


def waterfall_breaks(
    df: DataFrame, keys: Sequence[str], order: str, start: str, end: str, tolerance: float = 1e-5,
    value: str | None = None, kind: str | None = None, verdict: DataFrame | None = None,
) -> DataFrame:
    """Steps that do not add up, each with the first rule it breaks in ``reason``.

    A step starts where the one before ended. With ``value``, its end is its start plus its value.
    With ``kind``, a row of kind ``total`` starts at zero and ends at the running total of the
    steps before it, and the next step goes on from there. With ``verdict`` (keys, kind, expected),
    a row of a kind named there ends at the value expected.
    """
    df, k = keyed(df, keys)
    w = by(k, order)
    before = F.coalesce(F.lag(end).over(w), F.lit(0.0))
    off = lambda a, b: F.abs(a - b) > tolerance
    total = F.col(kind) == "total" if kind else F.lit(False)
    rules = [F.when(~total & off(F.col(start), F.col("_before")), "start_is_not_the_end_before")]
    rules.append(F.when(total & off(F.col(start), F.lit(0.0)), "total_does_not_start_at_zero"))
    out = df.withColumn("_before", before)
    if value:
        run = F.sum(F.when(~total, F.col(value)).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_run", run)
        rules.append(F.when(~total & off(F.col(end), F.col(start) + F.col(value)), "end_is_not_start_plus_value"))
        rules.append(F.when(total & off(F.col(end), F.col("_run")), "total_is_not_the_running_total"))
    if verdict is not None:
        out = out.join(verdict.select(*k, F.col("kind").alias(kind), "expected"), [*k, kind], "left")
        rules.append(F.when(off(F.col(end), F.col("expected")), "end_is_not_the_verdict"))
    broken = out.withColumn("reason", F.coalesce(*rules)).filter("reason is not null")
    return unkeyed(keys, broken.drop("_before", "_run", "expected"))


def event_problems(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per event the first broken rule: id, precision, kind, url, duplicate."""
    repeated = duplicate_keys(df, ["event_id"]).select("event_id", F.lit(True).alias("_repeated"))
    reason = (
        F.when(F.col("event_id").isNull() | (F.trim("event_id") == ""), "no_id")
        .when(F.col("_repeated"), "duplicate_id")
        .when(~F.col("kind").isin(*kinds), "unknown_kind")
        .when((F.col("date_precision") == "day") & ~F.col("date_text").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_not_a_day")
        .when((F.col("date_precision") == "month") & ~F.col("date_text").rlike(r"^\d{4}-\d{2}$"), "date_not_a_month")
        .when(~F.col("source_url").rlike(r"^https?://"), "no_url")
    )
    return df.join(repeated, "event_id", "left").withColumn("reason", reason).drop("_repeated")


def publishable(df: DataFrame, registry: DataFrame, series: str = "series") -> tuple[DataFrame, DataFrame]:
    """Rows of series the registry releases, and the withheld series that give no reason."""
    shown = df.join(registry.filter("publish").select(series), series, "left_semi")
    silent = registry.filter(~F.col("publish") & (F.coalesce(F.trim("withheld_reason"), F.lit("")) == ""))
    return shown, silent.select(series)


def guarded_append(current: DataFrame, new: DataFrame, keys: Sequence[str], spec: Spec) -> tuple[DataFrame, DataFrame]:
    """The stored frame with the new rows of every key that passed, and the verdict per key.

    A key whose new rows fail keeps its stored rows. The choice is a join on
    the verdict, so nothing comes back to the driver.
    """
    new_k, k = keyed(new, keys)
    verdict = validate(new_k, k, spec).select(
        *k, (F.size("problems") == 0).alias("accepted"), "problems"
    )
    good = new_k.join(verdict.filter("accepted").select(*k), k, "left_semi")
    merged = current.unionByName(unkeyed(keys, good), allowMissingColumns=True)
    return merged, unkeyed(keys, verdict)
