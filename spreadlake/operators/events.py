"""Event windows, coverage classes and named ranges.

Events come in one of two forms. A curated list is handed over as (id, iso day)
pairs; it enters a plan as an array literal that is exploded per entity, so
asking every event of every entity needs no join at all. An event table is a
DataFrame of (event_id, day) and the entity's keys, of any size; it meets
entities, series and fine-grained rows in equi joins on keys and months, and is
never broadcast or paired with all entities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import calendar as cal
from spreadlake.functions.frames import keyed, unkeyed
from spreadlake.session import stored_dimension

EventRows = Sequence[tuple[str, str]]

#: Rows of one key and month up to which an interval join leaves them together.
HOT_ROWS = 500_000


def event_array(events: EventRows) -> Column:
    return F.array(
        *[F.struct(F.lit(i).alias("event_id"), F.lit(d).cast("date").alias("day")) for i, d in events]
    )


def asked(entities: DataFrame, events: EventRows | DataFrame) -> DataFrame:
    """One row per entity and event: all of a list, or those of a table that carry the entity's keys."""
    if not isinstance(events, DataFrame):
        return entities.select("*", F.inline(event_array(events)))
    shared = [c for c in entities.columns if c in events.columns and c not in ("event_id", "day")]
    if not shared:
        raise ValueError("an event table must carry the entities' keys")
    return entities.join(events.select(*shared, "event_id", F.to_date("day").alias("day")), shared)


def windows(entities: DataFrame, events: EventRows | DataFrame, before: int = 6, after: int = 6) -> DataFrame:
    """One row per entity, event and month offset."""
    rows = asked(entities, events)
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    return rows.withColumn("m", F.add_months(cal.month_start("day"), F.col("offset")))


def panels(
    entities: DataFrame, keys: Sequence[str], events: EventRows | DataFrame, series: Mapping[str, DataFrame], before: int = 6, after: int = 6
) -> DataFrame:
    """Each event month of each entity with every series beside it; nothing is filled.

    A series is (m, value) or (keys, m, value), one row per month.
    """
    out = windows(entities.select(*keys).distinct(), events, before, after)
    for name, frame in series.items():
        on = [c for c in (*keys, "m") if c in frame.columns]
        out = out.join(frame.select(*on, F.col("value").alias(name)), on, "left")
    return out


def in_window(
    fine: DataFrame, date: str, events: EventRows | DataFrame, before: int = 6, after: int = 6, keys: Sequence[str] = ()
) -> DataFrame:
    """Fine-grained rows inside each event's window, one row per event hit.

    Windows are whole months. A row's events are filtered out of a list by month
    distance: a generator in place of a range join. A table is joined by keys and months.
    """
    if isinstance(events, DataFrame):
        month = cal.month_start("day")
        spans = events.select(
            *keys, "event_id", "day", F.add_months(month, -before).alias("_from"), F.date_sub(F.add_months(month, after + 1), 1).alias("_to")
        )
        return interval_join(fine, spans, keys, date, "_from", "_to").drop("_from", "_to")
    idx = cal.month_index(date)
    hits = F.filter(
        event_array(events), lambda e: (idx - cal.month_index(e["day"])).between(-before, after)
    )
    return fine.select("*", F.inline(hits))


def interval_join(
    fine: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, start: str, end: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of ``fine`` with each span of their keys that holds their ``point``, both ends included.

    Spans are cut into months and meet points of the same month in an equi join; the exact days are
    compared after it. A month of one key with more than ``hot_rows`` points is dealt over several
    slices and its spans repeated in each; there are fewer such months than points / ``hot_rows``, so
    their table stays small. A null key, point or end matches nothing, nor does a span that ends
    before it starts. Columns beside the keys must differ in name.
    """
    on = [*keys, "_bin"]
    points = fine.withColumn("_bin", cal.month_index(point)).dropna(subset=on)
    load = points.groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = stored_dimension(load.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_slices")), "hot-months")
    slices = F.coalesce("_slices", F.lit(1))
    left = points.join(hot, on, "left").withColumn("_slice", F.pmod(F.xxhash64(*fine.columns), slices).cast("int")).drop("_slices")
    months = F.sequence(cal.month_index(start), cal.month_index(end))
    cut = spans.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(months)).join(hot, on, "left")
    cut = cut.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    both = left.join(cut, [*on, "_slice"])
    return both.filter(F.col(point).between(F.col(start), F.col(end))).drop("_bin", "_slice")


def window_totals(
    fine: DataFrame, keys: Sequence[str], date: str, value: str, events: DataFrame, before: int = 6, after: int = 6, by: Sequence[str] = ()
) -> DataFrame:
    """Count and mean of ``value`` in the whole months around each event of a table, per event and ``by``.

    Rows are first collapsed to one per keys, ``by`` and month, so that an event meets at most a
    window of months, however many rows they hold. An event without rows in its window is left out.
    """
    months = fine.groupBy(*keys, *by, cal.month_start(date).alias("m")).agg(F.count("*").alias("_n"), F.count(value).alias("_k"), F.sum(value).alias("_s"))
    wanted = events.select(*keys, "event_id", F.to_date("day").alias("day"))
    wanted = wanted.withColumn("m", F.explode(F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda k: F.add_months(cal.month_start("day"), k))))
    totals = wanted.join(months, [*keys, "m"]).groupBy(*keys, "event_id", "day", *by).agg(
        F.sum("_n").alias("n"), F.sum("_k").alias("_k"), F.sum("_s").alias("_s")
    )
    return totals.withColumn("mean", F.col("_s") / F.nullif("_k", F.lit(0))).drop("_k", "_s")


def coverage(
    series: DataFrame, keys: Sequence[str], events: EventRows | DataFrame, data_last: str, before: int = 6, after: int = 6
) -> DataFrame:
    """Per event and series: present months and why the others are missing.

    ``series`` is (keys, m, value); ``data_last`` is the latest month the study holds.
    """
    series, k = keyed(series, keys)
    have = series.filter(F.col("value").isNotNull())
    spans = have.groupBy(*k).agg(F.min("m").alias("s_first"), F.max("m").alias("s_last"))
    asked = windows(spans, events, before, after).join(have.select(*k, "m", "value"), [*k, "m"], "left")
    last = F.lit(data_last).cast("date")
    cls = (
        F.when(F.col("value").isNotNull(), "present")
        .when(F.col("m") < F.col("s_first"), "before_start")
        .when((F.col("m") > F.col("s_last")) & (F.col("m") > last), "future")
        .when(F.col("m") > F.col("s_last"), "after_end")
        .otherwise("hole")
    )
    names = ("present", "before_start", "after_end", "future", "hole")
    tagged = asked.withColumn("_cls", cls)
    return unkeyed(keys, 
        tagged.groupBy(*k, "event_id").agg(*[F.count_if(F.col("_cls") == n).alias(n) for n in names])
    )


def named_ranges(
    spans: DataFrame, events: EventRows | DataFrame, first: str = "first", last: str = "last", lead: int = 6, months: int = 12
) -> DataFrame:
    """From lead months before an event to the end of its twelfth month, clipped to the data."""
    rows = asked(spans, events)
    month = cal.month_start("day")
    start = F.greatest(F.add_months(month, -lead), F.col(first))
    end = F.least(F.date_sub(F.add_months(month, months), 1), F.col(last))
    return rows.withColumn("range_start", start).withColumn("range_end", end)
