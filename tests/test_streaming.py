"""Streams over a table of several files: results do not depend on the batching."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spreadlake.operators.quality import Spec
from spreadlake.streaming import incremental

SCHEMA = "k string, ts timestamp, value double, doc int, provisional boolean"


def rows(n=600):
    start = datetime(2024, 1, 1)
    return [("ab"[i % 2], start + timedelta(hours=i), float((i * 37) % 101), i % 5, i % 3 == 0) for i in range(n)]


@pytest.fixture
def folders(spark, tmp_path):
    """The same rows as one file and as seven, in order of time."""
    data = rows()
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/one")
    for i in range(7):
        part = data[i * len(data) // 7 : (i + 1) * len(data) // 7]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many")
    return f"{tmp_path}/one", f"{tmp_path}/many"


def ways(spark, folders):
    one, many = folders
    return [(one, 1), (many, 1), (many, 3), (many, 7)]


def test_period_mean_is_the_same_in_any_batching(spark, folders):
    got = set()
    for path, per in ways(spark, folders):
        means, late = incremental.streaming_period_mean(incremental.table_stream(spark, path, per), ["k"], "ts", "value", 5, delay="40 days")
        assert late == 0
        got.add(tuple(sorted((r.k, r.period, round(r.value or -1, 9), r.observations) for r in means.collect())))
    assert len(got) == 1 and sum(x[3] for x in got.pop()) == 600


def test_rows_of_closed_days_are_dropped_and_counted(spark, tmp_path):
    data = rows()
    path = f"{tmp_path}/t"
    spark.createDataFrame(data[300:], SCHEMA).coalesce(1).write.parquet(path)
    state = f"{tmp_path}/state"

    def run():
        return incremental.streaming_period_mean(incremental.table_stream(spark, path), ["k"], "ts", "value", 1, delay="2 days", folder=state)

    first, none = run()
    assert first.agg(F.sum("observations")).first()[0] == 300 and none == 0
    spark.createDataFrame(data[:300], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    # a day that is still open takes its row
    spark.createDataFrame([("a", data[-1][1], 5.0, 0, False)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    means, late = run()
    assert late > 0
    assert means.agg(F.sum("observations")).first()[0] == 301


def test_vintage_upsert_is_the_same_in_any_batching(spark, folders):
    got = set()
    for path, per in ways(spark, folders):
        stream = incremental.table_stream(spark, path, per).withColumn("day", F.to_date("ts"))
        table = incremental.streaming_vintage_upsert(stream, ["k", "day"], "ts", "doc", "provisional", ["value"])
        got.add(tuple(sorted((r.k, r.day, r.value, r.provisional, r.n_prints, r.first_vintage, r.revised, r.largest_revision, tuple(r.documents)) for r in table.collect())))
    assert len(got) == 1 and sum(x[4] for x in got.pop()) == 600


def test_guard_judges_a_unit_on_all_its_rows(spark, folders):
    spec = Spec(date="ts", bounds={"value": (0.0, 99.5)}, min_rows=12, unique_dates=False)
    got = set()
    for path, per in ways(spark, folders):
        stream = incremental.table_stream(spark, path, per).withColumn("day", F.to_date("ts"))
        good, bad = incremental.streaming_guarded_append(stream, ["k", "day"], spec)
        got.add((good.count(), bad.count(), tuple(sorted({(r.k, r.day, tuple(r.problems)) for r in bad.collect()}))))
    assert len(got) == 1
    good, bad, _ = got.pop()
    assert good + bad == 600 and good and bad


def test_o01_averages_all_rows_of_part_files_in_any_order(spark, tmp_path):
    from types import SimpleNamespace

    from spreadlake.plans import q_stream

    data = [(k, ts, v) for k, ts, v, _, _ in rows(6000)]
    shuffled = [data[(i * 2777) % 6000] for i in range(6000)]
    for i in range(5):
        part = shuffled[i * 1200 : (i + 1) * 1200]
        spark.createDataFrame(part, "event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = q_stream.o01(SimpleNamespace(spark=spark, sf_dir=str(tmp_path)))
    assert got.agg(F.sum("observations")).first()[0] == 6000
