"""Event tables against plain loops."""

import random
from datetime import date, timedelta

import pytest

from spreadlake.operators import events


def day(n):
    return date(2000, 1, 1) + timedelta(days=n)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(2)
    fine = [(rng.choice("ab"), day(rng.randrange(400)), float(rng.randrange(50))) for _ in range(300)]
    # one month of one key holds a third of all rows, many of them alike
    fine += [("a", day(40 + k % 9), 7.0) for k in range(150)] + [("a", None, 1.0), (None, day(3), 1.0)]
    spans = [(rng.choice("abc"), i, day(s), day(s + rng.randrange(-5, 90))) for i, s in enumerate(rng.choices(range(400), k=60))] + [("a", 99, None, day(9))]
    return fine, spans, spark.createDataFrame(fine, "k string, d date, v double"), spark.createDataFrame(spans, "k string, event_id int, s date, e date")


@pytest.mark.parametrize("hot", [7, 10**6])
def test_interval_join_finds_every_pair_once(frames, hot):
    fine, spans, f, s = frames
    want = sorted((k, d, v, i) for k, d, v in fine for q, i, a, b in spans if k == q and d and a and a <= d <= b)
    got = events.interval_join(f, s, ["k"], "d", "s", "e", hot_rows=hot).select("k", "d", "v", "event_id").collect()
    assert sorted(tuple(r) for r in got) == want


def test_window_totals_match_the_rows_in_each_window(frames):
    _, _, f, s = frames
    table = s.selectExpr("k", "event_id", "s as day").dropna()
    totals = {r.event_id: (r.n, r.mean) for r in events.window_totals(f, ["k"], "d", "v", table, 1, 2).collect()}
    rows = events.in_window(f, "d", table, 1, 2, keys=["k"]).groupBy("event_id").agg({"v": "avg", "*": "count"}).collect()
    assert {r["event_id"]: r["count(1)"] for r in rows} == {i: n for i, (n, _) in totals.items()}
    for r in rows:
        assert totals[r["event_id"]][1] == pytest.approx(r["avg(v)"])


def test_a_list_and_a_table_of_the_same_events_agree(spark):
    listed = [("x", "2000-03-05"), ("y", "2001-12-31")]
    table = spark.createDataFrame([(k, i, d) for k in "ab" for i, d in listed], "k string, event_id string, day string")
    series = spark.createDataFrame([(k, date(2000, m, 1), float(m)) for k in "ab" for m in range(1, 13) if m != 4], "k string, m date, value double")
    by = ["k", "event_id", "offset", "m", "s"]
    a, b = (events.panels(series, ["k"], e, {"s": series}).select(*by).orderBy(*by).collect() for e in (listed, table))
    assert a == b and len(a) == 2 * 2 * 13
    c, d = (events.coverage(series, ["k"], e, "2001-06-01").orderBy("k", "event_id").collect() for e in (listed, table))
    assert [tuple(x[n] for n in ("k", "event_id", "present", "hole", "future", "after_end")) for x in c] == [
        tuple(x[n] for n in ("k", "event_id", "present", "hole", "future", "after_end")) for x in d
    ]


def test_a_table_without_keys_is_refused(spark):
    table = spark.createDataFrame([("x", "2000-03-05")], "event_id string, day string")
    with pytest.raises(ValueError, match="keys"):
        events.windows(spark.createDataFrame([("a",)], "k string"), table)


def test_many_events_are_not_broadcast(spark):
    table = spark.range(200_000).selectExpr("concat('k', id % 50) k", "id event_id", "date_add(date'2000-01-01', cast(id % 700 as int)) day")
    series = spark.range(50 * 24).selectExpr("concat('k', id % 50) k", "add_months(date'2000-01-01', cast(id div 50 as int)) m", "cast(id as double) value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = events.panels(series, ["k"], table, {"s": series})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "CartesianProduct" not in plan
        assert out.count() == 200_000 * 13
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
