import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from spreadlake.operators import aggregates, calendar_ops, ranking

import numpy as np


def test_thin_and_empty_months(spark):
    rows = [("a", date(2024, 1, d), float(d)) for d in range(1, 21)]
    rows += [("a", date(2024, 2, 5), 1.0), ("a", date(2024, 4, 2), None)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {r.period.isoformat(): (r.value, r.observations) for r in calendar_ops.period_mean(df, ["k"], "d", "v").collect()}
    assert got == {
        "2024-01-01": (10.5, 20), "2024-02-01": (None, 1), "2024-03-01": (None, 0), "2024-04-01": (None, 0),
    }


def test_single_series_has_no_key_column(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 3, 1), 3.0)], "d date, v double")
    out = calendar_ops.period_mean(df, [], "d", "v", min_obs=1)
    assert set(out.columns) == {"period", "value", "observations"} and out.count() == 3


def test_gaps_by_grain(spark):
    days = [date(2024, 1, 5), date(2024, 1, 9), date(2024, 1, 24)]
    df = spark.createDataFrame([(d,) for d in days], "d date")

    def found(grain):
        return sorted(r.gap.isoformat() for r in calendar_ops.gaps(df, [], "d", grain).collect())

    assert found("weekly") == ["2024-01-15"]
    assert found("monthly") == []
    expected = [d for d in (days[0] + timedelta(n) for n in range(20)) if d < days[-1] and d not in days and d.weekday() < 5]
    assert found("daily") == [d.isoformat() for d in expected]


def test_longest_run_is_calendar_and_earliest(spark):
    months = [(date(2020, m, 1), True) for m in (1, 2, 5, 6, 9)]
    df = spark.createDataFrame(months, "m date, f boolean")
    r = calendar_ops.longest_run(df, [], "m", F.col("f")).first()
    assert (r.first.isoformat(), r["last"].isoformat(), r.length) == ("2020-01-01", "2020-02-01", 2)


def test_gap_clusters_match_brute_force(spark):
    rng = random.Random(7)
    values = sorted(rng.uniform(0, 300) for _ in range(200))
    groups = [[values[0]]]
    for v in values[1:]:
        (groups[-1].append(v) if v - groups[-1][-1] <= 2.5 else groups.append([v]))
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    got = sorted((r.first, r["last"], r.members) for r in calendar_ops.gap_clusters(df, [], "x", 2.5).collect())
    assert got == [(g[0], g[-1], len(g)) for g in groups]


def test_exact_quantiles_with_one_hot_key(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.normal(size=3000), 2), "cold": rng.normal(size=7), "one": np.array([4.0]),
            "wide": np.concatenate(([0.0, -1e300, 1e300, 5e-324], rng.normal(size=900) * 1e-9, 3 + rng.normal(size=900) * 1e-12))}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    for most in (5, 10**6):
        got = aggregates.exact_quantiles(df, ["k"], "x", qs, slice_values=most).collect()
        assert len(got) == len(data)
        for r in got:
            for name, q in qs.items():
                want = np.quantile(data[r.k], q)
                assert abs(r[name] - want) <= 1e-12 * max(1, abs(want))
    assert aggregates.exact_quantiles(df.filter("false"), ["k"], "x", qs).count() == 0


def test_percentile_counts_itself_and_skips_missing(spark):
    rows = [(date(2024, m, 1), v) for m, v in ((1, 5.0), (2, None), (3, 1.0), (4, 5.0))]
    out = ranking.trailing_rank(spark.createDataFrame(rows, "m date, v double"), [], "m", "v").orderBy("m").collect()
    assert [r.percentile for r in out] == [100.0, None, 50.0, 100.0]
    assert [r.rank_from_top for r in out] == [1, None, 2, 1]


def test_carrier_ties_and_missing(spark):
    rows = [("x", "b", 2.0), ("x", "a", 2.0), ("x", "c", None), ("y", "a", None)]
    got = {r.k: r.carrier for r in ranking.carrier(spark.createDataFrame(rows, "k string, p string, c double"), ["k"], "p", "c").collect()}
    assert got == {"x": "a", "y": None}
