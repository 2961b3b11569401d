import random
from datetime import date

import pytest

from spreadlake.operators import quality
from spreadlake.sources import scans, sinks


def test_every_rule_is_reported(spark):
    rows = [
        ("a", "2024-01-01", "1.0", 0), ("a", "2024-01-01", "99.0", 1), ("a", "oops", "x", 2), ("a", None, None, 3),
        ("b", "2024-01-01", "1.0", 4), ("b", "2024-01-02", "2.0", 5),
    ]
    df = spark.createDataFrame(rows, "k string, date string, v string, pos long")
    spec = quality.Spec(required=("v",), bounds={"v": (0, 10)}, min_rows=2, min_observations={"v": 2}, position="pos")
    got = {r.k: set(r.problems) for r in quality.validate(df, ["k"], spec).collect()}
    assert got["b"] == set()
    assert got["a"] == {"unparseable_dates", "empty_dates", "duplicate_dates", "outside_bounds_v", "non_numeric_v"}


def test_a_missing_column_is_a_listed_problem(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),)], "date date")
    r = quality.validate(df, [], quality.Spec(required=("v",))).first()
    assert r.problems == ["missing_column_v"] and r.rows == 1


def test_order_breaks_across_slices(spark):
    rng = random.Random(1)
    days = [date(2024, 1, 1 + rng.randrange(28)) for _ in range(300)]
    want = sum(b < a for a, b in zip(days, days[1:]))
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "pos long, d date").repartition(6)
    assert quality.order_breaks(df, [], "d", "pos", width=7).first().order_breaks == want


def test_guarded_append_keeps_previous_on_failure(spark):
    old = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("b", date(2024, 1, 1), 1.0)], "k string, date date, v double")
    new = spark.createDataFrame([("a", date(2024, 1, 2), 2.0), ("b", date(2024, 1, 2), 999.0)], "k string, date date, v double")
    merged, verdict = quality.guarded_append(old, new, ["k"], quality.Spec(bounds={"v": (0, 10)}))
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0)]
    assert {r.k: r.accepted for r in verdict.collect()} == {"a": True, "b": False}


def test_provisional_tail(spark):
    rows = [("a", date(2024, m, 1), f) for m, f in ((1, True), (2, False), (3, True), (4, True))] + [("b", date(2024, 1, 1), False)]
    df = spark.createDataFrame(rows, "k string, m date, f boolean")
    got = {r.k: r.provisional_from for r in quality.provisional_from(df, ["k"], "m", "f").collect()}
    assert got == {"a": date(2024, 3, 1), "b": None}


def test_header_is_matched_by_label():
    assert scans.match_header(["DATE", " Value "], {"v": ["value"]}) == {"v": " Value "}
    with pytest.raises(ValueError):
        scans.match_header(["DATE", "price"], {"v": ["value"]})


def test_missing_table_is_a_condition_of_its_own(spark, tmp_path):
    with pytest.raises(scans.MissingTable):
        scans.read_series(spark, str(tmp_path / "none"), "d date")


def test_unchanged_content_is_not_rewritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, -0.0)], "k int, v double")
    root = str(tmp_path / "mart")
    assert sinks.publish(df, root, ["k"]) is True
    assert sinks.publish(df.orderBy("v"), root, ["k"]) is False
    assert sinks.publish(df.filter("k = 1"), root, ["k"]) is True
    assert sinks.current(spark, root).count() == 1


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "shared")
    first, second = (spark.createDataFrame([(1, x)], "k int, v double") for x in (1.0, 2.0))
    assert sinks.publish(first, root)
    seen = sinks.last_commit(spark, root)
    assert sinks.publish(second, root, expected=seen)
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(first.filter("k > 1"), root, expected=seen)
    with pytest.raises(sinks.PublishConflict):
        sinks.publish(first, root, expected=seen)
    assert sinks.last_commit(spark, root) == 2 and sinks.current(spark, root).first().v == 2.0
    assert len(list((tmp_path / "shared").glob("v-*"))) == 2


def test_profile_knows_vintage_and_provisional_tail(spark):
    rows = [("a", date(2024, m, 1), float(m), f"v{m}", m in (2, 4, 5)) for m in range(1, 6)] + [("b", date(2024, 1, 1), None, "v9", True), ("c", date(2024, 1, 1), 1.0, None, None)]
    df = spark.createDataFrame(rows, "k string, d date, v double, doc string, guess boolean")
    declared = spark.createDataFrame([("a", "published")], "k string, method string")
    got = {r.k: r for r in quality.profile(df, ["k"], "d", "v", "monthly", vintage="doc", flag="guess", declared=declared).collect()}
    assert (got["a"].vintage, got["a"].provisional_from, got["a"].method) == ("v5", date(2024, 4, 1), "published")
    assert (got["b"].vintage, got["b"].provisional_from, got["b"].status) == (None, None, "failed")
    assert got["c"].provisional_from is None
