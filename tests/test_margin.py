from datetime import date

import pytest
from pyspark.sql import functions as F

from spreadlake.functions import text
from spreadlake.operators import margin, spread, vintage


def test_unit_rules(spark):
    rows = [(745.0, "usd_t", 7.45), (80.0, "usd_bbl", None), (80.0, "usd_bbl", 7.45), (80.0, "usd_t", None), (80.0, "usd_t", 0.0), (80.0, "eur", None)]
    good, bad = spread.convert(spark.createDataFrame(rows, "price double, unit string, bbl_per_t double"))
    assert sorted(r.usd_bbl for r in good.collect()) == [80.0, 100.0]
    assert sorted(r.reason for r in bad.collect()) == ["factor_missing", "factor_on_per_barrel_price", "factor_zero", "unknown_unit"]


def test_misaligned_legs_are_refused_not_dropped(spark):
    legs = spark.createDataFrame([("a", date(2024, 1, 1), "monthly", 1.0), ("a", date(2024, 2, 1), "weekly", 1.0), ("a", date(2024, 3, 1), "monthly", 1.0)], "p string, date date, window string, price double")
    bench = spark.createDataFrame([(date(2024, 1, 1), "monthly", 0.5), (date(2024, 2, 1), "monthly", 0.5)], "date date, window string, bench double")
    good, bad = spread.aligned_join(legs, bench, [])
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["no_benchmark_on_date", "window_differs"]


def _facts(spark, threshold=3.0):
    return spark.createDataFrame([(1, 0.5, 0.2, 10.0, 1.0, threshold)], "k int, residual double, gas_intensity double, gas double, other_cost double, threshold double")


def test_missing_leg_leaves_a_hole_but_keeps_the_carrier(spark):
    slate = spark.createDataFrame([(1, "a", 0.5, 10.0), (1, "b", 0.3, None)], "k int, product string, yield double, spread double")
    r = margin.evaluate(slate, _facts(spark), ["k"]).first()
    assert r.after_gas is None and r.carrier == "a" and r.carrier_contribution == 5.0


def test_breakevens_round_trip(spark):
    slate = spark.createDataFrame([(1, "a", 0.5, 10.0), (1, "b", 0.3, 20.0)], "k int, product string, yield double, spread double")
    base = margin.evaluate(slate, _facts(spark), ["k"], own="a").withColumn("margin_basis", F.lit("gross_of_gas"))
    r = base.select(margin.breakeven_gas().alias("g"), margin.breakeven_spread().alias("s")).first()
    back = margin.evaluate(slate, _facts(spark).withColumn("gas", F.lit(r.g)), ["k"]).first()
    assert abs(back.after_gas - 3.0) < 1e-9
    slate2 = slate.withColumn("spread", F.when(F.col("product") == "a", F.lit(r.s)).otherwise(F.col("spread")))
    assert abs(margin.evaluate(slate2, _facts(spark), ["k"]).first().after_gas - 3.0) < 1e-9


def test_a_product_without_a_row_leaves_a_hole_and_is_named(spark):
    slate = spark.createDataFrame([(1, "a", 0.5, 10.0)], "k int, product string, yield double, spread double")
    r = margin.evaluate(slate, _facts(spark), ["k"], products=["a", "b"], own="b").first()
    assert r.attributed is None and r.missing == ["b"] and r.reason == "slate_incomplete" and r.others == 5.0
    official = spark.createDataFrame([(1, 8.0)], "k int, official double")
    d = margin.decompose(slate, official, ["k"], products=["a", "b"]).first()
    assert d.residual is None and d.missing == ["b"] and d.reason == "a_spread_is_missing"
    nothing = margin.evaluate(slate.filter("k = 2"), _facts(spark), ["k"], products=["a", "b"]).first()
    assert nothing.missing == ["a", "b"] and nothing.after_gas is None


def test_breakeven_needs_no_spread_of_its_own(spark):
    slate = spark.createDataFrame([(1, "a", 0.5, None), (1, "b", 0.3, 20.0)], "k int, product string, yield double, spread double")
    r = margin.evaluate(slate, _facts(spark), ["k"], products=["a", "b"], own="a").select(margin.breakeven_spread().alias("s")).first()
    assert r.s == pytest.approx((3.0 + 2.0 + 1.0 - 0.5 - 6.0) / 0.5)


def test_evaluate_refuses_a_margin_charged_twice(spark):
    slate = spark.createDataFrame([(1, "a", 0.5, 10.0)], "k int, product string, yield double, spread double")
    r = margin.evaluate(slate, _facts(spark).withColumn("margin_basis", F.lit("net_of_gas")), ["k"]).first()
    assert r.reason == "gas_counted_twice" and r.after_gas is None


def test_slots_lose_no_reading(spark):
    rows = [(1, d, float(d)) for d in range(15)] + [(2, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, doc int, value double")
    back = vintage.from_slots(vintage.to_slots(df, ["k"], "doc", "value", 4), ["k"], 4)
    assert sorted((r.k, r.doc, r.value) for r in back.collect()) == sorted(rows)
    assert [r.slot for r in back.filter("k = 1").orderBy("doc").collect()] == list(range(1, 16))


def test_net_margin_refuses_a_cost(spark):
    rows = [("net_of_gas", 0.0), ("net_of_gas", 1.0), ("net_of_gas", None), ("gross_of_gas", 1.0)]
    df = spark.createDataFrame(rows, "margin_basis string, gas_cost double")
    assert [r.x for r in df.select(margin.double_count_reason().alias("x")).collect()] == [None, "gas_counted_twice", "gas_counted_twice", None]


def test_print_text_round_trip(spark):
    df = spark.createDataFrame([(date(2024, 3, 20), True, 946.5, None)], "v date, p boolean, a double, b double")
    entry = df.select(vintage.format_print(F.col("v"), F.col("p"), {"a": F.col("a"), "b": F.col("b")}).alias("e"))
    r = entry.select("e", vintage.parse_print("e").alias("p")).first()
    assert r.e == "2024-03-20|provisional|a=946.5"
    assert r.p.vintage == date(2024, 3, 20) and r.p["values"] == {"a": 946.5}


def test_final_beats_a_later_provisional(spark):
    rows = [(1, date(2024, 3, 1), "d1", True, 10.0), (1, date(2024, 4, 1), "d2", False, 12.0), (1, date(2024, 5, 1), "d3", True, 99.0)]
    df = spark.createDataFrame(rows, "k int, v date, doc string, p boolean, x double")
    r = vintage.final_beats_provisional(df, ["k"], "v", "doc", "p", ["x"]).first()
    assert (r.x, r.provisional, r.n_prints, r.revised, r.max_revision) == (12.0, False, 3, True, 2.0)
    one = vintage.final_beats_provisional(df.limit(1), ["k"], "v", "doc", "p", ["x"]).first()
    assert one.max_revision is None and one.revised is False


@pytest.mark.parametrize("printed, want", [
    ("1,234.5", 1234.5), ("1 349", 1349.0), ("-3", -3.0), ("+2.5", 2.5), ("n/a", None), ("12 (b)", None), ("", None),
])
def test_number_cells(spark, printed, want):
    assert spark.createDataFrame([(printed,)], "c string").select(text.parse_number("c").alias("x")).first().x == want


def test_printed_rows_keep_numbers_of_the_label(spark):
    df = spark.createDataFrame([("Fuel oil (380 cst 3.5% S)  12.5 –3.25R +1",)], "line string")
    label, tail = text.split_row("line")
    r = df.select(label.alias("a"), tail.alias("b")).first()
    assert r.a == "Fuel oil (380 cst 3.5% S)" and r.b == "12.5 –3.25R +1"


def test_french_dates(spark):
    df = spark.createDataFrame([("4-sept.-26",), ("31-févr.-26",), ("sept",)], "c string")
    assert [r.d for r in df.select(text.french_date("c").alias("d")).collect()] == [date(2026, 9, 4), None, None]


def test_no_waterfall_over_part_of_a_slate(spark):
    from spreadlake.operators import margin

    rows = [(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0), (2, "b", None), (3, "b", 4.0), (3, "z", 9.0)]
    df = spark.createDataFrame(rows, "m int, p string, c double")
    refused = {r.m: (r.legs, list(r.missing)) for r in margin.incomplete_slates(df, ["m"], "p", "c", ["b", "a"]).collect()}
    assert refused == {2: (1, ["b"]), 3: (1, ["a"])}
    kept = margin.complete_slates(df, ["m"], "p", "c", ["b", "a"]).collect()
    assert sorted((r.m, r.p) for r in kept) == [(1, "a"), (1, "b")]
