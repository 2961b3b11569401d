from datetime import date

import numpy as np
import pytest

from spreadlake.operators import regress, threshold


def months(n):
    return [date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


def planted(spark, n=120, seed=5):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for key, slope in (("a", 1.5), ("b", -0.7)):
        x = np.cumsum(rng.normal(size=n)) + 1000
        z = rng.normal(size=n)
        y = 3 + slope * x + 0.5 * z + rng.normal(size=n)
        data[key] = (x, z, y)
        rows += [(key, m, float(p), float(q), float(r)) for m, p, q, r in zip(months(n), x, z, y)]
    return spark.createDataFrame(rows, "k string, m date, x double, z double, y double").repartition(3), data


def robust_covariance(x, residuals, reach):
    """Var(b) = A e e' A' with every pair of periods weighted by how far apart they are; A maps y to b."""
    periods = np.arange(len(residuals))
    apart = np.abs(np.subtract.outer(periods, periods))
    triangle = np.clip((reach + 1 - apart) / (reach + 1), 0, None)
    a = np.linalg.pinv(x)
    small_sample = len(residuals) / (len(residuals) - x.shape[1])
    return small_sample * a @ (triangle * np.outer(residuals, residuals)) @ a.T


def test_coefficients_and_hac_errors_match_numpy(spark):
    df, data = planted(spark)
    xs = ["x", "z"]
    terms = {**regress.single_terms(["const", *xs]), "both": {"x": 1.0, "z": 2.0}}
    df2 = df.withColumnRenamed("k", "key")
    scored = regress.score(df2, regress.ols(df2, ["key"], "y", xs), ["key"], "y", xs)
    rows = {(r.key, r.term): r for r in regress.hac(scored, ["key"], "m", xs, terms).collect()}
    for key, (x, z, y) in data.items():
        design = np.column_stack([np.ones(len(x)), x, z])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        cov = robust_covariance(design, y - design @ beta, reach=4)
        for i, name in enumerate(["const", "x", "z"]):
            assert rows[key, name].coef == pytest.approx(beta[i], rel=1e-8)
            assert rows[key, name].se == pytest.approx(np.sqrt(cov[i, i]), rel=1e-6)
        w = np.array([0, 1.0, 2.0])
        assert rows[key, "both"].se == pytest.approx(np.sqrt(w @ cov @ w), rel=1e-6)


def test_zero_column_gets_no_weight(spark):
    df, data = planted(spark)
    df = df.withColumnRenamed("k", "key").selectExpr("*", "0.0 as dead")
    r = regress.ols(df, ["key"], "y", ["x", "dead"]).filter("key = 'a'").first()
    assert r.k == 2 and r.beta[2] == 0.0
    x, _, y = data["a"]
    assert r.beta[1] == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-8)


def test_forecasts_never_see_the_future(spark):
    df, _ = planted(spark)
    df = df.withColumnRenamed("k", "key")
    clean = {(r.key, r.m): r.forecast for r in regress.expanding_forecasts(df, ["key"], "m", "y", ["x", "z"], 60).collect()}
    poisoned = df.selectExpr("key", "m", "x", "z", "case when m >= date '2008-01-01' then 1e6 else y end y")
    dirty = {(r.key, r.m): r.forecast for r in regress.expanding_forecasts(poisoned, ["key"], "m", "y", ["x", "z"], 60).collect()}
    assert len(clean) == 120
    for at, value in clean.items():
        if at[1] <= date(2008, 1, 1):
            assert dirty[at] == value


def test_two_stage_matches_closed_form(spark):
    rng = np.random.default_rng(9)
    n = 200
    z = rng.normal(size=n)
    e = rng.normal(size=n)
    x = 0.8 * z + e
    y = 2 * x + 3 * e + rng.normal(size=n)
    df = spark.createDataFrame([("a", m, float(a), float(b), float(c)) for m, a, b, c in zip(months(n), z, x, y)], "key string, m date, z double, x double, y double")
    r = regress.instrument(df, ["key"], "m", "y", "x", "z", []).first()
    assert r.iv_coef == pytest.approx(np.cov(z, y)[0, 1] / np.cov(z, x)[0, 1], rel=1e-8)
    assert r.ols_coef == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-8)
    assert r.weak is False and abs(r.iv_coef - 2) < abs(r.ols_coef - 2)


def test_short_post_sample_gets_no_verdict(spark):
    df, _ = planted(spark)
    df = df.withColumnRenamed("k", "key")
    got = {r.verdict for r in regress.break_residuals(df, ["key"], "m", "y", ["x"], "2009-08-01").collect()}
    assert got == {"too_short"}
    got = {r.verdict for r in regress.break_residuals(df, ["key"], "m", "y", ["x"], "2008-08-01").collect()}
    assert got == {"reportable"}


def kinked(spark, noise, seed=4, n=160, slope=1.0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-5, 15, size=n)
    y = 80 - slope * np.maximum(4.0 - x, 0) + noise * rng.normal(size=n)
    rows = [("a", m, float(p), float(q)) for m, p, q in zip(months(n), x, y)]
    return spark.createDataFrame(rows, "key string, m date, x double, y double"), x, y


def test_profile_matches_brute_force(spark):
    df, x, y = kinked(spark, 1.0)
    lo, hi = np.quantile(x, 0.05), np.quantile(x, 0.95)
    grid = lo + 0.25 * np.arange(int(np.floor((hi - lo) / 0.25)) + 1)
    want = []
    for tau in grid:
        d = np.column_stack([np.ones(len(x)), np.maximum(tau - x, 0)])
        b = np.linalg.lstsq(d, y, rcond=None)[0]
        want.append(float(((y - d @ b) ** 2).sum()))
    got = threshold.profile(df, ["key"], "x", "y").orderBy("i").collect()
    assert len(got) == len(grid)
    assert np.allclose([r.ssr for r in got], want, rtol=1e-9)
    assert np.allclose([r.tau for r in got], grid)
    assert threshold.search(df, ["key"], "x", "y").first().tau == pytest.approx(grid[int(np.argmin(want))])


def test_planted_kink_is_identified_and_noise_is_not(spark):
    df, _, _ = kinked(spark, 0.3)
    r = threshold.verdict(df, ["key"], "m", "x", "y", replications=60).first()
    assert r.identified and abs(r.tau - 4.0) < 1.0 and r.slope_below == pytest.approx(1.0, abs=0.1)
    flat, _, _ = kinked(spark, 3.0, slope=0.0)
    r = threshold.verdict(flat, ["key"], "m", "x", "y", replications=60).first()
    assert not r.identified and len(r.reasons) > 0


def test_a_short_sample_identifies_nothing(spark):
    df, _, _ = kinked(spark, 0.1, n=20)
    r = threshold.verdict(df, ["key"], "m", "x", "y", replications=20).first()
    assert not r.identified and "too_few_months" in r.reasons


def test_resamples_match_a_plain_search(spark):
    df, x, y = kinked(spark, 2.0, n=60)
    bounds, blocks = threshold.grid(df, ["key"], "x"), threshold.block_length(df, ["key"], "m", "y")
    lo, cells = bounds.first().lo, bounds.first().cells
    got = {r.rep: r.tau for r in threshold.bootstrap_draws(df, ["key"], "m", "x", "y", blocks, bounds, 40).collect()}
    at = threshold.block_positions(60, blocks.first().block, np.arange(40), 62)
    for rep in range(40):
        xs, ys = x[at[rep]], y[at[rep]]
        fits = []
        for i in range(cells):
            h = np.maximum(lo + 0.25 * i - xs, 0)
            d = np.column_stack([np.ones(60), h])
            fits.append(((ys - d @ np.linalg.lstsq(d, ys, rcond=None)[0]) ** 2).sum())
        best = lo + 0.25 * int(np.argmin(np.round(np.array(fits) / ((ys - ys.mean()) ** 2).sum(), 11)))
        assert got[rep] == pytest.approx(best)


def test_bootstrap_is_reproducible(spark):
    df, _, _ = kinked(spark, 2.0)
    bounds = threshold.grid(df, ["key"], "x")
    blocks = threshold.block_length(df, ["key"], "m", "y")

    def run(frame):
        d = threshold.bootstrap_draws(frame, ["key"], "m", "x", "y", blocks, bounds, 30)
        return sorted((r.rep, round(r.tau, 9)) for r in d.collect())

    assert run(df) == run(df.repartition(7))


def test_four_candidates_a_gap_find_what_the_whole_profile_holds(spark):
    rng = np.random.default_rng(11)
    rows = []
    for key in range(12):
        x = np.round(rng.normal(scale=40, size=70), 0 if key % 2 else 3)
        y = rng.normal(size=70) - (0.02 * key) * np.maximum(rng.normal(scale=20) - x, 0)
        rows += [(str(key), m, float(p), float(q)) for m, p, q in zip(months(70), x, y)]
    df = spark.createDataFrame(rows, "key string, m date, x double, y double")
    for quantiles in ((0.05, 0.95), (0.0, 1.0)):
        prof = threshold.profile(df, ["key"], "x", "y", quantiles, 0.05).toPandas()
        found = {r.key: r for r in threshold.search(df, ["key"], "x", "y", quantiles, 0.05).collect()}
        for key, own in prof.sort_values("i").groupby("key"):
            assert list(own["i"]) == list(range(len(own)))
            best = own["ssr"].min()
            assert found[key].ssr == pytest.approx(best, rel=1e-12)
            assert found[key].tau == pytest.approx(own.loc[own["ssr"] <= best * (1 + 1e-14), "tau"].iloc[0])
