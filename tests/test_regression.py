import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumetrics.functions.tails import f_upper, t_quantile, t_two_sided
from plumetrics.operators import regression

SCHEMA = "season string, y double, a double, b double, c double"


def data(seed=4, n=120, seasons=("s1", "s2", "s3")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = seasons[i % len(seasons)]
        a, b, c = rng.gauss(0, 1), rng.uniform(0, 5), rng.gauss(410, 1)
        y = 410 + (1 + i % len(seasons)) * a - 0.3 * b + 0.1 * c + rng.gauss(0, 0.5)
        out.append((s, y, a, b, c))
    return out


def dense(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    df = len(y) - x.shape[1]
    s2 = resid @ resid / df
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))), df, math.sqrt(s2), resid


def design(rows):
    return [[1.0, *r[2:]] for r in rows], [r[1] for r in rows]


def test_global_model(frame):
    rows = data()
    fitted = regression.fit(frame(rows, SCHEMA), "y", ["a", "b", "c"])
    beta, se, df, sigma, resid = dense(*design(rows))
    got = sorted(fitted.coefficients().collect(), key=lambda r: r.term_order)
    assert [r.term for r in got] == ["(Intercept)", "a", "b", "c"]
    for r, b, s in zip(got, beta, se):
        assert r.estimate == pytest.approx(b, rel=1e-6) and r.std_error == pytest.approx(s, rel=1e-6)
        assert r.p_value == pytest.approx(t_two_sided(b / s, df), abs=1e-9)
        assert r.conf_high == pytest.approx(b + t_quantile(0.95, df) * s, rel=1e-6)
    stats = fitted.fit_statistics().first()
    y = np.array([r[1] for r in rows])
    r2 = 1 - resid @ resid / ((y - y.mean()) ** 2).sum()
    assert stats.r_squared == pytest.approx(r2) and stats.sigma == pytest.approx(sigma) and stats.df_residual == df
    f = r2 / 3 / ((1 - r2) / df)
    assert stats.f_statistic == pytest.approx(f) and stats.p_value == pytest.approx(f_upper(f, 3, df), abs=1e-12)


def test_per_season_models_missing_rows_and_residuals(frame):
    rows = data()
    holes = [("s1", None, 1.0, 1.0, 1.0), ("s1", 1.0, float("nan"), 1.0, 1.0), (None, 1.0, 2.0, None, 1.0)]
    df = frame(rows + holes, SCHEMA)
    fitted = regression.fit(df, "y", ["a", "b", "c"], ["season"])
    stats = {r.season: r for r in fitted.fit_statistics().collect()}
    assert (stats["s1"].n, stats["s1"].n_dropped, stats["s2"].n_dropped) == (40, 2, 0)
    assert stats[None].n == 0 and stats[None].sigma is None
    got = {}
    for r in fitted.coefficients().collect():
        got.setdefault(r.season, {})[r.term] = r.estimate
    for s in ("s1", "s2", "s3"):
        beta, *_, resid = dense(*design([r for r in rows if r[0] == s]))
        assert list(got[s].values()) == pytest.approx(list(beta), rel=1e-6)
    clean = frame(rows, SCHEMA)
    fitted = regression.fit(clean, "y", ["a", "b", "c"], ["season"])
    sums = fitted.residuals(clean).groupBy("season").agg(F.sum("residual").alias("s")).collect()
    assert all(abs(r.s) < 1e-7 for r in sums)
    five = {r.season: r for r in fitted.residual_summary(clean).collect()}
    *_, resid = dense(*design([r for r in rows if r[0] == "s2"]))
    assert five["s2"].res_median == pytest.approx(np.median(resid), abs=1e-6)
    assert five["s2"].res_max == pytest.approx(resid.max(), abs=1e-6)


def test_global_residual_summary(frame):
    rows = data(8)
    df = frame(rows, SCHEMA)
    r = regression.fit(df, "y", ["a", "b", "c"]).residual_summary(df).first()
    *_, resid = dense(*design(rows))
    assert tuple(r) == pytest.approx(tuple(np.quantile(resid, [0, 0.25, 0.5, 0.75, 1])), abs=1e-6)


def test_interaction_equals_dense_fit(frame):
    rows = data()
    levels = ["s1", "s2", "s3"]
    coefficients, stats = regression.fit(frame(rows, SCHEMA), "y", ["a", "b", "c"], ["season"]).with_interaction()
    x = []
    for s, _, *v in rows:
        d = [float(s == other) for other in levels[1:]]
        x.append([1.0, *v, *d, *[value * flag for value in v for flag in d]])
    beta, se, df, sigma, _ = dense(x, [r[1] for r in rows])
    got = sorted(coefficients.collect(), key=lambda r: r.term_order)
    assert [r.term for r in got[:6]] == ["(Intercept)", "a", "b", "c", "seasons2", "seasons3"]
    assert got[6].term == "a:seasons2" and len(got) == 12
    assert [r.estimate for r in got] == pytest.approx(list(beta), rel=1e-4, abs=1e-4)
    assert [r.std_error for r in got] == pytest.approx(list(se), rel=1e-4)
    one = stats.first()
    assert one.df_residual == df and one.sigma == pytest.approx(sigma, rel=1e-8)


def test_interaction_is_the_difference_of_season_models(frame):
    fitted = regression.fit(frame(data(), SCHEMA), "y", ["a", "b", "c"], ["season"])
    alone = {(r.season, r.term): r.estimate for r in fitted.coefficients().collect()}
    pooled = {r.term: r.estimate for r in fitted.with_interaction()[0].collect()}
    assert pooled["b:seasons3"] == pytest.approx(alone["s3", "b"] - alone["s1", "b"], abs=1e-6)


def test_one_season_interaction_and_rank_loss_in_a_season(frame):
    rows = data(seasons=("only",))
    coefficients, _ = regression.fit(frame(rows, SCHEMA), "y", ["a", "b"], ["season"]).with_interaction()
    assert [r.term for r in coefficients.orderBy("term_order").collect()] == ["(Intercept)", "a", "b"]
    flat = [(s, y, a, 2.0 if s == "s2" else b, c) for s, y, a, b, c in data()]
    coefficients, stats = regression.fit(frame(flat, SCHEMA), "y", ["a", "b"], ["season"]).with_interaction()
    got = {r.term: r.estimate for r in coefficients.collect()}
    assert got["b:seasons2"] is None and got["a:seasons2"] is not None
    assert stats.first().model_rank == 8


def test_collinear_predictor_is_left_out(frame):
    rows = [(*r, 2 * r[2] - r[3]) for r in data()]
    df = frame(rows, SCHEMA + ", d double")
    got = {r.term: r for r in regression.fit(df, "y", ["a", "b", "d", "c"]).coefficients().collect()}
    want = {r.term: r for r in regression.fit(df, "y", ["a", "b", "c"]).coefficients().collect()}
    assert got["d"].estimate is None and got["d"].p_value is None
    for term in ("a", "b", "c"):
        assert got[term].estimate == pytest.approx(want[term].estimate, rel=1e-9)


def test_tiny_groups(frame):
    df = frame([("one", 1.0, 2.0, 3.0, 4.0), ("two", 1.0, 2.0, 3.0, 4.0), ("two", 2.0, 3.0, 3.0, 4.0)], SCHEMA)
    fitted = regression.fit(df, "y", ["a", "b"], ["season"])
    got = {(r.season, r.term): r for r in fitted.coefficients().collect()}
    assert got["one", "(Intercept)"].estimate == 1.0 and got["one", "a"].estimate is None
    assert got["two", "a"].estimate == pytest.approx(1.0) and got["two", "a"].std_error is None
    assert {r.season: r.df_residual for r in fitted.fit_statistics().collect()} == {"one": 0, "two": 0}


def test_trend_band(frame):
    rows = [("q", x, 2 * x + (x % 3)) for x in map(float, range(30))] + [("thin", 1.0, 1.0)]
    band = regression.trend_band(frame(rows, "q string, x double, y double"), "x", "y", "q").orderBy("step").collect()
    assert len(band) == 80 and {r.q for r in band} == {"q"}
    x = [[1.0, r[1]] for r in rows[:30]]
    beta, _, df, sigma, _ = dense(x, [r[2] for r in rows[:30]])
    inverse = np.linalg.inv(np.array(x).T @ np.array(x))
    for r in (band[0], band[40], band[-1]):
        v = np.array([1.0, r.x])
        half = t_quantile(0.95, df) * sigma * math.sqrt(v @ inverse @ v)
        assert r.fitted == pytest.approx(v @ beta) and r.conf_high - r.fitted == pytest.approx(half)
