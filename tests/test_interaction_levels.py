"""The interaction model solved level by level against the pooled equations solved at once."""

import random

import pytest

from plumetrics.operators import ranking, regression

SCHEMA = "level string, y double, a double, b double"


def rows_of(levels, n=9, seed=3):
    draw = random.Random(seed)
    rows = []
    for i, level in enumerate(levels):
        for _ in range(n):
            a, b = draw.gauss(5, 2), draw.gauss(-3, 4)
            rows.append((level, 2 + i + (1 + 0.1 * i) * a - 0.5 * b + draw.gauss(0, 1), a, b))
    return rows


def figures(frames):
    coefficients, stats = frames
    terms = {r.term: r for r in coefficients.orderBy("term_order").collect()}
    return terms, stats.first()


def same(fitted):
    got, want = figures(fitted.with_interaction()), figures(fitted._dense_interaction(0.95))
    assert list(got[0]) == list(want[0])
    for term, row in want[0].items():
        assert got[0][term].term_order == row.term_order
        for field in ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"):
            a, b = got[0][term][field], row[field]
            assert (a is None) == (b is None), (term, field, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-6, abs=1e-8), (term, field)
    for field in want[1].asDict():
        assert got[1][field] == pytest.approx(want[1][field], rel=1e-8, abs=1e-12), field


def test_levels_equal_the_pooled_equations(frame):
    same(regression.fit(frame(rows_of(["p", "q", "r", "s"]), SCHEMA), "y", ["a", "b"], ["level"]))


def test_a_predictor_aliased_within_a_later_level(frame):
    rows = [(s, y, 4.0 if s == "q" else a, 2 * a + 1 if s == "r" else b) for s, y, a, b in rows_of(["p", "q", "r", "s"])]
    same(regression.fit(frame(rows, SCHEMA), "y", ["a", "b"], ["level"]))


def test_a_level_with_one_row_and_rows_without_a_level(frame):
    rows = rows_of(["p", "q"]) + [("t", 1.0, 2.0, 3.0), (None, 5.0, 1.0, 1.0), ("u", None, 1.0, 1.0)]
    got, stats = figures(regression.fit(frame(rows, SCHEMA), "y", ["a", "b"], ["level"]).with_interaction())
    assert got["levelt"].estimate is not None and got["a:levelt"].estimate is None and "levelu" not in got
    assert stats.n == 19 and stats.model_rank == 7


def test_a_predictor_aliased_within_the_first_level_is_solved_at_once(frame):
    rows = [(s, y, 4.0 if s == "p" else a, b) for s, y, a, b in rows_of(["p", "q", "r"])]
    same(regression.fit(frame(rows, SCHEMA), "y", ["a", "b"], ["level"]))


def test_no_rows(frame):
    coefficients, stats = regression.fit(frame([], SCHEMA), "y", ["a", "b"], ["level"]).with_interaction()
    assert coefficients.count() == 0 and stats.count() == 0


def test_many_levels(frame):
    rows = rows_of([f"l{i:05d}" for i in range(3000)], n=5)
    coefficients, stats = regression.fit(frame(rows, SCHEMA), "y", ["a", "b"], ["level"]).with_interaction()
    assert coefficients.count() == 9000 and stats.first().model_rank == 9000
    assert coefficients.agg({"term_order": "max"}).first()[0] == 8999


def test_rows_are_numbered_in_order(frame):
    df = frame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    got = sorted((r.v, r.place) for r in ranking.numbered(df, ["v"], "numbers").collect())
    assert got == [(i, i) for i in range(1000)]
