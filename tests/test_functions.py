import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumetrics.functions import dates, labels, scalars, tails


def column(frame, values, kind, build):
    rows = frame([(v,) for v in values], f"v {kind}").select(build(F.col("v")).alias("r")).collect()
    return [r.r for r in rows]


def test_season_bounds(frame):
    cases = [
        (-60.1, 1, "Other"), (-60.0, 1, "Summer (South)"), (-20.1, 4, "Autumn (South)"), (-20.0, 1, "Tropical Dry"),
        (20.0, 5, "Tropical Wet"), (20.0, 11, "Tropical Dry"), (20.1, 12, "Winter (North)"), (60.0, 7, "Summer (North)"),
        (60.1, 7, "Other"), (None, 7, "Other"), (0.0, None, "Tropical Dry"), (40.0, None, "Other"),
        (40.0, 3, "Spring (North)"), (40.0, 9, "Autumn (North)"), (-40.0, 8, "Winter (South)"), (-40.0, 11, "Spring (South)"),
    ]
    df = frame([(a, b) for a, b, _ in cases], "lat double, month bigint")
    got = [r.s for r in df.select(labels.season(F.col("lat"), F.col("month")).alias("s")).collect()]
    assert got == [c for *_, c in cases]
    assert set(got) <= set(labels.SEASONS)


def test_time_of_day(frame):
    got = column(frame, [0, 5, 6, 11, 12, 17, 18, 23, None], "int", labels.time_of_day)
    assert got == ["Night"] * 2 + ["Morning"] * 2 + ["Afternoon"] * 2 + ["Evening"] * 3


def test_small_labels(frame):
    assert column(frame, [49.9, 50.0, None], "double", labels.coastal_status) == ["Coastal", "Inland", None]
    assert column(frame, [-0.1, 0.0, 1.0, 1.1, None], "double", labels.iqr_zone) == [
        "below_q1", "middle", "middle", "above_q3", None]
    assert column(frame, ["Winter (North)", "Tropical Wet", "Autumn (South)", "Other"], "string", labels.hemisphere) == [
        "North", "Tropical", "South", None]
    assert column(frame, ["a", "b", None], "string", lambda c: labels.recode(c, {"a": "A"})) == ["A", "b", None]


def test_quadrants(frame):
    df = frame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, 1.0), (1.0, None)], "s double, c double")
    half = F.lit(0.5)
    got = [tuple(r) for r in df.select(
        labels.split_quadrant(F.col("s"), F.col("c"), half, half),
        labels.upper_quartile_quadrant(F.col("s"), F.col("c"), half, half),
    ).collect()]
    assert [g[0] for g in got] == [
        "High SIF\nHigh CO2", "High SIF\nLow CO2", "Low SIF\nHigh CO2", "Low SIF\nLow CO2", None, None]
    assert [g[1] for g in got] == [
        "HIGH_both", "LOW_emissions_HIGH_conc", "HIGH_emissions_LOW_conc", "LOW_both", "HIGH_emissions_LOW_conc",
        "LOW_emissions_HIGH_conc"]


def test_text_and_numbers(frame):
    assert column(frame, [" a ", "  ", "", None], "string", lambda c: scalars.clean_text(c, "Unknown")) == [
        "a", "Unknown", "Unknown", "Unknown"]
    assert column(frame, [" 12abc", "1.5e2", "-.5", "+3.", "abc", "", None, "Infinity", "NaN", "1e"], "string",
                  scalars.parse_number) == [12.0, 150.0, -0.5, 3.0, None, None, None, None, None, 1.0]
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(frame, values, "double", scalars.is_finite) == [True, False, False, False, False]
    assert column(frame, values, "double", scalars.finite_or_null) == [1.0, None, None, None, None]
    assert column(frame, values[:2] + [None], "double", scalars.number) == [1.0, None, None]
    assert column(frame, [0.01, 0.0], "double", scalars.negative_log10) == [pytest.approx(2.0), None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, frame, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = ["2020-03-08 02:30:00", "2020-03-08T02:30:00Z", "2020-03-08T02:30:00+05:30", "2020-03-08", "10:00:00",
                "", "soon", None]
        df = frame([(t,) for t in text], "v string").select(scalars.parse_time(F.col("v")).cast("string").alias("r"))
        assert [r.r for r in df.collect()] == [
            "2020-03-08 02:30:00", "2020-03-08 02:30:00", "2020-03-07 21:00:00", "2020-03-08 00:00:00", None, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mixed_dates(frame):
    cases = {
        "2020-01-31": (2020, 1, 31), "01/31/2020": (2020, 1, 31), "31.01.2020": (2020, 1, 31), "20200131": (2020, 1, 31),
        "2020-02": (2020, 2, 1), "2/2020": (2020, 2, 1), "03-04-2020": (2020, 3, 4), " 2021/7/4 ": (2021, 7, 4),
        "13-13-2020": None, "02-30-2020": None, "junk": None, "": None, "2020": None, None: None,
    }
    got = column(frame, list(cases), "string", dates.parse_mixed_date)
    assert got == [v and dt.date(*v) for v in cases.values()]


def test_rescale_and_widening(frame):
    got = column(frame, [-1.0, 0.0, 5.0, 10.0, 11.0, None], "double", lambda c: scalars.rescale(c, F.lit(0.0), F.lit(10.0)))
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0, None]
    assert column(frame, [1.0], "double", lambda c: scalars.rescale(c, c, c)) == [None]
    low, high = scalars.widen_if_flat(F.min("v"), F.max("v"), 0.02, 0.01)
    r = frame([(1.0,), (1.0,)], "v double").agg(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == (0.99, 1.01)


def test_tail_probabilities():
    # Two and one degrees of freedom have closed forms.
    for t in (0.0, 0.3, 1.0, 4.0, 30.0):
        assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / (2 + t * t) ** 0.5, abs=1e-14)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-14)
    for f in (0.5, 1.0, 3.0):
        assert tails.f_upper(f, 2, 10) == pytest.approx((1 + 2 * f / 10) ** -5, abs=1e-14)
    assert tails.t_quantile(0.95, 1e9) == pytest.approx(1.959963984540054, abs=1e-6)
    assert tails.t_quantile(0.95, 2) == pytest.approx(4.302652729911275, abs=1e-9)
    assert tails.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, abs=1e-9)


def test_trimming_and_numbers_are_those_of_the_plain_patterns(frame):
    """White space at either end, inside or alone, and U+0085, before which ``$`` also stands."""
    signs = ["", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u1680", "\u2028", "\u200b", "\u3000", "\ufeff", "é", "😀"]
    texts = [None, *[a + b + middle + c for a in signs for b in ("", " ") for middle in ("", "x", "1.5", "-2e3 x", ".5", "+", "a b") for c in (*signs, " \x85", " \n")]]
    plain = F.regexp_replace("s", f"^{scalars.SPACES}+|{scalars.SPACES}+$", "")
    value = F.regexp_extract(plain, scalars.NUMBER_PREFIX, 0).try_cast("double")
    df = frame([(t,) for t in texts], "s string").select(
        "s", scalars.trimmed(F.col("s")).alias("trimmed"), plain.alias("plain"), scalars.parse_number(F.col("s")).alias("number"), value.alias("value"))
    assert df.filter(~F.col("trimmed").eqNullSafe(F.col("plain")) | ~F.col("number").eqNullSafe(F.col("value"))).collect() == []
    text = df.select("trimmed")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in text  # most texts are not searched
