import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumetrics.operators import quantiles, ranking, scaling, summaries

P = {"q1": ("v", 0.25), "m": ("v", 0.5), "q3": ("v", 0.75), "p90": ("w", 0.9)}


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(3000):  # one group holds most rows
        out.append(("hot", rng.gauss(410, 2), rng.choice([1.0, 2.0, 3.0])))
    for key, n in (("a", 7), ("b", 1), (None, 40)):
        out += [(key, rng.gauss(0, 1), float(i)) for i in range(n)]
    out += [("gone", None, None), ("nan", float("nan"), 1.0), ("nan", 5.0, None)]
    return out


def expected(data):
    groups = {}
    for k, v, w in data:
        groups.setdefault(k, []).append((v, w))

    def q(values, p):
        present = [v for v in values if v is not None and not math.isnan(v)]
        return float(np.quantile(present, p)) if present else None

    return {
        k: tuple(q([r[0 if c == "v" else 1] for r in g], p) for c, p in P.values()) for k, g in groups.items()
    }


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert (a is None) == (b is None), k
            assert a is None or a == pytest.approx(b, abs=1e-9), k


@pytest.mark.parametrize("limit", [10**6, 100, 5, 0])
def test_grouped_quantiles_direct_and_narrowed(frame, limit):
    data = rows()
    df = frame(data, "k string, v double, w double")
    got = quantiles.group_summary(df, ["k"], [F.count(F.lit(1)).alias("n")], P, direct_limit=limit, bins=7, in_hand=20)
    result = {r.k: (r.q1, r.m, r.q3, r.p90) for r in got.collect()}
    close(result, expected(data))
    assert {r.k: r.n for r in got.collect()}["hot"] == 3000


@pytest.mark.parametrize("limit", [100, 5])
def test_many_groups_are_sorted_not_mapped(frame, monkeypatch, limit):
    """Quantiles of many small groups beside a hot one: same results as value maps."""
    monkeypatch.setattr(quantiles, "BUCKETS", 2)
    rng = random.Random(3)
    data = rows(3) + [(f"g{i % 400}", rng.choice([None, float("nan"), rng.gauss(0, 1), -0.0, 5.0, float("inf")]),
                       rng.choice([None, 1e308, -1e308, 2.0])) for i in range(1500)]
    df = frame(data, "k string, v double, w double")
    spec = {**P, "least": ("v", 0.0), "same": ("v", 0.5)}
    counts = [F.count(F.lit(1)).alias("n"), F.count("w").alias("n_w")]
    got = quantiles.group_summary(df, ["k"], counts, spec, direct_limit=limit, bins=7, in_hand=20)
    want = quantiles.group_summary(df, ["k"], counts, spec)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_small_groups_make_no_value_maps(spark, frame, monkeypatch, capsys):
    monkeypatch.setattr(quantiles, "BUCKETS", 2)
    df = frame(rows(4), "k string, v double, w double").filter("k is null or k != 'hot'")
    quantiles.group_summary(df, ["k"], [F.count(F.lit(1)).alias("n")], P, direct_limit=40).explain()
    plan = capsys.readouterr().out
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("limit", [10**6, 10])
def test_whole_table_quantiles(frame, limit):
    data = rows(2)
    df = frame(data, "k string, v double, w double")
    r = quantiles.group_summary(df, [], [F.count(F.lit(1)).alias("n")], P, direct_limit=limit, bins=7, in_hand=20).first()
    close({1: (r.q1, r.m, r.q3, r.p90)}, expected([(1, v, w) for _, v, w in data]))
    assert r.n == len(data)


@pytest.mark.parametrize("bins,in_hand", [(4096, 1000), (16, 10), (2, 1)])
def test_narrowing_finds_every_rank(spark, bins, in_hand):
    n = 20_000 if bins > 2 else 300
    # Two far clusters, an outlier, many copies of one value.
    v = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.rand(1)).otherwise(1e6 + F.rand(2))
    df = spark.range(n).select(F.when(F.col("id") == 5, 1e300).otherwise(v).alias("v")).cache()
    want = df.toPandas()["v"].to_numpy()
    spec = {f"p{p}": ("v", p / 100) for p in (0, 1, 5, 25, 50, 95, 100)}
    r = quantiles.narrowed_quantiles(df, [], spec, bins, in_hand).first()
    for p in (0, 1, 5, 25, 50, 95, 100):
        assert r[f"p{p}"] == pytest.approx(np.quantile(want, p / 100), rel=1e-12)


def test_narrowing_with_infinite_values(frame):
    values = [float("-inf"), -1.0, 0.0, 1.0, 2.0, float("inf"), float("inf")]
    df = frame([(v,) for v in values], "v double")
    r = quantiles.narrowed_quantiles(df, [], {"a": ("v", 0.0), "m": ("v", 0.5), "z": ("v", 1.0)}, 2, 1).first()
    assert tuple(r) == (float("-inf"), 1.0, float("inf"))


def test_empty_input(frame):
    df = frame([], "k string, v double, w double")
    assert quantiles.group_summary(df, ["k"], [], P).count() == 0
    for limit in (10, -1):
        assert tuple(quantiles.quantile_row(df, P, direct_limit=limit, bins=7, in_hand=20).first()) == (None,) * 4


def test_iqr_norm_maps_quartiles_to_zero_and_one(frame):
    df = frame([(float(i), 4.0, None if i % 9 == 0 else i * i * 1.0) for i in range(101)], "a double, flat double, b double")
    for limit in (10**6, 10):
        out = df.transform(scaling.iqr_norm({"an": "a", "fn": "flat", "bn": "b"}, direct_limit=limit, bins=7, in_hand=20))
        r = out.agg(F.percentile("an", F.lit(0.25)), F.percentile("an", F.lit(0.75)), F.percentile("bn", F.lit(0.25)),
                    F.percentile("bn", F.lit(0.75)), F.count("fn")).first()
        assert tuple(r) == pytest.approx((0, 1, 0, 1, 0))


def test_robust_range_ladder(frame):
    def ends(values):
        return tuple(summaries.robust_range(frame([(v,) for v in values], "v double"), "v").first())

    assert ends([]) == (380.0, 450.0)
    assert ends([400.0] * 5) == (399.0, 401.0)
    assert ends([400.0] * 99 + [410.0]) == (400.0, 410.0)
    assert ends([float(i) for i in range(101)]) == (5.0, 95.0)
    assert ends([None, float("nan")]) == (380.0, 450.0)


def test_boxplot(frame):
    data = [("x", float(v)) for v in [1, 2, 3, 4, 100]] + [("y", 1.0)] + [(None, 2.0)]
    got = {r.k: r for r in summaries.boxplot_stats(frame(data, "k string, v double"), "k", "v").collect()}
    assert (got["x"].q1, got["x"].median, got["x"].q3) == (2, 3, 4)
    assert (got["x"].whisker_low, got["x"].whisker_high, got["x"].n_outliers) == (1, 4, 1)
    assert got["y"].n == 1 and got[None].median == 2


@pytest.mark.parametrize("n,size", [(10, 37), (10, 10), (10, 5), (12000, 12345), (7, 1000)])
def test_systematic_sample_positions(spark, n, size):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several pieces per group
    try:
        one = spark.range(size).select((F.col("id") * 3 + 11).alias("id"), F.lit("m").alias("month"))
        other = spark.range(3).select((F.col("id") * 3 + 12).alias("id"), F.lit("few").alias("month"))
        rows = ranking.systematic_sample(one.union(other), "month", "id", n=n).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    places = range(size) if size <= n else [math.floor(i * (size / n)) for i in range(n)]
    assert sorted(r.id for r in rows if r.month == "m") == sorted(p * 3 + 11 for p in places)
    assert sorted(r.id for r in rows if r.month == "few") == [12, 15, 18]


def test_top_k_and_levels(frame):
    data = [("a", i, float(i % 4)) for i in range(10)] + [("b", 1, None), ("b", 2, 1.0), (None, 3, 2.0)]
    df = frame(data, "k string, id bigint, v double")
    got = [(r.k, r.id) for r in ranking.top_k(df, ["k"], F.abs("v"), 3, ["id"]).orderBy("k", "rank").collect()]
    assert got == [(None, 3), ("a", 3), ("a", 7), ("a", 2), ("b", 2), ("b", 1)]
    levels = ranking.ordered_levels(df, "k", "v").orderBy("position").collect()
    assert [r.k for r in levels] == ["a", "b", None]
    factors = ranking.factor_levels(df, "k").orderBy("code").collect()
    assert [(r.k, r.is_baseline) for r in factors] == [("a", True), ("b", False)]


def test_month_timeline_wraps(frame):
    df = frame([("2020-01-01",), ("2020-03-01",), ("2020-01-01",)], "m string").select(F.col("m").cast("date").alias("month"))
    got = ranking.month_timeline(df).orderBy("position").collect()
    assert [(str(r.month), r.label, r.long_label, str(r.next_month)) for r in got] == [
        ("2020-01-01", "Jan 2020", "January 2020", "2020-03-01"), ("2020-03-01", "Mar 2020", "March 2020", "2020-01-01")]


def test_series_and_boxes(frame):
    df = frame([("a", "2020-01-01", 1.0), ("a", "2020-02-01", 1.1), ("b", "2020-01-01", 5.0), ("b", "2020-05-01", 9.0)],
               "city_key string, month string, mean_value double")
    got = {r.city_key: tuple(r)[1:] for r in summaries.series_extent(df, "city_key").collect()}
    assert got["a"] == (pytest.approx(0.8), pytest.approx(1.3), "2020-01-01", "2020-02-01")
    assert got["b"] == (5.0, 9.0, "2020-01-01", "2020-05-01")
    box = summaries.bounding_box(frame([(1, 0.0, 0.0), (1, 2.0, 0.0)], "c int, latitude double, longitude double"), "c").first()
    assert (box.lat_min, box.lat_max, box.lon_min, box.lon_max) == pytest.approx((-0.3, 2.3, -0.01, 0.01))
