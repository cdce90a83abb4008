"""As-of and interval joins, running sums, rollups, sketches, table functions and attributes against plain Python."""

import math
import random
import statistics
from bisect import bisect_left, bisect_right
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumetrics.functions import attributes, tables
from plumetrics.operators import rollups, sketches, summaries, temporal
from plumetrics.session import cut_lineage

START = datetime(2020, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(n):
    return None if n is None else START + timedelta(hours=6 * n)


def hot(rnd, n):
    """Sites, one of which owns most rows."""
    return [rnd.choice(["hot"] * 8 + ["a", "b", None]) for _ in range(n)]


def test_asof_join_with_a_hot_site(frame):
    rnd = random.Random(1)
    left = [(i, s, day(rnd.choice([None, *range(60)])), "x") for i, s in enumerate(hot(rnd, 800))]
    right = [(s, day(rnd.choice([None, *range(5, 60, 3)])), rnd.choice([None, 1.0, 2.5]), "own") for s in hot(rnd, 120) if s != "b"]
    lefts = frame(left, "id int, site string, at timestamp, _held string").repartition(7)
    rights = frame(right, "site string, seen timestamp, value double, other string").repartition(3)
    got = temporal.asof_join(lefts, rights, ["site"], "at", ["value"], "seen")
    assert got.columns == ["id", "site", "at", "_held", "matched_time", "value"]
    want = []
    for i, s, at, x in left:
        own = [r for r in right if s is not None and r[0] == s and r[1] is not None and at is not None and r[1] <= at]
        best = max(own, key=lambda r: (r[1], r[2] is not None, r[2] or 0)) if own else (None, None, None)
        want.append((i, s, at, x, best[1], best[2]))
    assert rows_of(got) == sorted(want, key=repr)


def test_asof_join_does_not_gather_a_site(spark):
    """The pieces of one site that owns all rows are even."""
    n = 20000
    rows = spark.range(n).select(F.lit("hot").alias("site"), F.timestamp_seconds("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small as they are
    pieces = temporal.in_pieces(rows, ["site", "at"], "test").groupBy("_piece").count()
    sizes = [r["count"] for r in pieces.collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.7 * n


def test_asof_join_empty(frame):
    left, right = "id int, site string, at timestamp", "site string, at timestamp, value double"
    assert temporal.asof_join(frame([], left), frame([("a", START, 1.0)], right), ["site"], "at", ["value"]).count() == 0
    got = rows_of(temporal.asof_join(frame([(1, "a", START)], left), frame([], right), ["site"], "at", ["value"]))
    assert got == [(1, "a", START, None, None)]


@pytest.mark.parametrize("kind", ["time", "number"])
def test_interval_join(frame, kind):
    rnd = random.Random(2)
    place = (lambda n: None if n is None else START + timedelta(hours=n)) if kind == "time" else (lambda n: n)
    sites = ["hot"] * 5 + ["a", None]
    points = [(i, rnd.choice(sites), place(rnd.choice([None, *range(-50, 3000)]))) for i in range(300)]
    spans = []
    for i in range(150):
        a = rnd.randint(-100, 3000)
        spans.append((i, rnd.choice(sites), place(rnd.choice([a] * 9 + [None])), place(a + rnd.choice([-5, 0, 1, 7, 24, 400, 2500]))))
    column = "timestamp" if kind == "time" else "bigint"
    p = frame(points, f"point int, site string, at {column}")
    s = frame(spans, f"span int, site string, opens {column}, closes {column}")
    joined = temporal.interval_join(p, s, ["site"], "at", "opens", "closes", *([] if kind == "time" else [5]))
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = [(x, y) for x, a, t in points for y, b, o, c in spans
            if a == b and None not in (a, t, o, c) and o <= t < c]
    assert rows_of(joined.select("point", "span")) == sorted(want, key=repr) and want


def test_running(frame):
    rnd = random.Random(3)
    rows = [(i, s, rnd.randint(0, 50), rnd.choice([None, 0.25, 1.5, 4.0])) for i, s in enumerate(hot(rnd, 600))]
    got = temporal.running(frame(rows, "id int, site string, at int, value double").repartition(5), ["site"], ["at", "id"], "value")
    want, before = [], defaultdict(list)
    for i, s, at, v in sorted(rows, key=lambda r: (r[2], r[0])):
        previous = before[s][-1] if before[s] else None
        before[s].append(v)
        own = [x for x in before[s] if x is not None]
        want.append((i, s, at, v, len(own), sum(own) if own else None, sum(own) / len(own) if own else None, previous))
    assert rows_of(got) == sorted(want, key=repr)


def test_rollup_tells_missing_keys_from_totals(frame):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", None]), rnd.choice([None, math.nan, 1e9 + rnd.random()])) for _ in range(200)]
    rows.append(("alone", "x", 5.0))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollups.rollup_moments(frame(rows, "k string, l string, v double"), ["k", "l"], "v").collect()}
    groups = defaultdict(list)
    for k, l, v in rows:
        for key in ((k, l, 0), (k, None, 1), (None, None, 2)):
            groups[key].append(v)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        own = [v for v in values if v is not None and not math.isnan(v)]
        n_rows, n, mean, std = got[key]
        assert (n_rows, n) == (len(values), len(own))
        assert mean == pytest.approx(statistics.mean(own), abs=1e-6) if own else mean is None
        assert std == pytest.approx(statistics.stdev(own), rel=1e-4) if len(own) > 1 else std is None
    assert rollups.rollup_moments(frame([], "k string, v double"), ["k"], "v").count() == 0


# Sketches

def test_sketched_quantiles_keep_their_rank_error(spark):
    n, error = 200_000, 0.01
    df = spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") % 4).alias("batch"), F.pow(F.rand(7), 3).alias("v"))
    df = cut_lineage(df, "sketch-test")
    rows = [(r["g"], r["v"]) for r in df.collect()]
    spec = {f"p{i}": ("v", i / 20) for i in range(21)}
    once = sketches.quantiles_sketched(df, ["g"], spec, error)
    parts = sketches.quantile_sketches(df, ["g", "batch"], ["v"], error)
    merged = sketches.quantiles_of(sketches.merged_quantile_sketches(parts, ["g"], ["v"], error), ["g"], spec)
    for found in (once, merged):
        for r in found.collect():
            own = sorted(v for g, v in rows if g == r["g"])
            for name, (_, p) in spec.items():
                below, upto = bisect_left(own, r[name]) / len(own), bisect_right(own, r[name]) / len(own)
                assert below - error <= p <= upto + error
    assert rows_of(sketches.merged_quantile_sketches(parts, [], ["v"], error).select("n_rows")) == [(n,)]


def test_sketches_of_missing_values(frame):
    df = frame([("a", None), ("a", math.nan), ("b", 2.0), (None, 3.0)], "g string, v double")
    got = rows_of(sketches.quantiles_sketched(df, ["g"], {"m": ("v", 0.5)}))
    assert got == sorted([("a", None), ("b", 2.0), (None, 3.0)], key=repr)
    with pytest.raises(ValueError):
        sketches.sketch_size(1e-5)


def test_robust_range_by_sketch(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("v"))
    low, high = summaries.robust_range(df, "v", rank_error=0.01).first()
    assert abs(low - 5000) <= 1000 and abs(high - 95000) <= 1000
    flat = spark.range(50).select(F.lit(7.0).alias("v"))
    assert tuple(summaries.robust_range(flat, "v", rank_error=0.01).first()) == (6.0, 8.0)
    assert tuple(summaries.robust_range(flat.limit(0), "v", rank_error=0.01).first()) == summaries.EMPTY_RANGE


def test_distinct_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("month"), (F.col("id") % 20_011).alias("site"))
    months = sketches.distinct_sketches(df, ["month"], "site")
    total = sketches.distinct_counts(sketches.merged_distinct(months, [])).first()["n_distinct"]
    once = sketches.distinct_counts(sketches.distinct_sketches(df, [], "site")).first()["n_distinct"]
    bound = 20_011 * sketches.distinct_error()
    assert abs(total - 20_011) <= bound and abs(once - 20_011) <= bound


# Table functions and attributes

def test_trend_grid(spark, frame):
    tables.register_table_functions(spark)
    lines = frame([("a", 1.0, 2.0, 0.0, 10.0), ("b", None, 2.0, 0.0, 10.0)], "line string, intercept double, slope double, low double, high double")
    got = rows_of(spark.sql("SELECT * FROM trend_grid(TABLE(SELECT * FROM {lines}), 3)", lines=lines))
    assert got == [("a", 0, 0.0, 1.0), ("a", 1, 5.0, 11.0), ("a", 2, 10.0, 21.0)]
    assert rows_of(spark.sql("SELECT * FROM trend_grid(TABLE(SELECT * FROM {lines}), 1)", lines=lines)) == [("a", 0, 0.0, 1.0)]


def test_attributes(frame):
    texts = ['{"k": 5, "name": "x", "extra": [1]}', '{"k": "many"}', '{"k": null}', "{}", "[1]", "7", '{"k": 5', "", None,
             '{"k": 1.5, "at": 2.5}', '{"at": "no", "k": "no"}', "null"]
    df = frame([(i, t, "old") for i, t in enumerate(texts)], "id int, props string, rejected string")
    got = {r["id"]: (r["k"], r["name"], r["at"], r["rejected"]) for r in
           attributes.with_attributes(df, "props", "k bigint, name string, at double").collect()}
    assert got[0] == (5, "x", None, None) and got[1] == (None, None, None, "bad k")
    assert got[2] == got[3] == got[8] == (None, None, None, None)
    assert got[4][3] == got[5][3] == got[11][3] == "not an object"
    assert got[6][3] == got[7][3] == "malformed"
    assert got[10] == (None, None, None, "bad k")
