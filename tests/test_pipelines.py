import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumetrics.operators import relational
from plumetrics.plans import pipelines, standins

OBS = "sounding_id bigint, target_name string, datetime timestamp_ntz, local_time timestamp_ntz, latitude double, xco2 double, " \
    "city string, country string, population double"
SIF = "target_name string, datetime timestamp_ntz, local_time timestamp_ntz, latitude double, Daily_SIF_757nm double"
SITE = "target_name string, city string, country string, population double, gdp_bil_usd double, coastal_km double"


def tables(frame, repeat_site=False):
    rng = random.Random(11)
    obs, sif = [], []
    for i in range(400):
        name = rng.choice(["a", "a", "a", "b", "c", "nowhere", None])
        when = dt.datetime(2021, 1 + i % 12, 1 + i % 27)
        local = None if i % 17 == 0 else when + dt.timedelta(hours=i % 24)
        lat = {"a": 40.0, "b": -30.0, "c": 5.0}.get(name)
        obs.append((i, name, when, local, lat, None if i % 13 == 0 else 410 + rng.gauss(0, 2), "old", "old", 1.0))
        sif.append((name, when, local, lat, rng.random()))
    site = [("a", "A", "X", 10.0, 1.0, 5.0), ("b", "B", "Y", None, 2.0, 70.0), ("c", "C", None, 30.0, 3.0, None)]
    if repeat_site:
        site += [site[0], ("c", "C2", "Z", 31.0, 3.0, None)]
    return frame(obs, OBS), frame(sif, SIF), frame(site, SITE)


def row_level(obs, sif, site):
    """Join first, then summarise: the plain way."""
    soundings = relational.union_by_name(obs, sif)
    joined = pipelines.with_labels(relational.attach_sites(soundings, site))
    return joined.groupBy("target_name", *pipelines.SITE_FIELDS, "season", "time_of_day").agg(
        F.median("xco2").alias("xm"), F.stddev_samp("xco2").alias("xs"), F.count(F.lit(1)).alias("n"),
        F.count("xco2").alias("nx"), F.median("Daily_SIF_757nm").alias("sm"), F.stddev_samp("Daily_SIF_757nm").alias("ss"),
    )


@pytest.mark.parametrize("repeat_site", [False, True])
@pytest.mark.parametrize("limit", [10**6, 10])
def test_summary_before_join_equals_join_before_summary(frame, repeat_site, limit):
    obs, sif, site = tables(frame, repeat_site)
    keys = ["target_name", *pipelines.SITE_FIELDS, "season", "time_of_day"]
    want = {tuple(r[k] for k in keys): (r.xm, r.xs, r.n, r.sm, r.ss) for r in row_level(obs, sif, site).collect()}
    got = {
        tuple(r[k] for k in keys): (r.xco2_median, r.xco2_std, r.xco2_n, r.sif_median, r.sif_std)
        for r in pipelines.site_season_summary(obs, sif, site, direct_limit=limit, bins=7, in_hand=5).collect()
    }
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_count_mode(frame):
    obs, sif, site = tables(frame)
    rows = pipelines.site_season_summary(obs, sif, site).agg(F.sum("xco2_n"), F.sum("sif_n")).first()
    present = pipelines.site_season_summary(obs, sif, site, count_mode="non_missing").agg(F.sum("xco2_n"), F.sum("sif_n")).first()
    assert tuple(rows) == (800, 800) and tuple(present) == (400 - 31, 400)


def test_sounding_table_keeps_populated_sites_only(frame):
    table = pipelines.sounding_table(*tables(frame))
    assert {r.target_name for r in table.select("target_name").distinct().collect()} == {"a", "c"}
    assert table.filter("coast_iqr is not null").count() == 0  # one distinct distance: flat


def test_monthly_merge(frame):
    obs, sif, site = tables(frame)
    no2 = frame(
        [("a", "A", "X", 10.0, 1.0, 5.0, "True", v, d) for v, d in
         ((1.0, "2021-01-05"), (3.0, "01/20/2021"), (9.0, "2021-02"), (7.0, "junk"))]
        + [("b", "B", "Y", None, 2.0, 70.0, "False", 2.0, "2021-01-05")],
        "target_name string, city string, country string, population double, gdp_bil_usd double, coastal_km double, "
        "is_coastal string, no2 double, date string",
    )
    merged = pipelines.monthly_merge(no2, obs, sif)
    got = {(r.target_name, r.month): r for r in merged.collect()}
    assert set(got) == {("a", 1), ("a", 2)}
    assert got["a", 1].no2_median == 2.0 and got["a", 1].season == "Winter (North)"
    values = [r.xco2 for r in obs.filter("target_name = 'a' and month(datetime) = 1 and xco2 is not null").collect()]
    assert got["a", 1].xco2_median == pytest.approx(statistics.median(values))
    season = pipelines.seasonal_medians(merged).collect()
    assert len(season) == 1 and season[0].no2_median == 5.5
    assert season[0].no2_std == pytest.approx(statistics.stdev([2.0, 9.0]))


def test_relational_edges(frame):
    left = frame([("a",), ("b",), (None,)], "k string")
    right = frame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "k string, v int")
    joined = relational.left_join(left, right, ["k"])
    assert sorted((r.k or "", r.v or 0) for r in joined.collect()) == [("", 3), ("a", 1), ("a", 2), ("b", 0)]
    assert {r.k for r in relational.keys_only_in(left, right, "k").collect()} == {"b"}
    assert {r.k for r in relational.keys_only_in(right, left, "k").collect()} == {"z"}
    both = relational.union_by_name(left.withColumn("x", F.lit(1)), right)
    assert set(both.columns) == {"k", "x", "v"} and both.count() == 7
    assert tuple(relational.match_count(joined, "v").first()) == (4, 3, 1)
    assert relational.join_present(left, right, ["k"], "v").count() == 3


def test_impact_score(frame):
    rows = [(f"c{i}", 400.0 + i, i / 10, None if i == 0 else float(i), float(i * 2), float(i % 5), i, i + 1, float(i * 3))
            for i in range(9)]
    df = frame(rows, "city string, xco2_ppm double, sif_757nm double, population double, gdp_bil_usd double, "
                     "annual_co2_em_mtco2 double, xco2_numsams bigint, sif_numsams bigint, coastal_km double")
    table = pipelines.impact_table(df)
    assert table.count() == 8
    for r in table.collect():
        assert r.impact_iqr == pytest.approx(r.co2_conc_iqr - r.co2_em_iqr)
    q = table.agg(F.percentile("co2_conc_iqr", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    assert q == pytest.approx([0.0, 1.0])


NO2 = "target_name string, city string, country string, population double, gdp_bil_usd double, coastal_km double, " \
    "is_coastal string, no2 double, date string"


def no2_rows(frame):
    """Rows in and out of the months of the soundings, with missing names and dates, and places that differ within a month."""
    rng = random.Random(12)
    out = []
    for i in range(300):
        name = rng.choice(["a", "b", "c", "elsewhere", None])
        date = rng.choice([f"{rng.choice([2019, 2021])}-{1 + i % 12:02d}-{1 + i % 27:02d}", f"{1 + i % 12:02d}/2021", "junk", None])
        out.append((name, rng.choice(["A", None]), "X", rng.choice([10.0, 20.0, None]), float(i % 3), 5.0, "True", rng.random(), date))
    return frame(out, NO2)


@pytest.mark.parametrize("collide", [False, True])
def test_only_rows_of_sounding_months_are_summarised(frame, monkeypatch, collide):
    """The months of the soundings decide what is summarised, by a hash; a hash that tells nothing changes no result."""
    obs, sif, _ = tables(frame)
    # Every other month of the soundings is taken out.
    obs, no2 = obs.filter("month(datetime) % 2 = 1"), no2_rows(frame)
    keys = [*pipelines.MONTH_KEYS]
    months = pipelines.monthly_xco2(obs)
    all_sif, all_no2 = pipelines.monthly_sif(sif), pipelines.monthly_no2(no2)
    want = relational.left_join(relational.left_join(months, all_sif, keys), all_no2, keys)

    summarised = []

    def spy(df, *args, **kwargs):
        summarised.append(df.select(*keys).distinct().count())
        return summary(df, *args, **kwargs)

    summary, n_months = pipelines.group_summary, months.count()
    monkeypatch.setattr(pipelines, "group_summary", spy)
    if collide:
        monkeypatch.setattr(pipelines.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    pair = pipelines.monthly_pair(obs, sif).collect()
    merged = pipelines.monthly_merge(no2, obs, sif).drop("season").collect()
    if not collide:
        assert len(summarised) == 5 and all(n <= n_months for n in summarised)
    monkeypatch.undo()
    assert sorted(map(str, pair)) == sorted(map(str, relational.left_join(months, all_sif, keys).collect()))
    want = want.filter("population is not null").select(*merged[0].__fields__).collect()
    assert len(want) > 5 and sorted(map(str, merged)) == sorted(map(str, want))


def test_rows_of_a_hot_month_are_split(spark, monkeypatch):
    """Months too many to broadcast: rows of one month that holds nearly all go to several tasks."""
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1k",
                "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    monkeypatch.setattr("plumetrics.session.BROADCAST_ROWS", 0)
    key = [F.lit("a").alias("target_name"), F.lit(False).alias("nameless"), F.lit(2021).cast("bigint").alias("year")]
    months = spark.range(40).select(*key, F.col("id").alias("month"))
    rows = spark.range(0, 20000, 1, 4).select(*key, F.when(F.col("id") % 100 == 0, F.col("id") % 60).otherwise(3).alias("month"), "id")
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        kept = pipelines._of_months(rows, pipelines._month_hashes(months))
        assert len(kept.collect()) == rows.filter("month < 40").count()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(f"spark.sql.{k}")


def test_no2_file_joins_sites_to_orders_not_to_rows(spark, frame, tmp_path, capsys):
    """Sites listed twice, customers without orders, orders without customer: as the join of all rows with all sites."""
    when = dt.datetime(2020, 3, 14)
    data = {
        "nation": [(1, "N", 0)],
        "customer": [(1, "Customer#000000001", 1, 5.0, "x"), (1, "Customer#000000001", 1, 6.0, "x"),
                     (2, "Customer#000000002", None, -1.0, "x"), (3, None, 1, 1.0, "x"), (None, "Customer#000000009", 1, 1.0, "x")],
        "orders": [(i, i % 5 or None, "O", 1.0, when, "p") for i in range(10)] + [(None, 1, "O", 1.0, when, "p"), (4, 2, "O", 1.0, when, "p")],
        "lineitem": [(i % 12, 1, 1, i, 1.0, 1.0, 0.0, i / 100, "N", "O", when) for i in range(60)] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.5, "N", "O", when)],
    }
    for name, rows in data.items():
        frame(rows, standins.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = standins.no2_file(spark, str(tmp_path))
    owner = [(o[0], f"Customer#{o[1]:09d}") for o in data["orders"] if o[0] is not None and o[1] is not None]
    want = sorted((c[1], str(c[3] if c[3] > 0 else None), li[7]) for li in data["lineitem"] for order, name in owner if order == li[0]
                  for c in data["customer"] if c[1] == name)
    assert sorted((r["Target.Name"], str(r.population), r["mean"]) for r in got.collect()) == want and len(want) > 30
    got.explain()
    lines = capsys.readouterr().out.splitlines()

    def joins_above(column):
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and column in line)
        inner, n = len(lines[at]) - len(lines[at].lstrip(" :+-")), 0
        for line in reversed(lines[:at]):
            indent = len(line) - len(line.lstrip(" :+-"))
            if indent < inner:
                inner, n = indent, n + ("Join" in line)
        return n

    assert [joins_above(c) for c in ("l_shipdate", "o_custkey", "c_name")] == [1, 2, 3]
