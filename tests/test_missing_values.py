"""Missing keys, NaN in statistics, headers in another order, and tails at very many degrees of freedom."""

import datetime as dt
import math

import pytest
from pyspark.sql import types as T

from plumetrics.functions.tails import beta_share, f_upper, t_quantile, t_two_sided
from plumetrics import session
from plumetrics.operators import geo, regression, summaries
from plumetrics.plans import pipelines
from plumetrics.sources import readers, schemas
from plumetrics.streaming import ingest

NAN = float("nan")
JAN = dt.datetime(2021, 1, 5)
XCO2 = "target_name string, datetime timestamp_ntz, sounding_id long, latitude double, xco2 double"
SIF = "target_name string, datetime timestamp_ntz, Daily_SIF_757nm double"
NO2 = "target_name string, date string, city string, country string, population double, gdp_bil_usd double, " \
    "coastal_km double, is_coastal string, no2 double"


def test_missing_keys_are_groups_of_their_own(frame):
    xco2 = frame([(None, JAN, 1, 1.0, 400.0), ("", JAN, 2, 2.0, 401.0), ("<missing>", JAN, 3, 3.0, 402.0),
                  ("s", None, 4, 4.0, 403.0)], XCO2)
    sif = frame([(None, JAN, 1.0), ("", JAN, 2.0), ("<missing>", JAN, 3.0), ("s", None, 4.0)], SIF)
    want = {(None, 2021, 1): 400.0, ("", 2021, 1): 401.0, ("<missing>", 2021, 1): 402.0, ("s", None, None): 403.0}
    rows = pipelines.monthly_xco2(xco2).collect()
    assert {(r.target_name, r.year, r.month): r.xco2_median for r in rows} == want
    pair = pipelines.monthly_pair(xco2, sif).collect()
    assert {(r.target_name, r.year, r.month): r.xco2_median - r.sif_median for r in pair} == dict.fromkeys(want, 399.0)


def test_attributes_come_from_the_first_date(frame):
    place = ("c", "x", 1.0, 1.0, "True")
    no2 = frame([("s", "2021-01-09", "late", "x", 9.0, 1.0, 1.0, "True", 1.0),
                 ("s", "2021-01-02", place[0], place[1], 5.0, *place[2:], 3.0)], NO2)
    (row,) = pipelines.monthly_no2(no2).collect()
    assert (row.city, row.population, row.no2_median) == ("c", 5.0, 2.0)


def test_nan_counts_as_missing(frame):
    df = frame([("a", float(i), v) for i, v in enumerate((1.0, 2.0, NAN, 4.0, 6.0))], "k string, x double, v double")
    box = summaries.boxplot_stats(df, "k", "v").first()
    assert (box.n, box.n_outliers, box.whisker_high) == (4, 0, 6.0)
    assert summaries.monthly_mean(df, ["k"], "v").first().mean_value == 3.25
    band = regression.trend_band(df, "x", "v", "k").first()
    assert band.n == 4 and math.isfinite(band.slope)
    whole = regression.trend_band(df, "x", "v").first()
    assert "k" not in whole.asDict() and (whole.n, whole.slope) == (band.n, band.slope)
    points = frame([(1, "t", 1.0, 1.0, "c", "x", 3.0), (2, "t", 1.0, 1.0, "c", "x", NAN)],
                   "point_id long, datetime string, latitude double, longitude double, city string, country string, v double")
    stats = geo.cluster_stats(geo.spatial_clusters(points, "datetime", "point_id"), "datetime", "point_id", "v").first()
    assert (stats.n_points, stats.mean_val) == (2, 3.0)


def test_longitudes_out_of_range_fail(frame):
    points = frame([(1, "t", 0.0, 541.0)], "point_id long, datetime string, latitude double, longitude double")
    with pytest.raises(Exception, match="longitude out of range"):
        geo.spatial_clusters(points, "datetime", "point_id").collect()


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    def hinted(df, rows):
        plan = spark.range(5).join(session.broadcast_if_small(df, rows), "id")._jdf.queryExecution().logical().toString()
        return "broadcast" in plan

    numbers = spark.range(10)
    texts = numbers.selectExpr("id", "repeat('x', 1000) AS t")
    assert hinted(numbers, 10) and hinted(texts, 10) and not hinted(numbers, session.BROADCAST_ROWS + 1)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 5000)
    assert hinted(numbers, 10) and not hinted(texts, 10)


def two_headers(tmp_path, first, second):
    folder = tmp_path / "csv"
    folder.mkdir()
    for name, (header, line) in (("a.csv", first), ("b.csv", second)):
        (folder / name).write_text(f"{header}\n{line}\n")
    return str(folder)


def test_a_header_in_another_order_is_an_error(spark, tmp_path):
    folder = two_headers(tmp_path, ("p,q", "1,2"), ("q,p", "2,1"))
    schema = T.StructType.fromDDL("p double, q double")
    with pytest.raises(Exception):
        readers.read_csv(spark, folder, schema).collect()


def test_equal_headers_are_read_with_odd_ones_left_out(spark, tmp_path):
    folder = two_headers(tmp_path, (",p,z z,z z", "0,1,2,3"), (",p,z z,z z", "0,5,6,7"))
    got = readers.read_csv(spark, folder, T.StructType.fromDDL("p double")).collect()
    assert sorted(r.p for r in got) == [1.0, 5.0]


def test_text_soundings_need_their_header(spark, tmp_path):
    names = schemas.SOUNDING_TEXT.names
    line = ",".join("1" for _ in names)
    folder = two_headers(tmp_path, (",".join(names), line), (",".join(reversed(names)), line))
    with pytest.raises(Exception):
        readers.read_text_csv(spark, folder, schemas.SOUNDING_TEXT).collect()
    stream = ingest.text_stream(spark, folder, schemas.SOUNDING_TEXT)
    with pytest.raises(Exception):
        ingest.ingest_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))


@pytest.mark.parametrize("df", [1e7, 1e9, 1e11, 1e12])
def test_t_tails_reach_the_normal_limit(df):
    z = 1.959963984540054
    # First correction term of the quantile.
    assert t_quantile(0.95, df) == pytest.approx(z + (z ** 3 + z) / (4 * df), rel=1e-10)
    assert t_two_sided(1.96, df) == pytest.approx(math.erfc(1.96 / math.sqrt(2)) + 2 * math.exp(-1.9208) / math.sqrt(
        2 * math.pi) * (1.96 ** 3 + 1.96) / (4 * df), rel=1e-9)
    # With two degrees of freedom above, the tail is closed: (1 + 2 f / df) ^ (-df / 2).
    assert f_upper(3.0, 2, df) == pytest.approx(math.exp(-df / 2 * math.log1p(6.0 / df)), rel=1e-9)


def test_both_ways_to_the_tail_agree_where_they_meet():
    below, above = (t_two_sided(2.5, 2 * a) for a in (0.999999e6, 1.000001e6))
    assert below == pytest.approx(above, rel=1e-9)
    assert beta_share(5.0, 3.0, 0.4) == pytest.approx(sum(math.comb(7, j) * 0.4 ** j * 0.6 ** (7 - j) for j in range(5, 8)), rel=1e-13)
