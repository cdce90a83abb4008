"""Coordinates and text that are missing, not finite, or padded with unusual white space; quantiles of infinities."""

import math

import pytest
from pyspark.sql import functions as F

from plumetrics.functions.scalars import clean_text, parse_number
from plumetrics.operators import geo
from plumetrics.operators.quantiles import group_summary

NAN, INF = float("nan"), float("inf")
POINTS = "point_id long, datetime string, latitude double, longitude double"
ODD = [(3, "t", None, 10.0), (4, "t", None, 90.0), (5, "t", 5.0, None), (6, "t", 5.01, None), (7, "t", NAN, NAN),
       (8, "t", INF, 0.0), (9, "t", 0.0, -INF)]


def test_points_without_finite_coordinates_have_no_cluster(frame):
    points = frame([(1, "t", 0.01, 0.01), (2, "t", 0.02, 0.02), *ODD], POINTS)
    got = {r["point_id"]: r["cluster_id"] for r in geo.spatial_clusters(points, "datetime", "point_id").collect()}
    assert got == {1: 1, 2: 1, **{r[0]: None for r in ODD}}


def test_nearest_passes_over_points_without_finite_coordinates(frame):
    points = frame([(1, "t", 0.01, 0.01), *ODD], POINTS)
    probes = frame([(50, "t", 0.02, 0.02), (51, "t", NAN, 0.0), (52, "t", None, 0.0)], POINTS)
    got = geo.nearest_within(probes, points, 0.5, "point_id", "point_id").collect()
    assert [(r[0], r[1]) for r in got] == [(50, 1)] and math.isclose(got[0][2], 0.01414, abs_tol=1e-4)


def test_white_space_is_trimmed(frame):
    rows = frame([("\t",), (" x﻿\n",), (" 12abc",), ("　12\t",)], "t string")
    got = [tuple(r) for r in rows.select(clean_text(F.col("t"), "Unknown"), parse_number(F.col("t"))).collect()]
    assert got == [("Unknown", None), ("x", None), ("12abc", 12.0), ("12", 12.0)]


@pytest.mark.parametrize("values", [[-INF, 5.0], [-1e308, 1.5e308], [1.0, INF], [-INF, INF], [2.0, 2.0, 3.0]])
def test_quantiles_do_not_depend_on_the_size_of_the_group(frame, values):
    df = frame([("a", v) for v in values], "k string, v double")
    got = []
    for limit in (1_000_000, 1, 0):
        row = group_summary(df, ["k"], quantiles={"q": ("v", 0.5), "r": ("v", 0.3)}, direct_limit=limit).first()
        got.append(tuple("nan" if x is not None and math.isnan(x) else x for x in (row["q"], row["r"])))
    assert len(set(got)) == 1
