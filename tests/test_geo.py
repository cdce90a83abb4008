import math
import random

import pytest
from pyspark.sql import functions as F

from plumetrics.operators import geo

SCHEMA = "pid bigint, t string, latitude double, longitude double, city string, country string, xco2 double"


def distance(a, b):
    dlat = abs(a[0] - b[0])
    dlon = abs(a[1] - b[1]) * math.cos(math.radians((a[0] + b[0]) / 2))
    return math.sqrt(dlat * dlat + dlon * dlon)


def brute_clusters(rows, reach=0.08):
    """Union-find over all pairs of one timestamp; root is the smallest id."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[1] == b[1] and distance(a[2:4], b[2:4]) <= reach:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {r[0]: find(r[0]) for r in rows}


def points(seed=3):
    rng = random.Random(seed)
    rows, pid = [], 0

    def add(t, lat, lon):
        nonlocal pid
        rows.append((pid, t, lat, lon, f"c{pid % 3}", None if pid % 5 == 0 else "x", 410 + pid % 7 * 0.5))
        pid += 1

    for _ in range(150):  # one dense blob, many points in few cells
        add("hot", 10 + rng.gauss(0, 0.05), 20 + rng.gauss(0, 0.05))
    for _ in range(60):  # two dense half planes a little more than the reach apart
        add("gap", 5 + rng.random() * 0.05, 7 + rng.random() * 0.05)
        add("gap", 5 + rng.random() * 0.05, 7.05 + 0.0805 + rng.random() * 0.05)
    for i in range(60):  # a chain
        add("chain", -33 + i * 0.055, 151 + (i % 2) * 0.02)
    for _ in range(60):  # near and at the pole
        add("pole", 90 - rng.random() * 0.3, rng.uniform(-180, 180))
    add("pole", 90.0, 10.0)
    add("pole", 90.0, -170.0)
    for _ in range(100):
        add("wide", rng.uniform(55, 60), rng.uniform(-3, 3))
    for _ in range(12):  # same coordinates at two timestamps
        add("same1", 1.0, 1.0)
        add("same2", 1.0, 1.0)
    add("edge", 0.0, 0.0)
    add("edge", 0.08, 0.0)  # exactly the reach
    add("edge", 0.0, 179.99)
    add("edge", 0.0, -179.99)  # no wrap
    return rows


@pytest.mark.parametrize("compare_limit, in_hand", [(4096, 0), (1, 10), (1, 100_000)])
def test_clusters_equal_union_find(frame, compare_limit, in_hand):
    rows = points()
    got = geo.spatial_clusters(frame(rows, SCHEMA), "t", "pid", compare_limit=compare_limit, links_in_hand=in_hand)
    assert {r.pid: r.cluster_id for r in got.collect()} == brute_clusters(rows)


def test_links_never_exceed_pairs_of_places(frame):
    rows = points(5)
    df = frame(rows, SCHEMA)
    a = {tuple(r) for r in geo.proximity_links(df, "t", "pid").collect()}
    b = {tuple(r) for r in geo.proximity_links(df, "t", "pid", compare_limit=1).collect()}
    assert a == b and a
    place = {}
    cells = geo.located(df, "t", "pid").groupBy("time", "row", "col").agg(
        F.min("loc").alias("place"), F.collect_list(F.struct("latitude", "longitude")).alias("where")
    ).collect()
    for r in cells:
        place[r.place] = (r.time, [tuple(w) for w in r.where])
        assert all(distance(u, v) <= 0.08 for u in r.where for v in r.where)
    brute = set()
    ids = sorted(place)
    for i, x in enumerate(ids):
        for y in ids[i + 1:]:
            if place[x][0] == place[y][0] and any(
                distance(u, v) <= 0.08 for u in place[x][1] for v in place[y][1]
            ):
                brute.add((place[x][0], x, y))
    assert a == brute


def test_cluster_stats_and_members(frame):
    rows = points()
    df = frame(rows, SCHEMA)
    clustered = geo.spatial_clusters(df, "t", "pid")
    stats = geo.cluster_stats(clustered.withColumn("t", F.lit("2020-01-01").cast("timestamp_ntz")), "t", "pid", "xco2")
    by_id = {r.cluster_id: r for r in stats.collect()}
    members = {}
    for pid, root in brute_clusters(rows).items():
        members.setdefault(root, []).append(rows[pid][6])
    assert {k: v.n_points for k, v in by_id.items()} == {k: len(v) for k, v in members.items()}
    for k, values in members.items():
        r = by_id[k]
        assert r.mean_val == pytest.approx(sum(values) / len(values))
        flat = max(values) - min(values) < 0.02
        assert r.local_min == pytest.approx(min(values) - (0.01 if flat else 0))
        assert r.cluster_key.endswith(f"cluster{k}")
    assert geo.cluster_members(clustered, stats).count() == len(rows)


@pytest.mark.parametrize("leaf", [64, 1])
def test_nearest_equals_scan(frame, leaf):
    rows = [r for r in points() if r[1] != "pole"]
    rng = random.Random(9)
    probes = [(i, *rng.choice(rows)[2:4]) for i in range(40)]
    probes = [(i, lat + rng.gauss(0, 0.2), lon + rng.gauss(0, 0.2)) for i, lat, lon in probes]
    probes += [(100, 89.9, 0.0), (101, 10.0, 20.0), (102, 10.0, 20.0)]
    got = geo.nearest_within(
        frame(probes, "q bigint, latitude double, longitude double"), frame(rows, SCHEMA), 0.3, "q", "pid",
        leaf_locations=leaf,
    )
    want = {}
    for q, lat, lon in probes:
        near = sorted((distance((lat, lon), r[2:4]), r[0]) for r in rows)[0]
        if near[0] < 0.3:
            want[q] = near
    result = {r.q: (r.distance, r.pid) for r in got.collect()}
    assert {q: v[1] for q, v in result.items()} == {q: v[1] for q, v in want.items()}
    for q, v in want.items():
        assert result[q][0] == pytest.approx(v[0], abs=1e-12)


@pytest.mark.parametrize("in_hand", [0, 60, 1000])
def test_components_of_a_sorted_chain_and_star(frame, in_hand):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(100)]
    got = geo.connected_components(frame(chain + star, "a bigint, b bigint").repartition(5), in_hand).collect()
    assert len(got) == 302
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [101, 201]
    assert set(range(201)) in roots.values()


def test_sphere(frame):
    got = frame([(0.0, 0.0), (0.0, 180.0), (90.0, 0.0)], "lat double, lon double").select(
        *[c.alias(n) for n, c in geo.sphere_xyz(F.col("lat"), F.col("lon"), 2.0).items()]
    ).collect()
    assert got[0].z == pytest.approx(2) and got[0].is_front
    assert not got[1].is_front
    assert got[2].y == pytest.approx(-2)
