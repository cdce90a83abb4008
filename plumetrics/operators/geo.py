"""Proximity links, clusters of nearby soundings, nearest lookup, sphere coordinates.

Distances are in degrees on a local plane: sqrt(dlat^2 + (dlon cos(mean lat))^2), without wrapping at +-180.
Coordinates are expected within +-90 latitude and +-540 longitude.

Nothing here enumerates the pairs of a dense place. Points first collapse to distinct locations, locations to
grid cells; pairs of cells are settled by the least and greatest distance their bounding boxes allow, and only
unsettled pairs are looked into, by halving both cells until few enough locations are left to compare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.functions.scalars import KEY_SEPARATOR, is_finite, number, widen_if_flat
from plumetrics.operators.quantiles import keyed_join
from plumetrics.session import cut_lineage, cut_lineage_counted

# Fixed value: two points of one timestamp this near belong together.
LINK_DEG = 0.08
# Cell pairs with at most this many location pairs are compared location by location.
COMPARE_LIMIT = 4096
LEAF_LOCATIONS = 64
# At most this many links between places are joined to clusters in one task (some tens of MB).
LINKS_IN_HAND = 200_000
# Distances that agree to this many decimals count as equal.
TIE_DECIMALS = 12
SLACK = 1e-9
WIDEST_REACH = 1080.0
WIDEST_LONGITUDE = WIDEST_REACH / 2


def separation(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    dlat = F.abs(lat_a - lat_b)
    dlon = F.abs(lon_a - lon_b) * F.cos(F.radians((lat_a + lat_b) / 2))
    return F.sqrt(dlat * dlat + dlon * dlon)


def sphere_xyz(lat: Column, lon: Column, radius: float = 1.0) -> dict[str, Column]:
    """Position on a sphere (y down, z towards the viewer) and whether it faces the viewer."""
    phi, lam = F.radians(lat), F.radians(lon)
    z = radius * F.cos(phi) * F.cos(lam)
    return {"x": radius * F.cos(phi) * F.sin(lam), "y": -radius * F.sin(phi), "z": z, "is_front": z > 0}


def _greatest_cos(low: Column, high: Column) -> Column:
    ends = F.greatest(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high))))
    return F.when((low <= 0) & (high >= 0), 1.0).otherwise(ends)


def _least_cos(low: Column, high: Column) -> Column:
    ends = F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high))))
    return F.when((low <= 90) & (high >= 90) | (low <= -90) & (high >= -90), 0.0).otherwise(ends)


def _row_width(row: Column, side: float) -> Column:
    """Longitude width of the cells in a latitude row, such that no cell is wider than it is high."""
    return side / _greatest_cos(row * side, (row + 1) * side)


def _with_cell(df: DataFrame, side: float) -> DataFrame:
    return df.withColumn("row", F.floor(F.col("latitude") / side)).withColumn(
        "col", F.floor(F.col("longitude") / _row_width(F.col("row"), side))
    )


def _boxes(locations: DataFrame, *keys: str | Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    return locations.groupBy(*keys).agg(
        F.min("latitude").alias("lat1"), F.max("latitude").alias("lat2"),
        F.min("longitude").alias("lon1"), F.max("longitude").alias("lon2"),
        F.count(F.lit(1)).alias("n"), *extra,
    )


BOX = ("lat1", "lat2", "lon1", "lon2", "n")


def _distance_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest distance between points of two boxes, given as column prefixes."""
    def ends(axis: str) -> tuple[Column, ...]:
        return tuple(F.col(f"{side}{axis}{i}") for side in (a, b) for i in (1, 2))

    near, far = [], []
    for axis in ("lat", "lon"):
        a1, a2, b1, b2 = ends(axis)
        near.append(F.greatest(F.lit(0.0), b1 - a2, a1 - b2))
        far.append(F.greatest(b2 - a1, a2 - b1))
    a1, a2, b1, b2 = ends("lat")
    low, high = (a1 + b1) / 2, (a2 + b2) / 2
    least, greatest = near[1] * _least_cos(low, high), far[1] * _greatest_cos(low, high)
    single = low == high
    exact = far[1] * F.cos(F.radians(low))
    greatest = F.when(single, exact).otherwise(greatest)
    return F.sqrt(near[0] * near[0] + least * least), F.sqrt(far[0] * far[0] + greatest * greatest)


def _neighbour_columns(target_row: Column, reach_from: Column, side: float, limit: float) -> tuple[Column, Column]:
    """First and last cell column of ``target_row`` within ``limit`` of the box in lat1..lon2."""
    width = _row_width(target_row, side)
    low = (F.col("lat1") + target_row * side) / 2
    high = (F.col("lat2") + (target_row + 1) * side) / 2
    reach = F.least(F.lit(WIDEST_REACH), F.try_divide(F.lit(limit * (1 + SLACK)), _least_cos(low, high)))
    reach = F.coalesce(reach, F.lit(WIDEST_REACH))
    return F.floor((F.col("lon1") - reach) / width), F.floor((F.col("lon2") + reach) / width)


def _placed() -> Column:
    """True for finite coordinates; a longitude that the reach of cells does not cover fails the job."""
    finite = is_finite(F.col("latitude")) & is_finite(F.col("longitude"))
    beyond = finite & (F.abs("longitude") > WIDEST_LONGITUDE)
    message = F.concat(F.lit("longitude out of range: "), F.col("longitude").cast("string"))
    return F.when(beyond, F.raise_error(message).cast("boolean")).otherwise(finite)


def located(points: DataFrame, time: str, point_id: str, link_deg: float = LINK_DEG) -> DataFrame:
    """Distinct locations per timestamp with their smallest point id and grid cell; only finite coordinates count."""
    distinct = points.filter(_placed()).groupBy(F.col(time).alias("time"), "latitude", "longitude").agg(F.min(point_id).alias("loc"))
    return _with_cell(distinct, link_deg / math.sqrt(2) * (1 - SLACK))


def proximity_links(
    points: DataFrame, time: str, point_id: str, link_deg: float = LINK_DEG, compare_limit: int = COMPARE_LIMIT
) -> DataFrame:
    """Pairs of places (a, b), a < b, of one timestamp that hold points within ``link_deg`` of each other.

    A place is a grid cell in which any two points are within ``link_deg``; it goes by its smallest point id.
    Together with "same place" the links span exactly the clusters that all point pairs would give.
    """
    locations = cut_lineage(located(points, time, point_id, link_deg), "locations")
    places = cut_lineage(_boxes(locations, "time", "row", "col", extra=(F.min("loc").alias("place"),)), "places")
    return _place_links(locations, places, link_deg, compare_limit)


def _place_links(locations: DataFrame, places: DataFrame, link_deg: float, compare_limit: int) -> DataFrame:
    side = link_deg / math.sqrt(2) * (1 - SLACK)
    shift = F.explode(F.array(*[F.lit(i) for i in (0, 1, 2)]))
    reaching = places.select("*", shift.alias("shift"))
    target = F.col("row") + F.col("shift")
    first, last = _neighbour_columns(target, F.col("row"), side, link_deg)
    # Each pair once: forward in the own row, everything in the two rows above.
    first = F.when(F.col("shift") == 0, F.col("col") + 1).otherwise(first)
    keyed = (
        reaching.withColumns({"to_row": target, "c1": first, "c2": last})
        .filter(F.col("c1") <= F.col("c2"))
        .select("time", "to_row", F.explode(F.sequence("c1", "c2")).alias("to_col"),
                *[F.col(c).alias(f"a_{c}") for c in ("place", *BOX)])
    )
    others = places.select(F.col("time"), F.col("row").alias("to_row"), F.col("col").alias("to_col"),
                           *[F.col(c).alias(f"b_{c}") for c in ("place", *BOX)])
    pairs = keyed_join(keyed, others, ["time", "to_row", "to_col"])
    few = F.col("a_n") * F.col("b_n") <= compare_limit
    settled, n_large = cut_lineage_counted(
        _settle(pairs, link_deg).drop("to_row", "to_col"), "place-pairs", only=~(F.col("linked") | few))
    linked = settled.filter("linked").select("time", "a_place", "b_place")

    # Locations by place, for looking into unsettled pairs; every level of halving reads them again.
    membership = keyed_join(locations, places.select("time", "row", "col", "place"), ["time", "row", "col"])
    if n_large:
        membership = cut_lineage(membership, "locations-by-place")
    open_pairs = settled.filter(~F.col("linked")).drop("linked", *[f"{s}_{c}" for s in "ab" for c in BOX[:4]])
    open_pairs = open_pairs.withColumns({f"{s}_{c}": F.lit(0).cast("bigint") for s in "ab" for c in ("r", "c")})
    level = 0
    found = [linked]
    while True:
        found.append(_compare(open_pairs.filter(few), membership, side, level, link_deg))
        open_pairs = open_pairs.filter(~few)
        if not n_large:
            break
        level += 1
        halves = _boxes(_at_level(membership, side, level), "place", "r", "c")
        split = open_pairs
        for s in "ab":
            child = halves.select(
                F.col("place").alias(f"{s}_place"),
                *( [F.floor(F.col(k) / 2).alias(f"{s}_{k}") for k in "rc"] if level > 1
                   else [F.lit(0).cast("bigint").alias(f"{s}_{k}") for k in "rc"] ),
                *[F.col(k).alias(f"{s}_next_{k}") for k in "rc"],
                *[F.col(c).alias(f"{s}_box_{c}") for c in BOX],
            )
            split = split.join(child, [f"{s}_place", f"{s}_r", f"{s}_c"])
        split = split.select(
            "time", "a_place", "b_place",
            *[F.col(f"{s}_next_{k}").alias(f"{s}_{k}") for s in "ab" for k in "rc"],
            *[F.col(f"{s}_box_{c}").alias(f"{s}_{c}") for s in "ab" for c in BOX],
        )
        settled, n_large = cut_lineage_counted(_settle(split, link_deg), "halved-pairs", only=~(F.col("linked") | few))
        done = settled.filter("linked").select("time", "a_place", "b_place").distinct()
        found.append(done)
        open_pairs = settled.filter(~F.col("linked")).drop("linked", *[f"{s}_{c}" for s in "ab" for c in BOX[:4]])
        open_pairs = open_pairs.join(done.select("a_place", "b_place"), ["a_place", "b_place"], "left_anti")
    every = reduce(DataFrame.unionByName, found)
    return every.select(
        "time", F.least("a_place", "b_place").alias("a"), F.greatest("a_place", "b_place").alias("b")
    ).distinct()


def _settle(pairs: DataFrame, link_deg: float) -> DataFrame:
    """Drop pairs too far apart, mark those surely near; the rest stays open."""
    least, greatest = _distance_bounds("a_", "b_")
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    bounded = pairs.withColumns({"least": least, "greatest": greatest})
    linked = F.when(single, F.col("greatest") <= link_deg).otherwise(F.col("greatest") * (1 + SLACK) <= link_deg)
    possible = F.when(single, F.col("greatest") <= link_deg).otherwise(F.col("least") <= link_deg * (1 + SLACK))
    return bounded.filter(possible).withColumn("linked", linked).drop("least", "greatest")


def _at_level(membership: DataFrame, side: float, level: int) -> DataFrame:
    """Cell of each location when every place is halved ``level`` times in both directions."""
    parts = float(2 ** level)
    width = _row_width(F.col("row"), side)
    return membership.withColumns({
        "r": F.floor(F.col("latitude") / side * parts), "c": F.floor(F.col("longitude") / width * parts),
    })


def _compare(pairs: DataFrame, membership: DataFrame, side: float, level: int, link_deg: float) -> DataFrame:
    """Open pairs with few locations that do hold two locations within reach."""
    cells = _at_level(membership, side, level) if level else membership.withColumns(
        {k: F.lit(0).cast("bigint") for k in "rc"}
    )
    for s in "ab":
        member = cells.select(
            F.col("place").alias(f"{s}_place"), *[F.col(k).alias(f"{s}_{k}") for k in "rc"],
            F.col("latitude").alias(f"{s}_lat"), F.col("longitude").alias(f"{s}_lon"),
        )
        pairs = pairs.join(member, [f"{s}_place", f"{s}_r", f"{s}_c"])
    near = separation(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= link_deg
    return pairs.filter(near).select("time", "a_place", "b_place").distinct()


def connected_components(links: DataFrame, in_hand: int = 0) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is any node of the component.

    Once at most ``in_hand`` links are left, one task joins them outright: the same components in fewer rounds.

    Every round each node joins the neighbour that comes first in a random order drawn for that round, and the
    links between the joined nodes go on to the next round. The links shrink by a constant factor on average,
    whatever the shape of the components (Boegeholz, Brand and Todor, 2020).
    """
    links, left = cut_lineage_counted(links.select("a", "b"), "links")
    steps: list[DataFrame] = []
    while left:
        if left <= in_hand:
            few = links.select("a", "b").coalesce(1).mapInArrow(_joined_in_hand, _step_schema(links))
            steps.append(cut_lineage(few, "step"))
            break
        salt = F.lit(len(steps))

        def place(node: str) -> Column:
            return F.struct(F.xxhash64(node, salt).alias("h"), F.col(node).alias("id"))

        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        first = both.groupBy("node").agg(F.min(place("other")).alias("best"))
        root = F.least(place("node"), F.col("best"))["id"]
        step = cut_lineage(first.select("node", root.alias("root")), "step")
        steps.append(step)
        for end in ("a", "b"):
            links = links.join(step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        links = links.filter(F.col("a_root") != F.col("b_root")).select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")
        ).distinct()
        links, left = cut_lineage_counted(links, "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last, smallest step back to the first, so every join has a small side.
    result = steps.pop()
    for step in reversed(steps):
        later = result.select(F.col("node").alias("root"), F.col("root").alias("later"))
        result = step.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return result


def _step_schema(links: DataFrame) -> T.StructType:
    kind = links.schema["a"].dataType
    return T.StructType([T.StructField("node", kind), T.StructField("root", kind)])


def _joined_in_hand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links of all ``parts``, by joining trees of nodes."""
    above: dict = {}

    def top(node):
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    kind = None
    for part in parts:
        kind = part.schema.field("a").type
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
            above[top(a)] = top(b)
    if kind is not None:
        nodes = list(above)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind), pa.array([top(n) for n in nodes], kind)], names=["node", "root"])


def spatial_clusters(
    points: DataFrame, time: str, point_id: str, link_deg: float = LINK_DEG, compare_limit: int = COMPARE_LIMIT,
    links_in_hand: int = LINKS_IN_HAND,
) -> DataFrame:
    """``points`` with ``cluster_id``: connected groups of points of one timestamp within ``link_deg``.

    The id is the smallest point id of the cluster, so it does not depend on the order of the input. Points whose
    coordinates are missing, NaN or infinite belong to no cluster: their id is NULL.
    """
    locations = cut_lineage(located(points, time, point_id, link_deg), "locations")
    places = cut_lineage(_boxes(locations, "time", "row", "col", extra=(F.min("loc").alias("place"),)), "places")
    roots = connected_components(_place_links(locations, places, link_deg, compare_limit), links_in_hand)
    roots = cut_lineage(roots, "roots")
    seeds = roots.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("cluster_id"))
    named = roots.join(seeds, "root").select(F.col("node").alias("place"), "cluster_id")
    labels = cut_lineage(
        places.select("time", "row", "col", "place").join(named, "place", "left")
        .select("time", "row", "col", F.coalesce("cluster_id", "place").alias("cluster_id")),
        "cluster-labels",
    )
    cells = _with_cell(
        points.filter(_placed()).withColumn("time", F.col(time)), link_deg / math.sqrt(2) * (1 - SLACK))
    inside = keyed_join(cells, labels, ["time", "row", "col"]).select(*points.columns, "cluster_id")
    return inside.unionByName(points.filter(~_placed()).withColumn("cluster_id", F.lit(None).cast(inside.schema["cluster_id"].dataType)))


def cluster_stats(clustered: DataFrame, time: str, point_id: str, value: str) -> DataFrame:
    """Key, seed place, point count, mean and value range (moved out by 0.01 when under 0.02) per cluster."""
    low, high = widen_if_flat(F.min(number(value)), F.max(number(value)), 0.02, 0.01)
    seed = F.min_by(F.struct(F.col(time).alias("time"), "city", "country"), point_id)
    stats = clustered.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        seed.alias("seed"), F.count(F.lit(1)).alias("n_points"), F.avg(number(value)).alias("mean_val"),
        low.alias("local_min"), high.alias("local_max"),
    )
    key = F.concat_ws(
        KEY_SEPARATOR, F.col("seed.time").cast("string"), F.coalesce("seed.city", F.lit("")), F.coalesce("seed.country", F.lit("")),
        F.concat(F.lit("cluster"), F.col("cluster_id").cast("string")),
    )
    return stats.select(
        "cluster_id", key.alias("cluster_key"), "seed.city", "seed.country", F.col("seed.time").alias("datetime"),
        "n_points", "mean_val", "local_min", "local_max",
    )


def cluster_members(clustered: DataFrame, stats: DataFrame) -> DataFrame:
    """Every point with the key and figures of its cluster."""
    return clustered.join(
        stats.select("cluster_id", "cluster_key", "n_points", "mean_val", "local_min", "local_max"), "cluster_id"
    )


def nearest_within(
    probes: DataFrame, points: DataFrame, radius: float, probe_id: str, point_id: str,
    leaf_locations: int = LEAF_LOCATIONS,
) -> DataFrame:
    """(probe, point, distance): the nearest point strictly within ``radius``, smallest id on a tie.

    Goes down a grid from cells of the radius' size: per probe, cells that cannot hold the nearest point are
    dropped at every level, until the cells left hold few locations.
    """
    locations = points.filter(_placed()).groupBy(
        "latitude", "longitude"
    ).agg(F.min(point_id).alias("loc"))
    locations = cut_lineage(_with_cell(locations, radius), "locations")

    asked = probes.filter(_placed()).select(F.col(probe_id).alias("probe"), F.col("latitude").alias("p_lat"),
                          F.col("longitude").alias("p_lon"))
    box = {"lat1": "p_lat", "lat2": "p_lat", "lon1": "p_lon", "lon2": "p_lon"}
    reaching = asked.withColumns({k: F.col(v) for k, v in box.items()}).select(
        "*", F.explode(F.array(*[F.floor(F.col("p_lat") / radius) + i for i in (-1, 0, 1)])).alias("row")
    )
    first, last = _neighbour_columns(F.col("row"), F.col("row"), radius, radius)
    open_cells = reaching.select("probe", "p_lat", "p_lon", "row", F.explode(F.sequence(first, last)).alias("col"))
    open_cells = open_cells.join(_boxes(locations, "row", "col"), ["row", "col"])
    keys, level = ["row", "col"], 0
    while True:
        least, greatest = _distance_bounds("p_", "")
        bounded = open_cells.withColumns({
            "p_lat1": F.col("p_lat"), "p_lat2": F.col("p_lat"), "p_lon1": F.col("p_lon"), "p_lon2": F.col("p_lon"),
        }).withColumns({"least": least, "greatest": greatest})
        best = F.min("greatest").over(Window.partitionBy("probe"))
        kept = bounded.withColumn("best", best).filter(
            (F.col("least") <= F.col("best") * (1 + SLACK)) & (F.col("least") <= radius)
        )
        kept = cut_lineage(kept.select("probe", "p_lat", "p_lon", *keys, "n"), "nearest")
        if kept.filter(F.col("n") > leaf_locations).isEmpty():
            break
        level += 1
        parts = 4 ** level
        inner = locations.withColumns({
            f"r{level}": F.floor(F.col("latitude") / radius * parts),
            f"c{level}": F.floor(F.col("longitude") / _row_width(F.col("row"), radius) * parts),
        })
        if level > 1:
            inner = inner.withColumns({f"{k}{level - 1}": F.floor(F.col(f"{k}{level}") / 4) for k in "rc"})
        next_keys = ["row", "col", f"r{level}", f"c{level}"]
        children = _boxes(inner, *dict.fromkeys([*keys, *next_keys]))
        open_cells = kept.drop("n").join(children, keys).drop(*[k for k in keys if k not in next_keys])
        keys = next_keys
    if level:
        leaves = locations.withColumns({
            f"r{level}": F.floor(F.col("latitude") / radius * parts),
            f"c{level}": F.floor(F.col("longitude") / _row_width(F.col("row"), radius) * parts),
        })
    else:
        leaves = locations
    distance = separation(F.col("p_lat"), F.col("p_lon"), F.col("latitude"), F.col("longitude"))
    near = kept.drop("n").join(leaves, keys).withColumn("distance", distance).filter(F.col("distance") < radius)
    order = F.struct(F.round("distance", TIE_DECIMALS).alias("tie"), "loc", "distance")
    return near.groupBy("probe").agg(F.min(order).alias("hit")).select(
        F.col("probe").alias(probe_id), F.col("hit.loc").alias(point_id), F.col("hit.distance").alias("distance")
    )
