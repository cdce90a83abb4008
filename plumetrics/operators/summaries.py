"""Summaries behind charts: colour range, box plots, series extents, bounding boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumetrics.functions.scalars import number, widen_if_flat
from plumetrics.operators.quantiles import group_summary, keyed_join, narrowed_quantiles
from plumetrics.operators.sketches import quantiles_sketched
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

# The range shown when there is no data at all.
EMPTY_RANGE = (380.0, 450.0)


def robust_range(df: DataFrame, value: str, rank_error: float | None = None) -> DataFrame:
    """One row (low, high): p05/p95, else min/max when not increasing, else +-1 when still flat.

    Raw soundings are one huge group, so its quantiles are always found by narrowing. With a ``rank_error`` they come
    from one sketch instead: a single pass, ranks off by that much at most; the ends of the range stay exact.
    """
    spec = {"lo": (value, 0.0), "p05": (value, 0.05), "p95": (value, 0.95), "hi": (value, 1.0)}
    if rank_error is None:
        ends = narrowed_quantiles(cut_lineage(df.select(number(value).alias(value)), "range-values"), [], spec)
    else:
        ends = quantiles_sketched(df, [], spec, rank_error)
    inner, flat = F.col("p95") > F.col("p05"), F.col("hi") <= F.col("lo")
    low = F.when(inner, F.col("p05")).when(flat, F.col("lo") - 1).otherwise(F.col("lo"))
    high = F.when(inner, F.col("p95")).when(flat, F.col("hi") + 1).otherwise(F.col("hi"))
    return ends.select(
        F.coalesce(low, F.lit(EMPTY_RANGE[0])).alias("low"), F.coalesce(high, F.lit(EMPTY_RANGE[1])).alias("high")
    )


def boxplot_stats(df: DataFrame, key: str, value: str, **options) -> DataFrame:
    """Hinges, whiskers (furthest values within 1.5 IQR of the hinges) and outlier count per group."""
    rows = df.select(key, number(value).alias(value))
    hinges = group_summary(
        rows, [key], [F.count(value).alias("n")],
        {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}, **options,
    )
    hinges = broadcast_if_small(*cut_lineage_counted(hinges, "hinges"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        keyed_join(rows, hinges, [key])
        .groupBy(key, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def monthly_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and count of ``value`` per ``keys``; partial sums leave little to shuffle."""
    return df.groupBy(*keys).agg(F.avg(number(value)).alias("mean_value"), F.count(F.lit(1)).alias("n_points"))


def series_extent(monthly: DataFrame, key: str, month: str = "month", value: str = "mean_value") -> DataFrame:
    """Value range (moved out by 0.2 when under 0.4 wide) and first and last month of each series."""
    low, high = widen_if_flat(F.min(value), F.max(value), 0.4, 0.2)
    return monthly.groupBy(key).agg(
        low.alias("min_value"), high.alias("max_value"),
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
    )


def bounding_box(df: DataFrame, key: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Extent per group with 15 % padding, at least 0.01 degrees."""
    ends = df.groupBy(key).agg(*[f(c).alias(f"{c}_{n}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max))])
    pads = {c: F.greatest((F.col(f"{c}_max") - F.col(f"{c}_min")) * 0.15, F.lit(0.01)) for c in (lat, lon)}
    return ends.select(
        key,
        (F.col(f"{lat}_min") - pads[lat]).alias("lat_min"), (F.col(f"{lat}_max") + pads[lat]).alias("lat_max"),
        (F.col(f"{lon}_min") - pads[lon]).alias("lon_min"), (F.col(f"{lon}_max") + pads[lon]).alias("lon_max"),
    )
