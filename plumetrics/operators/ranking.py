"""Top-k per group, ordered category levels, the month timeline and systematic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.functions.dates import month_label
from plumetrics.operators.quantiles import group_summary, keyed_join
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

# Fixed value: points kept per month.
SAMPLE_SIZE = 12_000


def numbered(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """``df`` with ``place``, counted from 0 in ``order``, which must tell all rows apart.

    Rows are numbered within range-partitioned pieces and the sizes of the earlier pieces, a row each, are added.
    """
    ranges = df.repartitionByRange(*order).withColumn("piece", F.spark_partition_id())
    pieces = cut_lineage(ranges, label)
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("rows")).select(
        "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("piece").orderBy(*order)
    return pieces.join(offsets, "piece").select(
        *df.columns, (F.col("offset") + F.row_number().over(within) - 1).cast("bigint").alias("place"))


def top_k(df: DataFrame, by: Sequence[str], score: Column, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows of each group with the highest score, missing scores last.

    The rank filter lets the planner cut every partition to k rows per group before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ordered_levels(df: DataFrame, key: str, value: str, **options) -> DataFrame:
    """Category levels with their position when ordered by group median."""
    levels = group_summary(df, [key], [], {"median_value": (value, 0.5)}, **options)
    placed = numbered(levels, [F.col("median_value").asc_nulls_last(), F.col(key)], "ordered-levels")
    return placed.select(*levels.columns, (F.col("place") + 1).alias("position"))


def factor_levels(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct levels with their code; the first is the baseline of a model."""
    levels = df.select(key).filter(F.col(key).isNotNull()).distinct()
    code = (F.col("place") + 1).alias("code")
    return numbered(levels, [key], "factor-levels").select(key, code).withColumn("is_baseline", F.col("code") == 1)


def month_timeline(months: DataFrame, month: str = "month") -> DataFrame:
    """Distinct months with position, labels and the month to show next (the last wraps to the first)."""
    # At most twelve rows per calendar year reach the window.
    distinct = months.select(month).filter(F.col(month).isNotNull()).distinct()
    order = Window.orderBy(month)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return distinct.select(
        month,
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        month_label(F.col(month)).alias("label"),
        month_label(F.col(month), long=True).alias("long_label"),
        F.coalesce(F.lead(month).over(order), F.first(month).over(whole)).alias("next_month"),
    )


def systematic_sample(df: DataFrame, by: str, order: str, n: int = SAMPLE_SIZE) -> DataFrame:
    """Rows at positions floor(i * size / n) of each group, all rows when the group has at most ``n``.

    ``order`` is unique and gives the position of a row. Positions are found on the two columns alone: they are
    range-partitioned into even pieces, rows are numbered within a piece, and the sizes of the earlier pieces of
    the group are added. So no task sees a whole group, and wide rows are only read again to be picked.
    """
    ranges = df.select(by, order).repartitionByRange(by, order)
    # Written down, because the piece of a row must not change between its uses.
    pieces = cut_lineage(ranges.withColumn("piece", F.spark_partition_id()), "pieces")
    group = Window.partitionBy(by)
    earlier = group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy(by, "piece").agg(F.count(F.lit(1)).alias("rows")).select(
        by, "piece",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"),
        F.sum("rows").over(group).alias("size"),
    )
    within = Window.partitionBy(by, "piece").orderBy(order)
    ranked = keyed_join(pieces, offsets, [by, "piece"]).withColumn(
        "place", F.col("offset") + F.row_number().over(within) - 1
    )
    # Doubles on purpose: whole-number arithmetic picks other rows in some cases.
    step = F.col("size") / F.lit(float(n))
    guess = F.floor(F.col("place") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | (i.between(0, n - 1) & (F.floor(i * step) == F.col("place")))
    # At most n rows a group; sent whole while their bytes are few, so the wide rows need no shuffle.
    picked = broadcast_if_small(*cut_lineage_counted(ranked.filter((F.col("size") <= n) | hit).select(order), "picked"))
    return df.join(picked, order, "left_semi")
