"""Moments for every prefix of a list of keys, rolled up level by level from those of the finest groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumetrics.functions.scalars import number
from plumetrics.operators.quantiles import keyed_join, with_row
from plumetrics.session import cut_lineage


def merged_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of (n_rows, n, mean, spread: sum of squared distances from the mean), merged to ``keys``.

    Distances are taken from each group's own mean, so large values with a small spread keep their digits.
    """
    weighted = F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    means = parts.groupBy(*keys).agg(weighted.alias("centre"))
    centred = keyed_join(parts, means, keys) if keys else with_row(parts, means, "m").withColumn("centre", F.col("m.centre"))
    away = F.col("mean") - F.col("centre")
    return centred.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.min("centre").alias("mean"),
        F.sum(F.col("spread") + F.col("n") * away * away).alias("spread"))


def rollup_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, n_rolled, n_rows, n, mean and std (sample) of ``value`` for all prefixes of ``keys``, down to the total.

    ``n_rolled`` is the number of last keys that a row adds up over: it tells a total from a group whose key is missing.
    Raw rows are reduced once, to one row of moments per finest group; each level is merged from the finer one before.
    Without a present value mean and std are null, and with one std is. An empty table has no groups and no total.
    """
    keys = list(keys)
    x = number(value)
    level = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.count(x) * F.var_pop(x)).alias("spread"))
    levels = []
    for kept in range(len(keys), -1, -1):
        if kept < len(keys):
            level = merged_moments(level, keys[:kept])
        level = cut_lineage(level.filter("n_rows > 0"), "moments")
        rolled = {k: F.lit(None).cast(df.schema[k].dataType) for k in keys[kept:]}
        levels.append(level.withColumns({**rolled, "n_rolled": F.lit(len(keys) - kept)}))
    spread = F.greatest(F.col("spread"), F.lit(0.0))
    return reduce(DataFrame.unionByName, levels).select(
        *keys, "n_rolled", "n_rows", "n", "mean", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"))
