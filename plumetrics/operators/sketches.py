"""Mergeable sketches, stored per group and batch: quantiles (KLL) and distinct counts (HyperLogLog).

An opt-in for inputs so large that the exact rounds of ``quantiles`` cost too much. Sketches of a few kilobytes are made
while rows are read; sketches of batches, months or groups merge to the sketch of all their rows, to the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.functions.scalars import number
from plumetrics.operators.quantiles import QuantileSpec

RANK_ERROR = 0.01
LEAST_K, MOST_K = 8, 65535


def sketch_size(rank_error: float = RANK_ERROR) -> int:
    """The KLL parameter for a rank error.

    The published error of KLL at 99 % confidence is 2.446 / k^0.9433. Half the wanted error is asked for, so a rank
    is off by more than ``rank_error`` only at more than five standard deviations.
    """
    k = math.ceil((2.446 / (rank_error / 2)) ** (1 / 0.9433))
    if k > MOST_K:
        raise ValueError(f"a rank error of {rank_error} needs k = {k}; the greatest is {MOST_K}")
    return max(LEAST_K, k)


def quantile_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """One row per group: ``n_rows`` and, for each column, its sketch under the column's name. Missing values and NaN are left out."""
    k = F.lit(sketch_size(rank_error))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.kll_sketch_agg_double(number(c), k).alias(c) for c in columns])


def merged_quantile_sketches(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Sketches made by ``quantile_sketches`` with the same rank error, merged to ``keys`` (a part of theirs, or none)."""
    k = F.lit(sketch_size(rank_error))
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *[F.kll_merge_agg_double(c, k).alias(c) for c in columns])


def quantiles_of(sketches: DataFrame, keys: Sequence[str], quantiles: QuantileSpec) -> DataFrame:
    """Quantiles out of sketches: values of the data whose rank is off by at most the rank error. Null without values."""
    def value(column: str, p: float) -> Column:
        own = F.col(column)
        filled = own.isNotNull() & (F.kll_sketch_get_n_double(own) > 0)
        return F.when(filled, F.kll_sketch_get_quantile_double(own, F.lit(float(p))))

    return sketches.select(*keys, *[value(c, p).alias(name) for name, (c, p) in quantiles.items()])


def quantiles_sketched(df: DataFrame, keys: Sequence[str], quantiles: QuantileSpec, rank_error: float = RANK_ERROR) -> DataFrame:
    """The approximate counterpart of ``group_summary(df, keys, quantiles=...)``: one aggregation, no rounds."""
    columns = list(dict.fromkeys(c for c, _ in quantiles.values()))
    return quantiles_of(quantile_sketches(df, keys, columns, rank_error), keys, quantiles)


DISTINCT_LOG_K = 14


def distinct_error(log_k: int = DISTINCT_LOG_K) -> float:
    """Five standard deviations of the relative error of a merged sketch."""
    return 5 * 1.04 / math.sqrt(1 << log_k)


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str, log_k: int = DISTINCT_LOG_K) -> DataFrame:
    """(keys, sketch): a HyperLogLog sketch of the different present values of ``column`` per group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(log_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches merged to ``keys`` (none: one row): values that several groups share count once."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``n_distinct`` estimated from each sketch, in place of the sketch; the relative error is under ``distinct_error``."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
