"""Interquartile scaling and whole-table thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.functions.scalars import number
from plumetrics.operators.quantiles import QuantileSpec, quantile_row, quartiles_of


def table_quantiles(df: DataFrame, quantiles: QuantileSpec, **options) -> dict[str, Column]:
    """Whole-table quantiles of ``df`` as constants: computed once, then free in every query that uses them."""
    row = quantile_row(df, quantiles, **options).first()
    return {name: F.lit(row[name]).cast("double") for name in quantiles}


def iqr_norm(columns: Mapping[str, str], **options) -> Callable[[DataFrame], DataFrame]:
    """Transform adding ``(x - Q1) / (Q3 - Q1)`` for each ``output: input``; a flat column gives NULL."""

    def transform(df: DataFrame) -> DataFrame:
        wanted: dict[str, tuple[str, float]] = {}
        for column in sorted(set(columns.values())):
            wanted.update(quartiles_of(column, column))
        q = table_quantiles(df, wanted, **options)
        return df.withColumns({
            out: F.try_divide(number(c) - q[f"{c}_q1"], q[f"{c}_q3"] - q[f"{c}_q1"])
            for out, c in columns.items()
        })

    return transform
