"""Unions, site joins and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumetrics.operators.quantiles import keyed_join


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns one of them lacks are filled with NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def left_join(facts: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which missing keys match each other; repeated keys of ``other`` repeat the fact.

    The planner broadcasts ``other`` when it is small, and splits hot keys at run time when it is not.
    """
    return keyed_join(facts, other, keys, "left")


def attach_sites(observations: DataFrame, sites: DataFrame, key: str = "target_name") -> DataFrame:
    """Replace the place columns of the observations by those of the site table."""
    return left_join(observations.drop("city", "country", "population"), sites, [key])


def join_present(facts: DataFrame, other: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Left join, then keep rows where ``required`` is present; the planner makes it an inner join."""
    return left_join(facts, other, keys).filter(F.col(required).isNotNull())


def keys_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return keyed_join(left.select(key).distinct(), right.select(key).distinct(), [key], "left_anti")


def match_count(joined: DataFrame, column: str) -> DataFrame:
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_matched"),
        F.count_if(F.col(column).isNull()).alias("n_unmatched"),
    )
