"""What the operators share: table access, Arrow helpers, and numbering rows in a global order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumetrics.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def texts(column: pa.Array) -> list[str]:
    """Column values as str, null as empty text."""
    return [t or "" for t in column.to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has such a column."""
    while name in df.columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def piece_count(size: float, per_piece: float, least: int = 1) -> int:
    """Number of pieces that hold at most ``per_piece`` on average."""
    return max(least, math.ceil(size / per_piece))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """``df`` with ``place``: the position, from 0, of a row in its group when sorted by ``order``.

    Rows are range-partitioned by group and order, so a large group is spread over many tasks; a row's place is its
    place in its piece plus the sizes of the earlier pieces. Equal rows get their places in any order.
    """
    keys = [*group, *order]
    pieces = cut_lineage(
        df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_piece": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}),
        label,
    )
    # One row per piece and group. Without a group that is one row per partition, whatever the data.
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    begins = begins.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate([*group, "_piece"])], "_before", "_first")
    key = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate([*group, "_piece"])]
    return pieces.join(begins, key).select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"))
