"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table counted to have at most this many rows and bytes is sent whole to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "plumetrics", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="plumetrics-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no other call returns."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile drop their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared scratch folder once and read it back.

    Survives the loss of executors, computes the input once, and gives later joins true file sizes: the
    planner then broadcasts the table only if it is under the broadcast threshold.
    """
    return cut_lineage_counted(df, label)[0]


def cut_lineage_counted(df: DataFrame, label: str = "step", only: Column | None = None) -> tuple[DataFrame, int]:
    """Like ``cut_lineage``, with the number of rows (for which ``only`` is true), counted while they are written.

    The shuffle files behind the table are dropped as soon as it is written: nothing reads them again.
    """
    path = scratch_path(df.sparkSession, label)
    seen = Observation()
    with shuffles_freed(df.sparkSession):
        n_rows = F.count(F.lit(1)) if only is None else F.count_if(only)
        df.observe(seen, n_rows.alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table of few rows and bytes; beyond that leave the join, and its skew, to the planner.

    ``df`` is read once to add up its texts and other values without a fixed width, so it should be a stored table.
    """
    if rows > BROADCAST_ROWS:
        return df
    fixed = (T.NumericType, T.DatetimeType, T.DateType, T.BooleanType)
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    n_bytes = 16 * rows * len(df.columns)
    if loose:
        lengths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("bigint") for c in loose]
        n_bytes += df.agg(F.sum(reduce(lambda a, b: a + b, lengths))).first()[0] or 0
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df
