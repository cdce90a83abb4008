"""Incremental ingest of text soundings and running city means (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.session import scratch_path
from plumetrics.sources.readers import UNKNOWN_CITY, ingest_gate
from plumetrics.sources.snapshots import SnapshotTable, newest_rows

CITY_MONTH = ["city_key", "month"]


def text_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Soundings as text from the headered CSV files that arrive in ``folder``.

    A header that does not name the columns of ``schema`` in their order stops the stream.
    """
    return (
        spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )


def ingest_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Pass everything that has arrived through the gate and append it to a Parquet table, exactly once."""
    query = (
        ingest_gate(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def city_month_running(stream: DataFrame) -> DataFrame:
    """Running count and mean per city and month; the state is one row per city and month."""
    known = ingest_gate(stream).filter(F.col("city") != UNKNOWN_CITY)
    return known.groupBy("city_key", "month").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("xco2").alias("mean_value")
    )


def upsert_available(running: DataFrame, target: str, checkpoint: str, compact_every: int = 50) -> None:
    """Commit the rows each batch changed to the table in ``target``; a batch that runs again changes nothing.

    Every ``compact_every`` batches one row per key is written as a snapshot, which readers use from then on.
    """

    def save(changed: DataFrame, batch: int) -> None:
        table = SnapshotTable(changed.sparkSession, target)
        table.append(changed, batch)
        if (batch + 1) % compact_every == 0:
            table.compact(lambda rows: newest_rows(rows, CITY_MONTH))

    query = (
        running.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The committed state of the upserted table: of every key the row of its last batch."""
    return newest_rows(SnapshotTable(spark, target).read("city_key string, month date, n_points bigint, mean_value double"), CITY_MONTH)


def scratch_pair(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh (target, checkpoint) folders."""
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
