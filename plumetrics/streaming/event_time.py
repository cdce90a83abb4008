"""Monthly means by event time: a watermark, months that are closed and leave the state, and a table of late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumetrics.session import cut_lineage
from plumetrics.sources.readers import UNKNOWN_CITY, ingest_gate
from plumetrics.sources.snapshots import SnapshotTable

MICROS_A_DAY = 86_400_000_000
OPEN = "city_key string, month date, n_points bigint, total double, seen bigint"
CLOSED = "city_key string, month date, n_points bigint, total double"


def micros(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp"))


def month_end() -> Column:
    return micros(F.add_months("month", 1))


def _tables(spark: SparkSession, target: str) -> dict[str, SnapshotTable]:
    return {name: SnapshotTable(spark, f"{target.rstrip('/')}/{name}") for name in ("open", "closed", "late")}


def take_batch(soundings: DataFrame, batch: int, target: str, delay_days: float) -> None:
    """Add one batch of gated soundings to the months under ``target``.

    The watermark is the latest event time of the earlier batches less ``delay_days``. A row of a month that ended by
    then is late: its month is closed, and the row goes to the table of late rows as it is. All others change their
    month. Then the watermark follows this batch, and the months it has passed move from the state to the closed
    months, once. The state holds the open months and the latest event time only.

    Late rows and closed months are committed before the state, each once a batch, so a batch that was cut off and
    runs again ends in the same tables; readers go by the last batch of the state.
    """
    spark = soundings.sparkSession
    tables = _tables(spark, target)
    if tables["open"].committed(batch):
        return
    before = tables["open"].read(OPEN).drop("batch")
    seen = before.agg(F.max("seen")).first()[0]
    delay = int(delay_days * MICROS_A_DAY)
    mark = F.lit(None if seen is None else seen - delay).cast("bigint")
    late = F.coalesce(month_end() <= mark, F.lit(False))

    soundings = soundings.persist()
    try:
        tables["late"].append(soundings.filter(late), batch)
        newest = soundings.agg(F.max(micros(F.col("datetime")))).first()[0]
        latest = max((x for x in (seen, newest) if x is not None), default=None)
        fresh = soundings.filter(~late).groupBy("city_key", "month").agg(
            F.count(F.lit(1)).alias("n_points"), F.sum("xco2").alias("total"))
        # A row without a month only carries the latest event time.
        both = before.filter(F.col("month").isNotNull()).drop("seen").unionByName(fresh)
        months = cut_lineage(both.groupBy("city_key", "month").agg(
            F.sum("n_points").alias("n_points"), F.sum("total").alias("total")), "months")
    finally:
        soundings.unpersist()
    passed = F.coalesce(month_end() <= F.lit(None if latest is None else latest - delay).cast("bigint"), F.lit(False))
    tables["closed"].append(months.filter(passed), batch)
    clock = spark.createDataFrame([(None, None, None, None, latest)], OPEN)
    tables["open"].replace(months.filter(~passed).withColumn("seen", F.lit(latest).cast("bigint")).unionByName(clock), batch)


def months_available(stream: DataFrame, target: str, checkpoint: str, delay_days: float) -> None:
    """Take everything that has arrived, micro-batch by micro-batch, into the months under ``target``."""

    def save(text: DataFrame, batch: int) -> None:
        take_batch(ingest_gate(text).filter(F.col("city") != UNKNOWN_CITY), batch, target, delay_days)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def month_means(spark: SparkSession, target: str) -> DataFrame:
    """Count and mean of every month so far, and whether it is closed. Nothing committed: an empty table."""
    tables = _tables(spark, target)
    state = tables["open"].read(OPEN)
    done = tables["closed"].read(CLOSED).filter(F.col("batch") <= F.lit(tables["open"].newest()))
    rows = state.filter(F.col("month").isNotNull()).select("city_key", "month", "n_points", "total", F.lit(False).alias("closed"))
    rows = rows.unionByName(done.select("city_key", "month", "n_points", "total", F.lit(True).alias("closed")))
    return rows.select("city_key", "month", "n_points", (F.col("total") / F.col("n_points")).alias("mean_value"), "closed")


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """The soundings that came after their month was closed, with the batch in which they came."""
    tables = _tables(spark, target)
    return tables["late"].read("city_key string, month date, xco2 double").filter(F.col("batch") <= F.lit(tables["open"].newest()))
