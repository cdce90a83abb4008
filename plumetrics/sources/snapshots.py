"""A table of committed batches: a killed write leaves nothing behind that a reader sees, a repeated one adds nothing.

Every attempt to write a batch has a folder of its own. A batch counts from the moment at which one row about it stands
in the table's log; that row is written by one task into one file, which appears whole or not at all. A snapshot stands
for all batches up to its own. Readers list the log first and then open the folders it names, so they never see a folder
that is being written, and go on with what they have listed while the table is compacted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "batch bigint, attempt string, whole boolean, columns string, committed_at timestamp"


class SnapshotTable:
    """Batches under ``root``. The numbers of batches ascend and belong to one writer (one streaming checkpoint)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        """One row per commit of a batch, or of a snapshot (``whole``)."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._no_rows(LOG)

    def visible(self) -> list[T.Row]:
        """The newest snapshot and the batches after it, in order: one short row each.

        Where two writers committed the same batch, the earlier entry counts.
        """
        log = self.log()
        newest = log.agg(F.max(F.when(F.col("whole"), F.col("batch")))).first()[0]
        own = ~F.col("whole") if newest is None else (
            ~F.col("whole") & (F.col("batch") > newest) | F.col("whole") & (F.col("batch") == newest))
        first: dict[int, T.Row] = {}
        for entry in sorted(log.filter(own).collect(), key=lambda r: (r["batch"], r["committed_at"], r["attempt"])):
            first.setdefault(entry["batch"], entry)
        return list(first.values())

    def newest(self) -> int | None:
        """The number of the last committed batch."""
        return self.log().agg(F.max("batch")).first()[0]

    def committed(self, batch: int) -> bool:
        """Whether the batch stands in the log, by itself or in a snapshot."""
        return not self.log().filter((F.col("batch") == batch) | F.col("whole") & (F.col("batch") >= batch)).isEmpty()

    def append(self, df: DataFrame, batch: int, partition_by: Sequence[str] = ()) -> bool:
        """Add ``df`` as ``batch``; false, and nothing is written, if the batch is committed already."""
        if self.committed(batch):
            return False
        self._commit(batch, self._write(df, batch, partition_by), df.schema, whole=False)
        return True

    def replace(self, df: DataFrame, batch: int, partition_by: Sequence[str] = ()) -> bool:
        """Make ``df`` the whole table as of ``batch``; false if a snapshot that is as new is there already."""
        if not self.log().filter(F.col("whole") & (F.col("batch") >= batch)).isEmpty():
            return False
        self._commit(batch, self._write(df, batch, partition_by), df.schema, whole=True)
        return True

    def compact(self, combine: Callable[[DataFrame], DataFrame], partition_by: Sequence[str] = ()) -> bool:
        """Write ``combine`` of all rows (with their ``batch``) as a snapshot of the last batch."""
        seen = self.visible()
        if len(seen) < 2:
            return False
        rows = combine(self._open(seen)).drop("batch")
        return self.replace(rows, seen[-1]["batch"], partition_by)

    def read(self, columns: str | None = None) -> DataFrame:
        """All committed rows with their ``batch`` (of a snapshot: its own). ``columns`` is the schema while nothing is committed."""
        seen = self.visible()
        if seen:
            return self._open(seen)
        if columns is None:
            raise ValueError(f"nothing is committed in {self.root}")
        return self._no_rows(f"{columns}, batch bigint")

    def _no_rows(self, columns: str) -> DataFrame:
        return self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), columns)

    def _folder(self, batch: int, attempt: str) -> str:
        return f"{self.root}/data/batch={batch}/attempt={attempt}"

    def _write(self, df: DataFrame, batch: int, partition_by: Sequence[str]) -> str:
        """Write one attempt. Rows of a partition are brought together, large partitions in several files."""
        attempt = uuid.uuid4().hex
        rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
        rows.write.partitionBy(*partition_by).parquet(self._folder(batch, attempt))
        return attempt

    def _commit(self, batch: int, attempt: str, schema: T.StructType, whole: bool) -> None:
        values = {"batch": F.lit(batch).cast("bigint"), "attempt": F.lit(attempt), "whole": F.lit(whole),
                  "columns": F.lit(schema.json()), "committed_at": F.current_timestamp()}
        entry = self.spark.range(1).select(*[c.alias(n) for n, c in values.items()])
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _open(self, entries: list[T.Row]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entries[-1]["columns"]))
        keyed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
        reader = self.spark.read.schema(keyed).option("basePath", f"{self.root}/data")
        return reader.parquet(*[self._folder(r["batch"], r["attempt"]) for r in entries]).drop("attempt")


def newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of every key the row of its last batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row")).select(*keys, "row.*")
