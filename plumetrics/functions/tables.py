"""Table functions for SQL: the grids of fitted lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf


@arrow_udtf(returnType="line string, step int, x double, fitted double")
class TrendGrid:
    """``trend_grid(TABLE(lines), steps)``: each line at ``steps`` even places from its low to its high end.

    The table's columns are line, intercept, slope, low, high. A line with a missing number gives no rows; one step is
    the low end alone.
    """

    def eval(self, lines: pa.RecordBatch, steps: pa.Array) -> Iterator[pa.Table]:
        n = steps[0].as_py()
        step = np.arange(n, dtype=np.int32)
        for line, *ends in zip(*(c.to_pylist() for c in lines.columns)):
            if None not in ends:
                intercept, slope, low, high = ends
                x = low + (high - low) * step / max(n - 1, 1)
                yield pa.table({"line": [line] * n, "step": step, "x": x, "fitted": intercept + slope * x})


def register_table_functions(spark: SparkSession) -> None:
    """Make ``trend_grid`` usable from SQL in this session."""
    spark.udtf.register("trend_grid", TrendGrid)
