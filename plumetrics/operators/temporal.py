"""Joins and running sums along time that spread one hot site over many tasks.

Rows are range-partitioned by key and time into even pieces, whatever their keys. What a piece needs from the pieces
before it (a last value, a sum) is one row per key and piece; windows over those rows stand in for one over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.operators.quantiles import keyed_join
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

MICROS_A_DAY = 86_400_000_000


def in_pieces(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` with ``_piece``: even ranges of ``order``, written down so that a row's piece stays the same."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), label)


def carried(edges: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """(by, _piece) with ``columns`` evaluated over the earlier pieces of the key, broadcast if few."""
    out = edges.select(*by, "_piece", *[c.alias(n) for n, c in columns.items()])
    return broadcast_if_small(*cut_lineage_counted(out, "piece-edges"))


def earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], right_time: str | None = None,
    matched: str = "matched_time",
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` at or before its time, and that row's time.

    Rows match on equal ``by``; a missing key or time matches nothing, and such rows of ``left`` stay without values.
    Of right rows at one key and time the one with the greatest values (compared in their order) counts. Right rows
    count with their missing values: the last row decides, not the last present value.
    """
    by, values = list(by), list(values)
    right_time = right_time or time
    seen = right.filter(F.col(right_time).isNotNull()).dropna(subset=by).groupBy(*by, F.col(right_time).alias("_at")).agg(
        F.max(F.struct(F.lit(0).alias("_any"), *values)).alias("_best"))
    held = F.struct(F.col("_at").alias(matched), *[F.col(f"_best.{v}").alias(v) for v in values])
    row = F.struct(*left.columns)
    rights = seen.select(*by, "_at", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_salt"),
                         F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"), held.alias("_held"))
    # Many rows of one key and time may lie in different pieces, as nothing changes between them.
    lefts = left.select(*by, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_salt"),
                        row.alias("_row"), F.lit(None).cast(rights.schema["_held"].dataType).alias("_held"))
    pieces = in_pieces(rights.unionByName(lefts), [*by, "_at", "_side", "_salt"], "as-of")
    last = F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col("_at")))
    edges = pieces.groupBy(*by, "_piece").agg(last.alias("_last"))
    before = carried(edges, by, {"_before": F.last("_last", ignorenulls=True).over(earlier(by))})
    within = Window.partitionBy("_piece", *by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = pieces.withColumn("_own", F.last("_held", ignorenulls=True).over(within)).filter("_side = 1")
    found = keyed_join(own, before, [*by, "_piece"], "left").withColumn("_found", F.coalesce("_own", "_before"))
    known = F.col("_at").isNotNull()
    for key in by:
        known = known & F.col(key).isNotNull()
    return found.withColumn("_found", F.when(known, F.col("_found"))).select("_row.*", "_found.*")


def on_axis(df: DataFrame, column: str) -> Column:
    """A time as microseconds, a whole number as it is."""
    c = F.col(column)
    return c.cast("bigint") if isinstance(df.schema[column].dataType, T.IntegralType) else F.unix_micros(c.cast("timestamp"))


def bin_of(position: Column, width: Column) -> Column:
    """Number of the bin, rounded down; whole-number arithmetic throughout."""
    return F.call_function("div", position - F.pmod(position, width), width)


def interval_join(
    points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, base: int = MICROS_A_DAY,
) -> DataFrame:
    """Pairs of points and spans with equal ``by`` and start <= at < end: all columns of both, keys once.

    A span is put into the bins it touches, at the level (bins of base x 4^level) whose bins are at least as long as
    itself, so into two bins at most. A point looks into one bin at each level that occurs, and bounds are compared
    again. A pair meets once, as a span has one level and a point one bin there. Missing keys, times or bounds match
    nothing; a span that ends where it starts is empty. Names of columns other than ``by`` must differ.
    """
    by = list(by)
    begin, stop = on_axis(spans, start), on_axis(spans, end)
    placed = spans.withColumns({"_begin": begin, "_end": stop}).filter("_begin < _end")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_end") - F.col("_begin")) / F.lit(float(base))) / 2)).cast("int")
    width = (F.lit(base) * F.pow(F.lit(4.0), F.col("_level"))).cast("bigint")

    binned = cut_lineage(placed.withColumn("_level", level).withColumn("_width", width), "spans")
    # A level for each factor of four between the shortest and the longest span: few, whatever the data.
    levels = sorted(r["_level"] for r in binned.select("_level").distinct().collect())
    bins = F.sequence(bin_of(F.col("_begin"), F.col("_width")), bin_of(F.col("_end") - 1, F.col("_width")))
    left = binned.withColumn("_bin", F.explode(bins))
    known = points.withColumn("_at", on_axis(points, at)).filter(F.col("_at").isNotNull())
    looked = known.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(
        "_width", width).withColumn("_bin", bin_of(F.col("_at"), F.col("_width")))
    pairs = looked.drop("_width").join(left.drop("_width"), [*by, "_level", "_bin"])
    return pairs.filter("_begin <= _at and _at < _end").drop("_level", "_bin", "_at", "_begin", "_end")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with n_running, sum_running, mean_running and previous of ``value`` along ``order`` within ``by``.

    ``order`` tells the rows of a key apart. Missing values count and add nothing; ``previous`` is the value of the row
    before, missing or not, null for the first. Missing keys are a key of their own. Decimal values are summed exactly;
    sums of doubles may differ in the last digits with the pieces.
    """
    by, order = list(by), list(order)
    pieces = in_pieces(df, [*by, *order], "running")
    within = Window.partitionBy("_piece", *by).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    edges = pieces.groupBy(*by, "_piece").agg(
        F.count(value).alias("_n"), F.sum(value).alias("_sum"), F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    before = carried(edges, by, {
        "_n_before": F.coalesce(F.sum("_n").over(earlier(by)), F.lit(0)), "_sum_before": F.sum("_sum").over(earlier(by)),
        "_previous": F.lag("_last").over(Window.partitionBy(*by).orderBy("_piece"))})
    own = pieces.withColumns({
        "_n": F.count(value).over(so_far), "_sum": F.sum(value).over(so_far), "_lag": F.lag(value).over(within),
        "_row": F.row_number().over(within)})
    joined = keyed_join(own, before, [*by, "_piece"])
    total = F.coalesce(F.col("_sum") + F.col("_sum_before"), "_sum", "_sum_before")
    count = F.col("_n") + F.col("_n_before")
    previous = F.when(F.col("_row") > 1, F.col("_lag")).otherwise(F.col("_previous").getField(value))
    return joined.select(
        *df.columns, count.alias("n_running"), total.alias("sum_running"),
        F.when(count > 0, total.cast("double") / count).alias("mean_running"), previous.alias("previous"))
