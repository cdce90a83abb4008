"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.llm.common import numbered
from plumetrics.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
PORTION = 2 << 20
# Expected copies are whole multiples of 2^-32, so that prefix sums are exact.
UNIT = 1 << 32


def word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns as they are, with ``text`` replaced by ``size``, its number of words between ASCII white space.

    Works on the bytes of many texts at once: a word begins at a byte that is no white space and stands first in its text
    or behind white space.
    """
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    for batch in parts:
        column = pc.cast(batch.column("text"), pa.large_binary()).fill_null(b"")
        if column.offset:
            column = pa.concat_arrays([column])
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        size, first = np.zeros(len(column), np.int64), 0
        while first < len(column):
            # Whole texts of about PORTION bytes at a time.
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PORTION, side="right")) - 1)
            own = offsets[first: last + 1] - offsets[first]
            gap = space[data[offsets[first]: offsets[last]]]
            if len(gap):
                begins = ~gap
                begins[1:] &= gap[:-1]
                head = own[:-1][own[:-1] < own[1:]]
                begins[head] = ~gap[head]
                size[first:last] = np.diff(np.searchsorted(np.flatnonzero(begins), own))
            first = last
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(size)], names=[*rest, "size"])


def sized(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    read = docs.select(*carry, F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    return read.mapInArrow(word_counts, f"{kinds}, size bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources in code point order, null last, take the weights in turn. All sizes are shared out by weight; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight. That is a common level:
    target = min(most * size, level * weight), and sources stop in the order of most * size / weight. The window
    orders one row per source: mixture weights are a list of sources, so this is small beside the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    stop = F.lit(most) * F.col("source_size")
    weighed = sizes.withColumn("weight", share).withColumn("_stop", stop).withColumn("_at", stop / F.col("weight"))
    by_stop = Window.orderBy("_at", F.col("source").asc_nulls_last())
    before, whole = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("_stop").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("_level", rest / left)
    # Sources before the first that keeps below its stop are full. Levels rise up to it and fall behind it.
    level = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(whole)
    target = F.least(F.col("_stop").cast("double"), F.coalesce(level * F.col("weight"), F.col("_stop").cast("double")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 20, doc_id: str = "doc_id",
    text: str = "text", source: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= copies * size), and ``carry``.

    Within a source documents stand in the order of size, then id. Each is expected target / source_size times; the
    prefix sum of that, moved by one random offset per source, crosses a whole number as often as the document is
    emitted. The order by size keeps a source within about its largest document of its target. Everything is whole
    numbers and hashes of the source's name, so reruns agree.

    Null text has size 0; a null source is a source of its own, the last; documents of size 0 get copies but take no
    words; a source of size 0 has target 0 and gets none. Repeated rows are documents of their own (which of them
    gets more copies is not defined). An empty table gives an empty result. Places in a large source are found by
    range pieces, so no task holds a source.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    # Written once, as the range partitioning reads its input twice.
    sizes = cut_lineage(sized(read, [c for c in read.columns if c != "text"]), "sizes")
    placed = numbered(sizes, ["source"], ["size", "doc_id"], "places")
    goals = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size") * UNIT), F.lit(most * UNIT)),
    ).otherwise(0).cast("bigint")
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(UNIT))
    goals = goals.withColumn("_rate", rate).withColumn("_offset", offset)

    def crossed(places):
        # The whole part of (places * rate + offset) / UNIT without overflow: rate = high * UNIT + low.
        high, low = F.shiftright("_rate", 32), F.col("_rate").bitwiseAND(UNIT - 1)
        top, bottom = F.shiftright(places, 30), places.bitwiseAND((1 << 30) - 1)
        partial = top * low  # in units of 2^30
        below = bottom * low + F.col("_offset") + F.shiftleft(partial.bitwiseAND(3), 30)
        return places * high + F.shiftright(partial, 2) + F.shiftright(below, 32)

    copies = (crossed(F.col("place") + 1) - crossed(F.col("place"))).cast("int")
    joined = placed.withColumnRenamed("source", "_own").join(goals, F.col("_own").eqNullSafe(F.col("source")))
    return joined.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"),
        (copies.cast("bigint") * F.col("size")).alias("taken"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
