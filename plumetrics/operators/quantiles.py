"""Exact quantiles (linear interpolation at (n - 1) p) that hold up when one group owns most rows.

Spark's ``percentile`` keeps every distinct value of a group in the memory of one task. That is right for
groups of bounded size, so group sizes are counted first. Groups beyond ``direct_limit`` rows are narrowed
instead: counts per bin, which add up on the map side and spread over all reducers, show which bin holds a
wanted rank; only the values of that bin are looked at next, until few enough are left to order them. No raw
row of such a group is ever shuffled before that, and counts are exact, so the result is.

Tables of very many groups, each of few rows, would spend most of their time on making, storing and merging those value
maps. There the rows are dealt by group and sorted by value instead, and the wanted places are read off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.functions.scalars import number
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

DIRECT_LIMIT = 1_000_000
# Narrowing: bins per round, and the number of values that are ordered at last.
BINS = 4096
IN_HAND = 1_000_000
# Groups are counted by buckets of their hash first: a few bytes a bucket, however many groups there are.
BUCKETS = 1 << 16
GREATEST = 1.7976931348623157e308

# output name -> (column, probability)
QuantileSpec = Mapping[str, tuple[str, float]]


def median_of(column: str) -> tuple[str, float]:
    return (column, 0.5)


def quartiles_of(column: str, prefix: str) -> dict[str, tuple[str, float]]:
    return {f"{prefix}_q1": (column, 0.25), f"{prefix}_q3": (column, 0.75)}


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys`` (a missing key is a group of its own), keys kept once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"_right_{k}" for k in keys])


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """``df`` with the single row of another frame as a struct column: one scalar subquery, no join."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def group_summary(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column] = (),
    quantiles: QuantileSpec | None = None,
    direct_limit: int = DIRECT_LIMIT,
    bins: int = BINS,
    in_hand: int = IN_HAND,
    stored: bool = False,
) -> DataFrame:
    """One row per group with ``aggregates`` and exact ``quantiles``; ``keys`` may be empty.

    ``df`` should hold few columns beside those used: it is written to the scratch folder once (``stored`` tells that
    it already is such a table), so the work behind it is not repeated for each of the readings that follow.
    """
    keys = list(keys)
    if not quantiles:
        return df.groupBy(*keys).agg(*aggregates)
    direct = _direct_columns(quantiles)
    if not aggregates:
        df = df.select(*dict.fromkeys([*keys, *[column for column, _ in quantiles.values()]]))
    df, n_rows = (df, df.count()) if stored else cut_lineage_counted(df, "summary-input")
    # No group is larger than the table.
    if n_rows <= direct_limit:
        return df.groupBy(*keys).agg(*aggregates, *direct)
    if not keys:
        picked = narrowed_quantiles(df, keys, quantiles, bins, in_hand)
        if not aggregates:
            return picked
        return with_row(df.agg(*aggregates), picked, "picked").select("*", "picked.*").drop("picked")

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    buckets, n_used = cut_lineage_counted(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows")), "buckets")
    # Only when groups are many is a raw row per value, dealt by group, spread over all tasks; sorting carries whole rows,
    # so rows that hold much beside the values are cheaper by value maps.
    columns = {column for column, _ in quantiles.values()}
    narrow = len(df.columns) - len(keys) - len(columns) <= len(columns)
    rest = (lambda some: _ordered_summary(some, keys, aggregates, quantiles)) if narrow and n_used > BUCKETS // 2 else (
        lambda some: some.groupBy(*keys).agg(*aggregates, *direct))
    # A group is no larger than its bucket, so groups are counted one by one in large buckets alone.
    large = buckets.filter(F.col("_rows") > direct_limit).select("_bucket")
    n_large = large.count()
    if not n_large:
        return rest(df)
    inside = df.select(*keys, bucket.alias("_bucket")).join(broadcast_if_small(large, n_large), "_bucket", "left_semi")
    hot = inside.groupBy(*keys).count().filter(F.col("count") > direct_limit).drop("count")
    hot, n_hot = cut_lineage_counted(hot, "hot-groups")
    if not n_hot:
        return rest(df)
    # There are fewer hot groups than rows / direct_limit. Broadcasting them keeps the rows of a hot group
    # spread over the tasks that read them.
    hot = broadcast_if_small(hot, n_hot)
    cold_rows = keyed_join(df, hot, keys, "left_anti")
    hot_rows = keyed_join(df, hot, keys, "left_semi")
    picked = narrowed_quantiles(hot_rows, keys, quantiles, bins, in_hand)
    base = hot_rows.groupBy(*keys).agg(*aggregates) if aggregates else hot
    hot_result = keyed_join(base, picked, keys, "left")
    return rest(cold_rows).unionByName(hot_result)


def quantile_row(df: DataFrame, quantiles: QuantileSpec, **options) -> DataFrame:
    """Whole-table quantiles as a single row."""
    return group_summary(df, [], (), quantiles, **options)


def _direct_columns(quantiles: QuantileSpec) -> list[Column]:
    wanted: dict[str, list[float]] = {}
    for column, p in quantiles.values():
        wanted.setdefault(column, []).append(p)
    # One value map per column serves all its probabilities.
    maps = {c: F.percentile(number(c), F.array(*[F.lit(float(p)) for p in ps])) for c, ps in wanted.items()}
    return [
        maps[column][wanted[column].index(p)].alias(name) for name, (column, p) in quantiles.items()
    ]


def _ordered_summary(df: DataFrame, keys: list[str], aggregates: Sequence[Column], quantiles: QuantileSpec) -> DataFrame:
    """One row per group, quantiles read off the sorted values.

    Rows are sorted by a hash of the keys first, which tells most groups apart by one number; texts are compared only
    where hashes are equal. They are dealt by the keys alone, so that joins on these need no further exchange.
    """
    columns = list(dict.fromkeys(column for column, _ in quantiles.values()))
    group = ["_hash", *keys]
    rows = df.withColumn("_hash", F.xxhash64(*keys)).repartition(*keys)
    for i, c in enumerate(columns):
        rows = rows.withColumn(f"_v{i}", number(c))
        order = Window.partitionBy(*group).orderBy(F.col(f"_v{i}").asc_nulls_last())
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({f"_n{i}": F.count(f"_v{i}").over(whole), f"_at{i}": F.row_number().over(order) - 1})

    def rank(i: int, p: float) -> Column:
        return (F.col(f"_n{i}") - 1) * F.lit(float(p))

    wanted = sorted({(columns.index(c), float(p)) for c, p in quantiles.values()})
    ends = []
    for k, (i, p) in enumerate(wanted):
        ends += [F.max(F.when(F.col(f"_at{i}") == end(rank(i, p)), F.col(f"_v{i}"))).alias(f"_x{e}_{k}")
                 for e, end in enumerate((F.floor, F.ceil))]
    sizes = [F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))]
    out = rows.groupBy(*group).agg(*aggregates, *sizes, *ends)

    def value(column: str, p: float) -> Column:
        i = columns.index(column)
        k, at = wanted.index((i, float(p))), rank(i, p)
        return _between(at, F.col(f"_x0_{k}"), F.col(f"_x1_{k}"))

    inner = {"_hash", *[f"_n{i}" for i in range(len(columns))], *[f"_x{e}_{k}" for k in range(len(wanted)) for e in (0, 1)]}
    return out.select(*[c for c in out.columns if c not in inner], *[value(*spec).alias(name) for name, spec in quantiles.items()])


def _between(at: Column, x0: Column, x1: Column) -> Column:
    """The value at rank ``at``; in the form that ``percentile`` uses, so all ways agree, infinite and very large values included."""
    return F.when(x0 == x1, x0).otherwise((F.ceil(at) - at) * x0 + (at - F.floor(at)) * x1)


def narrowed_quantiles(
    df: DataFrame, keys: Sequence[str], quantiles: QuantileSpec, bins: int = BINS, in_hand: int = IN_HAND
) -> DataFrame:
    """Quantiles by narrowing for every group, without looking at sizes first.

    Groups in which every value is missing are absent from the result when there are keys.
    """
    keys = list(keys)
    columns = sorted({column for column, _ in quantiles.values()})
    probabilities = sorted({float(p) for _, p in quantiles.values()})
    series = F.explode(F.array(*[
        F.struct(F.lit(i).alias("series"), number(c).alias("v")) for i, c in enumerate(columns)
    ]))
    values = (
        df.select(*keys, series.alias("s")).select(*keys, "s.series", "s.v").filter(F.col("v").isNotNull())
    )
    group = [*keys, "series"]

    # One row per wanted rank: the range of values it lies in, and how many values lie below and inside.
    at = (F.col("n") - 1) * F.col("p")
    whole = values.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = (
        whole.select("*", F.explode(F.array(*map(F.lit, probabilities))).alias("p"))
        .select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
        .select(*group, "n", "p", "rank", "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    )
    ranks, n_ranks = cut_lineage_counted(ranks, "ranks")
    # A range too short to cut holds a handful of distinct values at most.
    wide = (F.col("inside") > in_hand) & (_half("high") - _half("low") > 0)
    while not ranks.filter(wide).isEmpty():
        open_ranks = ranks.filter(wide)
        counts = (
            _within(values, open_ranks, group, n_ranks).withColumn("bin", _bin(bins))
            .groupBy(*group, "low", "high", "bin")
            .agg(F.count(F.lit(1)).alias("copies"), F.min("v").alias("to_low"), F.max("v").alias("to_high"))
        )
        moved = _holding(open_ranks, counts, group, "bin").select(
            *group, "n", "p", "rank", F.col("to_low").alias("low"), F.col("to_high").alias("high"),
            (F.col("below") + F.col("upto") - F.col("copies")).alias("below"), F.col("copies").alias("inside"),
        )
        ranks = cut_lineage(ranks.filter(~wide).unionByName(moved), "ranks")

    counts = _within(values, ranks, group, n_ranks).groupBy(*group, "low", "high", "v").agg(
        F.count(F.lit(1)).alias("copies")
    )
    found = _holding(ranks, counts, group, "v").groupBy(*group, "n", "p").agg(
        F.max(F.when(F.col("rank") == F.floor(at), F.col("v"))).alias("x0"),
        F.max(F.when(F.col("rank") == F.ceil(at), F.col("v"))).alias("x1"),
    )
    valued = found.withColumn("value", _between(at, F.col("x0"), F.col("x1")))
    return valued.groupBy(*keys).agg(*[
        F.max(F.when((F.col("series") == columns.index(c)) & (F.col("p") == float(p)), F.col("value"))).alias(name)
        for name, (c, p) in quantiles.items()
    ])


def _within(values: DataFrame, ranks: DataFrame, group: list[str], n_ranks: int) -> DataFrame:
    """Values inside the ranges of the wanted ranks; a range shared by several ranks counts once."""
    ranges = broadcast_if_small(ranks.select(*group, "low", "high").distinct(), n_ranks)
    return keyed_join(values, ranges, group).filter(F.col("v").between(F.col("low"), F.col("high")))


def _half(column: str) -> Column:
    """Half of a value: differences of halves stay finite, infinite values included."""
    return F.greatest(F.lit(-GREATEST), F.least(F.lit(GREATEST), F.col(column))) / 2


def _bin(bins: int) -> Column:
    """Bin of ``v`` between ``low`` and ``high``; the two ends never share one."""
    part = (_half("v") - _half("low")) / (_half("high") - _half("low"))
    return F.least(F.lit(bins - 1), F.floor(part * bins))


def _holding(ranks: DataFrame, counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Each wanted rank with the bin or value that holds it."""
    upto = Window.partitionBy(*group, "low", "high").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.withColumn("upto", F.sum("copies").over(upto))
    holds = (F.col("rank") < F.col("below") + F.col("upto")) & (
        F.col("rank") >= F.col("below") + F.col("upto") - F.col("copies")
    )
    return keyed_join(ranks, ordered, [*group, "low", "high"]).filter(holds)
