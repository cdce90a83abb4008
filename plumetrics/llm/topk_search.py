"""Exact top-k inner products by the three-phase uniform threshold (Cao and Wang, 2004), in tiles and blocks of vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from plumetrics.llm.common import piece_count
from plumetrics.session import cut_lineage

K = 20
LISTS = 4
QUERY_BLOCK, ROW_BLOCK = 512, 4096
# A tile is what travels: up to that many blocks, while its vectors take TILE_BYTES as 64-bit numbers. Small tables
# have more tiles, down to a block each, so that their pairs are enough for all tasks.
QUERY_TILE, ROW_TILE = 16, 8
QUERY_TILES, ROW_TILES = 2, 16
TILE_BYTES = 32 << 20
MOST_TASKS = 4096
SCALE = 64
NO_CUTOFF = -(1 << 63)
TILE = "tile long, ids binary, rows binary, width int, kind string, matrix binary"


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def tile_count(count: int, width: int, per_block: int, most_blocks: int, wanted: int) -> int:
    """Number of tiles of at most ``most_blocks`` blocks; ``wanted`` or more if there are as many blocks."""
    per_tile = max(per_block, min(per_block * most_blocks, TILE_BYTES // (8 * max(width, 1))))
    return max(piece_count(count, per_tile), min(piece_count(count, per_block), wanted))


def tiles(rows: DataFrame, number: int) -> DataFrame:
    """(id, row, vector) -> ``number`` tiles of about as many vectors each, in the narrowest whole numbers."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"])
        width = max((len(v) for v in part["vector"]), default=0)
        matrix = np.zeros((len(part), width), np.int64)
        for i, v in enumerate(part["vector"]):
            matrix[i, : len(v)] = v
        low, high = matrix.min(initial=0), matrix.max(initial=0)
        narrow = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return pd.DataFrame({
            "tile": [key[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "rows": [part["row"].to_numpy(np.int64).tobytes()],
            "width": [width], "kind": [np.dtype(narrow).str], "matrix": [matrix.astype(narrow).tobytes()]})

    # By row, so that no tile grows with the rows of one id.
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(number)))
    return cut_lineage(dealt.groupBy("tile").applyInPandas(pack, TILE), "tiles")


def unpacked(ids: bytes, rows: bytes, width: int, kind: str, matrix: bytes, to_width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers and matrix, padded with zeros to ``to_width`` columns."""
    ids, rows = (np.frombuffer(x, np.int64) for x in (ids, rows))
    matrix = np.frombuffer(matrix, kind).reshape(len(ids), width).astype(np.int64)
    return ids, rows, np.pad(matrix, ((0, 0), (0, to_width - width)))


def partial_scores(queries: np.ndarray, rows: np.ndarray, lists: int) -> np.ndarray:
    """Inner products over each of ``lists`` ranges of components: (lists, queries, rows). Exact whole numbers.

    Floating-point numbers are exact, and fast, as long as no sum can reach 2^24 or 2^53; beyond that 64-bit integers
    are used.
    """
    width = queries.shape[1]
    cuts = [width * i // lists for i in range(lists + 1)]
    bound = width * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    return np.stack([queries[:, a:b] @ rows[:, a:b].T for a, b in zip(cuts, cuts[1:])])


def local_lists(scores: np.ndarray, same: np.ndarray, k: int) -> list[np.ndarray]:
    """Phase 1: for each query the totals of the k best entries of each list, the k best of these totals."""
    lists, n_queries, n_rows = scores.shape
    total = scores.sum(axis=0)
    if n_rows <= k:
        return [total[q][~same[q]] for q in range(n_queries)]
    chosen = np.zeros((n_queries, n_rows), bool)
    least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    hidden = np.where(same[None], scores.dtype.type(least), scores)
    for one in hidden:
        np.put_along_axis(chosen, np.argpartition(one, n_rows - k, axis=1)[:, n_rows - k:], True, axis=1)
    chosen &= ~same
    return [np.sort(total[q][chosen[q]])[::-1][:k] for q in range(n_queries)]


def above(scores: np.ndarray, same: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, total) of all entries whose total reaches their query's ``cutoff``.

    An entry that reaches it has at least cutoff / lists (rounded down) in some list, so only such entries are collected; one is
    given up when its collected scores, with that uniform threshold for those not collected, stay below the cutoff;
    the others are resolved.
    """
    lists = len(scores)
    share = (cutoff // lists)[:, None]
    sent = scores >= share[None]
    reach = np.where(sent, scores, share[None]).sum(axis=0)
    query, row = np.nonzero(sent.any(axis=0) & ~same & (reach >= cutoff[:, None]))
    total = scores[:, query, row].sum(axis=0)
    keep = total >= cutoff[query]
    return query[keep], row[keep], total[keep]


def pieces(count: int, per_piece: int) -> list[slice]:
    return [slice(i, i + per_piece) for i in range(0, count, per_piece)]


def leading(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` rows of each query with the highest score, then the smaller id."""
    return found.sort_values(["query_row", "score", "vec_id"], ascending=[True, False, True]).groupby("query_row").head(k)


def best(rows: DataFrame, by: list[str], block: str, blocks: int, entry: Column, k: int) -> DataFrame:
    """(by, top): the ``k`` least ``entry`` values of a group, in two rounds, so that no list grows with the blocks."""
    part = F.pmod(F.col(block), F.lit(max(1, math.isqrt(blocks)))).alias("_part")
    first = rows.groupBy(*by, part).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    return first.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, lists: int = LISTS, query_block: int = QUERY_BLOCK,
    row_block: int = ROW_BLOCK, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    query_rows: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with all other rows.

    ``is_query`` is a condition on ``rows``. Vectors are scaled and floored to whole numbers, and their components
    are dealt to ``lists`` score lists. The threshold method runs in three phases: every pair of a query tile and a
    row tile sends the ``k`` best totals of the leaders of its blocks' local lists; the k-th best total of a query is a safe
    cutoff, as that many rows reach it; with the cutoffs, sent along with the query tiles, every pair collects the entries
    that can reach theirs and resolves them exactly. Equal scores go by smaller vec_id.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do rows whose id is null.
    Vectors of different length are compared as if padded with zeros. Equal rows are one row.
    Rows that repeat an id with another vector are candidates, and if asked for queries, of their own: a query meets all
    rows but itself, and each query of an id has its ``k`` rows (``query_rows`` adds a number that tells them apart).
    A query gets fewer than k rows only if there are no more; with no other row it has none.
    An empty table gives an empty result. The query set meets all rows in tiles of fixed size, by a cogroup on the pair of
    tile numbers, and within a pair in blocks: the work is queries times rows, the memory of a task one pair of tiles and
    the scores of one pair of blocks. No side is broadcast: the copies of the tiles, one for each tile of the other side, are
    far more than the planner, who knows the stored tiles, takes them for.
    """
    read = rows.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("id"), quantized(F.col(vector), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"))
    different = read.groupBy("id", "vector").agg(F.max("asked").alias("asked"))
    read = cut_lineage(different.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = read.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("vector")).alias("w")).first()
    width = size["w"] or 0
    n_rows = tile_count(size["n"], width, row_block, ROW_TILE, ROW_TILES)
    n_queries = tile_count(size["asked"], width, query_block, QUERY_TILE, QUERY_TILES)
    row_tiles = tiles(read, n_rows).withColumnRenamed("tile", "rb")
    query_tiles = tiles(read.filter("asked"), n_queries).withColumnRenamed("tile", "qb")
    # Twice as many tasks as pairs, so that few tasks get several pairs by their hash.
    n_tasks = min(2 * n_queries * n_rows, MOST_TASKS)

    def dealt(side: DataFrame, other: str, number: int) -> GroupedData:
        copies = side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<bigint>")))
        return copies.repartition(n_tasks, "qb", "rb").groupBy("qb", "rb")

    def met(queries: DataFrame, each: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
        return dealt(queries, "rb", n_rows).cogroup(dealt(row_tiles, "qb", n_queries)).applyInPandas(each, schema)

    def opened(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpacked(*tile[["ids", "rows", "width", "kind", "matrix"]].iloc[0], width)

    def gather(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        leaders = [np.zeros(0, np.int64)]
        met_rows = [np.zeros(0, np.int64)]
        if len(queries) and len(rows):
            (_, q_rows, q_matrix), (_, r_rows, r_matrix) = opened(queries), opened(rows)
            for q in pieces(len(q_rows), query_block):
                found = [[] for _ in q_rows[q]]
                for r in pieces(len(r_rows), row_block):
                    scores = partial_scores(q_matrix[q], r_matrix[r], lists)
                    for one, totals in zip(found, local_lists(scores, q_rows[q][:, None] == r_rows[r][None, :], k)):
                        one.append(totals.astype(np.int64))
                top = [np.sort(np.concatenate(one))[::-1][:k] for one in found]
                leaders += top
                met_rows.append(np.repeat(q_rows[q], [len(t) for t in top]))
        return pd.DataFrame({"qb": key[0], "rb": key[1], "query_row": np.concatenate(met_rows), "total": np.concatenate(leaders)})

    def resolve(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        kept = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "score")})]
        if len(queries) and len(rows):
            (q_ids, q_rows, q_matrix), (r_ids, r_rows, r_matrix) = opened(queries), opened(rows)
            cutoffs, cutoff_rows = (np.frombuffer(queries[c].iloc[0], np.int64) for c in ("cutoffs", "cutoff_rows"))
            cutoff = pd.Series(cutoffs, index=cutoff_rows)
            cutoff = cutoff.reindex(q_rows, fill_value=NO_CUTOFF).to_numpy()
            for q in pieces(len(q_rows), query_block):
                for r in pieces(len(r_rows), row_block):
                    scores = partial_scores(q_matrix[q], r_matrix[r], lists)
                    query, row, total = above(scores, q_rows[q][:, None] == r_rows[r][None, :], cutoff[q])
                    kept.append(leading(pd.DataFrame({"query_row": q_rows[q][query], "query_id": q_ids[q][query],
                                                      "vec_id": r_ids[r][row], "score": total.astype(np.int64)}), k))
        return leading(pd.concat(kept, ignore_index=True), k).assign(rb=key[1])

    local = met(query_tiles, gather, "qb long, rb long, query_row long, total long")
    leaders = best(local, ["qb", "query_row"], "rb", n_rows, -F.col("total"), k)
    # With fewer than k rows in all nothing is cut off.
    cutoff = F.when(F.size("top") >= k, -F.element_at("top", k)).otherwise(F.lit(NO_CUTOFF))

    def cutoffs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qb": [key[0]], "cutoff_rows": [part["query_row"].to_numpy(np.int64).tobytes()],
                             "cutoffs": [part["cutoff"].to_numpy(np.int64).tobytes()]})

    per_tile = cut_lineage(
        leaders.select("qb", "query_row", cutoff.alias("cutoff")).groupBy("qb")
        .applyInPandas(cutoffs, "qb long, cutoff_rows binary, cutoffs binary"), "cutoffs")
    found = met(query_tiles.hint("merge").join(per_tile, "qb"), resolve,
                "query_row long, query_id long, vec_id long, score long, rb long")
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id"))
    top = best(found, ["query_row", "query_id"], "rb", n_rows, entry, k)
    return top.select("query_row", "query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"), *(["query_row"] if query_rows else []))
