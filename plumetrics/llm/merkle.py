"""Merkle manifest of a dataset by cogrouped exchange of subtrees.

The leaves of a tree are dealt to superblocks of consecutive places. Upward, each superblock sends its top node to the
next round, where tops are dealt to superblocks again, until every tree has one node. Downward, the rows of a superblock
are cogrouped with the outer nodes that its top needs on the way to the root; a task then reduces its superblock once
more, joins the inner and the outer siblings of each row to its proof, and folds it. A task holds one superblock,
however large a tree is. The trees' tops are the leaves of one more tree, built by the same rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.llm.common import numbered
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

FAN = 8
LEVELS = 4  # of a superblock: 8^4 rows
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels from the bottom up: the row's place in its run, and the others of the run.
Path = list[tuple[int, list[str]]]
NODES = "tree bigint, place bigint, total bigint, digest string"
OUTER = "tree bigint, block bigint, digest string, subroot string, path string"


def joined_hash(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """sha-256 of the fields: each its UTF-8 byte count, a colon and its text, or a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


def steps(total: int, fan: int, levels: int) -> int:
    """Reductions within a superblock of a tree that has ``total`` nodes in its round."""
    needed = 0
    while total > 1 and needed < levels:
        total, needed = -(-total // fan), needed + 1
    return needed


def reduce_up(digests: list[str], times: int, fan: int) -> list[list[str]]:
    """The nodes of each level; ``fan`` consecutive ones, or the fewer last ones, become one."""
    levels = [digests]
    for _ in range(times):
        below = levels[-1]
        levels.append([joined_hash(below[i: i + fan]) for i in range(0, len(below), fan)])
    return levels


def inner_path(levels: list[list[str]], at: int, fan: int) -> Path:
    path = []
    for level in levels[:-1]:
        own, begin = at % fan, at // fan * fan
        run = level[begin: begin + fan]
        path.append((own, run[:own] + run[own + 1:]))
        at //= fan
    return path


def written(path: Path) -> str:
    return ";".join(f"{own}:{','.join(others)}" for own, others in path)


def parsed(text: str) -> Path:
    levels = (x.split(":") for x in text.split(";")) if text else ()
    return [(int(own), others.split(",") if others else []) for own, others in levels]


def fold_up(digest: str, path: Path) -> str:
    for own, others in path:
        digest = joined_hash([*others[:own], digest, *others[own:]])
    return digest


def proof_hash(path: Path) -> str:
    return joined_hash(x for _, others in path for x in others)


def top_nodes(fan: int, levels: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        total = int(part["total"].iloc[0])
        top = reduce_up(part["digest"].tolist(), steps(total, fan, levels), fan)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "total": [-(-total // fan**levels)], "digest": [top]})

    return run


def hand_down(fan: int, levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cogroup function of an upper round: the outer nodes of each node, for the superblock below it."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place")
        tree = reduce_up(nodes["digest"].tolist(), steps(int(nodes["total"].iloc[0]), fan, levels), fan)
        above, subroot = outer["path"].iloc[0], outer["subroot"].iloc[0]
        paths = [written(inner_path(tree, i, fan)) for i in range(len(nodes))]
        return pd.DataFrame({
            "tree": nodes["tree"], "block": nodes["place"], "digest": nodes["digest"], "subroot": subroot,
            "path": [";".join(x for x in (own, above) if x) for own in paths]})

    return run


def finish(fan: int, levels: int, root: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cogroup function of the leaves: their proofs, and what the leaf, or its changed form, folds to."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("place")
        digests = leaves["digest"].tolist()
        tree = reduce_up(digests, steps(int(leaves["total"].iloc[0]), fan, levels), fan)
        above = parsed(outer["path"].iloc[0])
        paths = [inner_path(tree, i, fan) + above for i in range(len(digests))]
        folded = [fold_up(now, path) for now, path in zip(leaves["now"].tolist(), paths)]
        return pd.DataFrame({
            "row": leaves["row"], "leaf": digests, "subroot": outer["subroot"].iloc[0], "root": root,
            "proof": [written(path) for path in paths], "proof_sha256": [proof_hash(path) for path in paths],
            "folded_root": folded, "verified": [x == root for x in folded]})

    return run


def in_blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(fan**levels)).cast("bigint"))


def rounds(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the top nodes of each round, down to one node for each tree."""
    found = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        tops = in_blocks(found[-1].select("tree", "place", "total", "digest"), fan, levels).groupBy("tree", "block")
        found.append(cut_lineage(tops.applyInPandas(top_nodes(fan, levels), NODES), "merkle-tops"))
        most = -(-most // fan**levels)
    return found


def cogrouped(nodes: DataFrame, outer: DataFrame, fan: int, levels: int):
    return in_blocks(nodes, fan, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))


def outer_nodes(upper: list[DataFrame], top: DataFrame, fan: int, levels: int) -> DataFrame:
    """From the outer nodes of the last round's nodes to those of the first round of ``upper``."""
    outer = top
    for nodes in reversed(upper):
        outer = cut_lineage(cogrouped(nodes, outer, fan, levels).applyInPandas(hand_down(fan, levels), OUTER), "merkle-outer")
    return outer


def manifest(
    docs: DataFrame, by: str = "lang", order: str = "doc_id", changed: Column | None = None, text: str = "text",
    fields: Iterable[str] = FIELDS, fan: int = FAN, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields``. The leaves of one value of ``by`` ascend by ``order`` (null first; equal ids by
    leaf) and reduce ``fan`` by ``fan`` to a subroot; subroots, ordered by ``by`` (null first, by UTF-8 bytes), to the
    root. ``proof`` lists, level by level from the leaf to the root, the row's place in its run and the others of the
    run. ``folded_root`` is recomputed from the proof and the row as it is now: where ``changed`` holds (null: not), the
    ``text`` with A-Z lower-cased (null stays), else the row itself. ``verified`` tells whether it equals the root.
    Null fields have a mark of their own, empty ones do not share it. Equal rows have equal leaves and places of their
    own. A single row is its own subroot; a single subroot is the root. An empty table gives an empty result. Further
    columns are not read, whatever their names. A superblock has fan^levels rows; a hot value of ``by`` has many.
    """
    now = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = list(fields)
    now_leaf = leaf([now if f == text else F.col(f) for f in fields])
    leaves = cut_lineage(docs.select(
        F.col(by).cast("string").alias("group"), F.col(order).alias("row"), leaf(map(F.col, fields)).alias("digest"),
        F.when(F.lit(False) if changed is None else changed, now_leaf).alias("changed")), "merkle-leaves")
    counts = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
    groups, n_groups = cut_lineage_counted(
        numbered(counts, [], ["group"], "merkle-groups").select(F.col("group").alias("name"), "total", F.col("place").alias("tree")), "merkle-trees")
    member = leaves.join(broadcast_if_small(groups, n_groups), F.col("group").eqNullSafe(F.col("name"))).select(
        "tree", "total", "row", "digest", F.coalesce("changed", "digest").alias("now"))
    # As text from here on, as pandas has no whole numbers with nulls.
    placed = cut_lineage(numbered(member, ["tree"], ["row", "digest"], "merkle-order").withColumn(
        "row", F.col("row").cast("string")), "merkle-places")

    lower = rounds(placed, fan, levels)
    subroots = lower[-1].select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(n_groups).cast("bigint").alias("total"), "digest")
    upper = rounds(subroots, fan, levels)
    last = upper[-1].first()
    root = last["digest"] if last else ""
    top = upper[-1].select("tree", F.col("place").alias("block"), "digest", F.lit("").alias("subroot"), F.lit("").alias("path"))
    by_tree = outer_nodes(upper[:-1], top, fan, levels)
    if n_groups > 1:
        by_tree = by_tree.withColumns({"tree": F.col("block"), "block": F.lit(0).cast("bigint")})
    own_top = by_tree.withColumn("subroot", F.col("digest"))
    # The last round of every tree is its top alone, so the rounds before it are handed down to, and the first is finished.
    outer = outer_nodes(lower[1:-1], own_top, fan, levels)
    done = cogrouped(lower[0], outer, fan, levels).applyInPandas(
        finish(fan, levels, root),
        "row string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")
    return done.select(F.col("row").cast(docs.schema[order].dataType).alias("doc_id"), *done.columns[1:])
