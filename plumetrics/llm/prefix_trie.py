"""Prefix trie of conversations: ROLLUP over positional turn-id columns, block by block.

A conversation is a row of turn ids for each block of eight positions. One ROLLUP over the eight columns aggregates all
prefixes of all blocks at once, and ``grouping_id`` tells how long a prefix is. A block that does not begin a
conversation is keyed by the node where the block before it ends, so long conversations are rows like all others.

Node names. A turn id is the first 128 bits of the sha-256 of role and text. A node is named by its depth and 128 bits:
the XOR, over its turns, of hashes of position and turn id. XOR adds up along a conversation, so the name at which a
block begins is a running sum over the blocks before it, and the name of the parent leaves out the last turn.

Sums over subtrees need no walk through the trie. A node belongs to the smallest of its members; the nodes of one
conversation are a stretch that ends where the conversation ends. So a sum over the nodes of a subtree is a sum over its
members of what each owns, corrected for the part that the top's own member owns above the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.llm.common import fold, numbered, partitions
from plumetrics.session import cut_lineage

WIDTH = 8
RUN = 1024   # blocks of a conversation that one window adds up
CHUNK = 4096  # ids that are joined to one text before the texts of a node are hashed in order
NAME = ["depth", "a", "b"]
BITS = {"a": 1, "b": 2}


def named(which: str, position: str, turn: str) -> str:
    """SQL of the 64 bits that a turn adds to half ``which`` of a node's name."""
    return f"xxhash64({BITS[which]}, CAST({position} AS BIGINT), {turn})"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, id, size): turns in order, with the code points of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    id = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), id.alias("id"),
        F.char_length(text).cast("bigint").alias("size"))
    return cut_lineage(numbered(rows, ["conv_id"], ["turn", "role", "id"], "turns").select("conv_id", "place", "id", "size"), "turn-places")


def rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conversation, position, id, size) of the rebuilt conversations, and the ids of all conversations.

    The first h turns of the group's first conversation, then the own turns after the first h; h is the crc32 of the
    id as text, modulo ``heads``.
    """
    lengths = cut_lineage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "turn-counts")
    wanted = lengths.select("conv_id", fold("conv_id", heads).alias("h"),
                            (F.col("conv_id") - F.col("conv_id") % group).alias("first"))
    first = lengths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    plan = cut_lineage(wanted.join(first, "first", "left").select(
        "conv_id", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("kept")), "turn-plan")
    openings = turns.filter((F.col("place") < heads - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "first")
    taken = plan.join(openings, "first").filter(F.col("place") < F.col("h"))
    own = turns.join(plan, "conv_id").filter(F.col("place") >= F.col("h"))
    parts = taken.select("conv_id", F.col("place").alias("position"), "id", "size").unionAll(
        own.select("conv_id", (F.col("place") - F.col("h") + F.col("kept")).alias("position"), "id", "size"))
    return parts, plan.select("conv_id")


def in_blocks(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conversation and block: turn ids and sizes by slot, and sums over the blocks before it.

    Every conversation has a first block, also one without turns. Running sums are taken within ``RUN`` blocks; the
    sums of whole runs are added, so no window takes all turns of a long conversation.
    """
    marks = ids.select("conv_id", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("binary").alias("id"),
                       F.lit(None).cast("bigint").alias("size"))
    slot = F.col("position") % WIDTH
    # One turn for each position: the aggregates only lay the turns out.
    at = lambda i, c: F.max(F.when(slot == i, F.col(c))).alias(f"{'t' if c == 'id' else 'l'}{i}")
    block = F.coalesce(F.floor(F.col("position") / WIDTH), F.lit(0)).cast("bigint")
    rows = parts.unionAll(marks).groupBy("conv_id", block.alias("block")).agg(
        *[at(i, "id") for i in range(WIDTH)], *[at(i, "size") for i in range(WIDTH)],
        *[F.coalesce(F.expr(f"bit_xor({named(x, 'position', 'id')}) FILTER (WHERE position IS NOT NULL)"), F.lit(0)).cast("bigint").alias(f"own_{x}") for x in BITS],
        F.coalesce(F.sum("size"), F.lit(0)).alias("own_size"), F.count("position").alias("own_n"))
    rows = cut_lineage(rows.withColumn("run", F.floor(F.col("block") / RUN).cast("bigint")), "turn-blocks")
    adding = {"a": "bit_xor(own_a)", "b": "bit_xor(own_b)", "size": "sum(own_size)"}

    def running(keys: list[str], order: str) -> list[Column]:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.expr(x).over(before), F.lit(0)) for x in adding.values()]

    whole = rows.groupBy("conv_id", "run").agg(*[F.expr(x).alias(f"own_{c}") for c, x in adding.items()])
    a, b, size = running(["conv_id"], "run")
    runs = whole.select("conv_id", "run", a.alias("run_a"), b.alias("run_b"), size.alias("run_size"))
    a, b, size = running(["conv_id", "run"], "block")
    within = rows.withColumns({"pa": a, "pb": b, "psize": size})
    return cut_lineage(within.join(runs, ["conv_id", "run"]).withColumns({
        "pa": F.col("pa").bitwiseXOR(F.col("run_a")), "pb": F.col("pb").bitwiseXOR(F.col("run_b")),
        "psize": F.col("psize") + F.col("run_size")}).drop("run", "run_a", "run_b", "run_size"), "keyed-blocks")


def rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` for every prefix: its name, its parent's name, and the turn ids of its block.

    Prefixes that end behind the last turn of a block's rows, and those of no turn that the block before has too,
    are left out.
    """
    slots = range(WIDTH)
    turns = ", ".join(f"t{i}" for i in slots)
    grouped = blocks.sparkSession.sql(
        f"SELECT block, pa, pb, psize, {turns}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS upto, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, pa, pb, psize, ROLLUP ({turns})", blocks=blocks)
    last = F.get(F.array(*[f"t{i}" for i in slots]), F.col("upto") - 1)
    kept = grouped.filter(F.when(F.col("upto") == 0, F.col("block") == 0).otherwise(last.isNotNull()))

    def name(which: str, less: int) -> Column:
        halves = [f"if({i} < upto - {less}, {named(which, f'block * {WIDTH} + {i}', f't{i}')}, 0L)" for i in slots]
        return F.expr(f"p{which} ^ " + " ^ ".join(halves))

    return kept.withColumns({
        "depth": F.col("block") * WIDTH + F.col("upto"), "a": name("a", 0), "b": name("b", 0),
        "parent_a": name("a", 1), "parent_b": name("b", 1)})


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, n_ends, ends_sha256): the conversations that end at a node, hashed in the order of their ids.

    Ids are joined to texts of ``CHUNK`` ids in parallel; a node's texts then go through one running hash, which holds
    nothing but its state.
    """
    place = F.floor(F.col("place") / CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = numbered(ends, NAME, ["conv_id"], "ends").groupBy(*NAME, place).agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"))
    ordered = chunks.repartition(partitions(ends.sparkSession), *NAME).sortWithinPartitions(*NAME, "chunk")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, None, 0

        def row() -> pa.RecordBatch:
            values = [*now, n, state.hexdigest()]
            kinds = [*[pa.int64()] * 4, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*NAME, "n_ends", "ends_sha256"])

        for batch in parts:
            columns = batch.to_pydict()
            for key, text, count in zip(zip(*(columns[c] for c in NAME)), columns["ids"], columns["n"]):
                if key != now:
                    if now is not None:
                        yield row()
                    now, state, n = key, hashlib.sha256(text.encode()), count
                else:
                    state.update(b"," + text.encode())
                    n += count
        if now is not None:
            yield row()

    return ordered.mapInArrow(run, "depth bigint, a bigint, b bigint, n_ends bigint, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a different sequence of the first ``depth`` turns (role and text) of the rebuilt conversations, from the
    root without turns on; its members are the conversations that begin with it. ``conv_id`` is the smallest member,
    ``parent_conv_id`` that of the parent (root: null). ``n_leaves`` counts the childless nodes of the subtree, the node
    itself included; ``saved_tokens`` adds up, over the same nodes, (members - 1) times the code points of the last
    text; ``ends_sha256`` hashes the ids of the members that end at the node, joined by commas, smallest first.

    Turns are ordered by turn (null first); equal turn numbers by role, then by the hash of role and text, and equal
    rows are turns of their own. Null role or text is empty. Rows without a conv_id belong to no conversation and are
    not read. A conversation that is rebuilt to no turn is a member of the root only. An empty table gives an empty
    result. Further columns are not read. Conversations of any length, hot first turns and copies are spread: turns
    are numbered in even pieces, and every aggregate combines within tasks before it moves.
    """
    blocks = in_blocks(*rebuilt(turn_rows(conversations), group, heads))
    whole = cut_lineage(blocks.groupBy("conv_id").agg(
        F.sum("own_n").alias("depth"), F.expr("bit_xor(own_a)").alias("a"), F.expr("bit_xor(own_b)").alias("b"),
        F.sum("own_size").alias("total")), "whole-conversations")

    sizes = ", ".join(f"max(l{i}) AS l{i}" for i in range(WIDTH))
    counted = rolled_up(blocks.join(whole.select("conv_id", "total"), "conv_id"),
                        f"count(1) AS n_convs, min(conv_id) AS conv_id, sum(total) AS totals, {sizes}")
    sized = F.array(*[F.col(f"l{i}") for i in range(WIDTH)])
    before = F.expr("psize + " + " + ".join(f"if({i} < upto - 1, l{i}, 0L)" for i in range(WIDTH)))
    nodes = counted.select(*NAME, "parent_a", "parent_b", "conv_id", "n_convs", "totals", before.alias("before"),
                           F.coalesce(F.get(sized, F.col("upto") - 1), F.lit(0)).alias("size"))
    ends = end_hashes(whole.select(*NAME, "conv_id"))
    nodes = cut_lineage(nodes.join(ends, NAME, "left").withColumn(
        "leaf", (F.col("n_convs") == F.coalesce("n_ends", F.lit(0))).cast("bigint")), "trie-nodes")

    owned = nodes.groupBy("conv_id").agg(F.sum("size").alias("owned"), F.sum("leaf").alias("leaves"))
    values = cut_lineage(whole.join(owned, "conv_id", "left").select(
        "conv_id", "total", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "owned")
    below = rolled_up(blocks.join(values, "conv_id"), "sum(owned) AS owned_sum, sum(leaves) AS n_leaves").select(
        *NAME, "owned_sum", "n_leaves")
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    # The root's own name is its parent's too, but no node lies above it: its depth finds none.
    full = nodes.join(below, NAME).join(children, NAME, "left").join(
        values.select("conv_id", "total", "owned"), "conv_id").join(parents, ["depth", "parent_a", "parent_b"], "left")
    different = F.col("owned_sum") - F.col("owned") + F.col("total") - F.col("before")
    saved = F.col("totals") - F.col("n_convs") * F.col("before") - different
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
