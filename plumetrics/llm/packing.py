"""Best-fit-decreasing packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.session import cut_lineage

CAPACITY = 1024
END = 2
# Bytes of text that are encoded together.
PORTION = 1 << 20


class Run(NamedTuple):
    """``per_bin`` pieces of one length go into each of ``bins`` sequences from ``first_bin`` on, at ``offset``."""

    length: int
    first: int
    per_bin: int
    bins: int
    first_bin: int
    offset: int


class SegmentTree:
    """Which remaining capacities have open sequences; finds the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over ``counts`` (length -> number of pieces), in runs of equal steps.

    Pieces go by decreasing length, each to the open sequence with the least remaining capacity that takes it, else
    to a new one. Sequences with equal remaining capacity are alike, so a whole run of them is served at once: after
    a piece, the same sequence is the tightest for the next piece as long as it fits. The work and the number of runs
    depend on the number of lengths, not of pieces.
    """
    tree, open_bins, runs, new = SegmentTree(capacity), {}, [], 0

    def put(first_bin: int, bins: int, room: int) -> None:
        if room and bins:
            open_bins.setdefault(room, []).append((first_bin, bins))
            tree.mark(room, True)

    def serve(first: int, left: int, length: int, first_bin: int, bins: int, room: int) -> int:
        """Fill ``bins`` alike sequences as far as ``left`` pieces go; returns the number of pieces placed."""
        each, offset = room // length, capacity - room
        full = min(bins, left // each)
        if full:
            runs.append(Run(length, first, each, full, first_bin, offset))
            put(first_bin, full, room - each * length)
        rest = left - full * each if full < bins else 0
        if rest:
            runs.append(Run(length, first + full * each, rest, 1, first_bin + full, offset))
            put(first_bin + full, 1, room - rest * length)
        put(first_bin + full + bool(rest), bins - full - bool(rest), room)
        return full * each + rest

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, first = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                bins = -(-left // (capacity // length))
                placed = serve(first, left, length, new, bins, capacity)
                new += bins
            else:
                first_bin, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.mark(room, False)
                placed = serve(first, left, length, first_bin, bins, room)
            first, left = first + placed, left - placed
    return runs


class Encoder:
    """Texts -> token ids; each different word of a portion of texts is encoded once.

    A blank between two visible characters always begins a new word of the byte-level pattern, so words may be
    encoded on their own. Other white space stays inside a word; a text with a blank beside white space or at an end
    is encoded whole. Ids equal those of the JSON file of the same vocabulary (tests compare them).
    """

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.ids = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.blank_first = np.zeros(max(ranks.values()) + 1, bool)
        self.blank_first[[rank for word, rank in ranks.items() if word[:1] == b" "]] = True

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begins) of the words, each behind a blank: the only blank it has, so its first id tells its begin."""
        ids = np.array(self.ids("".join([" " + w for w in words])), np.uint32)
        return ids, np.append(np.flatnonzero(self.blank_first[ids]), len(ids))

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null is an empty text."""
        column = pc.fill_null(column, "")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PORTION, prepend=0) > 0)
        for first, last in zip([0, *cuts], [*cuts, len(column)]):
            if last > first:
                yield from self.portion(column.slice(first, last - first))

    def portion(self, column: pa.Array) -> Iterator[np.ndarray]:
        split = pc.split_pattern(column, " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        coded = pc.list_flatten(split).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        alone = np.array([bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words], bool)
        # A first word is encoded without a blank, and may begin with other white space.
        heads = [words[i] for i in at[begins].tolist()]
        good = alone[at]
        good[begins] = [bool(w) and not w[-1].isspace() for w in heads]
        plain = np.logical_and.reduceat(good, begins)
        used = np.flatnonzero(alone)
        ids, cuts = self.words([words[i] for i in used.tolist()])
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[used], length[used] = cuts[:-1], np.diff(cuts)
        each = length[at]
        each[begins] = 0
        stops = np.cumsum(each)
        every = ids[np.repeat(start[at] - stops + each, each) + np.arange(stops[-1])]
        for text, head, ok, a, b in zip(column.to_pylist(), heads, plain.tolist(), (stops - each)[begins].tolist(),
                                        stops[ends - 1].tolist()):
            if ok:
                yield np.concatenate((np.array(self.ids(head), np.uint32), every[a:b]))
            else:
                yield np.array(self.ids(text), np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(kind: str, capacity: int, end: int, ranks_path: str | None):
    """mapInArrow function: (doc_id, text) -> pieces of each document, with their task and place within task and length."""
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("task", pa.int64()), ("at", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = Encoder(ranks_path), TaskContext.get().partitionId()
        tail, seen = np.array([end], np.uint32), [0] * (capacity + 1)
        for batch in parts:
            owner, rows = [], []
            for i, ids in enumerate(encode(batch.column("text"))):
                raw = np.concatenate((ids, tail)).astype("<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    owner.append(i)
                    rows.append((k, start, length, zlib.crc32(raw[4 * start: 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * len(schema)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, f.type) for c, f in zip(columns, schema))], names=["doc_id", *schema.names])

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized whole, ``end`` is put after each, and only those longer than ``capacity`` are cut. The
    pieces of all documents are packed by best-fit decreasing, as if by one bin-packer, from the number of pieces of
    each length: at most ``capacity`` numbers, whatever the data. A piece's number among those of its length (place
    in its task plus the earlier tasks' counts) then tells its sequence. Pieces of one length are interchangeable, so
    no task ever holds a sequence or a length whole.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed each. An empty table gives an
    empty result. ``ranks_path`` names the vocabulary; by default the public byte-level one is used.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    pieces = cut_lineage(
        read.mapInArrow(pieces_of(kind, capacity, end, ranks_path), f"doc_id {kind}, {PIECES}, task bigint, at bigint"),
        "pieces",
    )
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = pieces.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("at"))
    return placed.mapInArrow(place_in(runs), f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint")


def place_in(runs: Sequence[Run]):
    """mapInArrow function: a piece's length and rank -> sequence and offset. ``runs`` is bounded by the capacity."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, rank) as one number: ranks stay below 2^48.
        starts = (table[:, 0] << 48) + table[:, 1]
        for batch in parts:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            own = table[np.searchsorted(starts, (length << 48) + rank, side="right") - 1] if len(table) else table
            within = rank - own[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(own[:, 4] + within // own[:, 2]),
                 pa.array(own[:, 5] + within % own[:, 2] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run
