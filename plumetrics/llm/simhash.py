"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumetrics.llm.common import texts
from plumetrics.operators.geo import connected_components
from plumetrics.session import cut_lineage

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
# Up to this many different fingerprints of a bucket are compared directly; larger buckets are divided.
COMPARED = 32


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half the XXH64 values of the text's word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = np.unpackbits(hashes[at: at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        got = np.array([fingerprint(t) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(got)], names=[*rest, "fp"])


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks; whatever ``radius`` bits differ, some mask leaves all of them out.

    Bit i gets the vector v(i), going round the nonzero vectors of radius + 1 bits. The mask of a nonzero vector u
    keeps bit i where <u, v(i)> is odd. For any ``radius`` bits there is a u whose products with their vectors are
    all even, as that is ``radius`` linear conditions on radius + 1 unknowns.
    """
    size = radius + 1
    vectors = list(range(1, 1 << size))
    return [sum(1 << i for i in range(bits) if (u & vectors[i % len(vectors)]).bit_count() % 2) for u in vectors]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_links(distinct: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Links (a, b), a < b, between the different fingerprints ``fp``, that join all within two bits.

    Tables: each mask deals the fingerprints into buckets of equal masked bits, and every near pair meets in some
    bucket. Buckets of up to ``compared`` fingerprints compare all their pairs. A larger one is divided exactly: each
    member is listed under itself and under every variant with one unmasked bit flipped. Two members are within two
    bits if and only if they share a variant, and a variant has at most 65 members, so no hot bucket meets in one
    place and no list of pairs grows with its square; the members of a variant are linked to the least of them.
    """
    masks = covering_masks(BITS, RADIUS)
    tables = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                       for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("t.mask", "t.key", "fp")
    sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = cut_lineage(rows.join(sizes, ["mask", "key"]), "buckets")
    small = rows.filter(F.col("n") <= compared)
    pairs = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("all")).select(
        F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    near = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    free = F.element_at(F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks]),
                        F.col("mask") + 1)
    variants = rows.filter(F.col("n") > compared).select(
        "mask", "fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), free)).alias("bit")
    ).select("mask", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("variant"))
    shared = variants.groupBy("mask", "variant").agg(F.collect_list("fp").alias("all"))
    stars = shared.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return near.union(stars.filter(F.col("a") < F.col("b"))).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), compared: int = COMPARED,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, group, and the columns in ``carry``.

    Documents whose fingerprints differ in at most two bits are linked; component_id is the smallest doc_id that
    links reach (ids that are null do not count; null if there is no other), group the least fingerprint reached.
    Equal fingerprints are one class from the start, so copies cost one row each. Null text is empty text; texts
    without words have fingerprint zero and are linked like others; fewer than three words are one shingle. Repeated
    rows are documents of their own with one component. An empty table gives an empty result.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                       F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    marked = cut_lineage(read.mapInArrow(fingerprints, f"{kinds}, fp bigint"), "fingerprints")
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(near_links(classes.select("fp"), compared))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min("fp").alias("group"))
    named = joined.join(heads, "root").select("fp", "component_id", "group")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group",
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
