"""Benchmark passages in documents, by a prefix-filtered set join. DataFrame expressions only, no Python on rows.

A document holds a window of an item only if it holds all shingles of the window, so one shingle is enough to find it:
the window's prefix is its shingle that is rarest in the documents. The documents are read twice. The first pass counts
the benchmark's shingles over all documents; the second looks up the prefix shingles only. A hit places the window in
the document (the shingle's position less its offset); windows that would begin before or end behind the text are out
by their bounds, and the others are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.llm.common import piece_count
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

WINDOW = 10
SHINGLE = 3
# Shingles and windows that are sent to every task at a time; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN, " "))


def word_count(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.size(F.split(words, " ")))


def stretch(words: Column, start: Column, size: Column) -> Column:
    """``size`` words from position ``start`` (from 0) on, with blanks between them."""
    return F.array_join(F.slice(words, start + 1, size), " ")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item, words, size): every window of every item; a shorter item is one window, one without words has none."""
    texts = items.withColumn("n", word_count(F.col("plain"))).filter("n > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("start")
    size = F.least(F.col("n"), F.lit(window))
    placed = texts.select("item", F.split("plain", " ").alias("all"), size.alias("size"), starts)
    return placed.select("item", stretch(F.col("all"), F.col("start"), F.col("size")).alias("words"), "size").distinct()


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(id, words, size, offset, length, token): the shingles of each window; a shorter window is one shingle."""
    length = F.least(F.col("size"), F.lit(shingle))
    offsets = F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("offset")
    placed = windows.select("id", "words", "size", length.alias("length"), offsets)
    return placed.withColumn("token", stretch(F.split("words", " "), F.col("offset"), F.col("length")))


def passes(tokens: DataFrame, pass_bytes: int) -> list[tuple[int, DataFrame]]:
    """(length, rows to broadcast): ``tokens`` by shingle length, divided so that no part exceeds ``pass_bytes`` by much.

    Rows are divided by the hash of their window or token, so that a token of many windows is divided too.
    """
    own = [F.octet_length(c) for c in ("token", "words") if c in tokens.columns]
    size = F.sum(reduce(lambda a, b: a + b, own).cast("bigint") + 64)
    parts = []
    for length, n_bytes in sorted((r["length"], r["bytes"]) for r in tokens.groupBy("length").agg(size.alias("bytes")).collect()):
        number = piece_count(n_bytes, pass_bytes)
        place = F.pmod(F.xxhash64(*[c for c in ("token", "words") if c in tokens.columns]), F.lit(number))
        parts += [(length, F.broadcast(tokens.filter((F.col("length") == length) & (place == i)).drop("length")))
                  for i in range(number)]
    return parts


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(row, n, all, at, token): the shingles of ``length`` words of every document."""
    split = docs.filter(F.col("n") >= length).select("row", "n", F.split("plain", " ").alias("all"))
    # The outer form keeps the planner from splitting each text once more to see whether it has words.
    each = split.select("row", "n", "all", F.posexplode_outer("all").alias("at", "word"))
    more = [F.get(F.col("all"), F.col("at") + i) for i in range(1, length)]
    token = F.concat_ws(" ", F.col("word"), *more) if more else F.col("word")
    return each.filter(F.col("at") + length <= F.col("n")).select("row", "n", "all", "at", token.alias("token"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, doc_id: str = "doc_id",
    item_id: str = "item_id", text: str = "text", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, places.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.
    ``places`` are the occurrences of windows as sorted, different (start, end) in words, end exclusive; ``n_hit``
    counts the words inside any of them; ``items`` are the different ids, as sorted strings, of the items that have
    one. Null texts have no words. A null item id counts as an empty string; rows that repeat an id count as one item
    with the windows of all. Every row of ``docs`` gets its own result, repeated ids and rows included; an empty
    table gives an empty result, an empty benchmark no hits. Equal windows of many items are looked up once. Other
    columns are not read. Work is two reads of the documents for each ``pass_bytes`` of benchmark; no text is shuffled,
    so common passages load no task.
    """
    stored = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), plain(F.col(text)).alias("plain")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "plain", word_count(F.col("plain")).alias("n")), "plain-docs")
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), plain(F.col(text)).alias("plain"))
    owned = cut_lineage(windows_of(named, window), "item-windows")
    windows = cut_lineage(owned.select("words", "size").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    grams = cut_lineage(shingles_of(windows, shingle), "shingles")

    # Rarity over all documents.
    known = grams.select("length", "token").distinct()
    seen = [positions(stored, length).select("token").join(part, "token").groupBy("token").count()
            for length, part in passes(known, pass_bytes)]
    bare = stored.select("row", F.lit(None).cast("string").alias("token")).limit(0)
    counts = cut_lineage(union(seen) if seen else bare.groupBy("token").count(), "shingle-counts")
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset", "length")
    rarest = grams.join(counts, "token", "left").groupBy("id", "words", "size").agg(F.min(rank).alias("first"))
    # A window with a shingle that no document has is in none.
    prefixes = cut_lineage(rarest.filter("first.count > 0").select("id", "words", "size", "first.token", "first.offset", "first.length"), "prefixes")

    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n"))
    same = stretch(F.col("all"), F.greatest(start, F.lit(0)), F.col("size")) == F.col("words")
    hits = [positions(stored, length).join(part, "token").filter(inside & same).select("row", start.alias("start"), "size", "id")
            for length, part in passes(prefixes, pass_bytes)]
    nothing = stored.select("row", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("id")).limit(0)
    found = cut_lineage(union(hits) if hits else nothing, "occurrences")

    places = found.groupBy("row").agg(F.array_sort(F.collect_set(
        F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("places"))
    links, n_links = cut_lineage_counted(owned.join(windows, ["words", "size"]).select("id", "item"), "window-items")
    holders = found.select("row", "id").distinct().join(broadcast_if_small(links, n_links), "id").select("row", "item").distinct()
    lists = holders.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("words")),
        lambda done, x: F.struct(
            F.greatest(done["upto"], x["end"]).alias("upto"),
            (done["words"] + F.greatest(x["end"] - F.greatest(done["upto"], x["start"]), F.lit(0))).alias("words")),
        lambda done: done["words"])
    joined = stored.select("doc_id", "row", "n").join(places, "row", "left").join(lists, "row", "left")
    return joined.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("places", F.array().cast("array<struct<start:int,end:int>>")).alias("places"))
