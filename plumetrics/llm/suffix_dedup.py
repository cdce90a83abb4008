"""Removal of long repeated byte strings: suffix arrays of repeated regions, intervals expanded on their BWT.

A 50-byte string of a document is removed if it also starts in a document with a smaller id. One suffix array over
the whole corpus would pass everything through one task. Instead every 50-byte window belongs to one anchor, the
k-byte string with the least hash inside it. Equal windows have equal anchors, so anchors can be dealt out by hash
and looked into one by one, without losing a pair:

1. Every task lists the anchors of its texts. An anchor seen in two different texts is repeated; equal texts are
   one class, and only its first document goes on.
2. For repeated anchors, the stretch of bytes covered by consecutive windows of the anchor (its context) is sent to
   the anchor's bucket, equal contexts of a task once.
3. A bucket builds the suffix array and the Burrows-Wheeler transform of its different contexts and extends
   intervals backward, breadth first, so common prefixes come by increasing length, up to the window length. Suffixes
   in one interval of that length start with the same window; all but those of the least document are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumetrics.llm.common import partitions, piece_count
from plumetrics.session import cut_lineage

LENGTH = 50
ANCHOR = 20
# Anchors of a task are sent in one list per bucket; buckets are made so many that one holds about this many bytes.
BUCKET_TEXT = 64 << 20
# An anchor that more texts hold is dealt out by its neighbours too.
HOT_TEXTS = 1 << 16
PORTION, CACHED, CHUNK = 16 << 20, 128 << 10, 1 << 20
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``length`` bytes, put together from halves of doubling length."""
    part = (data.astype(np.uint64) + np.uint64(1)) * MIX
    part ^= part >> np.uint64(29)
    whole, have, size = None, 0, 1
    while length:
        if length & 1:
            if whole is None:
                whole = part
            else:
                n = min(len(whole), len(part) - have)
                whole = whole[: max(n, 0)] * np.uint64(pow(BASE, size, 1 << 64)) + part[have: have + max(n, 0)]
            have += size
        length >>= 1
        if length:
            part = part[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:] if len(part) > size else part[:0]
            size *= 2
    whole = whole ^ (whole >> np.uint64(31))
    whole = whole * MIX
    return whole ^ (whole >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width and len(values) > size:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    if rest and len(values) > rest:
        values = np.minimum(values[: len(values) - rest], values[rest:])
    return values


def contexts(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """(anchor hash, text number, start, number of windows) of all contexts of the texts, in order.

    Short texts are joined to pieces that stay in the processor's cache.
    """
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    sizes = np.array([len(t) for t in texts], np.int64)
    groups = np.cumsum(sizes) // CACHED
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        if len(data) < length:
            continue
        least = sliding_least(rolling(data, anchor), length - anchor + 1)
        ends = np.cumsum(sizes[a:b])
        number = np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])[: len(least)]
        good = np.ones(len(least), bool)
        for end in ends[:-1]:
            good[max(0, end - length + 1): end] = False
        new = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= good[1:] & ~good[:-1]
        begins = np.flatnonzero(new & good)
        # A context ends where the next one begins or where windows stop.
        stops = np.flatnonzero(np.append((new | ~good)[1:], True) & good) + 1
        found.append((least[begins], number[begins].astype(np.int64) + a, begins - (ends - sizes[a:b])[number[begins]], stops - begins))
    hashes, number, start, windows = (np.concatenate(c) for c in zip(*found))
    # In a text that repeats itself an anchor may go on for long; windows of one anchor may be divided at will.
    most = length - anchor + 1
    parts = -(-windows // most)
    if (parts > 1).any():
        hashes, number, start, windows = (np.repeat(c, parts) for c in (hashes, number, start, windows))
        place = np.arange(len(parts.repeat(parts))) - np.repeat(np.cumsum(parts) - parts, parts)
        start, windows = start + most * place, np.minimum(most, windows - most * place)
    return hashes, number, start, windows


def portions(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that their texts have about ``PORTION`` bytes."""
    for batch in parts:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        sums = np.cumsum([len(t) for t in texts]) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(sums)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), texts[a:b]


def text_key(text: bytes) -> int:
    """The same number as Spark's ``xxhash64`` of the text."""
    return xxhash.xxh64_intdigest(text, 42)


ANCHOR_NAMES = ("bucket", "hashes", "keys", "known", "known_keys")
ANCHORS = "bucket int, hashes binary, keys binary, known binary, known_keys binary"


def dealt(bucket: np.ndarray, *order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries, sorted by ``order``); one sort, whatever the number of buckets."""
    places = np.lexsort((*order[::-1], bucket))
    begins = np.flatnonzero(np.append(True, np.diff(bucket[places]) != 0)) if len(places) else places
    for part in np.split(places, begins[1:]) if len(places) else ():
        yield int(bucket[part[0]]), part


def list_anchors(buckets: int, length: int, anchor: int):
    """mapInArrow function: (text) -> for each bucket the anchors of a portion's different texts, with the texts' keys.

    Within a portion a text is listed once. An anchor that the portion already shows to be repeated is answered on
    the spot (columns ``known``), and only two of its texts are sent for comparison, however many hold it. An anchor
    takes 16 bytes, into however many buckets they are dealt.
    """
    kinds = [pa.int32(), *[pa.binary()] * 4]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, every in portions(parts):
            texts = list(dict.fromkeys(every))
            keys = np.array([text_key(t) for t in texts], np.uint64).view(np.int64)
            hashes, number, _, _ = contexts(texts, length, anchor)
            order = np.argsort(hashes, kind="stable")
            hashes, number = hashes[order], number[order]
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])
            hashes, number = hashes[fresh], number[fresh]
            first = np.ones(len(hashes), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            begins = np.flatnonzero(first)
            counts = np.diff(np.append(begins, len(hashes)))
            many = np.repeat(counts > 1, counts)
            sent = first.copy()
            sent[1:] |= first[:-1]
            # By text, so that the keys compress to little.
            for k, part in dealt((hashes % np.uint64(buckets)).astype(np.int32), number):
                own, known = part[sent[part]], part[many[part]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((
                    k, hashes[own].tobytes(), keys[number[own]].tobytes(),
                    hashes[known].tobytes(), keys[number[known]].tobytes()), kinds)], names=list(ANCHOR_NAMES))

    return run


def repeated_anchors(hot_texts: int):
    """Group function of a bucket: (key, hash), a row for each repeated anchor of a text.

    The last bit of a hash tells whether more than ``hot_texts`` texts of the bucket's portions hold the anchor.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in part[c]])
        hashes, owners = read("hashes", np.uint64), read("keys", np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        low, high = np.minimum.reduceat(owners, begins), np.maximum.reduceat(owners, begins)
        many = np.repeat(low != high, np.diff(np.append(begins, len(hashes))))
        hashes = np.concatenate([hashes[many], read("known", np.uint64)])
        owners = np.concatenate([owners[many], read("known_keys", np.int64)])
        _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        flagged = (hashes & ~np.uint64(1)) | (counts[at] > hot_texts).astype(np.uint64)
        order = np.argsort(owners, kind="stable")
        return pd.DataFrame({"key": owners[order], "hash": flagged[order].view(np.int64)})

    return run


def divided(texts: list[bytes], hashes: np.ndarray, number: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, anchor: int):
    """Contexts of hot anchors, divided where the second least hash of a window changes: (hash, number, start, windows).

    Equal windows have equal least and second least hashes, so they meet under the hash of both.
    """
    sizes = windows + length - 1
    joined = b"".join(texts[i][s: s + n] for i, s, n in zip(number.tolist(), start.tolist(), sizes.tolist()))
    values = rolling(np.frombuffer(joined, np.uint8), anchor)
    ends = np.cumsum(sizes)
    context = np.repeat(np.arange(len(sizes)), sizes)
    values[values == hashes[context[: len(values)]]] = np.uint64((1 << 64) - 1)
    second = sliding_least(values, length - anchor + 1)
    context = context[: len(second)]
    place = np.arange(len(second)) - (ends - sizes)[context]
    good = np.flatnonzero(place < windows[context])
    second, context, place = second[good], context[good], place[good]
    begins = np.flatnonzero(np.append(True, (second[1:] != second[:-1]) | (context[1:] != context[:-1])))
    counts = np.diff(np.append(begins, len(second)))
    at = context[begins]
    return hashes[at] ^ (second[begins] * MIX), number[at], start[at] + place[begins], counts


CONTEXT_NAMES = ("bucket", "bytes", "windows", "starts", "owners", "docs", "keys", "known")
CONTEXTS = "bucket int, bytes binary, windows binary, starts binary, owners binary, docs binary, keys binary, known binary"


def send_contexts(buckets: int, length: int, anchor: int):
    """mapInArrow function: (doc, key, text, hashes) -> for each bucket the contexts of repeated anchors.

    Of equal contexts of a portion only those of the least document are sent; the others are removed at once, as
    triples (key, start, end) in ``known``. Contexts of hot anchors are dealt by a second hash too.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for batch, texts in portions(parts):
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "key"))
            flagged = np.unique(batch.column("hashes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            wanted, hot = np.unique(flagged >> one), np.unique(flagged[(flagged & one) == one] >> one)
            hashes, number, start, windows = contexts(texts, length, anchor)
            hit = np.isin(hashes >> one, wanted)
            hashes, number, start, windows = hashes[hit], number[hit], start[hit], windows[hit]
            many = np.isin(hashes >> one, hot)
            if many.any():
                split = divided(texts, hashes[many], number[many], start[many], windows[many], length, anchor)
                hashes, number, start, windows = (
                    np.concatenate([a[~many], b.astype(a.dtype)]) for a, b in zip((hashes, number, start, windows), split))
            owner = docs[number]
            ids: dict[bytes, int] = {}
            stretch = [texts[i][s: s + w + length - 1] for i, s, w in zip(number.tolist(), start.tolist(), windows.tolist())]
            name = np.array([ids.setdefault(x, len(ids)) for x in stretch], np.int64)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, name, owner)
            later = owner > least[name]
            for k, every in dealt((hashes % np.uint64(buckets)).astype(np.int32), number, start):
                part, known = every[~later[every]], every[later[every]]
                done = np.stack([keys[number[known]], start[known], start[known] + windows[known] + length - 1], axis=1)
                names, at = np.unique(number[part], return_inverse=True)
                row = (k, b"".join([stretch[i] for i in part.tolist()]), windows[part].astype(np.uint8).tobytes(),
                       start[part].astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(),
                       docs[names].tobytes(), keys[names].tobytes(), done.astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int32()), *(pa.array([v], pa.binary()) for v in row[1:])], names=list(CONTEXT_NAMES))

    return run


def suffix_array(data: np.ndarray, ends: np.ndarray, deep: int) -> np.ndarray:
    """Order of the suffixes of a joined text whose parts end at ``ends`` (positions of zeros).

    Prefix doubling from packed first bytes. A suffix ends with its part; suffixes that are equal up to there go by
    position, as if the zeros were different letters in that order. Exact for parts shorter than ``deep``.
    """
    n, size = len(data), 7
    stop = ends[np.searchsorted(ends, np.arange(n))]
    rank = np.zeros(n, np.int64)
    for i in range(size):
        at = np.arange(n) + i
        rank = (rank << 9) | np.where(at < stop, data[np.minimum(at, n - 1)], 0)
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        if size >= deep:
            return order
        at = np.arange(n) + size
        rank = (dense << 32) | np.where(at < stop, dense[np.minimum(at, n - 1)], 0)
        size *= 2


def equal_prefixes(data: np.ndarray, ends: np.ndarray, length: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): the suffix order, and where in it the suffixes of a new ``length``-byte prefix begin.

    Breadth-first expansion of intervals on the Burrows-Wheeler transform (after Beller, Gog, Ohlebusch and
    Schnattinger, 2013). All intervals of a length are extended backward by every letter at once: the rows of an
    interval that are preceded by one letter become, through the mapping from last to first column, the next rows of
    that letter. Where two neighbours come from different intervals, a common prefix of exactly the current length
    ends, so these are found by increasing value; expansion stops at ``length``.
    """
    order = suffix_array(data, ends, deep)
    before = np.where(order > 0, data[order - 1], 0)  # the transform; a part is preceded by the end of the last one
    first = data[order]
    begins = np.append(True, first[1:] != first[:-1]) | (first == 0)  # each end is a letter of its own
    # Rows of the last column in the order in which they appear in the first. Ends lead, and are never extended.
    source = np.argsort(before, kind="stable").astype(np.int32)
    skip = int((first == 0).sum())
    letters = first[skip:]
    source = source[skip:]
    for _ in range(length - 1):
        interval = np.cumsum(begins, dtype=np.int32)[source]
        wider = begins.copy()
        wider[skip + 1:] = (interval[1:] != interval[:-1]) | (letters[1:] != letters[:-1])
        if (wider == begins).all():
            break
        begins = wider
    return order, begins


def removed_windows(parts: list[bytes], docs: np.ndarray, length: int, deep: int) -> list[np.ndarray]:
    """For each context (with its least document) whether each window also starts in a smaller document's context."""
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    data[ends] = 0
    order, begins = equal_prefixes(data, ends, length, deep)
    owner = docs[np.searchsorted(ends, order)]
    # Suffixes shorter than a window hold an end, which is different in every part, so they stand alone.
    at = np.flatnonzero(begins)
    least = np.repeat(np.minimum.reduceat(owner, at), np.diff(np.append(at, len(order))))
    gone = np.zeros(len(data), bool)
    gone[order] = least < owner
    return [gone[e - n: e - length + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def mark(length: int, anchor: int):
    """Group function of a bucket: (key, span), a row for each removed stretch of a text, its start x 2^32 + its end."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        windows, starts, known = (
            np.concatenate([np.frombuffer(x, kind) for x in part[c]]).astype(np.int64)
            for c, kind in (("windows", np.uint8), ("starts", np.uint32), ("known", np.int64)))
        docs, keys = (
            np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(o, np.uint32)] for x, o in zip(part[c], part["owners"])])
            for c in ("docs", "keys"))
        names: dict[bytes, int] = {}
        name = np.empty(len(windows), np.int64)
        at = 0
        for body, own in zip(part["bytes"], part["windows"]):
            end = 0
            for w in own:
                begin, end = end, end + w + length - 1
                name[at] = names.setdefault(body[begin:end], len(names))
                at += 1
        different = list(names)
        least = np.full(len(different), np.iinfo(np.int64).max)
        np.minimum.at(least, name, docs)
        done = [known.reshape(-1, 3)]
        later = docs > least[name]
        done.append(np.stack([keys[later], starts[later], starts[later] + windows[later] + length - 1], axis=1))
        gone = expand(different, least, length, anchor)
        for i in np.flatnonzero(~later & np.isin(name, np.fromiter(gone, np.int64, len(gone)))).tolist():
            flags = gone[name[i]]
            edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            done.append(np.stack([np.full(len(edges), keys[i]), starts[i] + edges[:, 0], starts[i] + edges[:, 1] + length - 1], axis=1))
        every = np.concatenate(done)
        every = every[np.argsort(every[:, 0], kind="stable")]
        return pd.DataFrame({"key": every[:, 0], "span": (every[:, 1] << 32) | every[:, 2]})

    return run


def expand(different: list[bytes], least: np.ndarray, length: int, anchor: int) -> dict[int, np.ndarray]:
    """Context number -> which of its windows also start in a smaller document's other context; only where one does.

    Contexts are taken anchor by anchor. Those without a window whose hash repeats are passed over; the rest goes in
    chunks of whole anchors to the interval expansion, which decides.
    """
    if len(different) < 2:
        return {}
    heads = np.frombuffer(b"".join(x[:length] for x in different), np.uint8).reshape(-1, length)
    group = np.concatenate([
        sliding_least(rolling(part.reshape(-1), anchor), length - anchor + 1)[::length]
        for part in np.array_split(heads, piece_count(heads.size, CACHED))])
    order = np.argsort(group, kind="stable")
    counts = np.unique(group, return_inverse=True, return_counts=True)
    order = order[counts[2][counts[1]][order] > 1]
    found: dict[int, np.ndarray] = {}
    chunk: list[int] = []
    size = 0
    for k, i in enumerate(order.tolist()):
        chunk.append(i)
        size += len(different[i])
        if k + 1 == len(order) or size >= CHUNK and group[order[k + 1]] != group[i]:
            joined = np.frombuffer(b"".join(different[j] for j in chunk), np.uint8)
            windows = rolling(joined, length)
            sizes = np.array([len(different[j]) for j in chunk])
            owner = np.repeat(np.arange(len(chunk)), sizes)[: len(windows)]
            inside = np.arange(length, length + len(windows)) <= np.cumsum(sizes)[owner]
            _, at, many = np.unique(windows[inside], return_inverse=True, return_counts=True)
            chosen = [chunk[j] for j in np.unique(owner[inside][many[at] > 1]).tolist()]
            if chosen:
                flags = removed_windows([different[j] for j in chosen], least[chosen], length, 2 * length)
                found.update((j, f) for j, f in zip(chosen, flags) if f.any())
            chunk, size = [], 0
    return found


def remove_spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, whole, spans) -> what is removed, its number of runs, and the bytes that stay."""
    for batch in parts:
        rows = []
        bodies = (t or "" for t in batch.column("text").to_pylist())
        for text, whole, spans in zip(bodies, batch.column("whole").to_pylist(), batch.column("spans")):
            body = text.encode("utf-8", "surrogatepass")
            n = len(body)
            if whole:
                runs = [(0, n)]
            elif spans.is_valid:
                every = np.sort(spans.values.to_numpy(zero_copy_only=False))
                begins, high = every >> 32, np.maximum.accumulate(every & 0xFFFFFFFF)
                new = np.append(True, begins[1:] > high[:-1])
                runs = list(zip(begins[new].tolist(), high[np.append(new[1:], True)].tolist()))
            else:
                runs = []
            edges = [0, *(x for run in runs for x in run), n]
            rest = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else body
            rows.append((n, n - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text",
    bucket_text: int = BUCKET_TEXT, hot_texts: int = HOT_TEXTS, with_bytes: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept bytes.

    Every byte covered by a ``length``-byte string that also starts in a document with a smaller id is removed.
    Texts are UTF-8 bytes, null is empty; texts shorter than ``length`` lose nothing. Strings are judged on the input.
    Ids are whole numbers; a null id counts as larger than all. Rows that repeat an id do not take strings from each
    other, as neither id is smaller. An empty table gives an empty result. Hot passages are answered within tasks
    before they are sent, so no bucket receives a passage more often than there are portions of text. An anchor that
    more than ``hot_texts`` texts hold is dealt out by its windows' second least hash as well.
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(last)).alias("doc"),
                       body.alias("text"))
    keyed = read.withColumn("key", F.xxhash64("text"))
    # Two further checks make texts of one class equal beyond doubt.
    light = cut_lineage(keyed.select("doc", "key", F.crc32("text").alias("check"), F.octet_length("text").alias("size")), "texts")
    size = light.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    buckets = piece_count(size, bucket_text, partitions(spark) if size > bucket_text else 1)
    long = keyed.filter(F.octet_length("text") >= length)
    listed = long.select("text").mapInArrow(list_anchors(buckets, length, anchor), ANCHORS)
    repeated = listed.groupBy("bucket").applyInPandas(repeated_anchors(hot_texts), "key bigint, hash bigint")
    # Written, so that the anchors' shuffle is dropped before the contexts are sent.
    by_key = cut_lineage(repeated.groupBy("key").agg(F.collect_list("hash").alias("hashes")), "repeated-anchors")
    # One document of each text; copies meet within tasks first.
    firsts = long.groupBy("key").agg(F.min(F.struct("doc", "text")).alias("one")).select("key", "one.*")
    sent = firsts.join(by_key, "key").select("doc", "key", "text", "hashes").mapInArrow(send_contexts(buckets, length, anchor), CONTEXTS)
    spans = cut_lineage(sent.groupBy("bucket").applyInPandas(mark(length, anchor), "key bigint, span bigint"), "spans")
    decided = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    # One row per text that has copies or loses something; written, so that hot texts are joined in parts.
    heads = light.filter(F.col("size") >= length).groupBy("key", "check", "size").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("rows"))
    verdicts = cut_lineage(heads.join(decided, "key", "left").filter("rows > 1 or spans is not null").select(
        F.col("key").alias("_key"), F.col("check").alias("_check"), F.col("size").alias("_size"), "head", "spans"), "verdicts")
    same = (F.col("key") == F.col("_key")) & (F.crc32("text") == F.col("_check")) & (F.octet_length("text") == F.col("_size"))
    whole = F.coalesce(F.col("doc") > F.col("head"), F.lit(False))
    out = keyed.join(verdicts, same, "left").select("doc_id", "text", whole.alias("whole"), F.when(~whole, F.col("spans")).alias("spans"))
    kind = read.schema["doc_id"].dataType.simpleString()
    result = out.mapInArrow(
        remove_spans, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return result if with_bytes else result.drop("kept")
