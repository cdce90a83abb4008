"""Secret scans over a ledger of content-addressed versions. DataFrame expressions only, no Python on rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.session import broadcast_if_small, cut_lineage_counted, scratch_path

SPAN = "struct<start:bigint,kind:int,end:bigint>"
LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


class Rule(NamedTuple):
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` is under ``least`` long are dropped.

    ``hint`` is a pattern or text without which a text cannot match; it spares most texts the search. A new ``version``
    makes every blob unseen for the rule.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# The three base patterns. Runs of one class are matched from the least length on, which drops the same.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1,
         "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8,}\."),
)
RULES = (*BASE, *MORE)


CHUNK = 256
# Code points of a piece of text that redaction reads at a time.
PIECE = 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (numbers) the fold of those before it, from ``zero``; ``step`` is associative.

    A fold that appends copies its list each time, so lists are folded in chunks, and the chunks' own folds added.
    """
    nothing = F.array().cast("array<bigint>")
    first = F.lit(zero).cast("bigint")

    def fold(some: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), nothing.alias("out"))
        return F.aggregate(some, state, lambda done, x: F.struct(
            step(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])

    def joined(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, first, step))
        return F.flatten(F.zip_with(chunks, fold(sums, first), fold))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda i: F.slice(v, i, F.lit(CHUNK)))

    return once(once(values, cut), joined)


def spans_of(rule: Rule, text: Column) -> Column:
    """(start, end) of the matches in code points, end exclusive.

    ``split`` gives the stretches between the matches and ``regexp_extract_all`` the matches, in the same order; the
    lengths of both add up to the positions.
    """
    lengths = lambda parts: F.transform(parts, lambda s: F.char_length(s).cast("bigint"))
    sizes = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    judged = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else sizes
    matched = F.arrays_zip(sizes.alias("size"), judged.alias("own"), lengths(F.split(text, rule.pattern, -1)).alias("gap"))

    def placed(each: Column) -> Column:
        # The last stretch has no match behind it.
        done = before(F.transform(each, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), 0, lambda a, b: a + b)
        both = F.zip_with(each, done, lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["own"].alias("own")))
        good = F.filter(both, lambda x: x["own"] >= rule.least)
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.rlike(text, F.lit(rule.hint)), once(matched, placed)).otherwise(nothing)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, text, unseen: kinds to look for) -> ledger rows, one for each blob and unseen rule."""
    found = F.array(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                 F.when(F.array_contains("unseen", r.kind), spans_of(r, F.col("text"))).alias("spans"))
        for r in rules
    ])
    rows = blobs.select("blob", F.explode(found).alias("x")).select("blob", "x.*")
    return rows.filter(F.col("spans").isNotNull())


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def update(docs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the blobs of ``docs`` and the rule versions that ``ledger`` does not have; each is scanned once.

    One row per blob and rule scanned; a rule that found nothing has no spans. With a ledger, blob ids alone are
    compared with it, and only texts of unseen blobs are read on: the ids are sent to the texts if they are few. Copies
    meet in the deduplication by blob, which combines within tasks first, so a text is moved once per task, however
    many copies there are.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("text"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return scan_blobs(blobs.dropDuplicates(["blob"]).withColumn("unseen", kinds), rules)
    current = ledger.filter(F.concat_ws(":", "rule", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
    seen = current.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>")))
    unseen, n_unseen = cut_lineage_counted(blobs.select("blob").distinct().join(seen, "blob", "left").select(
        "blob", missing.alias("unseen")).filter(F.size("unseen") > 0), "unseen-blobs")
    return scan_blobs(blobs.join(broadcast_if_small(unseen, n_unseen), "blob").dropDuplicates(["blob"]), rules)


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, found): the spans of the current rules of each blob that has any, by start, then rule order."""
    order = {r.kind: i for i, r in enumerate(rules)}
    number = F.coalesce(*[F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), order[r.kind]) for r in rules])
    own = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))
    rows = ledger.filter(number.isNotNull() & (F.size("spans") > 0)).select("blob", own.alias("spans"))
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))


def scan(
    docs: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text",
) -> DataFrame:
    """``docs`` with ``blob`` (sha-256 of the text) and ``found``: array of (start, kind: place in ``rules``, end).

    The ledger is a Parquet table of (blob, rule, version, spans) in ``ledger_path``; without one a new ledger is
    kept in the scratch folder of the session. Every row of ``docs`` is a version under some path; blobs that the
    ledger knows for a rule's version are not scanned again, and findings are joined back to all rows. Positions are
    code points. Null text is empty text; both, and texts without a secret, have an empty ``found``. Repeated rows
    share a blob and its findings; spans that begin together go by rule order. Long texts take time in proportion to
    their length and matches. An empty table gives an empty result. Columns named blob or found are replaced.
    """
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "ledger")
    known = None
    if ledger_path:
        # An empty append makes the folder readable on its first use.
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
        known = spark.read.schema(LEDGER).parquet(path)
    update(docs, known, rules, text).write.mode("append").parquet(path)
    marked = docs.drop("blob", "found").withColumn("blob", blob_id(F.col(text)))
    entries = spark.read.schema(LEDGER).parquet(path)
    if ledger_path:
        # Other corpora may have filled it.
        entries = entries.join(marked.select("blob").distinct(), "blob", "left_semi")
    found = findings(entries, rules)
    return marked.join(found, "blob", "left").select(
        *[marked[c] for c in marked.columns],
        F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"),
    )


def listed(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mark``; overlapping spans are one stretch.

    Null text and texts without spans stay as they are. The text is cut into pieces of ``PIECE`` code points once and
    each kept stretch read from the pieces it lies in, so time grows with length plus spans, not with their product.
    """
    ends = before(F.transform(found, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))

    def cleaned(pieces: Column) -> Column:
        def cut(begin: Column, end: Column) -> Column:
            first, last = (F.floor(x / PIECE).cast("int") for x in (begin, end))
            own = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.substring(own, (begin - first * PIECE + 1).cast("int"), (end - begin).cast("int"))

        # Of spans that overlap only the first writes the mark; the others begin before the farthest end so far.
        kept = F.zip_with(found, ends, lambda s, at: F.when(
            s["start"] >= at, F.concat(cut(at, s["start"]), F.lit(mark))).otherwise(""))
        rest = cut(F.array_max(F.transform(found, lambda s: s["end"])), F.char_length(text).cast("bigint"))
        return F.concat(F.array_join(kept, ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(found) > 0, once(pieces, cleaned)).otherwise(text)
