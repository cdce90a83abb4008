"""Text, number and scaling expressions. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEPARATOR = "|||"

# A leading decimal number, as a browser's number parser would take it from the front of a text.
NUMBER_PREFIX = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"

# Text that starts with a year; a bare clock time is no date.
# White space and Unicode spaces, byte order mark included.
SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
DATED = r"^[0-9]{4}"
# A clock time that ends in Z or in a zone offset such as +02:00 or -0330.
ZONED = r"[0-9]:[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def number(name: str | Column) -> Column:
    """A double column in which NaN counts as missing."""
    value = (F.col(name) if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """True for a present number that is neither NaN nor infinite (NaN sorts above infinity)."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def trimmed(text: Column) -> Column:
    """Without white space at both ends: blanks, line ends, tabs, and the spaces of Unicode.

    Most texts have none, so only those whose first or last sign is one are searched. ``$`` also stands before a line
    end that is no space (U+0085), so texts that end in one are searched too.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(f"{SPACES}|\\x{{85}}"), F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")).otherwise(text)


def clean_text(value: Column, fallback: str = "") -> Column:
    """Trimmed text; missing or blank text becomes ``fallback``."""
    return F.coalesce(F.nullif(trimmed(value), F.lit("")), F.lit(fallback))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *parts)


def parse_number(text: Column) -> Column:
    """Text to double, taking the leading number ("12abc" is 12); NULL when there is none."""
    return F.regexp_extract(text, f"^{SPACES}*({NUMBER_PREFIX.removeprefix('^')})", 1).try_cast("double")


def parse_time(text: Column) -> Column:
    """ISO text, or "date time" text, to a UTC clock time without zone; NULL for junk.

    Text without a zone is read as UTC, whatever the zone of the session.
    """
    plain = trimmed(text)
    suffix = F.when(plain.rlike(ZONED), "").when(plain.contains(":"), "Z").otherwise("T00:00:00Z")
    dated = F.when(plain.rlike(DATED), F.concat(plain, suffix))
    instant = dated.try_cast("timestamp")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` between ``low`` and ``high``, held within [0, 1]; NULL if they are equal."""
    share = F.try_divide(value - low, high - low)
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def negative_log10(p: Column) -> Column:
    """-log10(p); NULL where p is not positive."""
    return F.when(p > 0, -F.log10(p))


def widen_if_flat(low: Column, high: Column, least_span: float, pad: float) -> tuple[Column, Column]:
    """Move both ends out by ``pad`` when they are nearer than ``least_span``."""
    flat = (high - low) < least_span
    return F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
