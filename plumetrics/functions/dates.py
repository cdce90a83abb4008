"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_FIRST = "^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"
# Shape of the digits -> the same date with the year first. Month first wins unless the month would be over 12.
REORDER = {
    "^([0-9]{4})([0-9]{2})([0-9]{2})$": "$1-$2-$3",
    "^(0?[0-9]|1[0-2])-([0-9]{1,2})-([0-9]{4})$": "$3-$1-$2",
    "^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$": "$3-$2-$1",
    "^([0-9]{1,2})-([0-9]{4})$": "$2-$1",
}


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts).cast("bigint"),
        "month": F.month(ts).cast("bigint"),
        "day_of_year": F.dayofyear(ts).cast("bigint"),
    }


def local_hour(local_time: Column) -> Column:
    """Hour on the local clock; the column must be a timestamp without zone."""
    return F.hour(local_time).cast("bigint")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def month_label(month: Column, long: bool = False) -> Column:
    # Formatting goes through the session's zone; at noon no zone changes the day.
    noon = month.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    return F.date_format(noon, "MMMM yyyy" if long else "MMM yyyy")


def parse_mixed_date(text: Column) -> Column:
    """Date from year-month-day, month-day-year, day-month-year, year-month or month-year text.

    Any run of separators counts as one. The preference is fixed, so 03-04-2020 is always 4 March.
    """
    plain = F.regexp_replace(F.trim(text), "[^0-9]+", "-")
    iso = F.when(plain.rlike(YEAR_FIRST), plain)
    for shape, year_first in REORDER.items():
        iso = iso.when(plain.rlike(shape), F.regexp_replace(plain, shape, year_first))
    return iso.try_cast("date")
