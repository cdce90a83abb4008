"""The four end-to-end analyses: sounding models, impact score, monthly three-source merge, explorer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.functions import labels
from plumetrics.functions.dates import calendar_parts, local_hour, parse_mixed_date
from plumetrics.functions.scalars import number
from plumetrics.operators.quantiles import group_summary, keyed_join
from plumetrics.operators.relational import join_present, union_by_name
from plumetrics.operators.scaling import iqr_norm, table_quantiles
from plumetrics.operators.summaries import monthly_mean
from plumetrics.session import broadcast_if_small, cut_lineage, cut_lineage_counted

SITE_FIELDS = ("country", "population", "gdp_bil_usd", "coastal_km")
SEASON_PREDICTORS = ("sif_iqr", "pop_iqr", "xco2_numsams_iqr", "gdp_iqr", "coast_iqr")
IMPACT_PREDICTORS = ("sif_iqr", "pop_iqr", "xco2numsams_iqr", "sifnumsams_iqr", "gdp_iqr", "coast_iqr")
RAW_PREDICTORS = ("sif_median", "pop_iqr", "gdp_iqr", "coast_iqr")
NO2_PREDICTORS = (*RAW_PREDICTORS, "no2_median")

IMPACT_SCALING = {
    "co2_conc_iqr": "xco2_ppm", "co2_em_iqr": "annual_co2_em_mtco2", "sif_iqr": "sif_757nm", "pop_iqr": "population",
    "xco2numsams_iqr": "xco2_numsams", "sifnumsams_iqr": "sif_numsams", "gdp_iqr": "gdp_bil_usd",
    "coast_iqr": "coastal_km",
}
SEASON_SCALING = {
    "xco2_iqr": "xco2_median", "sif_iqr": "sif_median", "pop_iqr": "population", "xco2_numsams_iqr": "xco2_n",
    "sif_numsams_iqr": "sif_n", "gdp_iqr": "gdp_bil_usd", "coast_iqr": "coastal_km",
}
MONTHLY_SCALING = {
    "xco2_iqr": "xco2_median", "sif_iqr": "sif_median", "pop_iqr": "population", "gdp_iqr": "gdp_bil_usd",
    "coast_iqr": "coastal_km", "no2_iqr": "no2_median",
}


def with_labels(soundings: DataFrame) -> DataFrame:
    """Calendar parts, season from the sounding's own latitude, and local time of day."""
    return (
        soundings.withColumns(calendar_parts(F.col("datetime")))
        .withColumn("season", labels.season(F.col("latitude"), F.col("month")))
        .withColumn("hour", local_hour(F.col("local_time")))
        .withColumn("time_of_day", labels.time_of_day(F.col("hour")))
    )


def site_season_summary(
    xco2: DataFrame, sif: DataFrame, site_table: DataFrame, count_mode: str = "rows", **options
) -> DataFrame:
    """Medians, spreads and counts per site, season and time of day, with the site's attributes.

    Soundings are summarised before the site join: the attributes depend on the site alone, so the join sees a
    handful of rows per site and not the soundings. A site listed m times repeats each of its soundings m times,
    which scales the counts and spreads and leaves the medians alone.
    """
    soundings = union_by_name(xco2.drop("city", "country", "population"), sif)
    labelled = with_labels(soundings).select(
        "target_name", "season", "time_of_day", number("xco2").alias("xco2"),
        number("Daily_SIF_757nm").alias("sif"),
    )
    summary = group_summary(
        labelled, ["target_name", "season", "time_of_day"],
        [
            F.count(F.lit(1)).alias("rows"), F.count("xco2").alias("xco2_present"), F.count("sif").alias("sif_present"),
            F.stddev_samp("xco2").alias("xco2_std"), F.stddev_samp("sif").alias("sif_std"),
        ],
        {"xco2_median": ("xco2", 0.5), "sif_median": ("sif", 0.5)}, **options,
    )
    place = site_table.groupBy("target_name", *SITE_FIELDS).agg(
        F.min("city").alias("city"), F.count(F.lit(1)).alias("listed")
    )
    joined = keyed_join(summary, place, ["target_name"], "left")
    m = F.coalesce("listed", F.lit(1))

    def spread(std: str, present: str) -> Column:
        n = F.col(present)
        factor = F.sqrt(F.try_divide(m * (n - 1), m * n - 1))
        return F.when(m == 1, F.col(std)).when(n == 1, 0.0).otherwise(F.col(std) * factor)

    rows = count_mode == "rows"
    return joined.select(
        "target_name", *SITE_FIELDS, "season", "time_of_day", "city", "xco2_median",
        spread("xco2_std", "xco2_present").alias("xco2_std"),
        (m * F.col("rows" if rows else "xco2_present")).alias("xco2_n"), "sif_median",
        spread("sif_std", "sif_present").alias("sif_std"),
        (m * F.col("rows" if rows else "sif_present")).alias("sif_n"),
    )


def sounding_table(xco2: DataFrame, sif: DataFrame, site_table: DataFrame, **options) -> DataFrame:
    """The modelling table of the sounding analysis: summaries of sites with population, IQR-scaled."""
    summary = site_season_summary(xco2, sif, site_table, **options).filter(F.col("population").isNotNull())
    options.pop("count_mode", None)
    # The quartiles, the models and the charts all read this table; compute it once.
    return cut_lineage(summary, "site-season").transform(iqr_norm(SEASON_SCALING, **{**options, "stored": True}))


def impact_table(city_year: DataFrame, **options) -> DataFrame:
    """Cities with population, IQR-scaled, with the impact score: concentration minus emissions."""
    cities = cut_lineage(city_year.dropna(subset=["population"]), "cities")
    return cities.transform(iqr_norm(IMPACT_SCALING, **options)).withColumn(
        "impact_iqr", F.col("co2_conc_iqr") - F.col("co2_em_iqr")
    )


def with_upper_quartile_quadrant(city_year: DataFrame, **options) -> DataFrame:
    """Quadrant of every city by the third quartiles of concentration and emissions over all cities."""
    cities = cut_lineage(city_year, "cities")
    q = table_quantiles(
        cities, {"conc_q3": ("xco2_ppm", 0.75), "em_q3": ("annual_co2_em_mtco2", 0.75)}, **options
    )
    return cities.withColumn("quadrant", labels.upper_quartile_quadrant(
        F.col("xco2_ppm"), F.col("annual_co2_em_mtco2"), q["conc_q3"], q["em_q3"]
    ))


def with_split_quadrant(table: DataFrame, **options) -> DataFrame:
    """Median-split quadrant and coastal status of a scaled table."""
    q = table_quantiles(table, {"sif": ("sif_iqr", 0.5), "co2": ("xco2_iqr", 0.5)}, **options)
    return table.withColumns({
        "quadrant": labels.split_quadrant(F.col("sif_iqr"), F.col("xco2_iqr"), q["sif"], q["co2"]),
        "coastal_status": labels.coastal_status(F.col("coastal_km")),
    })


MONTH_KEYS = ("target_name", "year", "month")
# Keys without missing values while tables are grouped and joined: plain equality pairs them, so the joins can use
# the partitioning the groupings leave behind. A flag tells a missing name from an empty one; no month is 0.
_JOIN_KEYS = ("target_name", "nameless", "year", "month")


def _month_keys(ts: Column) -> list[Column]:
    parts = calendar_parts(ts)
    return [
        F.coalesce("target_name", F.lit("")).alias("target_name"), F.isnull("target_name").alias("nameless"),
        *[F.coalesce(parts[k], F.lit(0)).alias(k) for k in ("year", "month")],
    ]


def _restore_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "target_name": F.when(~F.col("nameless"), F.col("target_name")),
        **{k: F.when(F.col("month") != 0, F.col(k)) for k in ("year", "month")},
    }).drop("nameless")


def _month_hashes(months: DataFrame) -> DataFrame:
    """A hash of the keys of each month, every hash once. They are stored, so a join with them can split the rows of a hot month."""
    hashes = months.select(F.xxhash64(*_JOIN_KEYS).alias("_wanted")).distinct()
    return broadcast_if_small(*cut_lineage_counted(hashes, "month-hashes"))


def _of_months(rows: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """Rows of the months with these ``hashes`` (all rows if there are none given).

    Rows of other months would be summarised only to be dropped by the join that follows. That join still compares the
    keys themselves, so it does no harm if a row of another month has the hash of a wanted one.
    """
    if hashes is None:
        return rows
    hashed = rows.withColumn("_hash", F.xxhash64(*_JOIN_KEYS))
    return hashed.join(hashes, F.col("_hash") == F.col("_wanted")).drop("_hash", "_wanted")


def _xco2_by_month(xco2: DataFrame, **options) -> DataFrame:
    rows = xco2.select(*_month_keys(F.col("datetime")), "datetime", "sounding_id", "latitude", number("xco2").alias("xco2"))
    return group_summary(
        rows, _JOIN_KEYS,
        [F.min_by("latitude", F.struct("datetime", "sounding_id")).alias("latitude"), F.count("xco2").alias("xco2_n")],
        {"xco2_median": ("xco2", 0.5)}, **options,
    )


def _sif_by_month(sif: DataFrame, hashes: DataFrame | None = None, **options) -> DataFrame:
    rows = sif.select(*_month_keys(F.col("datetime")), number("Daily_SIF_757nm").alias("sif"))
    rows = _of_months(rows, hashes)
    return group_summary(rows, _JOIN_KEYS, [F.count("sif").alias("sif_n")], {"sif_median": ("sif", 0.5)}, **options)


PLACE = ("city", *SITE_FIELDS, "is_coastal")


def _first_place(*order: str) -> Column:
    """The attributes of the row that comes first in ``order``; of several such rows the least attributes."""
    return F.min(F.struct(*order, *PLACE)).alias("place")


def _spread_place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "place")]
    return df.select(*keys, *[F.col(f"place.{c}").alias(c) for c in PLACE], *rest)


def _no2_by_month(no2: DataFrame, hashes: DataFrame | None = None, **options) -> DataFrame:
    dated = no2.withColumn("parsed", parse_mixed_date(F.col("date")))
    rows = dated.select(*_month_keys(F.col("parsed")), "parsed", *PLACE, number("no2").alias("no2"))
    rows = _of_months(rows, hashes)
    months = group_summary(rows, _JOIN_KEYS, [_first_place("parsed")], {"no2_median": ("no2", 0.5)}, **options)
    return _spread_place(months, _JOIN_KEYS)


def monthly_xco2(xco2: DataFrame, **options) -> DataFrame:
    """Per site and month: latitude of the first sounding in time, median and number of values present."""
    return _restore_keys(_xco2_by_month(xco2, **options))


def monthly_sif(sif: DataFrame, **options) -> DataFrame:
    """Per site and month: median and number of values present."""
    return _restore_keys(_sif_by_month(sif, **options))


def monthly_no2(no2: DataFrame, **options) -> DataFrame:
    """Per site and month: the site's attributes on its first date and the median NO2; dates come in mixed formats."""
    return _restore_keys(_no2_by_month(no2, **options))


def monthly_pair(xco2: DataFrame, sif: DataFrame, **options) -> DataFrame:
    """Monthly XCO2 with the SIF of the same site and month, where there is any."""
    months = cut_lineage(_xco2_by_month(xco2, **options), "xco2-months")
    return _restore_keys(months.join(_sif_by_month(sif, _month_hashes(months), **options), list(_JOIN_KEYS), "left"))


def monthly_merge(no2: DataFrame, xco2: DataFrame, sif: DataFrame, **options) -> DataFrame:
    """The three monthly tables joined on site and month, sites without population dropped, with season."""
    months = cut_lineage(_xco2_by_month(xco2, **options), "xco2-months")
    hashes = _month_hashes(months)
    merged = (
        months
        .join(_sif_by_month(sif, hashes, **options), list(_JOIN_KEYS), "left")
        .join(_no2_by_month(no2, hashes, **options), list(_JOIN_KEYS), "left")
        .filter(F.col("population").isNotNull())
    )
    return _restore_keys(merged).withColumn("season", labels.season(F.col("latitude"), F.col("month")))


def seasonal_medians(merged: DataFrame, **options) -> DataFrame:
    """Median and spread of the monthly medians per site and season, with the site's attributes in the first month."""
    keys, values = ("target_name", "season"), ("xco2", "sif", "no2")
    medians = group_summary(
        merged, keys,
        [_first_place("year", "month")] + [F.stddev_samp(f"{v}_median").alias(f"{v}_std") for v in values],
        {f"{v}_median": (f"{v}_median", 0.5) for v in values}, **options,
    )
    return _spread_place(medians, keys).filter(F.col("population").isNotNull())


def monthly_table(no2: DataFrame, xco2: DataFrame, sif: DataFrame, **options) -> DataFrame:
    """The modelling table of the three-source analysis."""
    merged = cut_lineage(monthly_merge(no2, xco2, sif, **options), "monthly")
    medians = cut_lineage(seasonal_medians(merged, stored=True, **options), "seasonal")
    return medians.transform(iqr_norm(MONTHLY_SCALING, stored=True, **options))


def city_month_series(points: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Monthly mean of every known city."""
    return monthly_mean(points.filter(F.col("city") != unknown), ["city_key", "month"], "xco2")
