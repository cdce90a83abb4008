"""Every operator as a named query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.functions import attributes, labels, tables
from plumetrics.functions.dates import calendar_parts, local_hour, month_start, parse_mixed_date
from plumetrics.functions.scalars import clean_text, composite_key, negative_log10, rescale
from plumetrics.operators import (
    geo, quantiles, ranking, regression, relational, rollups, scaling, sketches, summaries, temporal,
)
from plumetrics.plans import pipelines, standins
from plumetrics.plans.oracles import FINE
from plumetrics.plans.standins import sif_obs, sites, table, xco2_obs
from plumetrics.session import cut_lineage, scratch_path
from plumetrics.sources import readers, schemas
from plumetrics.sources.snapshots import SnapshotTable
from plumetrics.streaming import event_time, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RADIUS = 0.5
# Names shown for the terms of the impact model.
TERM_NAMES = {
    "sif_iqr": "SIF", "pop_iqr": "Population", "xco2numsams_iqr": "CO2 Sample Size",
    "sifnumsams_iqr": "SIF Sample Size", "gdp_iqr": "GDP", "coast_iqr": "Coastal Distance",
}
# Names shown on the significance grid.
GRID_TERMS = {"sif_iqr": "SIF", "pop_iqr": "Population", "coast_iqr": "Coast", "xco2_numsams_iqr": "xco2_numsams"}


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded (no negative zero), whole numbers as bigint, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, special.get(f.name, FINE.get(f.name, digits))) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    return build


def query_raw_units(build: Query) -> Query:
    """Coefficients of models in raw units have four to six digits before the point: four behind it are compared."""
    QUERIES[build.__name__] = lambda spark, sf_dir: rounded(build(spark, sf_dir), estimate=4, std_error=4)
    return build


# Frames several queries start from.

def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.with_labels(xco2_obs(spark, d))


def _sounding_table(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.sounding_table(xco2_obs(spark, d), sif_obs(spark, d), sites(spark, d))


def _no2(spark: SparkSession, d: str) -> DataFrame:
    return readers.select_renamed(standins.no2_file(spark, d), schemas.NO2_COLUMNS)


def _monthly_table(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.monthly_table(_no2(spark, d), xco2_obs(spark, d), sif_obs(spark, d))


def _impact(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.impact_table(
        pipelines.with_upper_quartile_quadrant(standins.city_year(spark, d))
    )


def _city_points(spark: SparkSession, d: str) -> DataFrame:
    city, country = clean_text(F.col("city"), readers.UNKNOWN_CITY), clean_text(F.col("country"))
    return xco2_obs(spark, d).filter(F.col("xco2").isNotNull()).select(
        "sounding_id", "latitude", "longitude", "xco2", city.alias("city"), composite_key(city, country).alias("city_key"),
        month_start(F.col("datetime")).alias("month"), "datetime",
    )


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    clustered = geo.spatial_clusters(standins.cluster_points(spark, d), "datetime", "point_id")
    return cut_lineage(clustered, "clustered")


def _text_folder(spark: SparkSession, d: str) -> str:
    """The text soundings written as CSV files, as they would arrive."""
    folder = scratch_path(spark, "sounding-text")
    text = standins.sounding_text(spark, d)
    text.write.option("header", True).option("maxRecordsPerFile", 100_000).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    return folder


TEXT_STREAM = T.StructType([T.StructField("sounding_id", T.LongType()), *schemas.SOUNDING_TEXT.fields])


def _text_soundings(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_text_csv(spark, _text_folder(spark, d), TEXT_STREAM)


# Scans and sources.

@query
def scan_csv_city(spark, d):
    folder = scratch_path(spark, "city-csv")
    cities = standins.city_year(spark, d).withColumnsRenamed({"xco2_ppm": "xco2 ppm"})
    cities.write.option("header", True).csv(folder)
    renamed = T.StructType([T.StructField(f.name.replace("xco2_ppm", "xco2.ppm"), f.dataType) for f in schemas.CITY_YEAR])
    return readers.read_csv(spark, folder, renamed).withColumnRenamed("xco2.ppm", "xco2_ppm")


@query
def scan_csv_reordered(spark, d):
    """Two deliveries of the city table in one folder: the columns of the second are reversed, with one more."""
    folder = scratch_path(spark, "city-deliveries")
    cities, first = standins.city_year(spark, d), F.pmod(F.xxhash64("city"), F.lit(2)) == 0
    cities.filter(first).write.option("header", True).csv(f"{folder}/delivery=1")
    later = cities.filter(~first).select(*reversed(cities.columns), F.lit("late").alias("remark"))
    later.write.option("header", True).csv(f"{folder}/delivery=2")
    return readers.read_csv(spark, folder, schemas.CITY_YEAR)


@query
def scan_parquet(spark, d):
    return readers.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])


@query
def ingest_gate(spark, d):
    return readers.ingest_gate(_text_soundings(spark, d))


@query
def ingest_tally(spark, d):
    return readers.ingest_tally(_text_soundings(spark, d))


@query
def schema_report(spark, d):
    site_report = readers.schema_report(standins.site_file(spark, d), "site")
    return site_report.unionByName(readers.schema_report(xco2_obs(spark, d), "xco2_obs"))


@query
def literal_grid(spark, d):
    counts = _labelled(spark, d).groupBy("season", "time_of_day").agg(F.count(F.lit(1)).alias("n"))
    literals = {"season": labels.SEASONS, "time_of_day": labels.TIMES_OF_DAY}
    grid = spark.range(1).select()
    for name, values in literals.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid.join(counts, list(literals), "left").fillna(0, ["n"])


# Projections and filters.

@query
def select_rename(spark, d):
    return readers.select_renamed(standins.site_file(spark, d), schemas.SITE_COLUMNS).withColumn(
        "is_coastal", readers.coastal_flag(F.col("is_coastal"))
    )


@query
def drop_if_present(spark, d):
    return xco2_obs(spark, d).drop("city", "country", "population", "not_there")


@query
def date_parts(spark, d):
    return xco2_obs(spark, d).select("sounding_id", *[
        c.alias(n) for n, c in calendar_parts(F.col("datetime")).items()
    ])


@query
def drop_na(spark, d):
    return standins.city_year(spark, d).dropna(subset=["population"])


@query
def filter_not_null(spark, d):
    return sites(spark, d).filter(F.col("population").isNotNull()).select("target_name", "population", "coastal_km")


@query
def filter_eq(spark, d):
    return _labelled(spark, d).filter(F.col("season") == "Summer (North)").select("sounding_id", "season", "xco2")


@query
def filter_in(spark, d):
    cities = pipelines.with_upper_quartile_quadrant(standins.city_year(spark, d))
    return cities.filter(F.col("quadrant").isin("LOW_emissions_HIGH_conc", "HIGH_emissions_LOW_conc")).select(
        "city", "quadrant"
    )


# Joins and set operations.

@query
def left_join_dim(spark, d):
    joined = relational.attach_sites(xco2_obs(spark, d), sites(spark, d))
    return joined.select("sounding_id", "target_name", "xco2", "country", "population", "gdp_bil_usd", "coastal_km")


@query
def left_join_monthly(spark, d):
    return pipelines.monthly_pair(xco2_obs(spark, d), sif_obs(spark, d)).drop("latitude")


@query
def left_join_filtered(spark, d):
    place = sites(spark, d).select("target_name", "country", "population")
    return relational.join_present(
        xco2_obs(spark, d).select("sounding_id", "target_name", "xco2"), place, ["target_name"], "population"
    )


@query
def anti_missing_in_dim(spark, d):
    seen = table(spark, d, "lineitem").select(standins.site_name(F.col("l_partkey")).alias("target_name"))
    return relational.keys_only_in(seen, sites(spark, d), "target_name")


@query
def anti_missing_in_fact(spark, d):
    seen = table(spark, d, "events").select(standins.site_name(F.col("user_id")).alias("target_name"))
    return relational.keys_only_in(sites(spark, d), seen, "target_name")


@query
def join_match_count(spark, d):
    seen = table(spark, d, "lineitem").select(standins.site_name(F.col("l_partkey")).alias("target_name"))
    return relational.match_count(relational.attach_sites(seen, sites(spark, d)), "country")


@query
def union_by_name(spark, d):
    return relational.union_by_name(
        xco2_obs(spark, d).select("target_name", "datetime", "xco2"),
        sif_obs(spark, d).select("target_name", "datetime", "Daily_SIF_757nm"),
    )


@query
def except_keys(spark, d):
    seen = table(spark, d, "lineitem").select(standins.site_name(F.col("l_partkey")).alias("target_name"))
    return seen.subtract(sites(spark, d).select("target_name"))


@query
def distinct_labels(spark, d):
    return _labelled(spark, d).select("season", "time_of_day").distinct()


# Labels, dates and text.

@query
def labels_season(spark, d):
    return _labelled(spark, d).select("sounding_id", "latitude", "month", "season")


@query
def labels_time_of_day(spark, d):
    return _labelled(spark, d).select("sounding_id", "hour", "time_of_day")


@query
def parse_mixed_dates(spark, d):
    parsed = standins.no2_file(spark, d).select("date", parse_mixed_date(F.col("date")).alias("parsed"))
    return parsed.groupBy("date", "parsed").agg(F.count(F.lit(1)).alias("n"))


@query
def coastal_status(spark, d):
    return sites(spark, d).select("target_name", "coastal_km", labels.coastal_status(F.col("coastal_km")).alias("status"))


def _clean_text_query(spark, d):
    text = standins.sounding_text(spark, d)
    city, country = clean_text(F.col("city"), readers.UNKNOWN_CITY), clean_text(F.col("country"))
    return text.select(
        "sounding_id", city.alias("city"), country.alias("country"), composite_key(city, country).alias("city_key")
    )


QUERIES["clean_text"] = lambda spark, sf_dir: rounded(_clean_text_query(spark, sf_dir))


@query
def month_bins(spark, d):
    return _city_points(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("n_points"))


@query
def month_timeline(spark, d):
    return ranking.month_timeline(_city_points(spark, d))


@query
def timestamp_buckets(spark, d):
    return standins.cluster_points(spark, d).groupBy("datetime").agg(F.count(F.lit(1)).alias("n_points"))


# Statistics.

@query
def group_site_season_tod(spark, d):
    return pipelines.site_season_summary(xco2_obs(spark, d), sif_obs(spark, d), sites(spark, d))


@query
def first_by_time(spark, d):
    return pipelines.monthly_xco2(xco2_obs(spark, d)).select(*pipelines.MONTH_KEYS, "latitude")


@query
def median_by_group(spark, d):
    return quantiles.group_summary(_labelled(spark, d), ["season", "time_of_day"], [], {"xco2_median": ("xco2", 0.5)})


@query
def stddev_by_group(spark, d):
    return _labelled(spark, d).groupBy("target_name", "season").agg(F.stddev_samp("xco2").alias("xco2_std"))


@query
def count_non_missing(spark, d):
    return _labelled(spark, d).groupBy("season").agg(F.count("xco2").alias("xco2_n"), F.count(F.lit(1)).alias("n_rows"))


@query
def quartiles(spark, d):
    obs = sif_obs(spark, d).withColumn("season", labels.season(F.col("latitude"), F.month("datetime")))
    return quantiles.group_summary(
        obs, ["season"], [F.count(F.lit(1)).alias("n")],
        quantiles.quartiles_of("Daily_SIF_757nm", "sif") | {"sif_median": ("Daily_SIF_757nm", 0.5)},
    )


@query
def robust_range(spark, d):
    return summaries.robust_range(xco2_obs(spark, d), "xco2")


@query
def median_of_medians(spark, d):
    merged = cut_lineage(pipelines.monthly_merge(_no2(spark, d), xco2_obs(spark, d), sif_obs(spark, d)), "monthly")
    return pipelines.seasonal_medians(merged)


@query
def boxplot_stats(spark, d):
    return summaries.boxplot_stats(_impact(spark, d), "quadrant", "impact_iqr")


@query
def load_totals(spark, d):
    # Distinct counts over few months and clusters; both shrink in the partial aggregation.
    points = _city_points(spark, d).agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("month").alias("n_months")
    )
    clusters = _clustered(spark, d).agg(F.countDistinct("cluster_id").alias("n"))
    return points.withColumn("n_clusters", clusters.scalar())


@query
def iqr_norm(spark, d):
    return sites(spark, d).select("target_name", "population", "coastal_km").transform(
        scaling.iqr_norm({"pop_iqr": "population", "coast_iqr": "coastal_km"})
    )


@query
def impact_score(spark, d):
    return _impact(spark, d).select("city", "co2_conc_iqr", "co2_em_iqr", "impact_iqr")


@query
def iqr_zone(spark, d):
    return _impact(spark, d).select(
        "city", labels.iqr_zone(F.col("co2_conc_iqr")).alias("conc_zone"),
        labels.iqr_zone(F.col("co2_em_iqr")).alias("em_zone"),
    )


@query
def median_quadrant(spark, d):
    return pipelines.with_split_quadrant(_sounding_table(spark, d)).select(
        "target_name", "season", "time_of_day", "sif_iqr", "xco2_iqr", "quadrant", "coastal_status"
    )


@query
def q3_quadrant(spark, d):
    return pipelines.with_upper_quartile_quadrant(standins.city_year(spark, d)).select("city", "quadrant")


@query
def intensity(spark, d):
    obs = xco2_obs(spark, d).filter(F.col("xco2").isNotNull())
    ranged = quantiles.with_row(obs, summaries.robust_range(obs, "xco2"), "ends")
    return ranged.select("sounding_id", rescale(F.col("xco2"), F.col("ends.low"), F.col("ends.high")).alias("intensity"))


@query
def city_month_mean(spark, d):
    return pipelines.city_month_series(_city_points(spark, d))


@query
def chart_range(spark, d):
    return summaries.series_extent(pipelines.city_month_series(_city_points(spark, d)), "city_key")


@query
def scatter_frame(spark, d):
    return _impact(spark, d).select(
        "city", "co2_em_iqr", "co2_conc_iqr", "quadrant", (F.col("population") / 1e6).alias("population_m"),
        labels.coast_shape(readers.coastal_flag(F.col("is_coastal"))).alias("shape"),
        F.when(F.col("quadrant").isin("LOW_emissions_HIGH_conc", "HIGH_emissions_LOW_conc"), F.col("city")).alias("label"),
    )


# Ranking.

ROW_KEYS = ("target_name", "season", "time_of_day")


def _extremes(table: DataFrame) -> DataFrame:
    score = F.abs("sif_iqr") + F.abs("xco2_iqr")
    return ranking.top_k(table, ["quadrant"], score, 6, ROW_KEYS)


@query
def topk_extremes(spark, d):
    table = pipelines.with_split_quadrant(_sounding_table(spark, d))
    return _extremes(table).select(*ROW_KEYS, "quadrant", "sif_iqr", "xco2_iqr", "rank")


@query
def extremes_frame(spark, d):
    table = pipelines.with_split_quadrant(_sounding_table(spark, d))
    # Six rows for each of five quadrants (missing is one): safe to broadcast.
    extremes = F.broadcast(_extremes(table).select(*ROW_KEYS, F.col("rank").alias("extreme_rank")))
    return quantiles.keyed_join(table, extremes, ROW_KEYS, "left").select(
        *ROW_KEYS, "sif_iqr", "xco2_iqr", (F.col("population") / 1e6).alias("population_m"), "coastal_status",
        F.when(F.col("extreme_rank").isNotNull(), F.col("quadrant")).alias("highlight"),
        F.when(F.col("extreme_rank").isNotNull(), F.col("city")).alias("label"),
    )


@query
def reorder_levels(spark, d):
    return ranking.ordered_levels(_impact(spark, d), "quadrant", "impact_iqr")


@query
def systematic_sample(spark, d):
    points = _city_points(spark, d).select("sounding_id", "month", "latitude", "longitude", "xco2")
    # The test tables hold fewer points per month than the usual 12000; the size is a parameter.
    return ranking.systematic_sample(points, "month", "sounding_id", n=100)


@query
def factor_levels(spark, d):
    return ranking.factor_levels(_labelled(spark, d), "season")


# Geospatial.

@query
def proximity_pairs(spark, d):
    return geo.proximity_links(standins.cluster_points(spark, d), "datetime", "point_id")


@query
def spatial_clusters(spark, d):
    return _clustered(spark, d).select("point_id", "cluster_id")


@query
def cluster_stats(spark, d):
    return geo.cluster_stats(_clustered(spark, d), "datetime", "point_id", "xco2")


@query
def cluster_members(spark, d):
    clustered = _clustered(spark, d)
    return geo.cluster_members(clustered, geo.cluster_stats(clustered, "datetime", "point_id", "xco2")).select(
        "point_id", "cluster_id", "cluster_key", "n_points", "mean_val"
    )


@query
def local_intensity(spark, d):
    clustered = _clustered(spark, d)
    members = geo.cluster_members(clustered, geo.cluster_stats(clustered, "datetime", "point_id", "xco2"))
    return members.select(
        "point_id", "cluster_id", rescale(F.col("xco2"), F.col("local_min"), F.col("local_max")).alias("local_intensity")
    )


@query
def cluster_bbox(spark, d):
    return summaries.bounding_box(_clustered(spark, d), "cluster_id")


@query
def nearest_within(spark, d):
    key = F.col("c_custkey")
    probes = table(spark, d, "customer").select(
        key.alias("probe_id"), ((key * 53) % 280 / 10 - 14).alias("latitude"), ((key * 97) % 275 / 10).alias("longitude")
    )
    return geo.nearest_within(probes, standins.cluster_points(spark, d), RADIUS, "probe_id", "point_id")


@query
def sphere_xyz(spark, d):
    place = table(spark, d, "customer").select(
        "c_custkey", standins.site_latitude(F.col("c_custkey")).alias("lat"),
        standins.site_longitude(F.col("c_custkey")).alias("lon"),
    )
    return place.select("c_custkey", *[c.alias(n) for n, c in geo.sphere_xyz(F.col("lat"), F.col("lon"), 210.0).items()])


# Regression.

INFERENCE = ("term", "estimate", "std_error", "statistic", "p_value")


@query
def ols_global(spark, d):
    return regression.fit(_impact(spark, d), "impact_iqr", pipelines.IMPACT_PREDICTORS).coefficients().select(*INFERENCE)


@query
def ols_tidy(spark, d):
    tidy = regression.fit(_impact(spark, d), "impact_iqr", pipelines.IMPACT_PREDICTORS).coefficients()
    shown = tidy.filter(F.col("term") != regression.INTERCEPT).select(
        labels.recode(F.col("term"), TERM_NAMES).alias("term"), "estimate", "std_error", "statistic", "p_value",
        "conf_low", "conf_high", (F.col("p_value") < 0.20).alias("p_below_020"),
    )
    # One row per term of the model reaches the single-partition window.
    place = F.row_number().over(ranking.Window.orderBy("estimate", "term")).cast("bigint")
    return shown.withColumn("position", place)


@query
def ols_fit(spark, d):
    return regression.fit(_impact(spark, d), "impact_iqr", pipelines.IMPACT_PREDICTORS).fit_statistics()


@query
def ols_by_season(spark, d):
    return regression.fit(_sounding_table(spark, d), "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"]).coefficients().select(
        "season", *INFERENCE
    )


@query
def ols_interaction(spark, d):
    fitted = regression.fit(_sounding_table(spark, d), "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"])
    return fitted.with_interaction()[0].select(*INFERENCE)


@query
def ols_interaction_fit(spark, d):
    fitted = regression.fit(_sounding_table(spark, d), "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"])
    return fitted.with_interaction()[1]


@query_raw_units
def ols_summer_north(spark, d):
    summer = _sounding_table(spark, d).filter(F.col("season") == "Summer (North)")
    return regression.fit(summer, "xco2_median", pipelines.RAW_PREDICTORS).coefficients().select(*INFERENCE)


@query_raw_units
def ols_by_season_no2(spark, d):
    return regression.fit(_monthly_table(spark, d), "xco2_median", pipelines.NO2_PREDICTORS, ["season"]).coefficients().select(
        "season", *INFERENCE
    )


@query
def ols_na_rows(spark, d):
    fitted = regression.fit(_sounding_table(spark, d), "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"])
    return fitted.fit_statistics().select("season", "n", "n_dropped", "df_residual")


@query
def ols_residuals(spark, d):
    table = _sounding_table(spark, d)
    return regression.fit(table, "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"]).residual_summary(table)


@query
def ols_collinear(spark, d):
    table = _impact(spark, d).withColumn("twice_sif", 2 * F.col("sif_iqr") - F.col("gdp_iqr"))
    fitted = regression.fit(table, "impact_iqr", ["sif_iqr", "gdp_iqr", "twice_sif", "coast_iqr"])
    return fitted.coefficients().select(*INFERENCE)


@query
def trend_line(spark, d):
    band = regression.trend_band(_impact(spark, d), "coastal_km", "impact_iqr", "quadrant")
    return band.select("quadrant", "step", "n", "slope", "intercept", "r_squared", "x", "fitted")


@query
def trend_band(spark, d):
    return regression.trend_band(_impact(spark, d), "coastal_km", "impact_iqr", "quadrant")


def _season_fit(spark: SparkSession, d: str) -> regression.LinearFit:
    return regression.fit(_sounding_table(spark, d), "xco2_iqr", pipelines.SEASON_PREDICTORS, ["season"])


@query
def season_report(spark, d):
    stats = _season_fit(spark, d).fit_statistics()
    return stats.select(
        "season", F.substring("season", 1, 10).alias("short_season"), labels.hemisphere(F.col("season")).alias("hemisphere"),
        "r_squared", "p_value", negative_log10(F.col("p_value")).alias("neg_log10_p"),
        F.when(F.col("p_value") < 0.05, "Sig").otherwise("Not Sig").alias("significance"),
    )


@query
def coef_compare(spark, d):
    tidy = _season_fit(spark, d).coefficients()
    wide = tidy.groupBy("season").pivot("term", ["sif_iqr", "coast_iqr"]).agg(F.first("estimate"))
    return wide.select(
        "season", F.col("sif_iqr").alias("sif_coef"), F.col("coast_iqr").alias("coast_coef"),
        labels.hemisphere(F.col("season")).alias("hemisphere"),
    )


@query
def significance_grid(spark, d):
    tidy = _season_fit(spark, d).coefficients().filter(F.col("term").isin(*GRID_TERMS))
    return tidy.select(
        "season", labels.recode(F.col("term"), GRID_TERMS).alias("predictor"),
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
    )


# Streaming.

@query
def stream_ingest(spark, d):
    target, checkpoint = ingest.scratch_pair(spark, "ingested")
    ingest.ingest_available(ingest.text_stream(spark, _text_folder(spark, d), TEXT_STREAM, 2), target, checkpoint)
    return spark.read.parquet(target)


@query
def stream_city_month(spark, d):
    target, checkpoint = ingest.scratch_pair(spark, "city-month")
    stream = ingest.text_stream(spark, _text_folder(spark, d), TEXT_STREAM)
    ingest.upsert_available(ingest.city_month_running(stream), target, checkpoint)
    return ingest.latest(spark, target)


# Committed batches and event time.

@query
def sink_snapshots(spark, d):
    sink = SnapshotTable(spark, scratch_path(spark, "sink"))
    points = _city_points(spark, d).select("sounding_id", "city_key", "xco2", "month")
    for batch in range(3):
        rows = points.filter(F.col("sounding_id") % 3 == batch)
        if batch == 1:
            sink._write(rows, batch, ["month"])  # an attempt that was cut off before its commit
        sink.append(rows, batch, ["month"])
        sink.append(rows, batch, ["month"])  # a writer that starts again
        if batch == 1:
            sink.compact(lambda kept: kept, ["month"])
    # Cents are added up exactly.
    total = F.sum(F.col("xco2").cast("decimal(18,2)")).cast("double").alias("total")
    return sink.read().groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), total)


def _delivered_months(spark: SparkSession, d: str) -> str:
    """The text soundings in four deliveries of twenty months, some a delivery late; the folder of the months made of them."""
    folder, target, checkpoint = (scratch_path(spark, f"delivered-{x}") for x in ("text", "months", "checkpoint"))
    number = lambda at, n: F.substring("datetime", at, n).try_cast("int")
    since = F.coalesce((number(1, 4) - 1995) * 12 + number(6, 2) - 1, F.lit(0))
    delivery = F.least(F.lit(3), F.floor(since / 20) + F.when(F.col("sounding_id") % 13 == 0, 1).otherwise(0))
    text = cut_lineage(standins.sounding_text(spark, d).withColumn("delivery", delivery), "deliveries")
    for k in range(4):
        text.filter(F.col("delivery") == k).drop("delivery").write.mode("append").option("header", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
        stream = ingest.text_stream(spark, folder, TEXT_STREAM, 1_000_000)
        event_time.months_available(stream, target, checkpoint, delay_days=400)
    return target


@query
def stream_event_time(spark, d):
    return event_time.month_means(spark, _delivered_months(spark, d))


@query
def stream_late_rows(spark, d):
    return event_time.late_rows(spark, _delivered_months(spark, d)).groupBy("month", "batch").agg(
        F.count(F.lit(1)).alias("n_late"))


# Sketches.

@query
def quantiles_sketched(spark, d):
    """Sketches of two batches, merged; each quantile is held against its exact rank."""
    soundings = _labelled(spark, d).select("sounding_id", "season", "xco2")
    batches = [soundings.filter(F.col("sounding_id") % 2 == k) for k in range(2)]
    parts = [sketches.quantile_sketches(b, ["season"], ["xco2"]) for b in batches]
    merged = cut_lineage(sketches.merged_quantile_sketches(parts[0].unionByName(parts[1]), ["season"], ["xco2"]), "sketches")
    ps = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    found = sketches.quantiles_of(merged, ["season"], {n: ("xco2", p) for n, p in ps.items()})
    long = found.select("season", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(n).alias("value")) for n, p in ps.items()])).alias("x")).select("season", "x.*")
    ranked = soundings.filter(F.col("xco2").isNotNull()).join(F.broadcast(long), "season").groupBy("season", "p").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("xco2") < F.col("value")).alias("below"),
        F.count_if(F.col("xco2") <= F.col("value")).alias("upto"))
    error = F.lit(sketches.RANK_ERROR)
    within = (F.col("below") / F.col("n") <= F.col("p") + error) & (F.col("upto") / F.col("n") >= F.col("p") - error)
    return ranked.select("season", "p", "n", within.alias("within_bound"))


@query
def distinct_sketched(spark, d):
    """Sites per month, and over all months from the merged sketches, held against the exact numbers."""
    soundings = xco2_obs(spark, d).select(month_start(F.col("datetime")).alias("month"), "target_name")
    months = cut_lineage(sketches.distinct_sketches(soundings, ["month"], "target_name"), "month-sketches")
    total = sketches.merged_distinct(months, []).withColumn("month", F.lit(None).cast("date"))
    found = sketches.distinct_counts(months.unionByName(total))
    # Few months, and one total.
    exact = soundings.groupBy("month").agg(F.countDistinct("target_name").alias("n_sites")).unionByName(
        soundings.agg(F.lit(None).cast("date").alias("month"), F.countDistinct("target_name").alias("n_sites")))
    off = F.abs(F.col("n_distinct") - F.col("n_sites"))
    return quantiles.keyed_join(exact, found, ["month"]).select(
        "month", "n_sites", (off <= F.col("n_sites") * sketches.distinct_error()).alias("within_bound"))


# Joins and sums along time.

@query
def asof_sif(spark, d):
    left = xco2_obs(spark, d).select("sounding_id", "target_name", "datetime")
    return temporal.asof_join(left, sif_obs(spark, d), ["target_name"], "datetime", ["Daily_SIF_757nm"])


@query
def interval_soundings(spark, d):
    spans = standins.observation_windows(spark, d)
    points = xco2_obs(spark, d).select("target_name", "sounding_id", "datetime", F.col("xco2").cast("decimal(18,2)").alias("xco2"))
    pairs = temporal.interval_join(points, spans, ["target_name"], "datetime", "opens", "closes")
    return pairs.groupBy("target_name").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("sounding_id").alias("n_soundings"), F.sum("xco2").cast("double").alias("total"))


@query
def running_city_mean(spark, d):
    points = _city_points(spark, d).select("sounding_id", "city_key", "datetime", F.col("xco2").cast("decimal(18,2)").alias("xco2"))
    found = temporal.running(points, ["city_key"], ["datetime", "sounding_id"], "xco2")
    return found.select("sounding_id", "city_key", "n_running", F.col("sum_running").cast("double").alias("sum_running"), F.col("previous").cast("double").alias("previous"))


@query
def rollup_moments(spark, d):
    rows = _labelled(spark, d).select(
        labels.hemisphere(F.col("season")).alias("hemisphere"), "season", "city",
        F.floor(F.col("xco2") / 1000).cast("double").alias("thousands"))
    return rollups.rollup_moments(rows, ["hemisphere", "season", "city"], "thousands")


# Table functions and attributes.

@query
def trend_grid(spark, d):
    tables.register_table_functions(spark)
    band = regression.trend_band(_impact(spark, d), "coastal_km", "impact_iqr", "quadrant")
    lines = band.groupBy("quadrant").agg(
        F.min("intercept").alias("intercept"), F.min("slope").alias("slope"), F.min("x").alias("low"), F.max("x").alias("high"))
    lines = lines.select("quadrant", "intercept", "slope", "low", "high")
    return spark.sql("SELECT line AS quadrant, step, x, fitted FROM trend_grid(TABLE(SELECT * FROM {lines}), 80)", lines=lines)


@query
def props_attributes(spark, d):
    return attributes.with_attributes(standins.event_props(spark, d), "props", "k bigint").select("event_id", "k", "rejected")
