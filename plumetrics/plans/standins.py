"""The benchmark tables read as sites, soundings and monthly NO2, as FIXTURES.md describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumetrics.sources.readers import nan_as_null

# Declared, so that no query spends a job on reading file footers first.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_as_null(spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet"))


def site_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def site_latitude(key: Column) -> Column:
    return (key * 53) % 1400 / 10 - 70


def site_longitude(key: Column) -> Column:
    return (key * 97) % 3600 / 10 - 180


def city_name(key: Column) -> Column:
    """Some soundings carry no city."""
    return F.when(key % 50 != 0, F.concat(F.lit("City "), (key % 200).cast("string")))


def country_name(key: Column) -> Column:
    return F.concat(F.lit("Country "), (key % 25).cast("string"))


def site_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites under the header names of the site file."""
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_name").alias("Target.Name"),
            F.concat(F.lit("POINT ("), site_longitude(key), F.lit(" "), site_latitude(key), F.lit(")"))
            .alias("Site.Center.WKT"),
            F.concat(F.lit("SHAPE, "), key.cast("string")).alias("Site.Shape.WKT"),
            city_name(key).alias("city"), F.col("n_name").alias("country"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("population"),
            (50 + (key * 37) % 1000).cast("double").alias("gdp_bil_usd"),
            ((key * 13) % 300).cast("double").alias("coastal_km"),
            F.when((key * 13) % 300 < 50, "True").otherwise("False").alias("is_coastal"),
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = {"Target.Name": "target_name", "Site.Center.WKT": "wkt_center", "Site.Shape.WKT": "wkt_shape"}
    return site_file(spark, sf_dir).withColumnsRenamed(renamed)


def xco2_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("sounding_id"), site_name(key).alias("target_name"), F.col("o_orderdate").alias("datetime"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(order % 24).cast("int"))).alias("local_time"),
        site_latitude(key).alias("latitude"), site_longitude(key).alias("longitude"),
        F.when(order % 97 != 0, F.col("o_totalprice")).alias("xco2"),
        city_name(key).alias("city"), country_name(key).alias("country"),
        F.lit(None).cast("double").alias("population"), F.col("o_orderpriority").alias("source_file"),
    )


def _shipped(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *columns).join(owners, "l_orderkey")


def sif_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    hour = (F.col("l_orderkey") % 24).cast("int")
    return _shipped(spark, sf_dir, "l_shipdate", "l_extendedprice").select(
        site_name(key).alias("target_name"), F.col("l_shipdate").alias("datetime"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=hour)).alias("local_time"),
        site_latitude(key).alias("latitude"), (F.col("l_extendedprice") / 100000).alias("Daily_SIF_757nm"),
    )


def no2_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NO2 rows with dates written in five ways."""
    # Formatting goes through the session's zone; at noon no zone changes the day.
    ts = F.col("l_shipdate") + F.make_dt_interval(hours=F.lit(12))
    styles = ["yyyy-MM-dd", "MM/dd/yyyy", None, "yyyy-MM", "MM/yyyy"]
    which = F.col("l_orderkey") % 5
    date = F.when(which == 0, F.date_format(ts, styles[0])).when(which == 1, F.date_format(ts, styles[1]))
    # Day first is only certain when the day is above twelve.
    date = date.when((which == 2) & (F.dayofmonth(ts) > 12), F.date_format(ts, "dd-MM-yyyy"))
    date = date.when(which == 2, F.date_format(ts, "yyyyMMdd"))
    date = date.when(which == 3, F.date_format(ts, styles[3])).otherwise(F.date_format(ts, styles[4]))
    # The sites are joined to the orders, of which there are far fewer than rows.
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), site_name(F.col("o_custkey")).alias("Target.Name")
    ).join(site_file(spark, sf_dir), "Target.Name")
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_tax").alias("mean"), date.alias("date"))
    where = F.substring_index
    return shipped.join(owners, "l_orderkey").select(
        "`Target.Name`", F.col("`Site.Center.WKT`").alias(".geo"), "`Site.Shape.WKT`",
        where(where("`Site.Center.WKT`", " ", -1), ")", 1).cast("double").alias("lat"),
        where(where("`Site.Center.WKT`", "(", -1), " ", 1).cast("double").alias("lon"),
        "city", "country", "population", "gdp_bil_usd", "coastal_km", "is_coastal", "mean", "date",
    )


def city_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per city with the attributes of the impact score."""
    key = F.col("c_custkey")
    soundings = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.avg("o_totalprice") / 1000).alias("xco2_ppm"), F.count(F.lit(1)).alias("xco2_numsams")
    )
    rich = F.col("c_acctbal") > 0
    return (
        table(spark, sf_dir, "customer").join(soundings, key == F.col("o_custkey"), "left")
        .select(
            F.col("c_name").alias("city"), "xco2_ppm", ((key * 17) % 500 / 1000).alias("sif_757nm"),
            F.when(rich, F.col("c_acctbal")).alias("population"),
            (50 + (key * 37) % 1000).cast("double").alias("gdp_bil_usd"),
            F.when(rich, 10 + (key * 29) % 701 / 10).alias("annual_co2_em_mtco2"),
            F.coalesce("xco2_numsams", F.lit(0)).alias("xco2_numsams"),
            ((key * 7) % 41).alias("sif_numsams"), ((key * 13) % 300).cast("double").alias("coastal_km"),
            F.when((key * 13) % 300 < 50, "True").otherwise("False").alias("is_coastal"),
        )
    )


def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as soundings; a timestamp is a day."""
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("point_id"), F.col("ts").cast("date").cast("timestamp_ntz").alias("datetime"),
        ((user % 15) * 2 - 14 + (event % 9) * 0.05).alias("latitude"),
        ((user % 10) * 3 + (event % 11) * 0.05).alias("longitude"),
        F.col("value").alias("xco2"), F.concat(F.lit("City "), (user % 40).cast("string")).alias("city"),
        country_name(user).alias("country"),
    )


def sounding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soundings as text, with blanks, junk and two ways to write a time."""
    k = F.col("sounding_id")
    clock = F.col("local_time").cast("string")
    iso = F.replace(clock, F.lit(" "), F.lit("T"))
    stamp = F.when(k % 31 == 0, "soon").when(k % 3 == 0, F.concat(iso, F.lit("Z"))).when(
        k % 3 == 1, F.concat(iso, F.lit("+05:30"))
    ).otherwise(clock)
    return xco2_obs(spark, sf_dir).select(
        k, stamp.alias("datetime"), F.substring(clock, 12, 5).alias("local_time"),
        F.when(k % 29 == 0, "").otherwise(F.format_string("%.1f", "latitude")).alias("latitude"),
        F.when(k % 37 == 0, "NaN").otherwise(F.format_string(" %.1f", "longitude")).alias("longitude"),
        F.when(k % 41 == 0, "Infinity").when(k % 43 == 0, F.format_string("%.2fppm", "xco2"))
        .otherwise(F.format_string("%.2f", "xco2")).alias("xco2"),
        F.when(k % 7 == 0, "   ").otherwise(F.concat(F.lit(" "), "city")).alias("city"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("country")).alias("country"),
        F.when(k % 5 == 0, "n/a").otherwise((k * 3).cast("string")).alias("population"),
        "target_name", "source_file",
    )


def observation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as windows in which a site is observed, 10 to 500 days long."""
    days = F.make_dt_interval(days=(F.col("l_quantity") * 10).cast("int"))
    return _shipped(spark, sf_dir, "l_shipdate", "l_quantity").select(
        site_name(F.col("o_custkey")).alias("target_name"), F.col("l_shipdate").alias("opens"), (F.col("l_shipdate") + days).alias("closes"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of events as JSON; some texts are cut off, some hold another type, another shape or nothing."""
    k = F.col("event_id")
    props = F.when(k % 13 == 0, F.expr("left(props, length(props) - 1)")).when(k % 17 == 0, F.lit('{"k": "many"}')).when(
        k % 19 == 0, F.lit("[1]")).when(k % 23 == 0, F.lit("{}")).when(k % 29 != 0, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", props.alias("props"))
