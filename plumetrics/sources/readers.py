"""Scans of CSV and Parquet files, column selection, the tolerant ingest gate and schema reports."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.functions.dates import month_start
from plumetrics.functions.scalars import clean_text, composite_key, finite_or_null, is_finite, parse_number, parse_time

UNKNOWN_CITY = "Unknown"
HEADERS_AT_A_TIME = 32
PATTERN_SIGNS = re.compile(r"[*?\[\]{}\\]")


def clean_header(names: Iterable[str]) -> list[str]:
    """Header names with every character outside letters, digits, dot and underscore turned into a dot."""
    seen: dict[str, int] = {}
    cleaned = []
    for name in names:
        plain = re.sub(r"[^0-9A-Za-z._]", ".", name.strip())
        if not re.match(r"[A-Za-z]|[.](?![0-9])", plain):
            plain = f"X{plain}"
        copies = seen.get(plain, 0)
        seen[plain] = copies + 1
        cleaned.append(f"{plain}.{copies}" if copies else plain)
    return cleaned


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV matched to ``schema`` by cleaned header name; blank, NA or unreadable values are NULL.

    ``path`` is a file, a folder or a pattern. Its files may have their columns in any order, and further columns:
    files of one header are one scan, and the scans are united by name. A file that lacks a column of ``schema`` is an
    error; files without a header line hold no rows.
    """
    scans, base = [], _base_path(spark, path)
    for files in headers_of(spark, path).values():
        raw = _csv_reader(spark, base).csv(files)
        raw = raw.toDF(*clean_header(raw.columns))
        missing = [n for n in schema.names if n not in raw.columns]
        if missing:
            raise ValueError(f"missing columns {missing} in {files[0]}; found {raw.columns}")
        scans.append(raw.select(*[_typed(f).alias(f.name) for f in schema.fields]))
    if not scans:
        raise ValueError(f"missing columns {schema.names}; no file with a header in {path}")
    return reduce(DataFrame.unionByName, scans)


def headers_of(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by the cleaned names of their header; empty files are left out.

    Only the first line of a file is read, by a one-task job each; some tens of them run at a time.
    """
    files = _files(spark, path)
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_A_TIME) as pool:
        for file, header in zip(files, pool.map(lambda f: _csv_reader(spark).csv(f).columns, files)):
            if header:
                found.setdefault(tuple(clean_header(header)), []).append(file)
    return found


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files below ``path``, as path patterns that name one file each."""
    return sorted(PATTERN_SIGNS.sub(lambda m: "\\" + m[0], unquote(f)) for f in spark.read.text(path).inputFiles())


def _base_path(spark: SparkSession, path: str) -> str | None:
    """``path`` if it is a folder: partition columns of files below it are then kept when they are read one by one."""
    files = _files(spark, path)
    single = len(files) == 1 and files[0].endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
    return None if single or PATTERN_SIGNS.search(path) else path


def _csv_reader(spark: SparkSession, base: str | None = None) -> DataFrameReader:
    reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
    return reader.option("basePath", base) if base else reader


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV whose header must name the columns of ``schema`` in this order; another header is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _typed(field: T.StructField) -> Column:
    text = F.nullif(F.col(f"`{field.name}`").cast("string"), F.lit("NA"))
    if isinstance(field.dataType, T.StringType):
        return text
    typed = F.trim(text).try_cast(field.dataType)
    return F.when(~F.isnan(typed), typed) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else typed


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan with NaN turned into NULL; only the wanted columns are read."""
    df = spark.read.parquet(path)
    return nan_as_null(df.select(*columns) if columns else df)


def nan_as_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def select_renamed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns under new names; ``columns`` maps output name to input name."""
    require_columns(df, columns.values())
    return df.select(*[F.col(f"`{source}`").alias(out) for out, source in columns.items()])


def coastal_flag(text: Column) -> Column:
    """"True"/"False" text to boolean."""
    return F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)


def parse_soundings(text: DataFrame) -> DataFrame:
    """All text rows with parsed values and ``valid``: position, value and time are all finite."""
    parsed = text.withColumns({
        "lat_text": parse_number(F.col("latitude")), "lon_text": parse_number(F.col("longitude")),
        "value": parse_number(F.col("xco2")), "t": parse_time(F.col("datetime")),
        "pop": parse_number(F.col("population")),
    })
    valid = is_finite(F.col("lat_text")) & is_finite(F.col("lon_text")) & is_finite(F.col("value"))
    return parsed.withColumn("valid", F.coalesce(valid & F.col("t").isNotNull(), F.lit(False)))


def ingest_gate(text: DataFrame) -> DataFrame:
    """Typed soundings; rows without finite position, value and time are rejected."""
    extra = [c for c in text.columns if c not in SOUNDING_NAMES]
    city, country = clean_text(F.col("city"), UNKNOWN_CITY), clean_text(F.col("country"))
    # Named first, so that each is cleaned once and not again for the key.
    named = parse_soundings(text).filter("valid").withColumns({"_city": city, "_country": country})
    city, country = F.col("_city"), F.col("_country")
    return named.select(
        *extra,
        F.col("lat_text").alias("latitude"), F.col("lon_text").alias("longitude"), F.col("value").alias("xco2"),
        F.col("t").alias("datetime"), month_start(F.col("t")).alias("month"),
        clean_text(F.col("datetime")).alias("datetime_text"), clean_text(F.col("local_time")).alias("local_time"),
        city.alias("city"), country.alias("country"), composite_key(city, country).alias("city_key"),
        finite_or_null(F.col("pop")).alias("population"),
        clean_text(F.col("target_name")).alias("target_name"), clean_text(F.col("source_file")).alias("source_file"),
    )


SOUNDING_NAMES = ("datetime", "local_time", "latitude", "longitude", "xco2", "city", "country", "population",
                  "target_name", "source_file")


def ingest_tally(text: DataFrame) -> DataFrame:
    """Rows read, rows accepted and rows rejected."""
    return parse_soundings(text).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_rejected"),
    )


def schema_report(df: DataFrame, table: str) -> DataFrame:
    """One row per column of ``df``: position, name and number of present values."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"),
                 F.col(f"`{c}`").alias("n_present"))
        for i, c in enumerate(df.columns)
    ])
    return counts.select(F.explode(rows).alias("r")).select(F.lit(table).alias("table_name"), "r.*")
