"""Declared schemas of the input tables. Text files are matched to them by header name."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, NUMBER, WHOLE = T.StringType(), T.DoubleType(), T.LongType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CITY_YEAR = _schema(
    city=TEXT, xco2_ppm=NUMBER, sif_757nm=NUMBER, population=NUMBER, gdp_bil_usd=NUMBER, annual_co2_em_mtco2=NUMBER,
    xco2_numsams=WHOLE, sif_numsams=WHOLE, coastal_km=NUMBER, is_coastal=TEXT,
)
PLACE = dict(city=TEXT, country=TEXT, population=NUMBER, gdp_bil_usd=NUMBER, coastal_km=NUMBER, is_coastal=TEXT)
SITE_FILE = _schema(**{"Target.Name": TEXT, "Site.Center.WKT": TEXT, "Site.Shape.WKT": TEXT}, **PLACE)
NO2_FILE = _schema(
    **{"Target.Name": TEXT, ".geo": TEXT, "Site.Shape.WKT": TEXT}, lat=NUMBER, lon=NUMBER, **PLACE, mean=NUMBER, date=TEXT
)
# The text form of soundings: everything is read as text, then passes the gate.
SOUNDING_TEXT = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("datetime", "local_time", "latitude", "longitude", "xco2", "city", "country", "population",
                 "target_name", "source_file")
])

# Output name -> header name.
SITE_COLUMNS = {
    "target_name": "Target.Name", "wkt_center": "Site.Center.WKT", "wkt_shape": "Site.Shape.WKT",
    "city": "city", "country": "country", "population": "population", "gdp_bil_usd": "gdp_bil_usd",
    "coastal_km": "coastal_km", "is_coastal": "is_coastal",
}
NO2_COLUMNS = {
    "target_name": "Target.Name", "wkt_center": ".geo", "wkt_shape": "Site.Shape.WKT", "latitude": "lat",
    "longitude": "lon", "city": "city", "country": "country", "population": "population",
    "gdp_bil_usd": "gdp_bil_usd", "coastal_km": "coastal_km", "is_coastal": "is_coastal", "no2": "mean",
    "date": "date",
}
