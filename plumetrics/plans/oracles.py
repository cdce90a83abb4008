"""The registered queries as plain SQL for an independent engine, written from the definitions.

Only building blocks are shared between statements: the stand-in tables as named subqueries, and a generator
for least squares by elimination.
"""

from __future__ import annotations

import math

from plumetrics.plans.pipelines import (
    IMPACT_PREDICTORS, IMPACT_SCALING, MONTHLY_SCALING, NO2_PREDICTORS, RAW_PREDICTORS, SEASON_PREDICTORS,
    SEASON_SCALING,
)

# Columns whose values have seven or more exact decimals; six would round on exact halves.
FINE = {"Daily_SIF_757nm": 9, "sif_median": 9, "sif_std": 9, "sif_q1": 9, "sif_q3": 9, "xco2_ppm": 9}

SITE_NAME = "printf('Customer#%09d', {})"


def _lat(k: str) -> str:
    return f"(({k} * 53) % 1400 / 10 - 70)"


def _lon(k: str) -> str:
    return f"(({k} * 97) % 3600 / 10 - 180)"


def _city(k: str) -> str:
    return f"CASE WHEN {k} % 50 <> 0 THEN 'City ' || ({k} % 200) END"


def _season(lat: str, month: str) -> str:
    north, south = f"{lat} > 20 AND {lat} <= 60", f"{lat} >= -60 AND {lat} < -20"
    quarters = [("(12, 1, 2)", "Winter", "Summer"), ("(3, 4, 5)", "Spring", "Autumn"),
                ("(6, 7, 8)", "Summer", "Winter"), ("(9, 10, 11)", "Autumn", "Spring")]
    text = f"CASE WHEN {lat} BETWEEN -20 AND 20 AND {month} BETWEEN 5 AND 10 THEN 'Tropical Wet' " \
           f"WHEN {lat} BETWEEN -20 AND 20 THEN 'Tropical Dry' "
    for months, up, down in quarters:
        text += f"WHEN {north} AND {month} IN {months} THEN '{up} (North)' "
        text += f"WHEN {south} AND {month} IN {months} THEN '{down} (South)' "
    return text + "ELSE 'Other' END"


def _tod(hour: str) -> str:
    return f"CASE WHEN {hour} < 6 THEN 'Night' WHEN {hour} < 12 THEN 'Morning' " \
           f"WHEN {hour} < 18 THEN 'Afternoon' ELSE 'Evening' END"


def _hemisphere(season: str) -> str:
    return f"CASE WHEN {season} LIKE '%(North)' THEN 'North' WHEN {season} LIKE '%(South)' THEN 'South' " \
           f"WHEN {season} LIKE 'Tropical%' THEN 'Tropical' END"


def _r(expr: str, name: str | None = None, digits: int = 6) -> str:
    digits = FINE.get(name or expr.split(".")[-1], digits)
    return f"round({expr}, {digits}) + 0.0 AS {name or expr.split('.')[-1]}"


def _scaled(source: str, scaling: dict[str, str]) -> str:
    """SELECT list and FROM of an IQR-scaled table."""
    columns = sorted(set(scaling.values()))
    q = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in columns)
    cells = ", ".join(f"(t.{c} - q.{c}_q1) / nullif(q.{c}_q3 - q.{c}_q1, 0) AS {out}" for out, c in scaling.items())
    return f"SELECT t.*, {cells} FROM {source} t, (SELECT {q} FROM {source}) q"


SITE = f"""SELECT c_name AS target_name, 'POINT (' || {_lon('c_custkey')} || ' ' || {_lat('c_custkey')} || ')' AS wkt_center,
    'SHAPE, ' || c_custkey AS wkt_shape, {_city('c_custkey')} AS city, n_name AS country,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS population, (50 + (c_custkey * 37) % 1000)::DOUBLE AS gdp_bil_usd,
    ((c_custkey * 13) % 300)::DOUBLE AS coastal_km, (c_custkey * 13) % 300 < 50 AS is_coastal,
    {_lat('c_custkey')} AS latitude, {_lon('c_custkey')} AS longitude
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

XCO2 = f"""SELECT o_orderkey AS sounding_id, {SITE_NAME.format('o_custkey')} AS target_name, o_orderdate AS datetime,
    o_orderdate + to_hours((o_orderkey % 24)::INT) AS local_time, {_lat('o_custkey')} AS latitude,
    {_lon('o_custkey')} AS longitude, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS xco2,
    {_city('o_custkey')} AS city, 'Country ' || (o_custkey % 25) AS country, o_orderpriority AS source_file
    FROM orders"""

SIF = f"""SELECT {SITE_NAME.format('o_custkey')} AS target_name, l_shipdate AS datetime,
    l_shipdate + to_hours((l_orderkey % 24)::INT) AS local_time, {_lat('o_custkey')} AS latitude,
    l_extendedprice / 100000 AS Daily_SIF_757nm FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

NO2 = f"""SELECT {SITE_NAME.format('o_custkey')} AS target_name, l_tax AS no2, l_shipdate AS shipped, CASE l_orderkey % 5
    WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y')
    WHEN 2 THEN CASE WHEN day(l_shipdate) > 12 THEN strftime(l_shipdate, '%d-%m-%Y') ELSE strftime(l_shipdate, '%Y%m%d') END
    WHEN 3 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%m/%Y') END AS date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey"""

CITY_YEAR = """SELECT c_name AS city, xco2_ppm, (c_custkey * 17) % 500 / 1000 AS sif_757nm,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS population, (50 + (c_custkey * 37) % 1000)::DOUBLE AS gdp_bil_usd,
    CASE WHEN c_acctbal > 0 THEN 10 + (c_custkey * 29) % 701 / 10 END AS annual_co2_em_mtco2,
    coalesce(n, 0) AS xco2_numsams, (c_custkey * 7) % 41 AS sif_numsams, ((c_custkey * 13) % 300)::DOUBLE AS coastal_km,
    CASE WHEN (c_custkey * 13) % 300 < 50 THEN 'True' ELSE 'False' END AS is_coastal
    FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) / 1000 AS xco2_ppm, count(*) AS n FROM orders GROUP BY 1)
    ON c_custkey = o_custkey"""

QUADRANT = """SELECT t.*, CASE WHEN coalesce(xco2_ppm > c3, false) AND coalesce(annual_co2_em_mtco2 > e3, false) THEN 'HIGH_both'
    WHEN coalesce(xco2_ppm > c3, false) THEN 'LOW_emissions_HIGH_conc'
    WHEN coalesce(annual_co2_em_mtco2 > e3, false) THEN 'HIGH_emissions_LOW_conc' ELSE 'LOW_both' END AS quadrant
    FROM city_year t, (SELECT quantile_cont(xco2_ppm, 0.75) AS c3, quantile_cont(annual_co2_em_mtco2, 0.75) AS e3
    FROM city_year)"""

LABELLED = f"""SELECT *, year(datetime) AS year, month(datetime) AS month, {_season('latitude', 'month(datetime)')} AS season,
    hour(local_time) AS hour, {_tod('hour(local_time)')} AS time_of_day FROM xco2"""

SUMMARY = f"""SELECT g.target_name, country, population, gdp_bil_usd, coastal_km, season, time_of_day, city,
    xco2_median, xco2_std, n AS xco2_n, sif_median, sif_std, n AS sif_n FROM (
    SELECT target_name, {_season('latitude', 'month(datetime)')} AS season, {_tod('hour(local_time)')} AS time_of_day,
    median(x) AS xco2_median, stddev_samp(x) AS xco2_std, count(*) AS n, median(s) AS sif_median, stddev_samp(s) AS sif_std
    FROM (SELECT target_name, datetime, local_time, latitude, xco2 AS x, NULL AS s FROM xco2
    UNION ALL SELECT target_name, datetime, local_time, latitude, NULL, Daily_SIF_757nm FROM sif) GROUP BY 1, 2, 3) g
    LEFT JOIN site USING (target_name)"""

MONTH = "target_name, year(datetime) AS year, month(datetime) AS month"
XMONTH = f"""SELECT {MONTH}, arg_min(latitude, (datetime, sounding_id)) AS latitude, median(xco2) AS xco2_median,
    count(xco2) AS xco2_n FROM xco2 GROUP BY 1, 2, 3"""
SMONTH = f"""SELECT {MONTH}, median(Daily_SIF_757nm) AS sif_median, count(Daily_SIF_757nm) AS sif_n FROM sif GROUP BY 1, 2, 3"""
MERGED = f"""SELECT x.target_name, x.month, {_season('x.latitude', 'x.month')} AS season, xco2_median, sif_median, no2_median
    FROM xmonth x LEFT JOIN smonth USING (target_name, year, month)
    LEFT JOIN (SELECT target_name, year(shipped) AS year, month(shipped) AS month, median(no2) AS no2_median FROM no2
    GROUP BY 1, 2, 3) n USING (target_name, year, month) JOIN site USING (target_name)
    WHERE population IS NOT NULL AND n.target_name IS NOT NULL"""
SEASONAL = """SELECT g.*, s.city, s.country, s.population, s.gdp_bil_usd, s.coastal_km,
    CASE WHEN s.is_coastal THEN 'True' ELSE 'False' END AS is_coastal FROM (SELECT target_name, season,
    median(xco2_median) AS xco2_median, stddev_samp(xco2_median) AS xco2_std, median(sif_median) AS sif_median,
    stddev_samp(sif_median) AS sif_std, median(no2_median) AS no2_median, stddev_samp(no2_median) AS no2_std
    FROM merged GROUP BY 1, 2) g JOIN site s USING (target_name)"""

SPLIT = """SELECT t.*, CASE WHEN sif_iqr > s AND xco2_iqr > x THEN 'High SIF' || chr(10) || 'High CO2'
    WHEN sif_iqr > s AND xco2_iqr <= x THEN 'High SIF' || chr(10) || 'Low CO2'
    WHEN sif_iqr <= s AND xco2_iqr > x THEN 'Low SIF' || chr(10) || 'High CO2'
    WHEN sif_iqr <= s AND xco2_iqr <= x THEN 'Low SIF' || chr(10) || 'Low CO2' END AS quadrant,
    CASE WHEN coastal_km < 50 THEN 'Coastal' WHEN coastal_km >= 50 THEN 'Inland' END AS coastal_status
    FROM season_table t, (SELECT median(sif_iqr) AS s, median(xco2_iqr) AS x FROM season_table)"""
EXTREMES = """SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY abs(sif_iqr) + abs(xco2_iqr) DESC NULLS LAST,
    target_name, season, time_of_day) AS rank FROM split"""

CITY_POINTS = """SELECT sounding_id, latitude, longitude, xco2, coalesce(city, 'Unknown') AS city,
    coalesce(city, 'Unknown') || '|||' || country AS city_key, date_trunc('month', datetime)::DATE AS month, datetime
    FROM xco2 WHERE xco2 IS NOT NULL"""

POINTS = """SELECT event_id AS point_id, date_trunc('day', ts)::TIMESTAMP AS datetime,
    (user_id % 15) * 2 - 14 + (event_id % 9) * 0.05::DOUBLE AS latitude,
    (user_id % 10) * 3 + (event_id % 11) * 0.05::DOUBLE AS longitude, value AS xco2, 'City ' || (user_id % 40) AS city,
    'Country ' || (user_id % 25) AS country FROM events"""
DISTANCE = "sqrt(pow(abs({0}.latitude - {1}.latitude), 2) + pow(abs({0}.longitude - {1}.longitude) * " \
    "cos(radians(({0}.latitude + {1}.latitude) / 2)), 2))"
EDGES = f"""SELECT a.point_id AS a, b.point_id AS b FROM points a JOIN points b ON a.datetime = b.datetime
    AND a.point_id <> b.point_id AND {DISTANCE.format('a', 'b')} <= 0.08"""
REACHED = """SELECT point_id AS id, point_id AS root FROM points UNION
    SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.id"""
CLUSTERED = """SELECT p.*, c.cluster_id FROM points p JOIN (SELECT id, min(root) AS cluster_id FROM reached GROUP BY id) c
    ON c.id = p.point_id"""
STATS = """SELECT s.*, k.city, k.country, k.datetime, strftime(k.datetime, '%Y-%m-%d %H:%M:%S') || '|||' || k.city || '|||' ||
    k.country || '|||cluster' || s.cluster_id AS cluster_key FROM (SELECT cluster_id, count(*) AS n_points,
    avg(xco2) AS mean_val, CASE WHEN max(xco2) - min(xco2) < 0.02 THEN min(xco2) - 0.01 ELSE min(xco2) END AS local_min,
    CASE WHEN max(xco2) - min(xco2) < 0.02 THEN max(xco2) + 0.01 ELSE max(xco2) END AS local_max
    FROM clustered GROUP BY 1) s JOIN points k ON k.point_id = s.cluster_id"""

TEXT = """SELECT sounding_id, CASE WHEN sounding_id % 31 = 0 THEN 'soon'
    WHEN sounding_id % 3 = 0 THEN strftime(local_time, '%Y-%m-%dT%H:%M:%SZ')
    WHEN sounding_id % 3 = 1 THEN strftime(local_time, '%Y-%m-%dT%H:%M:%S+05:30')
    ELSE strftime(local_time, '%Y-%m-%d %H:%M:%S') END AS dt,
    CASE WHEN sounding_id % 31 <> 0 THEN CASE WHEN sounding_id % 3 = 1 THEN local_time - INTERVAL 330 MINUTE
    ELSE local_time END END AS t, strftime(local_time, '%H:%M') AS local_time,
    CASE WHEN sounding_id % 29 <> 0 THEN round(latitude, 1) END AS latitude,
    CASE WHEN sounding_id % 37 <> 0 THEN round(longitude, 1) END AS longitude,
    CASE WHEN sounding_id % 41 <> 0 THEN xco2 END AS xco2,
    CASE WHEN sounding_id % 7 = 0 OR city IS NULL THEN 'Unknown' ELSE city END AS city,
    CASE WHEN sounding_id % 11 = 0 THEN '' ELSE country END AS country,
    CASE WHEN sounding_id % 5 <> 0 THEN (sounding_id * 3)::DOUBLE END AS population, target_name, source_file FROM xco2"""
GATED = """SELECT sounding_id, latitude, longitude, xco2, t AS datetime, date_trunc('month', t)::DATE AS month,
    dt AS datetime_text, local_time, city, country, city || '|||' || country AS city_key, population, target_name,
    source_file FROM text WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND xco2 IS NOT NULL AND t IS NOT NULL"""

# Four deliveries of twenty months, some rows a delivery late; a month is closed 400 days behind the latest row before.
DELIVERED = """delivered AS (SELECT *, CAST(least(3, ((CAST(substr(datetime_text, 1, 4) AS INT) - 1995) * 12 +
    CAST(substr(datetime_text, 6, 2) AS INT) - 1) // 20 + CASE WHEN sounding_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS delivery
    FROM gated WHERE city <> 'Unknown'),
    marks AS (SELECT delivery, max(latest) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 400 DAY AS mark
    FROM (SELECT delivery, max(datetime) AS latest FROM delivered GROUP BY 1)),
    judged AS (SELECT d.*, coalesce(month + INTERVAL 1 MONTH <= mark, false) AS late FROM delivered d JOIN marks USING (delivery))"""

PARTS = {
    "site": (SITE, ()), "xco2": (XCO2, ()), "sif": (SIF, ()), "no2": (NO2, ()), "city_year": (CITY_YEAR, ()),
    "cities": (QUADRANT, ("city_year",)),
    "rich": ("SELECT * FROM cities WHERE population IS NOT NULL", ("cities",)),
    "impact": (f"SELECT *, co2_conc_iqr - co2_em_iqr AS impact_iqr FROM ({_scaled('rich', IMPACT_SCALING)})", ("rich",)),
    "labelled": (LABELLED, ("xco2",)), "summary": (SUMMARY, ("site", "xco2", "sif")),
    "settled": ("SELECT * FROM summary WHERE population IS NOT NULL", ("summary",)),
    "season_table": (_scaled("settled", SEASON_SCALING), ("settled",)),
    "split": (SPLIT, ("season_table",)), "extremes": (EXTREMES, ("split",)),
    "xmonth": (XMONTH, ("xco2",)), "smonth": (SMONTH, ("sif",)), "merged": (MERGED, ("xmonth", "smonth", "no2", "site")),
    "seasonal": (SEASONAL, ("merged", "site")), "month_table": (_scaled("seasonal", MONTHLY_SCALING), ("seasonal",)),
    "city_points": (CITY_POINTS, ("xco2",)),
    "series": ("SELECT city_key, month, avg(xco2) AS mean_value, count(*) AS n_points FROM city_points "
               "WHERE city <> 'Unknown' GROUP BY 1, 2", ("city_points",)),
    "points": (POINTS, ()), "edges": (EDGES, ("points",)), "reached": (REACHED, ("points", "edges")),
    "clustered": (CLUSTERED, ("points", "reached")), "stats": (STATS, ("clustered", "points")),
    "text": (TEXT, ("xco2",)), "gated": (GATED, ("text",)),
}


def _with(body: str, *needed: str, extra: str = "") -> str:
    """``body`` preceded by the named subqueries it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    recursive = "RECURSIVE " if "reached" in order else ""
    parts = [f"{n} AS ({PARTS[n][0]})" for n in order] + ([extra] if extra else [])
    return f"WITH {recursive}{', '.join(parts)} {body}"


# Least squares.

def _tail(f: str, d1: str, d2: str) -> str:
    """P(F > f) by Simpson's rule on the angle form of the beta integral."""
    n = 2000
    start = f"atan(sqrt({d1} * {f} / {d2}))"
    width = f"least(pi() / 2 - {start}, 12 / sqrt({d2}))"
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    angle = f"({start} + {width} * i / {n})"
    height = f"exp(({d1} - 1) * ln(sin({angle})) + ({d2} - 1) * ln(greatest(cos({angle}), 1e-300)) + ln(2.0) + lgamma(({d1} + {d2}) / 2.0) " \
             f"- lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    return f"CASE WHEN {f} > 0 THEN {width} / {n} / 3 * list_sum(list_transform(range(0, {n} + 1), lambda i: {weight} * {height})) " \
           f"WHEN {f} = 0 THEN 1.0 END"


def _t_critical(df: str) -> str:
    """0.975 quantile of t: expansion around the normal quantile, then one Newton step."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    t = f"({z!r} + {g1!r} / {df} + {g2!r} / pow({df}, 2) + {g3!r} / pow({df}, 3) + {g4!r} / pow({df}, 4))"
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + {t} * {t} / {df}, -({df} + 1) / 2.0)"
    return f"({t} + ({_tail(f'({t} * {t})', '1', df)} - 0.05) / (2 * {density}))"


def _least_squares(source: str, y: str, xs: tuple[str, ...], by: str | None = None) -> str:
    """Subqueries moment_0 .. and fitted: one row per group with b_i, v_i (variance / s2), rss, tss, n, df."""
    k, names = len(xs), [*xs, y]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    a = {p: f"a_{p[0]}_{p[1]}" for p in pairs} | {(j, i): f"a_{i}_{j}" for i, j in pairs}
    group = f"{by} AS grp" if by else "1 AS grp"
    complete = " AND ".join(f"{n} IS NOT NULL" for n in names)
    cells = ", ".join(f"covar_samp({names[i]}, {names[j]}) * (count(*) - 1) AS {a[i, j]}" for i, j in pairs)
    means = ", ".join(f"avg({n}) AS m_{i}" for i, n in enumerate(names))
    text = f"moment_0 AS (SELECT {group}, count(*) AS n, {means}, {cells} FROM {source} WHERE {complete} GROUP BY 1)"
    keep = "grp, n, " + ", ".join(f"m_{i}" for i in range(k + 1))
    for p in range(k):
        steps = []
        for i, j in pairs:
            if i == p and j == p:
                e = f"-1.0 / {a[p, p]}"
            elif p in (i, j):
                e = f"{a[i, j]} / {a[p, p]}"
            else:
                e = f"{a[i, j]} - {a[i, p]} * {a[p, j]} / {a[p, p]}"
            steps.append(f"{e} AS {a[i, j]}")
        text += f", moment_{p + 1} AS MATERIALIZED (SELECT {keep}, {', '.join(steps)} FROM moment_{p})"
    slopes = ", ".join([f"m_{k} - (" + " + ".join(f"m_{i} * {a[i, k]}" for i in range(k)) + ") AS b_0"]
                       + [f"{a[i, k]} AS b_{i + 1}" for i in range(k)])
    centre = " + ".join(f"m_{i} * m_{j} * -{a[i, j]}" for i in range(k) for j in range(k))
    spread = ", ".join([f"1.0 / n + {centre} AS v_0"] + [f"-{a[i, i]} AS v_{i + 1}" for i in range(k)])
    text += f", fitted AS MATERIALIZED (SELECT grp, n, n - {k + 1} AS df, {slopes}, {spread}, {a[k, k]} AS rss, tss " \
            f"FROM moment_{k} JOIN (SELECT grp AS g0, {a[k, k]} AS tss FROM moment_0) ON grp IS NOT DISTINCT FROM g0)"
    rows = " UNION ALL ".join(
        f"SELECT grp, '{t}' AS term, {i} AS term_order, b_{i} AS estimate, sqrt(v_{i} * rss / df) AS std_error, df FROM fitted"
        for i, t in enumerate(["(Intercept)", *xs])
    )
    text += f", terms AS MATERIALIZED (SELECT *, estimate / std_error AS statistic FROM ({rows}))"
    square = "(statistic * statistic)"
    return text + f", coef AS MATERIALIZED (SELECT *, {_tail(square, '1', 'df')} AS p_value FROM terms)"


def _inference(group: str = "", raw: bool = False) -> str:
    cells = ", ".join(_r(c, digits=4 if raw and c in ("estimate", "std_error") else 6)
                      for c in ("estimate", "std_error", "statistic", "p_value"))
    return f"SELECT {group}term, {cells} FROM coef"


def _fit_statistics(k: int) -> str:
    f = f"((tss - rss) / {k} / (rss / df))"
    return f"SELECT n, (SELECT count(*) FROM impact) - n AS n_dropped, {k + 1}::BIGINT AS model_rank, df::BIGINT AS df_residual, " \
           f"{_r('sqrt(rss / df)', 'sigma')}, {_r('1 - rss / tss', 'r_squared')}, " \
           f"{_r('1 - (rss / tss) * (n - 1) / df', 'adj_r_squared')}, {_r(f, 'f_statistic')}, {k}::BIGINT AS df_model, " \
           f"{_r(_tail('f', str(k), 'df'), 'p_value')} FROM (SELECT *, {f} AS f FROM fitted)"


def _interaction() -> str:
    """Coefficients of the pooled model as differences to the first season."""
    k = len(SEASON_PREDICTORS)
    pooled = f"(SELECT sum(rss) / sum(df) AS s2, sum(df) AS pdf FROM fitted)"
    base = "(SELECT * FROM fitted ORDER BY grp LIMIT 1)"
    rows = []
    for i, t in enumerate(["(Intercept)", *SEASON_PREDICTORS]):
        rows.append(f"SELECT '{t}' AS term, b_{i} AS estimate, sqrt(v_{i} * s2) AS std_error, pdf AS df FROM {base}, {pooled}")
        name = "'season' || f.grp" if i == 0 else f"'{t}:season' || f.grp"
        rows.append(f"SELECT {name}, f.b_{i} - z.b_{i}, sqrt((f.v_{i} + z.v_{i}) * s2), pdf FROM fitted f, {base} z, {pooled} "
                    f"WHERE f.grp <> z.grp")
    fits = _least_squares("season_table", "xco2_iqr", SEASON_PREDICTORS, "season").split(", terms AS")[0]
    tail = _tail("(statistic * statistic)", "1", "df")
    extra = fits + f", terms AS MATERIALIZED (SELECT *, estimate / std_error AS statistic FROM ({' UNION ALL '.join(rows)})), " \
        f"coef AS MATERIALIZED (SELECT *, {tail} AS p_value FROM terms)"
    return _with(_inference(), "season_table", extra=extra)


def _interaction_fit() -> str:
    """Fit statistics of the pooled model: residuals add up over the seasons."""
    k = len(SEASON_PREDICTORS)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in ("xco2_iqr", *SEASON_PREDICTORS))
    total = f"(SELECT count(*) AS n_all, var_samp(xco2_iqr) FILTER ({complete}) * (count(*) FILTER ({complete}) - 1) AS tss " \
            "FROM season_table)"
    pooled = f"(SELECT sum(n)::BIGINT AS n, count(*) * {k + 1} AS rank, sum(df)::BIGINT AS df, sum(rss) AS rss FROM fitted)"
    body = f"SELECT n, n_all - n AS n_dropped, rank AS model_rank, df AS df_residual, {_r('sqrt(rss / df)', 'sigma')}, " \
           f"{_r('1 - rss / tss', 'r_squared')}, {_r('1 - (rss / tss) * (n - 1) / df', 'adj_r_squared')}, " \
           f"{_r('f', 'f_statistic')}, rank - 1 AS df_model, {_r(_tail('f', '(rank - 1)', 'df'), 'p_value')} FROM (SELECT *, " \
           f"(tss - rss) / (rank - 1) / (rss / df) AS f FROM {pooled}, {total})"
    fits = _least_squares("season_table", "xco2_iqr", SEASON_PREDICTORS, "season").split(", terms AS")[0]
    return _with(body, "season_table", extra=fits)


def _links() -> str:
    """Linked places by comparing all points of a timestamp; only the grid is shared with the query."""
    side = 0.08 / math.sqrt(2) * (1 - 1e-9)
    low, high = f"(r * {side!r})", f"((r + 1) * {side!r})"
    widest = f"CASE WHEN {low} <= 0 AND {high} >= 0 THEN 1.0 ELSE greatest(abs(cos(radians{low})), abs(cos(radians{high}))) END"
    extra = f"celled AS (SELECT *, floor(longitude / ({side!r} / ({widest}))) AS c FROM (SELECT *, floor(latitude / {side!r}) AS r " \
            f"FROM points)), placed AS (SELECT *, min(point_id) OVER (PARTITION BY datetime, r, c) AS place FROM celled)"
    return _with(f"SELECT DISTINCT a.datetime AS time, a.place AS a, b.place AS b FROM placed a JOIN placed b "
                 f"ON a.datetime = b.datetime AND a.place < b.place AND {DISTANCE.format('a', 'b')} <= 0.08", "points", extra=extra)


def _sql() -> dict[str, str]:
    season_fit = _least_squares("season_table", "xco2_iqr", SEASON_PREDICTORS, "season")
    impact_fit = _least_squares("impact", "impact_iqr", IMPACT_PREDICTORS)
    recode = {"sif_iqr": "SIF", "pop_iqr": "Population", "xco2numsams_iqr": "CO2 Sample Size",
              "sifnumsams_iqr": "SIF Sample Size", "gdp_iqr": "GDP", "coast_iqr": "Coastal Distance"}
    names = "CASE term " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in recode.items()) + " END"
    grid = {"sif_iqr": "SIF", "pop_iqr": "Population", "coast_iqr": "Coast", "xco2_numsams_iqr": "xco2_numsams"}
    grid_names = "CASE term " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grid.items()) + " END"
    seen = f"seen AS (SELECT {SITE_NAME.format('l_partkey')} AS target_name FROM lineitem)"
    users = f"seen AS (SELECT {SITE_NAME.format('user_id')} AS target_name FROM events)"
    city_cells = f"city, {_r('xco2_ppm')}, {_r('sif_757nm')}, {_r('population')}, {_r('gdp_bil_usd')}, " \
                 f"{_r('annual_co2_em_mtco2')}, xco2_numsams, sif_numsams, {_r('coastal_km')}, is_coastal"
    residual = " - ".join(["xco2_iqr", "b_0", *[f"b_{i + 1} * {x}" for i, x in enumerate(SEASON_PREDICTORS)]])
    quantile = "quantile_cont(res, {})"
    residual_cells = ", ".join(_r(quantile.format(p), n) for n, p in zip(
        ("res_min", "res_q1", "res_median", "res_q3", "res_max"), (0, 0.25, 0.5, 0.75, 1)))
    residual_complete = " AND ".join(f"{c} IS NOT NULL" for c in ("xco2_iqr", *SEASON_PREDICTORS))
    lines = """lines AS (SELECT quadrant, regr_count(impact_iqr, coastal_km)::BIGINT AS n, regr_slope(impact_iqr, coastal_km) AS slope,
        regr_intercept(impact_iqr, coastal_km) AS intercept, regr_r2(impact_iqr, coastal_km) AS r_squared,
        min(coastal_km) AS x1, max(coastal_km) AS x2, avg(coastal_km) AS mx,
        regr_sxx(impact_iqr, coastal_km) AS sxx, sqrt((regr_syy(impact_iqr, coastal_km) - pow(regr_sxy(impact_iqr,
        coastal_km), 2) / regr_sxx(impact_iqr, coastal_km)) / (count(*) - 2)) AS sigma FROM impact WHERE impact_iqr IS NOT NULL AND coastal_km IS NOT NULL
        GROUP BY 1 HAVING count(*) > 2 AND var_samp(coastal_km) > 0)"""
    three = _least_squares("impact", "impact_iqr", ("sif_iqr", "gdp_iqr", "coast_iqr"))
    step = "(size / 100.0::DOUBLE)"
    hit = " OR ".join(
        f"(floor(r / {step}) + {i} BETWEEN 0 AND 99 AND floor((floor(r / {step}) + {i}) * {step}) = r)" for i in (-1, 0, 1))
    place = ("city, country, population, gdp_bil_usd, coastal_km",)
    schema = []
    for t, source, columns in (
        ("site", "site", {"Target.Name": "target_name", "Site.Center.WKT": "wkt_center", "Site.Shape.WKT": "wkt_shape",
                          **{c: c for c in ("city", "country", "population", "gdp_bil_usd", "coastal_km", "is_coastal")}}),
        ("xco2_obs", "xco2", {c: ("NULL" if c == "population" else c) for c in (
            "sounding_id", "target_name", "datetime", "local_time", "latitude", "longitude", "xco2", "city", "country",
            "population", "source_file")}),
    ):
        schema += [f"SELECT '{t}' AS table_name, {i}::BIGINT AS position, '{n}' AS column_name, count({c}) AS n_present "
                   f"FROM {source}" for i, (n, c) in enumerate(columns.items())]

    return {
        "scan_csv_city": _with(f"SELECT {city_cells} FROM city_year", "city_year"),
        "scan_csv_reordered": _with(f"SELECT {city_cells} FROM city_year", "city_year"),
        "scan_parquet": f"SELECT o_orderkey, o_custkey, {_r('o_totalprice')}, o_orderdate FROM orders",
        "ingest_gate": _with(
            f"SELECT sounding_id, {_r('latitude')}, {_r('longitude')}, {_r('xco2')}, datetime, month, datetime_text, local_time, "
            f"city, country, city_key, population, target_name, source_file FROM gated", "gated"),
        "ingest_tally": _with("SELECT count(*) AS n_rows, (SELECT count(*) FROM gated) AS n_valid, "
                              "count(*) - (SELECT count(*) FROM gated) AS n_rejected FROM text", "gated"),
        "schema_report": _with(" UNION ALL ".join(schema), "site", "xco2"),
        "literal_grid": _with(
            "SELECT s.season, t.time_of_day, count(l.sounding_id) AS n FROM (VALUES ('Autumn (North)'), ('Autumn (South)'), "
            "('Other'), ('Spring (North)'), ('Spring (South)'), ('Summer (North)'), ('Summer (South)'), ('Tropical Dry'), "
            "('Tropical Wet'), ('Winter (North)'), ('Winter (South)')) s(season) CROSS JOIN (VALUES ('Night'), ('Morning'), "
            "('Afternoon'), ('Evening')) t(time_of_day) LEFT JOIN labelled l ON l.season = s.season AND "
            "l.time_of_day = t.time_of_day GROUP BY 1, 2", "labelled"),
        "select_rename": _with(
            f"SELECT target_name, wkt_center, wkt_shape, city, country, {_r('population')}, gdp_bil_usd, coastal_km, is_coastal "
            "FROM site", "site"),
        "drop_if_present": _with(
            f"SELECT sounding_id, target_name, datetime, local_time, {_r('latitude')}, {_r('longitude')}, {_r('xco2')}, "
            "source_file FROM xco2", "xco2"),
        "date_parts": _with("SELECT sounding_id, year(datetime) AS year, month(datetime) AS month, "
                            "dayofyear(datetime) AS day_of_year FROM xco2", "xco2"),
        "drop_na": _with(f"SELECT {city_cells} FROM city_year WHERE population IS NOT NULL", "city_year"),
        "filter_not_null": _with(f"SELECT target_name, {_r('population')}, coastal_km FROM site WHERE population IS NOT NULL", "site"),
        "filter_eq": _with(f"SELECT sounding_id, season, {_r('xco2')} FROM labelled WHERE season = 'Summer (North)'", "labelled"),
        "filter_in": _with("SELECT city, quadrant FROM cities WHERE quadrant IN ('LOW_emissions_HIGH_conc', "
                           "'HIGH_emissions_LOW_conc')", "cities"),
        "left_join_dim": _with(
            f"SELECT sounding_id, target_name, {_r('xco2')}, s.country, {_r('s.population')}, gdp_bil_usd, coastal_km "
            "FROM xco2 LEFT JOIN site s USING (target_name)", "xco2", "site"),
        "left_join_monthly": _with(
            f"SELECT target_name, year, month, xco2_n, {_r('xco2_median')}, sif_n, {_r('sif_median')} FROM xmonth "
            "LEFT JOIN smonth USING (target_name, year, month)", "xmonth", "smonth"),
        "left_join_filtered": _with(
            f"SELECT sounding_id, target_name, {_r('xco2')}, s.country, {_r('s.population')} FROM xco2 JOIN site s "
            "USING (target_name) WHERE s.population IS NOT NULL", "xco2", "site"),
        "anti_missing_in_dim": _with("SELECT DISTINCT target_name FROM seen WHERE target_name NOT IN "
                                     "(SELECT target_name FROM site)", "site", extra=seen),
        "anti_missing_in_fact": _with("SELECT target_name FROM site WHERE target_name NOT IN "
                                      "(SELECT target_name FROM seen)", "site", extra=users),
        "join_match_count": _with("SELECT count(*) AS n_rows, count(country) AS n_matched, count(*) - count(country) "
                                  "AS n_unmatched FROM seen LEFT JOIN site USING (target_name)", "site", extra=seen),
        "union_by_name": _with(
            f"SELECT target_name, datetime, {_r('xco2')}, NULL::DOUBLE AS Daily_SIF_757nm FROM xco2 UNION ALL "
            f"SELECT target_name, datetime, NULL, {_r('Daily_SIF_757nm')} FROM sif", "xco2", "sif"),
        "except_keys": _with("SELECT target_name FROM seen EXCEPT SELECT target_name FROM site", "site", extra=seen),
        "distinct_labels": _with("SELECT DISTINCT season, time_of_day FROM labelled", "labelled"),
        "labels_season": _with(f"SELECT sounding_id, {_r('latitude')}, month, season FROM labelled", "labelled"),
        "labels_time_of_day": _with("SELECT sounding_id, hour, time_of_day FROM labelled", "labelled"),
        "parse_mixed_dates": _with(
            "SELECT date, CASE WHEN length(date) < 8 THEN date_trunc('month', shipped)::DATE ELSE shipped::DATE END AS parsed, "
            "count(*) AS n FROM no2 GROUP BY 1, 2", "no2"),
        "coastal_status": _with("SELECT target_name, coastal_km, CASE WHEN coastal_km < 50 THEN 'Coastal' ELSE 'Inland' END "
                                "AS status FROM site", "site"),
        "clean_text": _with("SELECT sounding_id, city, country, city || '|||' || country AS city_key FROM text", "text"),
        "month_bins": _with("SELECT month, count(*) AS n_points FROM city_points GROUP BY 1", "city_points"),
        "month_timeline": _with(
            "SELECT month, row_number() OVER (ORDER BY month) - 1 AS position, strftime(month, '%b %Y') AS label, "
            "strftime(month, '%B %Y') AS long_label, coalesce(lead(month) OVER (ORDER BY month), min(month) OVER ()) "
            "AS next_month FROM (SELECT DISTINCT month FROM city_points)", "city_points"),
        "timestamp_buckets": _with("SELECT datetime, count(*) AS n_points FROM points GROUP BY 1", "points"),
        "group_site_season_tod": _with(
            f"SELECT target_name, country, {_r('population')}, gdp_bil_usd, coastal_km, season, time_of_day, city, "
            f"{_r('xco2_median')}, {_r('xco2_std')}, xco2_n, {_r('sif_median')}, {_r('sif_std')}, sif_n FROM summary", "summary"),
        "first_by_time": _with(f"SELECT target_name, year, month, {_r('latitude')} FROM xmonth", "xmonth"),
        "median_by_group": _with(f"SELECT season, time_of_day, {_r('median(xco2)', 'xco2_median')} FROM labelled GROUP BY 1, 2",
                                 "labelled"),
        "stddev_by_group": _with(f"SELECT target_name, season, {_r('stddev_samp(xco2)', 'xco2_std')} FROM labelled GROUP BY 1, 2",
                                 "labelled"),
        "count_non_missing": _with("SELECT season, count(xco2) AS xco2_n, count(*) AS n_rows FROM labelled GROUP BY 1", "labelled"),
        "quartiles": _with(
            f"SELECT {_season('latitude', 'month(datetime)')} AS season, count(*) AS n, "
            f"{_r('quantile_cont(Daily_SIF_757nm, 0.25)', 'sif_q1')}, {_r('quantile_cont(Daily_SIF_757nm, 0.75)', 'sif_q3')}, "
            f"{_r('median(Daily_SIF_757nm)', 'sif_median')} FROM sif GROUP BY 1", "sif"),
        "robust_range": _with(f"SELECT {_r('quantile_cont(xco2, 0.05)', 'low')}, {_r('quantile_cont(xco2, 0.95)', 'high')} FROM xco2",
                              "xco2"),
        "median_of_medians": _with(
            f"SELECT target_name, season, city, country, {_r('population')}, gdp_bil_usd, coastal_km, is_coastal, "
            + ", ".join(_r(f"{v}_{s}") for v in ("xco2", "sif", "no2") for s in ("median", "std")) + " FROM seasonal", "seasonal"),
        "boxplot_stats": _with(
            f"SELECT quadrant, n, {_r('q1')}, {_r('med', 'median')}, {_r('q3')}, "
            f"{_r('min(v) FILTER (inside)', 'whisker_low')}, {_r('max(v) FILTER (inside)', 'whisker_high')}, "
            "count(*) FILTER (NOT inside) AS n_outliers FROM (SELECT h.*, impact_iqr AS v, impact_iqr BETWEEN "
            "q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM impact JOIN (SELECT quadrant, count(impact_iqr) AS n, "
            "quantile_cont(impact_iqr, 0.25) AS q1, median(impact_iqr) AS med, quantile_cont(impact_iqr, 0.75) AS q3 FROM impact "
            "GROUP BY 1) h USING (quadrant)) GROUP BY quadrant, n, q1, med, q3", "impact"),
        "load_totals": _with("SELECT count(*) AS n_points, count(DISTINCT month) AS n_months, (SELECT count(DISTINCT cluster_id) "
                             "FROM clustered) AS n_clusters FROM city_points", "city_points", "clustered"),
        "iqr_norm": _with(
            f"SELECT target_name, {_r('population')}, coastal_km, {_r('pop_iqr')}, {_r('coast_iqr')} FROM "
            f"({_scaled('site', {'pop_iqr': 'population', 'coast_iqr': 'coastal_km'})})", "site"),
        "impact_score": _with(f"SELECT city, {_r('co2_conc_iqr')}, {_r('co2_em_iqr')}, {_r('impact_iqr')} FROM impact", "impact"),
        "iqr_zone": _with("SELECT city, " + ", ".join(
            f"CASE WHEN {c} < 0 THEN 'below_q1' WHEN {c} <= 1 THEN 'middle' WHEN {c} > 1 THEN 'above_q3' END AS {n}"
            for c, n in (("co2_conc_iqr", "conc_zone"), ("co2_em_iqr", "em_zone"))) + " FROM impact", "impact"),
        "median_quadrant": _with(f"SELECT target_name, season, time_of_day, {_r('sif_iqr')}, {_r('xco2_iqr')}, quadrant, "
                                 "coastal_status FROM split", "split"),
        "q3_quadrant": _with("SELECT city, quadrant FROM cities", "cities"),
        "intensity": _with(
            f"SELECT sounding_id, {_r('greatest(0.0, least(1.0, (xco2 - lo) / (hi - lo)))', 'intensity')} FROM xco2, "
            "(SELECT quantile_cont(xco2, 0.05) AS lo, quantile_cont(xco2, 0.95) AS hi FROM xco2) WHERE xco2 IS NOT NULL", "xco2"),
        "city_month_mean": _with(f"SELECT city_key, month, {_r('mean_value')}, n_points FROM series", "series"),
        "chart_range": _with(
            f"SELECT city_key, {_r('CASE WHEN hi - lo < 0.4 THEN lo - 0.2 ELSE lo END', 'min_value')}, "
            f"{_r('CASE WHEN hi - lo < 0.4 THEN hi + 0.2 ELSE hi END', 'max_value')}, first_month, last_month FROM (SELECT city_key, "
            "min(mean_value) AS lo, max(mean_value) AS hi, min(month) AS first_month, max(month) AS last_month FROM series GROUP BY 1)",
            "series"),
        "scatter_frame": _with(
            f"SELECT city, {_r('co2_em_iqr')}, {_r('co2_conc_iqr')}, quadrant, {_r('population / 1e6', 'population_m')}, "
            "CASE is_coastal WHEN 'True' THEN 'Coastal' WHEN 'False' THEN 'Inland' END AS shape, CASE WHEN quadrant IN "
            "('LOW_emissions_HIGH_conc', 'HIGH_emissions_LOW_conc') THEN city END AS label FROM impact", "impact"),
        "topk_extremes": _with(f"SELECT target_name, season, time_of_day, quadrant, {_r('sif_iqr')}, {_r('xco2_iqr')}, rank "
                               "FROM extremes WHERE rank <= 6", "extremes"),
        "extremes_frame": _with(
            f"SELECT target_name, season, time_of_day, {_r('sif_iqr')}, {_r('xco2_iqr')}, {_r('population / 1e6', 'population_m')}, "
            "coastal_status, CASE WHEN rank <= 6 THEN quadrant END AS highlight, CASE WHEN rank <= 6 THEN city END AS label "
            "FROM extremes", "extremes"),
        "reorder_levels": _with(
            f"SELECT quadrant, {_r('m', 'median_value')}, row_number() OVER (ORDER BY m, quadrant) AS position FROM "
            "(SELECT quadrant, median(impact_iqr) AS m FROM impact GROUP BY 1)", "impact"),
        "systematic_sample": _with(
            f"SELECT sounding_id, month, {_r('latitude')}, {_r('longitude')}, {_r('xco2')} FROM (SELECT *, row_number() OVER "
            "(PARTITION BY month ORDER BY sounding_id) - 1 AS r, count(*) OVER (PARTITION BY month) AS size FROM city_points) "
            f"WHERE size <= 100 OR {hit}", "city_points"),
        "factor_levels": _with("SELECT season, row_number() OVER (ORDER BY season) AS code, row_number() OVER (ORDER BY season) = 1 "
                               "AS is_baseline FROM (SELECT DISTINCT season FROM labelled)", "labelled"),
        "proximity_pairs": _links(),
        "spatial_clusters": _with("SELECT point_id, cluster_id FROM clustered", "clustered"),
        "cluster_stats": _with(f"SELECT cluster_id, cluster_key, city, country, datetime, n_points, {_r('mean_val')}, "
                               f"{_r('local_min')}, {_r('local_max')} FROM stats", "stats"),
        "cluster_members": _with(f"SELECT point_id, cluster_id, cluster_key, n_points, {_r('mean_val')} FROM clustered JOIN "
                                 "(SELECT cluster_id, cluster_key, n_points, mean_val FROM stats) USING (cluster_id)", "stats"),
        "local_intensity": _with(
            f"SELECT point_id, cluster_id, {_r('greatest(0.0, least(1.0, (xco2 - local_min) / (local_max - local_min)))', 'local_intensity')} "
            "FROM clustered JOIN (SELECT cluster_id, local_min, local_max FROM stats) USING (cluster_id)", "stats"),
        "cluster_bbox": _with("SELECT cluster_id, " + ", ".join(
            f"{_r(f'{f}({c}) {s} greatest((max({c}) - min({c})) * 0.15, 0.01)', f'{n}_{f}')}"
            for c, n in (("latitude", "lat"), ("longitude", "lon")) for f, s in (("min", "-"), ("max", "+"))) +
            " FROM clustered GROUP BY 1", "clustered"),
        "nearest_within": _with(
            f"SELECT probe_id, arg_min(p.point_id, (round(dist, 12), p.point_id)) AS point_id, {_r('min(dist)', 'distance')} FROM "
            f"(SELECT q.probe_id, p.point_id, {DISTANCE.format('q', 'p')} AS dist FROM probes q JOIN points p ON "
            f"abs(q.latitude - p.latitude) < 0.5) p WHERE dist < 0.5 GROUP BY 1", "points",
            extra="probes AS (SELECT c_custkey AS probe_id, (c_custkey * 53) % 280 / 10 - 14 AS latitude, "
                  "(c_custkey * 97) % 275 / 10 AS longitude FROM customer)"),
        "sphere_xyz": _with(
            "SELECT c_custkey, " + ", ".join([
                _r(f"210.0 * cos(radians({_lat('c_custkey')})) * sin(radians({_lon('c_custkey')}))", "x"),
                _r(f"-210.0 * sin(radians({_lat('c_custkey')}))", "y"),
                _r(f"210.0 * cos(radians({_lat('c_custkey')})) * cos(radians({_lon('c_custkey')}))", "z")]) +
            f", 210.0 * cos(radians({_lat('c_custkey')})) * cos(radians({_lon('c_custkey')})) > 0 AS is_front FROM customer", "site"),
        "ols_global": _with(_inference(), "impact", extra=impact_fit),
        "ols_tidy": _with(
            f"SELECT {names} AS term, {_r('estimate')}, {_r('std_error')}, {_r('statistic')}, {_r('p_value')}, "
            f"{_r('estimate - std_error * ' + _t_critical('df'), 'conf_low')}, "
            f"{_r('estimate + std_error * ' + _t_critical('df'), 'conf_high')}, p_value < 0.20 AS p_below_020, "
            f"row_number() OVER (ORDER BY estimate, {names}) AS position FROM coef WHERE term_order > 0", "impact", extra=impact_fit),
        "ols_fit": _with(_fit_statistics(len(IMPACT_PREDICTORS)), "impact", extra=impact_fit),
        "ols_by_season": _with(_inference(group="grp AS season, "), "season_table", extra=season_fit),
        "ols_interaction": _interaction(),
        "ols_interaction_fit": _interaction_fit(),
        "ols_summer_north": _with(
            _inference(raw=True), "season_table",
            extra="summer AS (SELECT * FROM season_table WHERE season = 'Summer (North)'), "
                  + _least_squares("summer", "xco2_median", RAW_PREDICTORS)),
        "ols_by_season_no2": _with(_inference("grp AS season, ", raw=True), "month_table",
                                   extra=_least_squares("month_table", "xco2_median", NO2_PREDICTORS, "season")),
        "ols_na_rows": _with(
            f"SELECT season, count(*) FILTER ({residual_complete}) AS n, count(*) FILTER (NOT ({residual_complete})) AS n_dropped, "
            f"count(*) FILTER ({residual_complete}) - {len(SEASON_PREDICTORS) + 1} AS df_residual FROM season_table GROUP BY 1",
            "season_table"),
        "ols_residuals": _with(
            f"SELECT season, {residual_cells} FROM (SELECT season, {residual} AS res FROM season_table JOIN fitted ON season = grp "
            f"WHERE {residual_complete}) GROUP BY 1", "season_table", extra=season_fit),
        "ols_collinear": _with(
            _inference() + " UNION ALL SELECT 'twice_sif', NULL, NULL, NULL, NULL", "impact", extra=three),
        "trend_line": _with(
            f"SELECT quadrant, step, n, {_r('slope')}, {_r('intercept')}, {_r('r_squared')}, "
            f"{_r('x1 + (x2 - x1) * step / 79', 'x')}, {_r('intercept + slope * (x1 + (x2 - x1) * step / 79)', 'fitted')} "
            "FROM lines, (SELECT unnest(range(0, 80)) AS step)", "impact", extra=lines),
        "trend_band": _with(
            f"SELECT quadrant, step, n, {_r('slope')}, {_r('intercept')}, {_r('r_squared')}, {_r('x')}, {_r('fit', 'fitted')}, "
            f"{_r('fit - half', 'conf_low')}, {_r('fit + half', 'conf_high')} FROM (SELECT *, intercept + slope * x AS fit, "
            f"{_t_critical('(n - 2)')} * sigma * sqrt(1 / n + pow(x - mx, 2) / sxx) AS half FROM (SELECT *, "
            "x1 + (x2 - x1) * step / 79 AS x FROM lines, (SELECT unnest(range(0, 80)) AS step)))", "impact", extra=lines),
        "season_report": _with(
            f"SELECT season, short_season, hemisphere, {_r('r_squared')}, {_r('p', 'p_value')}, "
            f"{_r('CASE WHEN p > 0 THEN -log10(p) END', 'neg_log10_p')}, CASE WHEN p < 0.05 THEN 'Sig' ELSE 'Not Sig' END "
            f"AS significance FROM (SELECT *, {_tail('f', str(len(SEASON_PREDICTORS)), 'df')} AS p FROM (SELECT grp AS season, "
            f"substr(grp, 1, 10) AS short_season, {_hemisphere('grp')} AS hemisphere, 1 - rss / tss AS r_squared, df, "
            f"(tss - rss) / {len(SEASON_PREDICTORS)} / (rss / df) AS f FROM fitted))", "season_table", extra=season_fit),
        "coef_compare": _with(
            f"SELECT grp AS season, {_r('b_1', 'sif_coef')}, {_r(f'b_{len(SEASON_PREDICTORS)}', 'coast_coef')}, "
            f"{_hemisphere('grp')} AS hemisphere FROM fitted", "season_table", extra=season_fit),
        "significance_grid": _with(
            f"SELECT grp AS season, {grid_names} AS predictor, p_value < 0.05 AS significant FROM coef WHERE term IN "
            f"({', '.join(repr(g) for g in grid)})", "season_table", extra=season_fit),
        "stream_ingest": _with(
            f"SELECT sounding_id, {_r('latitude')}, {_r('longitude')}, {_r('xco2')}, datetime, month, datetime_text, local_time, "
            f"city, country, city_key, population, target_name, source_file FROM gated", "gated"),
        "stream_city_month": _with(f"SELECT city_key, month, count(*) AS n_points, {_r('avg(xco2)', 'mean_value')} FROM gated "
                                   "WHERE city <> 'Unknown' GROUP BY 1, 2", "gated"),
        "sink_snapshots": _with("SELECT month, count(*) AS n_rows, CAST(sum(CAST(xco2 AS DECIMAL(18, 2))) AS DOUBLE) AS total "
                                "FROM city_points GROUP BY 1", "city_points"),
        "stream_event_time": _with(
            f"SELECT city_key, month, count(*) AS n_points, {_r('avg(xco2)', 'mean_value')}, coalesce(month + INTERVAL 1 MONTH <= "
            f"(SELECT max(datetime) FROM delivered) - INTERVAL 400 DAY, false) AS closed FROM judged WHERE NOT late GROUP BY 1, 2",
            "gated", extra=DELIVERED),
        "stream_late_rows": _with("SELECT month, delivery AS batch, count(*) AS n_late FROM judged WHERE late GROUP BY 1, 2",
                                  "gated", extra=DELIVERED),
        "quantiles_sketched": _with(
            "SELECT season, p, count(*) AS n, true AS within_bound FROM labelled, "
            "(SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p) WHERE xco2 IS NOT NULL GROUP BY 1, 2", "labelled"),
        "distinct_sketched": _with(
            "SELECT date_trunc('month', datetime)::DATE AS month, count(DISTINCT target_name) AS n_sites, true AS within_bound "
            "FROM xco2 GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT target_name), true FROM xco2", "xco2"),
        "asof_sif": _with(
            f"SELECT sounding_id, x.target_name, x.datetime, s.datetime AS matched_time, {_r('s.Daily_SIF_757nm')} FROM xco2 x ASOF LEFT JOIN "
            "(SELECT target_name, datetime, max(Daily_SIF_757nm) AS Daily_SIF_757nm FROM sif GROUP BY 1, 2) s "
            "ON x.target_name = s.target_name AND x.datetime >= s.datetime", "xco2", "sif"),
        "interval_soundings": _with(
            "SELECT x.target_name, count(*) AS n_pairs, count(DISTINCT sounding_id) AS n_soundings, "
            "CAST(sum(CAST(xco2 AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM xco2 x JOIN (SELECT "
            f"{SITE_NAME.format('o_custkey')} AS target_name, l_shipdate AS opens, l_shipdate + to_days((l_quantity * 10)::INT) AS closes "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey) w ON w.target_name = x.target_name AND opens <= datetime "
            "AND datetime < closes GROUP BY 1", "xco2"),
        "running_city_mean": _with(
            f"SELECT sounding_id, city_key, count(*) OVER w AS n_running, "
            f"{_r('CAST(sum(CAST(xco2 AS DECIMAL(18, 2))) OVER w AS DOUBLE)', 'sum_running')}, "
            f"{_r('lag(xco2) OVER w', 'previous')} FROM city_points WINDOW w AS (PARTITION BY city_key ORDER BY datetime, sounding_id)",
            "city_points"),
        "rollup_moments": _with(
            f"SELECT hemisphere, season, city, GROUPING(hemisphere) + GROUPING(season) + GROUPING(city) AS n_rolled, count(*) AS n_rows, "
            f"count(v) AS n, {_r('avg(v)', 'mean')}, {_r('stddev_samp(v)', 'std')} FROM (SELECT {_hemisphere('season')} AS hemisphere, season, "
            "city, floor(xco2 / 1000) AS v FROM labelled) GROUP BY ROLLUP (hemisphere, season, city)", "labelled"),
        "trend_grid": _with(
            f"SELECT quadrant, step, {_r('x')}, {_r('intercept + slope * x', 'fitted')} FROM (SELECT *, x1 + (x2 - x1) * step / 79 AS x "
            "FROM lines, (SELECT unnest(range(0, 80)) AS step))", "impact", extra=lines),
        "props_attributes": """SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0
            AND event_id % 23 <> 0 AND event_id % 29 <> 0 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k,
            CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 17 = 0 THEN 'bad k'
            WHEN event_id % 19 = 0 THEN 'not an object' END AS rejected FROM events""",
    }


ORACLES = _sql()
