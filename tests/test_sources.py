import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumetrics.plans import pipelines
from plumetrics.session import cut_lineage_counted, scratch_root
from plumetrics.sources import readers, schemas


def test_header_names():
    assert readers.clean_header(["Target Name", "Site.Center-WKT", "2x", "city", "city", ".geo", "_a"]) == [
        "Target.Name", "Site.Center.WKT", "X2x", "city", "city.1", ".geo", "X_a"]


def test_csv_by_name_with_missing_values(spark, tmp_path):
    path = tmp_path / "site.csv"
    path.write_text(
        "population,Target Name,Site Center WKT,Site Shape WKT,city,country,gdp_bil_usd,coastal_km,is_coastal,extra\n"
        '1000,a,POINT (1 2),"POLYGON ((1 2, 3 4))",A,X,5.5,NA,True,9\n'
        "\n"
        ",b,p,s,NA,Y,junk,NaN,False,9\n"
    )
    df = readers.read_csv(spark, str(path), schemas.SITE_FILE)
    sites = readers.select_renamed(df, schemas.SITE_COLUMNS).withColumn("is_coastal", readers.coastal_flag(F.col("is_coastal")))
    a, b = sites.orderBy("target_name").collect()
    assert (a.wkt_shape, a.population, a.gdp_bil_usd, a.coastal_km, a.is_coastal) == ("POLYGON ((1 2, 3 4))", 1000.0, 5.5, None, True)
    assert (b.city, b.population, b.gdp_bil_usd, b.coastal_km, b.is_coastal) == (None, None, None, None, False)
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv(spark, str(path), schemas.NO2_FILE)


def test_csv_files_of_other_headers_are_read_by_name(spark, tmp_path):
    schema = "city string, xco2 double, `site.name` string"
    want = T.StructType.fromDDL(schema)
    folder = tmp_path / "in [1]"
    for day, name, text in (
        (1, "a.csv", "city,xco2,Site Name\nRome,1.5,r\n".replace("Site Name", "site name")),
        (1, "b b.csv", "site name,extra,xco2,city\np,9,NA,Paris\n"),
        (2, "c.csv", "xco2,city,site name\n2.5,Oslo,\n"),
        (2, "d%20.csv", "city,xco2,site name\n"),
        (2, "empty.csv", ""),
    ):
        (folder / f"day={day}").mkdir(parents=True, exist_ok=True)
        (folder / f"day={day}" / name).write_text(text)
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    got = readers.read_csv(spark, path, want)
    rows = [("Oslo", 2.5, None), ("Paris", None, "p"), ("Rome", 1.5, "r")]
    assert sorted(map(tuple, got.collect())) == rows and got.schema.names == want.names
    assert len(readers.headers_of(spark, path)) == 3
    plain = tmp_path / "plain"
    for file in folder.rglob("*.csv"):
        (plain / file.parent.name).mkdir(parents=True, exist_ok=True)
        (plain / file.parent.name / file.name).write_text(file.read_text())
    dated = readers.read_csv(spark, str(plain), T.StructType.fromDDL("city string, day int")).collect()
    assert sorted(map(tuple, dated)) == [("Oslo", 2), ("Paris", 1), ("Rome", 1)]
    (plain / "day=1" / "lacks.csv").write_text("city,site name\nBern,x\n")
    with pytest.raises(ValueError, match="missing columns .*xco2.*lacks.csv"):
        readers.read_csv(spark, str(plain), want)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no file with a header"):
        readers.read_csv(spark, str(tmp_path / "none"), want)


def test_parquet_scan_prunes_and_drops_nan(spark, frame, tmp_path, capsys):
    path = str(tmp_path / "p")
    frame([(1, float("nan"), "x"), (2, 1.5, "y")], "id bigint, v double, s string").write.parquet(path)
    df = readers.read_parquet(spark, path, ["id", "v"])
    assert {r.id: r.v for r in df.collect()} == {1: None, 2: 1.5}
    df.explain()
    assert "ReadSchema: struct<id:bigint,v:double>" in capsys.readouterr().out


def text_rows():
    good = ("2020-01-05 10:00:00", "10:00", "1.5", "2.5", "410.5", " Rome ", "Italy", "5", "t1", "f")
    rows = [good]
    for i, bad in ((0, "soon"), (2, ""), (3, "NaN"), (4, "Infinity"), (4, None)):
        rows.append(tuple(bad if j == i else v for j, v in enumerate(good)))
    rows.append(("2020-02-05T10:00:00Z", None, "1.5deg", " 2.5", "411", " ", None, "many", None, None))
    return rows


def test_gate_and_tally(frame):
    text = frame(text_rows(), ", ".join(f"{n} string" for n in schemas.SOUNDING_TEXT.names))
    tally = readers.ingest_tally(text).first()
    assert (tally.n_rows, tally.n_valid, tally.n_rejected) == (7, 2, 5)
    a, b = readers.ingest_gate(text).orderBy("datetime").collect()
    assert (a.city_key, a.population, str(a.month), a.xco2) == ("Rome|||Italy", 5.0, "2020-01-01", 410.5)
    assert (b.city_key, b.population, b.latitude, b.target_name) == ("Unknown|||", None, 1.5, "")


def test_schema_report(frame):
    got = readers.schema_report(frame([(1, None), (2, "x")], "a int, b string"), "t").orderBy("position").collect()
    assert [tuple(r) for r in got] == [("t", 0, "a", 2), ("t", 1, "b", 1)]


def test_scratch_folder_comes_from_the_session(spark, frame):
    root = scratch_root(spark)
    assert root and scratch_root(spark) == root
    df, n = cut_lineage_counted(frame([(1,), (2,)], "a int"))
    assert n == 2 and df.count() == 2
    empty, n = cut_lineage_counted(frame([], "a int"))
    assert n == 0 and empty.isEmpty()


def test_upper_quartile_quadrant_ignores_missing(frame):
    rows = [(f"c{i}", float(i), float(100 - i) if i % 2 else None) for i in range(20)] + [("gap", None, None)]
    df = frame(rows, "city string, xco2_ppm double, annual_co2_em_mtco2 double")
    got = {r.city: r.quadrant for r in pipelines.with_upper_quartile_quadrant(df).collect()}
    assert got["gap"] == "LOW_both" and got["c18"] == "LOW_emissions_HIGH_conc"
    assert got["c1"] == "HIGH_emissions_LOW_conc" and got["c19"] == "LOW_emissions_HIGH_conc"
