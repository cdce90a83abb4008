from pyspark.sql import functions as F

from plumetrics.sources import readers, schemas
from plumetrics.streaming import ingest


def folder(frame, tmp_path, n=200):
    rows = []
    for i in range(n):
        stamp = "bad" if i % 10 == 0 else f"2021-0{1 + i % 3}-05 10:00:00"
        rows.append((stamp, "10:00", str(i % 50), "2.5", str(400 + i % 7), f"city{i % 4}" if i % 9 else "", "X", "5", "t", "f"))
    text = frame(rows, ", ".join(f"{c} string" for c in schemas.SOUNDING_TEXT.names))
    path = str(tmp_path / "in")
    text.repartition(5).write.option("header", True).csv(path)
    return text, path


def test_ingest_equals_batch_and_does_not_repeat(spark, frame, tmp_path):
    text, path = folder(frame, tmp_path)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_available(ingest.text_stream(spark, path, schemas.SOUNDING_TEXT, 2), target, checkpoint)
    got = spark.read.parquet(target)
    want = readers.ingest_gate(text)
    assert got.count() == want.count() == 180
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_means_equal_batch_over_several_runs(spark, frame, tmp_path):
    text, path = folder(frame, tmp_path)
    target, checkpoint = str(tmp_path / "state"), str(tmp_path / "check")

    def run():
        stream = ingest.text_stream(spark, path, schemas.SOUNDING_TEXT, 2)
        ingest.upsert_available(ingest.city_month_running(stream), target, checkpoint)

    run()
    text.write.mode("append").option("header", True).csv(path)  # the same soundings arrive again
    run()
    got = {(r.city_key, r.month): (r.n_points, round(r.mean_value, 9)) for r in ingest.latest(spark, target).collect()}
    both = text.union(text)
    want = readers.ingest_gate(both).filter(F.col("city") != "Unknown").groupBy("city_key", "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("xco2").alias("m"))
    assert got == {(r.city_key, r.month): (r.n, round(r.m, 9)) for r in want.collect()}
