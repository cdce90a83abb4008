"""Committed batches, snapshots, and months closed by event time."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumetrics.sources.snapshots import SnapshotTable, newest_rows
from plumetrics.streaming import event_time

ROWS = "k string, v int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "table"))


def test_batches_count_once(frame, table):
    with pytest.raises(ValueError):
        table.read()
    assert table.read(ROWS).columns == ["k", "v", "batch"] and table.read(ROWS).count() == 0
    first, second = frame([("a", 1), (None, 2)], ROWS), frame([("a", 3)], ROWS)
    assert table.append(first, 0, ["k"]) and not table.append(second, 0, ["k"])
    assert table.append(second, 1, ["k"]) and table.append(frame([], ROWS), 2, ["k"])
    assert rows_of(table.read().select("k", "v", "batch")) == sorted([("a", 1, 0), (None, 2, 0), ("a", 3, 1)], key=repr)
    assert table.newest() == 2


def test_a_killed_write_is_not_seen(frame, table, monkeypatch):
    rows = frame([("a", 1)], ROWS)

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_commit", killed)
        with pytest.raises(RuntimeError):
            table.append(rows, 0)
    assert table.read(ROWS).count() == 0 and not table.committed(0)
    assert table.append(rows, 0)
    assert rows_of(table.read()) == [("a", 1, 0)]


def test_two_writers_of_a_batch(frame, table):
    rows = frame([("a", 1)], ROWS)
    for attempt in [table._write(rows, 0, ()) for _ in range(2)]:  # both wrote before either had committed
        table._commit(0, attempt, rows.schema, whole=False)
    assert rows_of(table.read()) == [("a", 1, 0)]


def test_compaction(frame, table):
    for batch, v in enumerate([1, 2, 3]):
        table.append(frame([("a", v), (f"b{batch}", v)], ROWS), batch)
    before = table.read()
    assert table.compact(lambda rows: newest_rows(rows, ["k"]))
    want = [("a", 3, 2), ("b0", 1, 2), ("b1", 2, 2), ("b2", 3, 2)]
    assert rows_of(table.read()) == want and before.count() == 6
    assert not table.append(frame([("late", 0)], ROWS), 1)  # the snapshot stands for it
    assert table.append(frame([("a", 9)], ROWS), 3)
    assert len(table.visible()) == 2
    assert rows_of(newest_rows(table.read(), ["k"])) == [("a", 9), ("b0", 1), ("b1", 2), ("b2", 3)]
    assert table.replace(frame([("z", 1)], ROWS), 4) and rows_of(table.read()) == [("z", 1, 4)]


SOUNDINGS = "city_key string, month date, datetime timestamp, xco2 double"


def soundings(frame, rows):
    days = [(c, datetime.fromisoformat(d), x) for c, d, x in rows]
    return frame([(c, d.date().replace(day=1), d, x) for c, d, x in days], SOUNDINGS)


def test_late_rows_and_closed_months(spark, frame, tmp_path, monkeypatch):
    target = str(tmp_path / "months")
    batches = [
        [("a", "2021-01-05", 1.0), ("a", "2021-02-10", 2.0)],
        [("a", "2021-01-20", 3.0), ("b", "2021-03-20", 4.0)],      # January is open still: the mark is 11 January
        [("a", "2021-01-25", 5.0), ("b", "2021-02-03", 6.0)],      # the mark is 18 February: January is closed
        [("b", "2021-02-04", 7.0), ("c", "2021-06-01", 8.0)], [],
        [("c", "2021-04-01", 9.0)],
    ]
    assert event_time.month_means(spark, target).count() == 0 and event_time.late_rows(spark, target).count() == 0
    for batch, rows in enumerate(batches):
        if batch == 2:  # cut off between the closed months and the state, then run again
            with monkeypatch.context() as patch:
                patch.setattr(SnapshotTable, "replace", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(RuntimeError):
                    event_time.take_batch(soundings(frame, rows), batch, target, 30)
            assert event_time.late_rows(spark, target).count() == 0
        for _ in range(2):  # a batch that runs again changes nothing
            event_time.take_batch(soundings(frame, rows), batch, target, 30)
    got = {(r["city_key"], str(r["month"])): (r["n_points"], r["mean_value"], r["closed"]) for r in event_time.month_means(spark, target).collect()}
    assert got == {
        ("a", "2021-01-01"): (2, 2.0, True), ("a", "2021-02-01"): (1, 2.0, True), ("b", "2021-02-01"): (2, 6.5, True),
        ("b", "2021-03-01"): (1, 4.0, True), ("c", "2021-06-01"): (1, 8.0, False)}
    late = event_time.late_rows(spark, target)
    assert rows_of(late.select("city_key", "xco2", "batch")) == [("a", 5.0, 2), ("c", 9.0, 5)]
    state = SnapshotTable(spark, f"{target}/open").read()
    assert state.filter(F.col("month").isNotNull()).count() == 1  # closed months have left it
