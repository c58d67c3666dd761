from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.schemas import TABLES
from tidewater.sources import tables
from tidewater.sources.tables import KeyedTable, Store

SCHEMA = "time timestamp, ticker string, x double"


def frame(spark, rows):
    return spark.createDataFrame(rows, "time string, ticker string, x double").withColumn("time", F.to_timestamp("time"))


def content(table, *days):
    return sorted(((r["day"], str(r["time"]), r["ticker"], r["x"]) for r in table.read(*days).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["time", "ticker"], "time")


A, B = "2024-01-01 10:00:00", "2024-01-02 11:00:00"


def test_keys_are_replaced_and_other_days_stay_where_they_are(spark, table):
    assert table.version().number == -1 and table.read().count() == 0
    table.merge(frame(spark, [(A, "T", 1.0), (A, "U", 2.0), (B, "T", 3.0), (None, "T", 4.0)]))
    before = table.version().folders
    table.merge(frame(spark, [(A, "T", 5.0), (A, "V", 6.0), (None, "T", 7.0)]))
    assert content(table) == [("2024-01-01", A, "T", 5.0), ("2024-01-01", A, "U", 2.0), ("2024-01-01", A, "V", 6.0), ("2024-01-02", B, "T", 3.0), ("none", "None", "T", 7.0)]
    assert content(table, "2024-01-02") == [("2024-01-02", B, "T", 3.0)]
    after = table.version().folders
    assert after["2024-01-02"] == before["2024-01-02"] and after["2024-01-01"] != before["2024-01-01"]
    table.tidy(1)
    assert len(table.store.names("data")) == 2 and table.read().count() == 5


def test_a_batch_counts_once_and_keys_repeat_within_it(spark, table):
    rows = frame(spark, [(A, "T", 1.0), (A, "T", 3.0), (A, "T", 2.0), (A, None, 1.0), (A, None, 0.0)])
    table.merge(rows, ("one", 4), latest="x")
    for number in (4, 3):
        table.merge(frame(spark, [(A, "T", 9.0)]), ("one", number))
    assert content(table) == [("2024-01-01", A, "T", 3.0), ("2024-01-01", A, None, 1.0)]
    assert table.version().number == 0
    table.merge(frame(spark, [(A, "T", 8.0)]), ("two", 0))
    table.merge(frame(spark, []), ("one", 5))
    assert [r[3] for r in content(table) if r[2]] == [8.0] and table.version().applied == {"one": 5, "two": 0}


def test_another_writer_was_first(spark, table, monkeypatch):
    table.merge(frame(spark, [(A, "T", 1.0)]))
    other = KeyedTable(spark, table.path, table.key, "time")
    publish, calls = Store.publish, []

    def late(self, text, name):
        calls.append(name)
        if len(calls) == 1:  # between the reading and the publishing of the first
            other.merge(frame(spark, [(A, "U", 2.0), (B, "U", 2.0)]), ("other", 0))
        return publish(self, text, name)

    monkeypatch.setattr(Store, "publish", late)
    table.merge(frame(spark, [(A, "T", 5.0), (A, "V", 6.0)]), ("mine", 0))
    assert content(table) == [("2024-01-01", A, "T", 5.0), ("2024-01-01", A, "U", 2.0), ("2024-01-01", A, "V", 6.0), ("2024-01-02", B, "U", 2.0)]
    assert table.version().applied == {"mine": 0, "other": 0} and table.version().number == 2


def test_new_columns_and_given_types(spark, table):
    table.merge(frame(spark, [(A, "T", 1.0)]))
    table.merge(spark.createDataFrame([(B, "T", 2, "n")], "time string, ticker string, x int, note string").withColumn("time", F.to_timestamp("time")))
    got = sorted((r["x"], r["note"]) for r in table.read().collect())
    assert got == [(1.0, None), (2.0, "n")] and dict(table.read().dtypes)["x"] == "double"


def test_a_run_that_ended_between_two_tables_is_made_up_for(spark, tmp_path, monkeypatch):
    kept = tables.open_tables(spark, f"file://{tmp_path}/all")
    assert set(kept) == set(TABLES) and all(t.read().count() == 0 for t in kept.values())
    assert [f.name for f in kept["price_ticks"].read().schema][:-1] == [c.split()[0] for c in TABLES["price_ticks"][0].split(", ")]
    rows = spark.createDataFrame([("T", 1_700_000_000_000, -0.9, True, ["price"]), ("U", 1_700_000_000_000, 0.0, False, [])], "ticker string, window_end long, anomaly_score double, is_anomaly boolean, drifted array<string>")
    write = tables.scored_batch(kept, "s")
    with monkeypatch.context() as m:
        m.setattr(kept["anomaly_alerts"], "merge", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write(rows, 0)
    assert [kept[n].read().count() for n in ("feature_vectors", "anomaly_alerts", "drift_events")] == [2, 0, 0]
    again = tables.scored_batch(tables.open_tables(spark, f"file://{tmp_path}/all"), "s")
    for _ in range(2):
        again(rows, 0)
    assert [kept[n].read().count() for n in ("feature_vectors", "anomaly_alerts", "drift_events")] == [2, 1, 1]
    with pytest.raises(ValueError):
        tables.scored_batch(kept)(rows, 1)
