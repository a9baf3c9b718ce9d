import datetime as dt

import pytest

from wakeline.plans import reference

EVENT = "event_id bigint, user_id bigint, ts timestamp, value double, event_type string"


@pytest.fixture
def events(spark, tmp_path):
    def at(minute):
        return dt.datetime(2024, 1, 1, 0, minute, tzinfo=dt.timezone.utc)

    # Headings repeat every 360 event ids.
    rows = [(1, 7, at(0), 50.0, "view"), (361, 7, at(0), 50.0, "view"), (721, 7, at(9), 50.0, "view"), (1081, 7, at(0), 60.0, "view"), (2, 7, at(3), 1.0, "error"), (3, 7, at(4), 1.0, "click"), (4, 8, at(5), 1.0, "error"), (5, 8, at(6), 1.0, None)]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_pings_differing_in_one_column_stay(spark, events):
    got = reference.QUERIES["dedup_exact"](spark, events)
    assert set(got.columns) == {"mmsi", "t", "lat", "lon", "speed", "heading", "ship_type"}
    assert got.count() == 7


def test_known_ship_types_stay(spark, events):
    got = dict(tuple(r) for r in reference.QUERIES["ship_type_fill"](spark, events).collect())
    assert got == {1: "view", 361: "view", 721: "view", 1081: "view", 2: "click", 3: "click", 4: None, 5: None}
