"""The general data problems: nulls, blanks, repeats, hot keys, empty tables and clashing names."""

import random

import pytest

from loomgrid.operators import grid, spikes
from loomgrid.operators.orphans import orphan_references
from loomgrid.operators.timestamps import call_times, received_times, zone_table
from pyspark.sql import functions as F

CALLS = "call_id long, trip_id string, stop_id string, active int, domain string, period string"
PARENTS = "id string, a int, z int, key string"


def orphans(spark, calls, trips, stops):
    parents = {"trip_id": (spark.createDataFrame(trips, PARENTS), "id", "a", "z"), "stop_id": (spark.createDataFrame(stops, PARENTS), "id", "a", "z")}
    rows, keys = orphan_references(spark.createDataFrame(calls, CALLS), "call_id", "active", parents)
    return sorted((r.row_id, r.domain) for r in rows.collect()), sorted((r.domain, r.key, r.period, r.n) for r in keys.collect())


def test_orphans(spark):
    """Columns of the inputs may be called as the operator calls its own."""
    calls = [(1, "T1", "s1", 20240101, "d", "p"), (2, " t1 ", None, 20240101, "d", "p"), (3, "t2", "s9", 20240101, None, None), (4, "", " ", 20240101, "d", "p"), (5, "t1", "s1", None, "d", "p"), (3, "t2", "s9", 20240101, None, None)]
    rows, keys = orphans(spark, calls, [("t1", 20240101, 20991231, "x"), ("T2", 20240201, 20240301, "x"), (None, 1, 2, "x")], [("S1", 20240101, 20240101, "x"), ("s1", 20240101, 20240101, "x"), ("s9", 20240101, None, "x")])
    assert rows == [(3, "stop_id"), (3, "stop_id"), (3, "trip_id"), (3, "trip_id"), (5, "stop_id"), (5, "trip_id")]
    assert ("stop_id", "s9", 20240101, 2) in keys and ("trip_id", "t1", -1, 1) in keys


@pytest.mark.parametrize("calls, trips", [([], []), ([(1, "t", None, 1, "d", "p")], []), ([], [("t", 1, 2, "x")])])
def test_orphans_of_empty_tables(spark, calls, trips):
    assert orphans(spark, calls, trips, [])[0] == [(1, "trip_id")] * len(calls)


def test_orphans_equal_brute_force_with_a_hot_key(spark):
    rng = random.Random(0)
    calls = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(40)}", f"s{rng.randrange(40)}", 20240101 + rng.randrange(4), "d", "p") for i in range(400)]
    held = [(f"{p}{rng.randrange(40)}", 20240101 + rng.randrange(3), 20240102 + rng.randrange(3), "x") for p in "ts" for _ in range(60)]
    trips, stops = [h for h in held if h[0][0] == "t"], [h for h in held if h[0][0] == "s"]
    there = lambda key, day, table: any(k == key and a <= day <= z for k, a, z, _ in table)
    want = sorted([(c[0], "trip_id") for c in calls if not there(c[1], c[3], trips)] + [(c[0], "stop_id") for c in calls if not there(c[2], c[3], stops)])
    assert orphans(spark, calls, trips, stops)[0] == want


def series(spark, rows):
    frame = spark.createDataFrame(rows, "station string, direction boolean, t long, readings int")
    return grid.regular_series(frame, [F.col("station"), F.col("direction")], F.col("t"), F.col("station").isNotNull())


def test_grid(spark):
    out = series(spark, [("a", True, 10, 1), ("a", True, 299, 1), ("a", True, 2000, 1), ("a", None, 700, 1), (None, True, 5, 1), ("b", True, 0, 1), ("b", True, None, 1)]).collect()
    mine = {r.period_start: (r.readings, r.last_reading, r.status) for r in out if r.station == "a" and r.direction}
    assert mine == {0: (2, 299, "observed"), 300: (0, 299, "carried"), 600: (0, 299, "carried"), 900: (0, 299, "carried"), 1200: (0, None, "missing"), 1500: (0, None, "missing"), 1800: (1, 2000, "observed")}
    assert [r.period_start for r in out if r.direction is None] == [600] and not [r for r in out if r.station in (None, "b")]


def test_grid_of_nothing(spark):
    assert series(spark, []).count() == 0


ZONES = [(1, "Europe/Paris"), (2, " europe/PARIS "), (3, "UTC+2"), (4, "nowhere"), (5, None), (6, "EST"), (7, "UTC"), (7, "Asia/Tokyo")]


def zones(spark):
    return zone_table(spark.createDataFrame(ZONES, "manifest_id int, tz string"), "manifest_id", "tz")


def test_zones(spark):
    got = {r.manifest_id: r.zone for r in zones(spark).collect()}
    assert got == {1: "Europe/Paris", 2: "Europe/Paris", 3: "+02:00", 4: None, 5: None, 6: "-05:00", 7: None}


@pytest.mark.parametrize(
    "text, manifest, want",
    [
        ("2024-03-31 02:30:00", 1, -1), ("2024-10-27 02:30:00", 1, -1), ("2024-10-27 02:30:00 CEST", 1, 1729989000_000000), ("2024-07-01T12:00:00,5", 2, 1719828000_500000), ("2024-07-01 12:00", 4, -1), ("2024-07-01 12:00Z", 4, 1719835200_000000),
        ("07/01/2024 12:00 AM", 3, 1719784800_000000), ("1.7.2024 13:00:00 +0200", 4, 1719831600_000000), ("Mon, 1 Jul 2024 12:00:00 GMT", 5, 1719835200_000000), ("20240701T120000Z", 5, 1719835200_000000), ("1719835200000", 5, 1719835200_000000),
        ("1719835200.25", 5, 1719835200_250000), ("2024-02-30 00:00:00Z", 1, -1), ("2024-07-01 25:00:00Z", 1, -1), ("soon", 1, -1), ("12:00:00", 1, 1719828000_000000), ("25:00:00", 1, 1719874800_000000), ("12:00:00", 4, -1), ("2024-07-01 12:00:00 XYZ", 1, -1),
    ],
)
def test_received_times(spark, text, manifest, want):
    rows = spark.createDataFrame([(1, manifest, 20240701, text, "z")], "raw_id long, manifest_id int, service_date int, stop_timestamp string, zone_text string")
    assert [r.norm_value for r in received_times(rows, zones(spark)).collect()] == [want]


def test_call_times(spark):
    texts = {"7:05:09": 25509, "24:30:00": None, "070509": 25509, "709": 709, "076000": -1, "PT7H5M9S": 25509, "12:30:00 am": 1800, "7.05": 25500, "01:00:00+1": 90000, "2024-07-01 07:05:09": 25509, " ": None, None: None, "23:59:60": -1}
    rows = spark.createDataFrame([(i, 1, 20240701, t, None) for i, t in enumerate(texts)], "call_id long, manifest_id int, gtfs_active_date int, arrival_time string, departure_time string")
    got = {r.record_id: r.norm_value for r in call_times(rows, zones(spark)).collect()}
    assert got == {i: v for i, v in enumerate(texts.values()) if v is not None}


def test_spikes_of_odd_tables(spark):
    schema = "row_id long, service_date int, route_id string, direction_id boolean, start_time int, stop_sequence int, stop_id string, parent_station string, trunk_route_id string, vehicle_id string, stop_timestamp long, move_timestamp long, dwell_time_seconds long, travel_time_seconds long, headway_trunk_seconds long, field string"
    rows = [(i, *[None] * 11, v, v, v, "x") for i, v in enumerate((None, -5, 0, 30, 99999))]
    found = {(r.row_id, r.field_name): r.reason for r in spikes.implausible(spark.createDataFrame(rows, schema)).collect()}
    assert found == {(1, "dwell_time_seconds"): "impossible", (1, "travel_time_seconds"): "impossible", (1, "headway_trunk_seconds"): "impossible", (2, "travel_time_seconds"): "impossible", (2, "headway_trunk_seconds"): "impossible", **{(4, f): "impossible" for f in ("dwell_time_seconds", "travel_time_seconds", "headway_trunk_seconds")}}
    assert spikes.implausible(spark.createDataFrame([], schema)).count() == 0
