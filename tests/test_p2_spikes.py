"""Spikes and stuck values on small made tables."""

import math



from loomgrid.operators import spikes as p2





def _rows(spark, values, source="a", hour=10, start=0):
    rows = [(start + i, "travel_time_seconds", source, hour, v, round(math.log(v + 1) * p2.BINS)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, field string, source string, hour int, value long, bin int")


def test_fit_decides_the_cutoff(spark):
    """A narrow source has a near cutoff: 180 s lies far outside 100 to 109 s, though it isn't 2.2 times as much."""
    found = p2.spikes(_rows(spark, [100 + i % 10 for i in range(1000)] + [180])).select("value").collect()
    assert [r.value for r in found] == [180]


def test_wide_source_has_a_far_cutoff(spark):
    """The same value among a source's wide but regular ones is no case."""
    assert p2.spikes(_rows(spark, [60 + i % 120 for i in range(1000)] + [190])).count() == 0


def _calls(spark, lanes):
    rows = [(20240101, f"V{lane}", "dwell_time_seconds", "R", True, 0, i, v, 1000 * lane + i) for lane, values in enumerate(lanes) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "service_date int, vehicle string, field string, route_id string, direction_id boolean, start_time int, stop_sequence int, value long, row_id long")


def _regular(n, seed):
    """Neighbours are equal once in 25."""
    return [1000 * seed + (i - 1 if i % 25 == 0 else i) for i in range(1, n + 1)]


def test_stuck_vehicles_hide_no_shorter_run(spark):
    """A third of all calls is stuck; a run of nine of another vehicle is found all the same."""
    lanes = [_regular(100, s) for s in range(20)] + [[7] * 100 for _ in range(10)] + [_regular(40, 50) + [5] * 9 + _regular(40, 51)]
    found = p2.stuck(_calls(spark, lanes)).groupBy("vehicle").count().collect()
    assert {r.vehicle: r["count"] for r in found} == {f"V{i}": 100 for i in range(20, 30)} | {"V30": 9}


def test_length_is_the_same_at_every_size(spark):
    """A run of five is judged alike in a small table and in one of 50 times the rows."""
    run = _regular(30, 900) + [5] * 5 + _regular(30, 901)
    small, large = [[run] + [_regular(100, s) for s in range(n)] for n in (4, 200)]
    assert p2.stuck(_calls(spark, small)).count() == p2.stuck(_calls(spark, large)).count()


def test_wrongly_written_trunk(spark):
    """A row alone in the source of a wrong trunk is judged by the source of its route."""
    values = [300 + i % 40 for i in range(400)]
    rows = [(i, 20240101, "R1", True, 60 * i, 1, "S1", "P1", "Amber" if i else "Fern", f"V{i}", 1704103200 + i, None, None, None, v if i else 5742) for i, v in enumerate(values)]
    schema = (
        "row_id long, service_date int, route_id string, direction_id boolean, start_time int, stop_sequence int, stop_id string, parent_station string, trunk_route_id string, "
        "vehicle_id string, stop_timestamp long, move_timestamp long, dwell_time_seconds long, travel_time_seconds long, headway_trunk_seconds long"
    )
    found = p2.implausible(spark.createDataFrame(rows, schema)).collect()
    assert [(r.row_id, r.reason) for r in found] == [(0, "spike")]
