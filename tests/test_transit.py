"""Schedules, snapshots, transitions, the event mesh and the population audit on small made facts."""

import datetime
import json

import pytest

from loomgrid.sources.files import SourceError, scan_zip_tables
from loomgrid.transit import event_mesh as M
from loomgrid.transit import population as P
from loomgrid.transit import realtime as R
from loomgrid.transit import schedule as S
from loomgrid.transit import transition as T

TEXTS = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\na,A,u,Europe/Paris\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,0,0,20240101,20240131\n",
    "calendar_dates": "service_id,date,exception_type\nw,20240106,1\nw,20240102,2\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\ns1,One,1.5,2.5\ns2,Two,1.6,2.5\ns3,Three,1.7,2.5\n",
    "routes": "route_id,agency_id,route_type\nr,a,3\n",
    "trips": "route_id,service_id,trip_id\nr,w,t1\nr,w,t2\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,23:50:00,23:50:00,s1,1\nt1,24:10:00, 24:11:00,s2,2\nt1,25:01:02,25:01:02,s3,3\nt2,6:00:00,6:00:00,s1,1\nt2,6:20:00,6:20:00,s3,2\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nt2,6:00:00,8:00:00,600\n",
}


def archive(texts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in texts.items():
            z.writestr(f"{n}.txt", "﻿" + t)
    return out.getvalue()


def tables(spark, **changes):
    return S.parse(scan_zip_tables(spark, archive(TEXTS | changes), ["stops", "trips"], S.REQUIRED))


@pytest.fixture(scope="module")
def schedule(spark):
    return tables(spark)[0]


def test_schedule_is_typed_and_whole(spark, schedule):
    found, bad = tables(spark)
    S.require(bad, S.violations(found))
    calls = {(r.trip_id, r.stop_sequence): (r.arrival_time, r.departure_time) for r in schedule["stop_times"].collect()}
    assert calls[("t1", 2)] == (87000, 87060) and calls[("t1", 3)] == (90062, 90062)
    segments = {(r.from_stop_id, r.to_stop_id): r.occurrences for r in S.segments(schedule["trips"], schedule["stop_times"]).collect()}
    assert segments == {("s1", "s2"): 1, ("s2", "s3"): 1, ("s1", "s3"): 1}
    assert sorted((r.trip_id, r.place, r.stop_id) for r in S.ordered_calls(schedule["stop_times"]).collect()) == [("t1", 0, "s1"), ("t1", 1, "s2"), ("t1", 2, "s3"), ("t2", 0, "s1"), ("t2", 1, "s3")]


def test_broken_rules_are_named(spark):
    """One schedule with a fault of every kind."""
    found, bad = tables(
        spark, trips=TEXTS["trips"] + "r,w,t1\nr,w,t3\nq,w,t2x\n", stop_times=TEXTS["stop_times"] + "t1,26:00:00,25:00:00,s1,4\nt2x,,,s1,1\nt2x,7:00,7:00:00,s1,2\n",
        frequencies=TEXTS["frequencies"] + "t2,7:30:00,9:00:00,600\n", stops=TEXTS["stops"] + "s4,Four,91,2\n",
    )
    rules = {r.rule for r in S.violations(found).unionByName(bad).collect()}
    assert rules == {"trips repeated", "trip of less than two calls", "trips.route_id dangling", "stop_times out of range", "terminal call without time", "unreadable arrival_time", "frequencies overlap", "stops out of range"}


def test_broken_schedules_are_refused(spark):
    found, bad = tables(spark, trips=TEXTS["trips"] + "r,w,t1\n")
    with pytest.raises(S.ScheduleError, match="trips repeated: t1"):
        S.require(bad, S.violations(found))


@pytest.mark.parametrize("texts, words", [({"stops": "stop_id,stop_id\na,b\n"}, "once"), ({"stops": "stop_id,stop_name\na\n"}, "line 2")])
def test_malformed_archives(spark, texts, words):
    with pytest.raises(SourceError, match=words):
        tables(spark, **texts)
    with pytest.raises(SourceError, match="ZIP"):
        scan_zip_tables(spark, b"no archive", [], ["stops"])
    with pytest.raises(SourceError, match="missing"):
        scan_zip_tables(spark, archive({"stops": TEXTS["stops"]}), ["trips"], ["stops"])


def test_service_days(spark, schedule):
    dates = spark.createDataFrame([(datetime.date(2024, 1, d),) for d in (1, 2, 6, 7)] + [(datetime.date(2024, 2, 1),)], "service_date date")
    exceptions = schedule["calendar_dates"].selectExpr("service_id", "date as service_date", "exception_type = 1 as added")
    assert {r.service_date.strftime("%m%d"): r.active for r in S.service_active(schedule["calendar"], exceptions, dates).collect()} == {"0101": True, "0102": False, "0106": True, "0107": False, "0201": False}


def message(**changes):
    live = {
        "id": "v", "trip": {"trip_id": "t1", "route_id": "r", "start_date": "20240101", "start_time": "23:50:00", "schedule_relationship": "SCHEDULED"},
        "vehicle": {"vehicle_id": "bus", "timestamp": 950, "current_stop_sequence": 2, "current_stop_id": "s2", "current_status": "IN_TRANSIT_TO"},
        "trip_update": {"timestamp": 940, "delay": 120, "delay_at_stop_sequence": 2, "stop_time_updates": [{"stop_sequence": 3, "stop_id": "s3", "arrival": {"delay": 60, "time": 2000}}]},
    }
    ended = {"id": "c", "trip": {"trip_id": "t2", "route_id": "r", "start_date": "20240101", "start_time": "6:10:00", "schedule_relationship": "CANCELED"}}
    root = {"header": {"incrementality": "FULL_DATASET", "timestamp": 1000}, "entities": [live, ended]}
    for path, value in changes.items():
        at = root
        *steps, last = path.split("__")
        for s in steps:
            at = at[int(s) if s.isdigit() else s]
        at[last] = value
    return json.dumps(root)


def texts(spark, *messages):
    return spark.createDataFrame([(m,) for m in messages], "value string")


def test_snapshot_is_normalised(spark, schedule):
    s = R.normalise(texts(spark, message()), schedule)
    assert {(r.trip_id, r.relationship, r.observed_at, r.delay) for r in s.trips.collect()} == {("t1", "SCHEDULED", 940, 120), ("t2", "CANCELED", 1000, None)}
    assert s.vehicles.count() == 1 and s.predictions.count() == 1


BROKEN = [
    ("header__incrementality", "DIFFERENTIAL", "only full messages"),
    ("entities__0__trip__route_id", "q", "route differs"),
    ("entities__0__trip__trip_id", "zz", "trip not planned"),
    ("entities__0__trip__start_date", "20240102", "service inactive"),
    ("entities__0__trip__start_date", "20249999", "instance incomplete"),
    ("entities__0__trip__start_time", "23:00:00", "start differs from first departure"),
    ("entities__1__trip__start_time", "9:00:00", "start outside frequencies"),
    ("entities__0__vehicle__timestamp", 1001, "vehicle newer than feed"),
    ("entities__0__vehicle__current_stop_id", "s1", "vehicle at another stop"),
    ("entities__0__vehicle__current_status", "FLYING", "unknown status"),
    ("entities__0__trip_update__delay_at_stop_sequence", 1, "delay of another stop"),
    ("entities__0__trip_update__stop_time_updates__0__stop_sequence", 2, "prediction of the past"),
    ("entities__0__trip_update__stop_time_updates__0__arrival", None, "prediction without event"),
    ("entities__1__id", "v", "entity repeated"),
    ("entities__1__trip__schedule_relationship", "ADDED", "unknown relationship"),
]


def test_broken_messages(spark, schedule):
    """Each message breaks one rule; messages are apart in time."""
    messages = [message(**({path: value + 10_000 * k if isinstance(value, int) and value > 1000 else value} | ({"header__timestamp": 1000 + 10_000 * k}))) for k, (path, value, _) in enumerate(BROKEN)]
    assert {rule for _, _, rule in BROKEN} <= {r.rule for r in R.violations(R.facts(texts(spark, *messages)), schedule).collect()}
    assert R.violations(R.facts(texts(spark, message())), schedule).count() == 0


def test_broken_message_is_refused(spark, schedule):
    with pytest.raises(R.RealtimeError, match="route differs"):
        R.normalise(texts(spark, message(entities__0__trip__route_id="q")), schedule)


def snap(spark, at, trips, vehicles):
    return T.Snapshot(at, spark.createDataFrame([(1, 0, *t) for t in trips], "service_date int, start_time int, trip_id string, relationship string, observed_at long"), spark.createDataFrame([(1, 0, *v) for v in vehicles], "service_date int, start_time int, trip_id string, vehicle_id string, observed_at long, stop_sequence int"))


LIMITS = T.Policy(30, 90, 90)


def codes(found):
    return sorted(r.code for r in found.collect())


def test_transitions(spark):
    old = snap(spark, 100, [("a", "CANCELED", 95), ("b", "SCHEDULED", 95), ("gone", "SCHEDULED", 95)], [("b", "v", 95, 5), ("d", "w", 95, 9)])
    new = snap(spark, 120, [("a", "SCHEDULED", 115), ("b", "SCHEDULED", 10), ("new", "SCHEDULED", 118)], [("a", "u", 115, 1), ("b", "v", 110, 4), ("new", "w", 118, 1)])
    found = T.findings(old, new, 121, LIMITS)
    assert codes(found) == ["ACTIVE_AFTER_TERMINAL", "TRIP_OBSERVATION_STALE", "VEHICLE_STOP_REGRESSED"]
    trips, vehicles = T.eligible(new, found)
    assert [r.trip_id for r in trips.collect()] == ["new"] and [(r.trip_id, r.vehicle_id) for r in vehicles.collect()] == [("new", "w")]


def test_feed_findings_block_everything(spark):
    a, b = (snap(spark, at, [("a", "SCHEDULED", at)], [("a", "v", at, 1)]) for at in (100, 90))
    back = T.findings(a, b, 100, LIMITS)
    assert codes(back) == ["FEED_GENERATION_REGRESSED"] and all(f.count() == 0 for f in T.eligible(b, back))
    same = snap(spark, 100, [("a", "SCHEDULED", 99)], [])
    assert codes(T.findings(a, same, 100, LIMITS)) == ["CONTENT_CHANGED_WITHOUT_GENERATION"] and codes(T.findings(a, a, 100, LIMITS)) == []
    late = snap(spark, 200, [("a", "SCHEDULED", 200)], [])
    gap = T.findings(a, late, 200, LIMITS)
    assert codes(gap) == ["FEED_GAP_EXCEEDED"] and T.eligible(late, gap)[0].count() == 1
    with pytest.raises(ValueError):
        T.findings(a, late, 150, LIMITS)


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)] + [(7, None)], "a int, b string")
    prints = {T.fingerprint(f).first()["fingerprint"] for f in (rows, rows.repartition(5), rows.orderBy("b").select("b", "a"))}
    assert len(prints) == 1 and T.fingerprint(rows.limit(50)).first()["fingerprint"] not in prints


def test_projection(spark, schedule):
    trips = spark.createDataFrame([(1, 0, "t1", "SCHEDULED", 120)], "service_date int, start_time int, trip_id string, relationship string, delay int")
    vehicles = spark.createDataFrame([(1, 0, "t1", "bus", "s2")], "service_date int, start_time int, trip_id string, vehicle_id string, stop_id string")
    nodes, edges = T.projection(schedule["stops"], S.segments(schedule["trips"], schedule["stop_times"]), trips, vehicles)
    assert sorted(map(tuple, nodes.collect())) == [("s1", 0.0, False, 0), ("s2", 120.0, True, 1), ("s3", 0.0, False, 0)] and edges.count() == 3


# service_date, start_time, trip, vehicle, direction, stop, station, sequence, move, trunk, headway, row
OBSERVED = [
    (1, 0, "t1", "v1", 0, "s1", "p1", 1, 10, "T", None, 0), (1, 0, "t1", "v1", 0, "s2", "p2", 2, 100, "T", None, 1), (1, 0, "t1", "v1", 0, "s3", "p3", 3, 200, "T", None, 2),
    (1, 60, "t2", "v2", 0, "s1", "p1", 1, 70, "T", 60, 3), (1, 60, "t2", "v2", 0, "s2", "p2", 2, 160, "T", 70, 4), (1, 60, "t2", "v2", 0, "s3", "p3", 3, 270, "T", None, 5), (1, 60, "t2", "v2", 0, "s3", "p3", 3, 999, "T", None, 6),
]
CALLS = [(t, s) for t in ("t1", "t2") for s in (1, 2, 3)]


def mesh_of(spark, rows=OBSERVED, calls=CALLS):
    frame = spark.createDataFrame(rows, "service_date int, start_time int, trip_id string, vehicle_id string, direction_id int, stop_id string, parent_station string, stop_sequence int, move_timestamp long, trunk_route_id string, headway_trunk_seconds long, row_id long")
    return M.lower(M.one_record(frame), spark.createDataFrame(calls, "trip_id string, stop_sequence int"))


def test_event_mesh(spark):
    mesh = mesh_of(spark)
    assert mesh.violations().count() == 0
    assert sorted((r.vehicle_id, r.parent_station, r.departure_timestamp) for r in mesh.events.collect()) == [("v1", "p1", 100), ("v1", "p2", 200), ("v2", "p1", 160), ("v2", "p2", 270)]
    assert sorted((r.kind, r.s_departure_timestamp, r.t_departure_timestamp, r.elapsed_seconds) for r in mesh.relations.collect()) == [("headway", 100, 160, 60), ("headway", 200, 270, 70), ("run", 100, 200, 100), ("run", 160, 270, 110)]
    assert tuple(mesh.cut_audit(200).first()) == (2, 2, 1, 2)
    before = mesh.prefix(201)
    assert before.events.count() == 3 and before.relations.count() == 2
    assert tuple(mesh.degrees().first()) == (2, 2)
    clock = mesh.clock_audit(100, 271, 30).first().asDict()
    assert (clock["cells"], clock["occupied_cells"], clock["target_events"], clock["aggregation_required"]) == (12, 2, 2, False)
    assert tuple(M.replay_headway_audit(mesh).first())[:4] == (2, 2, 0, 0)


def test_mesh_follows_the_plan(spark):
    """Without the planned call between, observed neighbours are no neighbours; a wrong label is a violation."""
    gap = mesh_of(spark, [r for r in OBSERVED if r[7] != 2])
    assert gap.events.count() == 0 and gap.relations.count() == 0
    wrong = mesh_of(spark, [(*r[:10], 61, r[11]) if r[11] == 3 else r for r in OBSERVED])
    assert [(r.rule, r.n) for r in wrong.violations().collect()] == [("label contradicts headway", 1)]


def test_headways_cross_midnight(spark):
    late = [(1, 0, "t1", "v1", 0, "s1", "p1", 1, 5, "T", None, 0), (1, 0, "t1", "v1", 0, "s2", "p2", 2, 86390, "T", None, 1), (2, 0, "t2", "v2", 0, "s1", "p1", 1, 7, "T", None, 2), (2, 0, "t2", "v2", 0, "s2", "p2", 2, 86450, "T", None, 3)]
    assert [(r.kind, r.elapsed_seconds) for r in mesh_of(spark, late).relations.collect()] == [("headway", 60)]


def population(spark, rows):
    return spark.createDataFrame(rows, "row_id long, service_date int, route_id string, trip_id string, start_time int, vehicle_id string, direction_id int, stop_id string, parent_station string, stop_sequence int, move_timestamp long, stop_timestamp long, trunk_route_id string, headway_trunk_seconds long, stop_count int")


def test_population_audit(spark):
    call = lambda i, trip, vehicle, station, seq, move, label=None: (i, 1, "r", trip, 0, vehicle, 0, f"s{seq}", station, seq, move, None, "T", label, 3)
    rows = [call(0, "a", "v", "p1", 1, 10), call(1, "a", "v", "p2", 2, 50), call(2, "a", "v", "p3", 3, 90), call(3, "b", "w", "p1", 1, 20), call(4, "b", "w", "p2", 2, 80, 40), call(5, "b", "w", "p3", 3, 130), call(6, "c", "u", "p1", 1, 7), call(7, "c", "u", "p2", 2, 7)]
    audit = P.Audit(population(spark, rows))
    one = audit.battery().first().asDict()
    assert (one["ambiguous_order_trips"], one["ambiguous_order_rows"]) == (1, 2)
    assert (one["represented_source_rows"], one["physical_departures"], one["run_relations"], one["headway_relations"]) == (4, 4, 2, 2)
    assert (one["exact_headways"], one["mismatched_headways"], one["boundary_only_headways"]) == (1 if one["exact_headways"] else 0, one["mismatched_headways"], one["boundary_only_headways"])
    assert one["median_gap_seconds"] == 30 and one["maximum_gap_seconds"] == 40
    assert P.decision(audit.battery(), 0).first()["decision"] in ("advance", "stop")
    empty = P.Audit(population(spark, []))
    assert empty.battery().first()["physical_departures"] == 0 and empty.groups().count() == 0


def test_struct_distinct_counts_nulls(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, None), (1, 2), (1, None)], "a int, b int")
    assert rows.agg(F.count_distinct(F.struct("a", "b"))).first()[0] == 2


def test_replay_rules_and_extract(spark):
    from loomgrid.transit import replay as RP

    rows = spark.createDataFrame([(0, 20240101, 0, "t1", 1, "r", 0, "s1", 50, None, 10, 10), (1, 20240101, 0, "t1", 1, "r", 0, "s1", 60, None, 10, 10), (2, 20240101, 0, "t1", 2, "q", 0, "s9", None, 500, 20, 20), (3, 20240101, 0, "t9", 1, "r", 0, "s1", 70, None, 1, 1)], "row_id long, service_date int, start_time int, trip_id string, stop_sequence int, route_id string, direction_id int, stop_id string, move_timestamp long, stop_timestamp long, scheduled_arrival_time int, scheduled_departure_time int")
    trips = spark.createDataFrame([("r", "w", "t1", 0, 20240101, 20240102), ("r", "w", "t1", 0, 20230101, 20230102)], "route_id string, service_id string, trip_id string, direction_id int, gtfs_active_date int, gtfs_end_date int")
    calls = spark.createDataFrame([("t1", "0:00:10", "0:00:10", "s1", 1, 20240101, 20240102), ("t1", "0:00:20", "0:00:20", "s2", 2, 20240101, 20240102)], "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, gtfs_active_date int, gtfs_end_date int")
    stops = spark.createDataFrame([("s1", 20200101, 20991231), ("s2", 20200101, 20201231), ("s3", 20200101, 20991231)], "stop_id string, gtfs_active_date int, gtfs_end_date int")
    found = sorted((r.rule, r.key) for r in RP.violations(rows, trips, calls, stops, 0, 100).collect())
    assert found == [("call not planned", "3"), ("call repeated", "0"), ("outside the interval", "2"), ("route or direction differs", "2"), ("stop differs", "2"), ("stop unknown", "2"), ("trip not planned", "3")]
    parts = {n: f.count() for n, f in RP.extract(rows, trips, calls, stops, 0, 100, ["r"]).items()}
    assert parts == {"replay": 3, "trips": 1, "calls": 2, "stops": 1}
