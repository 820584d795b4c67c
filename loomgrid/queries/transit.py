"""Queries of transit facts, and their SQL. Observed calls are the replay table, plans the schedule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.session import table, written
from loomgrid.transit import event_mesh as M
from loomgrid.transit import population as P
from loomgrid.transit import replay as RP
from loomgrid.transit import schedule as S
from loomgrid.transit import transition as T

POLICY = T.Policy(30, 300, 300)


def _replay(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "replay").withColumn("direction_id", F.col("direction_id").cast("int"))


def _audit(spark: SparkSession, folder: str) -> P.Audit:
    return P.Audit(_replay(spark, folder))


def interval_valid_join(spark: SparkSession, folder: str) -> DataFrame:
    """Planned calls of each observed service date whose trip, call and stop are valid then."""
    return P.planned_calls(table(spark, folder, "replay"), *[table(spark, folder, f"schedule_{n}") for n in ("trips", "calls", "stops")])


def date_route_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.resolved(_replay(spark, folder), interval_valid_join(spark, folder))
    return P.rollup(rows)


def feed_versions_listagg(spark: SparkSession, folder: str) -> DataFrame:
    """The validity ranges of planned trips, as versions, that hold on each observed date."""
    ranges = table(spark, folder, "schedule_trips").select("gtfs_active_date", "gtfs_end_date").distinct().withColumn("feed_version", F.concat_ws("-", F.col("gtfs_active_date").cast("string"), F.col("gtfs_end_date").cast("string")))
    return P.feed_versions(table(spark, folder, "replay"), ranges)


def event_order_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return P.ambiguous_trips(_replay(spark, folder))


def event_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).aliases.select("row_id", "stop_sequence", "departure_timestamp")


def physical_events(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).events


def lane_times(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).times


def headway_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).headways


def run_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).runs


def run_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Departures with several successors or predecessors."""
    sources, targets = P.run_conflicts(_audit(spark, folder).runs)
    named = targets.select("service_date", *[F.col(t).alias(e) for t, e in zip(P.TARGET, P.EVENT[1:])])
    return sources.withColumn("role", F.lit("source")).unionByName(named.withColumn("role", F.lit("target")))


def exact_run_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).exact_runs


def population_battery(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).battery()


def population_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).groups()


def population_decision(spark: SparkSession, folder: str) -> DataFrame:
    audit = _audit(spark, folder)
    unresolved = P.resolved(audit.observed, interval_valid_join(spark, folder)).agg(F.count_if(~F.col("schedule_resolved"))).first()[0]
    return P.decision(audit.battery(), unresolved)


def vehicle_lane_headways(spark: SparkSession, folder: str) -> DataFrame:
    """Departures by the vehicle's next observed call, and their headways within the lane: two windows in one query."""
    from pyspark.sql import Window

    rows = _replay(spark, folder).filter("vehicle_id is not null and parent_station is not null and move_timestamp is not null")
    vehicle = Window.partitionBy("service_date", "vehicle_id").orderBy("move_timestamp", "row_id")
    left = rows.select("row_id", "service_date", "parent_station", "trunk_route_id", "direction_id", F.lead("move_timestamp").over(vehicle).alias("departure")).filter("departure is not null")
    lane = Window.partitionBy("service_date", "parent_station", "trunk_route_id", "direction_id").orderBy("departure", "row_id")
    return left.select("row_id", (F.col("departure") - F.lag("departure").over(lane)).alias("headway")).filter("headway is not null")


# -- the exact mesh -----------------------------------------------------------------------------------------------------------


def _mesh(spark: SparkSession, folder: str) -> M.EventMesh:
    columns = ["row_id", *M.INSTANCE, "vehicle_id", "direction_id", "stop_id", "parent_station", "stop_sequence", "move_timestamp", "trunk_route_id", "headway_trunk_seconds"]
    mesh = M.lower(M.one_record(_replay(spark, folder).select(*columns)), table(spark, folder, "schedule_calls").filter("trip_id is not null and stop_sequence is not null"))
    return M.EventMesh(written(mesh.events), written(mesh.relations))


def _interval(mesh: M.EventMesh) -> tuple[int, int]:
    a, z = mesh.events.agg(F.min("departure_timestamp"), F.max("departure_timestamp")).first()
    return (a, z + 1) if a is not None else (0, 1)


def mesh_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _mesh(spark, folder).relations.select("kind", *[f"{e}_{k}" for e in "st" for k in ("vehicle_id", "parent_station", "departure_timestamp")], "elapsed_seconds")


def mesh_violations(spark: SparkSession, folder: str) -> DataFrame:
    return _mesh(spark, folder).violations()


def _busiest(spark: SparkSession, folder: str) -> int:
    """The middle of the hour with the most calls."""
    hours = table(spark, folder, "replay").select(P.occurred_at().alias("at")).filter("at > 0").groupBy(F.expr("at div 3600").alias("h")).count()
    first = hours.orderBy(F.desc("count"), "h").first()
    return first["h"] * 3600 + 1800 if first else 1


def event_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """What the mesh holds before the middle of its busiest hour."""
    mesh = _mesh(spark, folder)
    before = mesh.prefix(_busiest(spark, folder))
    return before.relations.groupBy("kind").agg(F.count(F.lit(1)).alias("relations"), F.max("t_departure_timestamp").alias("last")).unionByName(before.events.agg(F.lit("event").alias("kind"), F.count(F.lit(1)).alias("relations"), F.max("departure_timestamp").alias("last")))


def cut_audit(spark: SparkSession, folder: str) -> DataFrame:
    mesh = _mesh(spark, folder)
    return mesh.cut_audit(_busiest(spark, folder))


def _clock(seconds: int):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        mesh = _mesh(spark, folder)
        return mesh.clock_audit(*_interval(mesh), seconds)

    return query


def mesh_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return _mesh(spark, folder).degrees()


def replay_headway_audit(spark: SparkSession, folder: str) -> DataFrame:
    return M.replay_headway_audit(_mesh(spark, folder))


def active_edges(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "schedule_calls").filter("trip_id is not null and stop_sequence is not null and stop_id is not null")
    return M.active_edges(_replay(spark, folder).filter("trip_id is not null"), calls)


def replay_missingness(spark: SparkSession, folder: str) -> DataFrame:
    return M.missingness(_replay(spark, folder), ["move_timestamp", "stop_timestamp", "travel_time_seconds", "dwell_time_seconds", "headway_trunk_seconds", "vehicle_id", "stop_id"])


def _plans(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, f"schedule_{n}") for n in ("trips", "calls", "stops")]


def replay_extract(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table belong to the calls of the busiest hour."""
    middle = _busiest(spark, folder)
    parts = RP.extract(_replay(spark, folder), *_plans(spark, folder), middle - 1800, middle + 1800)
    out = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t, f in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def replay_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """How often the observed calls break each rule, over the busiest day's interval."""
    middle = _busiest(spark, folder)
    return RP.violations(_replay(spark, folder), *_plans(spark, folder), middle - 43_200, middle + 43_200).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def graph_version(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the planned segments, the same in any order of rows."""
    return T.fingerprint(segments(spark, folder).select("route_id", "from_stop_id", "to_stop_id", "occurrences"))


# -- schedule and transitions -----------------------------------------------------------------------------------------------


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring stops of each route and how often trips use them, over the planned calls as they are written."""
    trips = table(spark, folder, "schedule_trips").filter("trip_id is not null").select("trip_id", "route_id").distinct()
    calls = table(spark, folder, "schedule_calls").filter("trip_id is not null and stop_id is not null").groupBy("trip_id", "stop_sequence").agg(F.min("stop_id").alias("stop_id"))
    return S.segments(trips, calls)


def next_call(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "schedule_calls").filter("trip_id is not null")
    return S.next_calls(calls, ("trip_id", "gtfs_active_date"), "call_id").select("call_id", "next_stop_id", "next_sequence")


def _services(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(services, exceptions): days of the week as a service's name says, the range of its trips; trips valid on one day only add that day."""
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    trips = table(spark, folder, "schedule_trips").filter("service_id is not null").select("service_id", day("gtfs_active_date").alias("a"), day("gtfs_end_date").alias("z"))
    name = F.lower("service_id")
    on = [F.when(name.contains("weekday"), 1).when(name.contains("daily"), 1).otherwise(0)] * 5 + [F.when(name.contains("saturday") | name.contains("weekend") | name.contains("daily"), 1).otherwise(0), F.when(name.contains("sunday") | name.contains("weekend") | name.contains("daily"), 1).otherwise(0)]
    services = trips.groupBy("service_id").agg(F.min("a").alias("start_date"), F.max("z").alias("end_date")).select("*", *[c.alias(d) for c, d in zip(on, S.WEEKDAYS)])
    return services, trips.filter("a = z").select("service_id", F.col("a").alias("service_date"), F.lit(True).alias("added")).distinct()


def calendar_service_active(spark: SparkSession, folder: str) -> DataFrame:
    services, exceptions = _services(spark, folder)
    dates = table(spark, folder, "replay").select(F.to_date(F.col("service_date").cast("string"), "yyyyMMdd").alias("service_date")).distinct()
    return S.service_active(services, exceptions, dates).select("service_id", F.date_format("service_date", "yyyyMMdd").cast("int").alias("service_date"), "active")


def schedule_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """How often the schedule breaks each rule."""
    tables = {n: table(spark, folder, t) for n, t in (("trips", "schedule_trips"), ("stop_times", "schedule_calls"), ("stops", "schedule_stops"))}
    calls = tables["stop_times"].withColumn("arrival_time", P.service_seconds(F.col("arrival_time"))).withColumn("departure_time", P.service_seconds(F.col("departure_time")))
    return S.violations(tables | {"stop_times": calls}).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _snapshot(spark: SparkSession, folder: str, at: int) -> T.Snapshot:
    """The last record of each instance of the hour before a time. An instance whose record names no vehicle counts as canceled."""
    seen = P.occurred_at()
    rows = _replay(spark, folder).filter("start_time is not null and trip_id is not null").withColumn("at", seen).filter(F.col("at").between(at - 3599, at))
    last = rows.groupBy(*T.INSTANCE).agg(F.max(F.struct("at", "row_id", "vehicle_id", "stop_sequence")).alias("r")).select(*T.INSTANCE, "r.*")
    trips = last.select(*T.INSTANCE, F.when(F.col("vehicle_id").isNull(), "CANCELED").otherwise("SCHEDULED").alias("relationship"), F.col("at").alias("observed_at"))
    return T.Snapshot(at, trips, last.filter("vehicle_id is not null").select(*T.INSTANCE, "vehicle_id", F.col("at").alias("observed_at"), "stop_sequence"))


def _snapshots(spark: SparkSession, folder: str) -> tuple[T.Snapshot, T.Snapshot]:
    """In the middle of the busiest hour and ten minutes later."""
    middle = _busiest(spark, folder)
    return _snapshot(spark, folder, middle), _snapshot(spark, folder, middle + 600)


def transition_findings(spark: SparkSession, folder: str) -> DataFrame:
    previous, current = _snapshots(spark, folder)
    return T.findings(previous, current, current.generated_at + 60, POLICY)


def eligible_entities(spark: SparkSession, folder: str) -> DataFrame:
    previous, current = _snapshots(spark, folder)
    trips, vehicles = T.eligible(current, written(T.findings(previous, current, current.generated_at + 60, POLICY)))
    return trips.withColumn("vehicle_id", F.lit(None).cast("string")).unionByName(vehicles)


def snapshot_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return T.fingerprint(T.content(_snapshots(spark, folder)[1]))


_QUERIES = (
    interval_valid_join, date_route_rollup, feed_versions_listagg, event_order_ambiguous, event_aliases, physical_events, lane_times, headway_relations, run_relations, run_conflicts, exact_run_relations,
    population_battery, population_groups, population_decision, vehicle_lane_headways, mesh_relations, mesh_violations, event_prefix, cut_audit, mesh_degrees, replay_headway_audit, active_edges, replay_missingness, replay_extract, replay_expectations, graph_version,
    segments, next_call, calendar_service_active, schedule_expectations, transition_findings, eligible_entities, snapshot_fingerprint,
)
QUERIES = {f.__name__: f for f in _QUERIES} | {f"clock_audit_{s}": _clock(s) for s in (30, 60, 300)}

# -- SQL ----------------------------------------------------------------------------------------------------------------------

_R = "WITH r AS (SELECT * REPLACE (CAST(direction_id AS INT) AS direction_id), coalesce(move_timestamp, stop_timestamp) AS seen FROM replay)"


def _seconds(c: str) -> str:
    return rf"CASE WHEN regexp_full_match({c}, '\s*[0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9]\s*') THEN CAST(split_part(trim({c}), ':', 1) AS INT) * 3600 + CAST(split_part({c}, ':', 2) AS INT) * 60 + CAST(split_part(trim({c}), ':', 3) AS INT) END"


_PLAN = f"""plan AS (SELECT DISTINCT d.service_date, t.trip_id, t.route_id, t.direction_id, coalesce(s.parent_station, s.stop_id) AS parent_station, {_seconds('c.arrival_time')} AS arrival, {_seconds('c.departure_time')} AS departure
FROM schedule_calls c JOIN schedule_trips t ON t.trip_id = c.trip_id JOIN schedule_stops s ON s.stop_id = c.stop_id JOIN (SELECT DISTINCT service_date FROM replay) d
ON d.service_date BETWEEN greatest(c.gtfs_active_date, t.gtfs_active_date, s.gtfs_active_date) AND least(c.gtfs_end_date, t.gtfs_end_date, s.gtfs_end_date))"""
_RESOLVED = f"""{_R}, {_PLAN}, q AS (SELECT r.*, p.trip_id IS NOT NULL AS known, CASE WHEN r.trip_id LIKE 'ADDED-%' THEN 'added' WHEN r.trip_id LIKE 'NONREV-%' THEN 'nonrevenue' ELSE 'other' END AS kind FROM r LEFT JOIN plan p ON p.service_date = r.service_date AND p.trip_id = r.trip_id
AND p.route_id = r.route_id AND p.direction_id = r.direction_id AND p.parent_station = r.parent_station AND p.arrival = r.scheduled_arrival_time AND p.departure = r.scheduled_departure_time)"""
_ALIASES = f"""{_R}, amb AS (SELECT DISTINCT service_date, route_id, trip_id FROM r GROUP BY service_date, route_id, trip_id, seen HAVING count(*) > 1),
pos AS (SELECT r.*, row_number() OVER w AS place, lead(move_timestamp) OVER w AS left_at FROM r ANTI JOIN amb USING (service_date, route_id, trip_id) WINDOW w AS (PARTITION BY service_date, route_id, trip_id ORDER BY seen NULLS LAST, row_id)),
al AS (SELECT * FROM pos WHERE stop_count > 1 AND left_at IS NOT NULL)"""
_EVENTS = _ALIASES + """, ev AS (SELECT service_date, vehicle_id, parent_station, direction_id, left_at, min(trunk_route_id) AS trunk, max(headway_trunk_seconds) AS label, count(*) AS named, count(DISTINCT trunk_route_id) AS trunks, count(DISTINCT headway_trunk_seconds) AS labels FROM al GROUP BY ALL),
lt AS (SELECT service_date, parent_station, trunk, direction_id, left_at, count(*) AS n FROM ev GROUP BY ALL),
hw AS (SELECT *, left_at - from_at AS gap FROM (SELECT *, lag(left_at) OVER w AS from_at, lag(n) OVER w AS from_n FROM lt WINDOW w AS (PARTITION BY service_date, parent_station, trunk, direction_id ORDER BY left_at)) WHERE n = 1 AND from_n = 1),
lb AS (SELECT al.service_date, al.route_id, al.headway_trunk_seconds AS label, hw.gap FROM al JOIN hw ON hw.service_date = al.service_date AND hw.parent_station = al.parent_station AND hw.trunk = al.trunk_route_id AND hw.direction_id = al.direction_id AND hw.left_at = al.left_at)"""
_RUNS = """, ru AS (SELECT DISTINCT service_date, route_id, vehicle_id, parent_station, direction_id, left_at, tv, tp, td, tt FROM (SELECT *, lead(place) OVER w AS np, lead(vehicle_id) OVER w AS tv, lead(parent_station) OVER w AS tp, lead(direction_id) OVER w AS td, lead(left_at) OVER w AS tt
FROM al WINDOW w AS (PARTITION BY service_date, route_id, trip_id ORDER BY place)) WHERE np = place + 1 AND left_at < tt),
cs AS (SELECT service_date, vehicle_id, parent_station, direction_id, left_at FROM ru GROUP BY ALL HAVING count(DISTINCT (tv, tp, td, tt)) > 1), ct AS (SELECT service_date, tv, tp, td, tt FROM ru GROUP BY ALL HAVING count(DISTINCT (vehicle_id, parent_station, direction_id, left_at)) > 1),
xr AS (SELECT ru.* FROM ru ANTI JOIN cs USING (service_date, vehicle_id, parent_station, direction_id, left_at) ANTI JOIN ct USING (service_date, tv, tp, td, tt))"""
_TARGETS = "tv AS target_vehicle_id, tp AS target_parent_station, td AS target_direction_id, tt AS target_timestamp"
_BATTERY = f"""(SELECT (SELECT count(*) FROM amb) AS ambiguous_order_trips, (SELECT count(*) FROM r SEMI JOIN amb USING (service_date, route_id, trip_id)) AS ambiguous_order_rows, (SELECT count(*) FROM al) AS represented_source_rows,
e.*, s.*, (SELECT count(*) FROM xr) AS run_relations, (SELECT count(*) FROM cs) AS ambiguous_run_sources, (SELECT count(*) FROM ct) AS ambiguous_run_targets, h.*, l.exact_headways, l.mismatched_headways,
(SELECT count(*) FROM hw JOIN ev ON ev.service_date = hw.service_date AND ev.parent_station = hw.parent_station AND ev.trunk = hw.trunk AND ev.direction_id = hw.direction_id AND ev.left_at = hw.left_at WHERE ev.label IS NULL) AS derived_only_headways,
(SELECT count(headway_trunk_seconds) FROM r) - l.exact_headways - l.mismatched_headways AS boundary_only_headways
FROM (SELECT count(*) AS physical_departures, CAST(coalesce(sum(named - 1), 0) AS BIGINT) AS duplicate_aliases, count(*) FILTER (WHERE trunks > 1 OR labels > 1) AS conflicting_aliases, count(DISTINCT (parent_station, trunk, direction_id)) AS station_directions FROM ev) e,
(SELECT count(*) FILTER (WHERE n > 1) AS simultaneous_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS simultaneous_events FROM lt) s,
(SELECT count(*) AS headway_relations, min(gap) AS minimum_gap_seconds, max(gap) AS maximum_gap_seconds, quantile_disc(gap, 0.5) AS median_gap_seconds, quantile_disc(gap, 0.95) AS p95_gap_seconds FROM hw) h,
(SELECT count(*) FILTER (WHERE label = gap) AS exact_headways, count(*) FILTER (WHERE label <> gap) AS mismatched_headways FROM lb) l)"""
_ONE = """WITH one AS (SELECT service_date, start_time, trip_id, vehicle_id, stop_sequence, arg_min(struct_pack(d := CAST(direction_id AS INT), st := stop_id, ps := parent_station, mv := move_timestamp, tr := trunk_route_id, hw := headway_trunk_seconds), row_id) AS x FROM replay
WHERE service_date IS NOT NULL AND start_time IS NOT NULL AND trip_id IS NOT NULL AND vehicle_id IS NOT NULL AND stop_sequence IS NOT NULL GROUP BY ALL),
nx AS (SELECT trip_id, stop_sequence, lead(stop_sequence) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nseq FROM (SELECT DISTINCT trip_id, stop_sequence FROM schedule_calls WHERE trip_id IS NOT NULL AND stop_sequence IS NOT NULL)),
dp AS (SELECT o.service_date, o.start_time, o.trip_id, o.vehicle_id, o.stop_sequence, nx.nseq, o.x.d AS d, o.x.ps AS ps, o.x.tr AS tr, o.x.hw AS hw, n.x.mv AS dt FROM one o JOIN nx ON nx.trip_id = o.trip_id AND nx.stop_sequence = o.stop_sequence JOIN one n ON n.service_date = o.service_date AND n.start_time = o.start_time
AND n.trip_id = o.trip_id AND n.vehicle_id = o.vehicle_id AND n.stop_sequence = nx.nseq WHERE n.x.mv IS NOT NULL),
me AS (SELECT service_date, vehicle_id, ps, d, dt, min(tr) AS tr, count(DISTINCT tr) AS trunks, count(DISTINCT hw) AS labels, max(hw) AS label FROM dp GROUP BY ALL),
pr AS (SELECT DISTINCT a.service_date, a.vehicle_id, a.ps, a.d, a.dt, b.ps AS bps, b.d AS bd, b.dt AS bat FROM dp a JOIN dp b ON b.service_date = a.service_date AND b.start_time = a.start_time AND b.trip_id = a.trip_id AND b.vehicle_id = a.vehicle_id AND b.stop_sequence = a.nseq),
rr AS (SELECT * FROM pr ANTI JOIN (SELECT service_date, vehicle_id, ps, d, dt FROM pr GROUP BY ALL HAVING count(*) > 1) USING (service_date, vehicle_id, ps, d, dt) ANTI JOIN (SELECT service_date, vehicle_id, bps, bd, bat FROM pr GROUP BY ALL HAVING count(*) > 1) USING (service_date, vehicle_id, bps, bd, bat) WHERE dt < bat),
hh AS (SELECT *, lag(dt) OVER w AS pat, lag(vehicle_id) OVER w AS pv, lag(ps) OVER w AS pps FROM me WHERE trunks = 1 AND labels <= 1 WINDOW w AS (PARTITION BY ps, tr, d ORDER BY dt, service_date NULLS FIRST, vehicle_id NULLS FIRST, ps NULLS FIRST, d NULLS FIRST)),
rl AS (SELECT 'run' AS kind, vehicle_id AS sv, ps AS sp, dt AS sa, vehicle_id AS tv, bps AS tp, bat AS ta, bat - dt AS el, NULL AS label, NULL AS tr, NULL AS d FROM rr UNION ALL SELECT 'headway', pv, pps, pat, vehicle_id, ps, dt, dt - pat, label, tr, d FROM hh WHERE dt > pat),
iv AS (SELECT min(dt) AS a, max(dt) + 1 AS z, (SELECT coalesce(move_timestamp, stop_timestamp) // 3600 * 3600 + 1800 AS m FROM replay WHERE coalesce(move_timestamp, stop_timestamp) > 0 GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1) AS m FROM me)"""


def _clock_sql(seconds: int) -> str:
    return f"""{_ONE}, c AS (SELECT tp, tr, d, (ta - (SELECT a FROM iv)) // {seconds} AS cell, count(*) AS n FROM rl WHERE kind = 'headway' AND label IS NOT NULL AND tp IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
k AS (SELECT count(DISTINCT (tp, tr, d)) * ((max(z) - max(a) + {seconds - 1}) // {seconds}) AS cells FROM c, iv)
SELECT CAST({seconds} AS INT) AS seconds, cells, count(*) AS occupied_cells, cells - count(*) AS empty_cells, CAST(coalesce(sum(n), 0) AS BIGINT) AS target_events, count(*) FILTER (WHERE n > 1) AS colliding_cells, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS merged_events, coalesce(max(n), 0) AS max_events_per_cell,
count(*) FILTER (WHERE n > 1) > 0 AS aggregation_required FROM c, k GROUP BY cells"""


_SNAP = f"""{_R}, b AS (SELECT seen // 3600 * 3600 + 1800 AS m FROM r WHERE seen > 0 GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1), sn AS (SELECT g, service_date, start_time, trip_id, vehicle_id, stop_sequence, seen FROM (SELECT r.*, g FROM r, (SELECT m AS g FROM b UNION ALL SELECT m + 600 FROM b) WHERE seen BETWEEN g - 3599 AND g AND start_time IS NOT NULL AND trip_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY g, service_date, start_time, trip_id ORDER BY seen DESC, row_id DESC) = 1), p AS (SELECT sn.* FROM sn, b WHERE g = m), c AS (SELECT sn.* FROM sn, b WHERE g = m + 600)"""
_FINDINGS = f"""{_SNAP}, fi AS (SELECT 'FEED_GAP_EXCEEDED' AS code, 'policy' AS severity, CAST(NULL AS INT) AS service_date, CAST(NULL AS INT) AS start_time, CAST(NULL AS VARCHAR) AS trip_id, CAST(NULL AS VARCHAR) AS vehicle_id, m AS before, m + 600 AS now, CAST(30 AS BIGINT) AS "limit" FROM b
UNION ALL SELECT 'ACTIVE_AFTER_TERMINAL', 'blocking', c.service_date, c.start_time, c.trip_id, NULL, NULL, NULL, NULL FROM c JOIN p USING (service_date, start_time, trip_id) WHERE p.vehicle_id IS NULL AND c.vehicle_id IS NOT NULL
UNION ALL SELECT 'TRIP_OBSERVATION_STALE', 'policy', service_date, start_time, trip_id, NULL, NULL, seen, 300 FROM c WHERE g + 60 - seen > 300
UNION ALL SELECT 'VEHICLE_OBSERVATION_STALE', 'policy', service_date, start_time, trip_id, vehicle_id, NULL, seen, 300 FROM c WHERE vehicle_id IS NOT NULL AND g + 60 - seen > 300
UNION ALL SELECT 'VEHICLE_STOP_REGRESSED', 'blocking', c.service_date, c.start_time, c.trip_id, c.vehicle_id, p.stop_sequence, c.stop_sequence, NULL FROM c JOIN p USING (service_date, start_time, trip_id, vehicle_id) WHERE c.stop_sequence < p.stop_sequence)"""
_DAY = "CAST(strptime(CAST({} AS VARCHAR), '%Y%m%d') AS DATE)"

SQL = {
    "interval_valid_join": f"WITH {_PLAN} SELECT * FROM plan",
    "date_route_rollup": f"""{_RESOLVED} SELECT service_date, route_id, count(*) AS source_rows, count(DISTINCT (start_time, trip_id)) AS trip_instances, count(DISTINCT vehicle_id) AS vehicles, count(*) FILTER (WHERE move_timestamp IS NULL) AS missing_movement, count(headway_trunk_seconds) AS source_headways,
count(*) FILTER (WHERE known) AS schedule_resolved, count(*) FILTER (WHERE NOT known) AS schedule_unresolved, count(*) FILTER (WHERE NOT known AND kind = 'added') AS unresolved_added, count(*) FILTER (WHERE NOT known AND kind = 'nonrevenue') AS unresolved_nonrevenue, count(*) FILTER (WHERE NOT known AND kind = 'other') AS unresolved_other FROM q GROUP BY 1, 2""",
    "feed_versions_listagg": "SELECT d.service_date, string_agg(v, ' | ' ORDER BY v) AS feed_versions FROM (SELECT DISTINCT service_date FROM replay) d JOIN (SELECT DISTINCT gtfs_active_date AS a, gtfs_end_date AS z, gtfs_active_date || '-' || gtfs_end_date AS v FROM schedule_trips) ON d.service_date BETWEEN a AND z GROUP BY 1",
    "event_order_ambiguous": f"{_ALIASES} SELECT * FROM amb",
    "event_aliases": f"{_ALIASES} SELECT row_id, stop_sequence, left_at AS departure_timestamp FROM al",
    "physical_events": f"{_EVENTS} SELECT service_date, vehicle_id, parent_station, direction_id, left_at AS departure_timestamp, trunk AS trunk_route_id, label AS source_headway_seconds, named AS aliases, trunks AS trunk_routes, labels AS source_labels FROM ev",
    "lane_times": f"{_EVENTS} SELECT service_date, parent_station, trunk AS trunk_route_id, direction_id, left_at AS departure_timestamp, n AS event_count FROM lt",
    "headway_relations": f"{_EVENTS} SELECT service_date, parent_station, trunk AS trunk_route_id, direction_id, left_at AS departure_timestamp, n AS event_count, from_at AS source_timestamp, from_n AS source_count, gap AS elapsed_seconds FROM hw",
    "run_relations": f"{_ALIASES}{_RUNS} SELECT service_date, route_id, vehicle_id, parent_station, direction_id, left_at AS departure_timestamp, {_TARGETS} FROM ru",
    "run_conflicts": f"{_ALIASES}{_RUNS} SELECT service_date, vehicle_id, parent_station, direction_id, left_at AS departure_timestamp, 'source' AS role FROM cs UNION ALL SELECT service_date, tv, tp, td, tt, 'target' FROM ct",
    "exact_run_relations": f"{_ALIASES}{_RUNS} SELECT service_date, route_id, vehicle_id, parent_station, direction_id, left_at AS departure_timestamp, {_TARGETS} FROM xr",
    "population_battery": f"{_EVENTS}{_RUNS} SELECT * FROM {_BATTERY}",
    "population_groups": f"""{_EVENTS}{_RUNS}, ca AS (SELECT service_date, route_id, count(*) AS represented_source_rows, count(DISTINCT (vehicle_id, parent_station, direction_id, left_at)) AS physical_departures, count(DISTINCT (parent_station, trunk_route_id, direction_id)) AS lanes, min(left_at) AS first_departure_timestamp, max(left_at) AS last_departure_timestamp FROM al GROUP BY 1, 2),
lg AS (SELECT service_date, route_id, count(*) AS headway_relations, count(*) FILTER (WHERE label = gap) AS exact_headways, count(*) FILTER (WHERE label <> gap) AS mismatched_headways, count(*) FILTER (WHERE label IS NULL) AS derived_only_headways, quantile_disc(gap, 0.5) AS median_gap_seconds, quantile_disc(gap, 0.95) AS p95_gap_seconds, max(gap) AS maximum_gap_seconds FROM lb GROUP BY 1, 2),
ag AS (SELECT service_date, route_id, count(DISTINCT trip_id) AS ambiguous_order_trips, count(*) AS ambiguous_order_rows FROM r JOIN amb USING (service_date, route_id, trip_id) GROUP BY 1, 2), rg AS (SELECT service_date, route_id, count(*) AS run_relations FROM xr GROUP BY 1, 2)
SELECT service_date, route_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('represented_source_rows', 'physical_departures', 'lanes', 'first_departure_timestamp', 'last_departure_timestamp', 'headway_relations', 'exact_headways', 'mismatched_headways', 'derived_only_headways', 'median_gap_seconds', 'p95_gap_seconds', 'maximum_gap_seconds', 'ambiguous_order_trips', 'ambiguous_order_rows', 'run_relations'))},
coalesce(represented_source_rows - physical_departures, 0) AS duplicate_aliases FROM (SELECT DISTINCT service_date, route_id FROM r) LEFT JOIN ca USING (service_date, route_id) LEFT JOIN lg USING (service_date, route_id) LEFT JOIN ag USING (service_date, route_id) LEFT JOIN rg USING (service_date, route_id)""",
    "population_decision": f"{_EVENTS}{_RUNS}, {_PLAN} SELECT exact_headways, conflicting_aliases, CASE WHEN exact_headways > 0 AND conflicting_aliases = 0 THEN CASE WHEN (SELECT count(*) FROM r) > (SELECT count(*) FROM r JOIN plan p ON p.service_date = r.service_date AND p.trip_id = r.trip_id AND p.route_id = r.route_id AND p.direction_id = r.direction_id AND p.parent_station = r.parent_station AND p.arrival = r.scheduled_arrival_time AND p.departure = r.scheduled_departure_time) THEN 'advance with a mask of the schedule' ELSE 'advance' END ELSE 'stop' END AS decision FROM {_BATTERY}",
    "vehicle_lane_headways": """WITH v AS (SELECT row_id, service_date, parent_station, trunk_route_id, direction_id, lead(move_timestamp) OVER (PARTITION BY service_date, vehicle_id ORDER BY move_timestamp, row_id) AS departure FROM replay WHERE vehicle_id IS NOT NULL AND parent_station IS NOT NULL AND move_timestamp IS NOT NULL),
h AS (SELECT row_id, departure - lag(departure) OVER (PARTITION BY service_date, parent_station, trunk_route_id, direction_id ORDER BY departure, row_id) AS headway FROM v WHERE departure IS NOT NULL) SELECT * FROM h WHERE headway IS NOT NULL""",
    "mesh_relations": f"{_ONE} SELECT kind, sv AS s_vehicle_id, sp AS s_parent_station, sa AS s_departure_timestamp, tv AS t_vehicle_id, tp AS t_parent_station, ta AS t_departure_timestamp, el AS elapsed_seconds FROM rl",
    "event_prefix": f"{_ONE} SELECT kind, count(*) AS relations, max(ta) AS last FROM rl, iv WHERE sa < m AND ta < m GROUP BY 1 UNION ALL SELECT 'event', count(*), max(dt) FROM me, iv WHERE dt < m",
    "cut_audit": f"{_ONE} SELECT (SELECT count(*) FROM me, iv WHERE dt < m) AS retained_events, (SELECT count(*) FROM me, iv WHERE dt >= m) AS excluded_events, (SELECT count(*) FROM rl, iv WHERE sa < m AND ta < m) AS retained_relations, (SELECT count(*) FROM rl, iv WHERE (sa < m) <> (ta < m)) AS crossing_relations",
    "active_edges": "WITH i AS (SELECT trip_id, stop_sequence, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id) AS a, stop_id AS b FROM (SELECT DISTINCT trip_id, stop_sequence, stop_id FROM schedule_calls WHERE trip_id IS NOT NULL AND stop_sequence IS NOT NULL AND stop_id IS NOT NULL)) SELECT a AS from_stop, b AS to_stop, bool_or(EXISTS (SELECT 1 FROM replay r WHERE r.trip_id = i.trip_id AND r.stop_sequence = i.stop_sequence)) AS active FROM i WHERE a IS NOT NULL GROUP BY 1, 2",
    "replay_missingness": "SELECT count(*) AS source_rows, count(DISTINCT (service_date, start_time, trip_id)) AS trip_instances, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT stop_id) AS stops, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in ("move_timestamp", "stop_timestamp", "travel_time_seconds", "dwell_time_seconds", "headway_trunk_seconds", "vehicle_id", "stop_id")) + " FROM replay",
    "segments": "WITH c AS (SELECT trip_id, stop_sequence, min(stop_id) AS s FROM schedule_calls WHERE trip_id IS NOT NULL AND stop_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT trip_id, s, lead(s) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS t FROM c) SELECT route_id, s AS from_stop_id, t AS to_stop_id, count(*) AS occurrences, min(trip_id) AS first_trip FROM n JOIN (SELECT DISTINCT trip_id, route_id FROM schedule_trips WHERE trip_id IS NOT NULL) USING (trip_id) WHERE t IS NOT NULL GROUP BY 1, 2, 3",
    "next_call": "SELECT call_id, lead(stop_id) OVER w AS next_stop_id, lead(stop_sequence) OVER w AS next_sequence FROM schedule_calls WHERE trip_id IS NOT NULL WINDOW w AS (PARTITION BY trip_id, gtfs_active_date ORDER BY stop_sequence NULLS FIRST, call_id)",
    "calendar_service_active": f"""WITH t AS (SELECT service_id, {_DAY.format('gtfs_active_date')} AS a, {_DAY.format('gtfs_end_date')} AS z FROM schedule_trips WHERE service_id IS NOT NULL), s AS (SELECT service_id, lower(service_id) AS n, min(a) AS a, max(z) AS z FROM t GROUP BY 1, 2), d AS (SELECT DISTINCT service_date, {_DAY.format('service_date')} AS day FROM replay)
SELECT s.service_id, d.service_date, EXISTS (SELECT 1 FROM t WHERE t.a = t.z AND t.a = d.day AND t.service_id = s.service_id) OR (d.day BETWEEN s.a AND s.z AND (contains(n, 'daily') OR CASE isodow(d.day) WHEN 6 THEN contains(n, 'saturday') OR contains(n, 'weekend') WHEN 7 THEN contains(n, 'sunday') OR contains(n, 'weekend') ELSE contains(n, 'weekday') END)) AS active FROM s, d""",
    "transition_findings": f"{_FINDINGS} SELECT * FROM fi",
    "eligible_entities": f"""{_FINDINGS} SELECT service_date, start_time, trip_id, CAST(NULL AS VARCHAR) AS vehicle_id FROM c ANTI JOIN (SELECT * FROM fi WHERE code IN ('ACTIVE_AFTER_TERMINAL', 'TRIP_OBSERVATION_STALE')) USING (service_date, start_time, trip_id)
UNION ALL SELECT service_date, start_time, trip_id, vehicle_id FROM (SELECT * FROM c WHERE vehicle_id IS NOT NULL) ANTI JOIN (SELECT * FROM fi WHERE code = 'ACTIVE_AFTER_TERMINAL') USING (service_date, start_time, trip_id) ANTI JOIN (SELECT * FROM fi WHERE code IN ('VEHICLE_STOP_REGRESSED', 'VEHICLE_OBSERVATION_STALE')) USING (service_date, start_time, trip_id, vehicle_id)""",
    "replay_headway_audit": f"""{_ONE}, j AS (SELECT * FROM rl WHERE kind = 'headway' AND tp IS NOT NULL AND d IS NOT NULL), bi AS (SELECT count(*) AS n FROM j WHERE label = el GROUP BY tp, d, ta // 300)
SELECT count(*) AS derived_values, count(*) FILTER (WHERE label = el) AS exact_matches, count(*) FILTER (WHERE label <> el) AS mismatches, count(*) FILTER (WHERE label IS NULL) AS derived_only, (SELECT count(*) FROM bi) AS target_bins, (SELECT count(*) FILTER (WHERE n > 1) FROM bi) AS colliding_target_bins, (SELECT coalesce(max(n), 0) FROM bi) AS max_targets_per_bin FROM j""",
    "graph_version": """WITH c AS (SELECT trip_id, stop_sequence, min(stop_id) AS s FROM schedule_calls WHERE trip_id IS NOT NULL AND stop_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT trip_id, s, lead(s) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS t FROM c),
g AS (SELECT route_id, s, t, count(*) AS n FROM n JOIN (SELECT DISTINCT trip_id, route_id FROM schedule_trips WHERE trip_id IS NOT NULL) USING (trip_id) WHERE t IS NOT NULL GROUP BY 1, 2, 3), h AS (SELECT sha256(concat_ws(chr(1), s, CAST(n AS VARCHAR), coalesce(route_id, chr(2)), t)) AS h FROM g)
SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), """ + ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {16 * i + 1}, 15) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)) + ")) AS fingerprint FROM h",
    "replay_extract": f"""{_R}, b AS (SELECT seen // 3600 * 3600 AS h FROM r WHERE seen > 0 GROUP BY 1 ORDER BY count(*) DESC, h LIMIT 1), c AS (SELECT r.* FROM r, b WHERE seen >= h AND seen < h + 3600), u AS (SELECT DISTINCT trip_id, service_date FROM c WHERE trip_id IS NOT NULL),
t AS (SELECT DISTINCT * FROM schedule_trips t WHERE EXISTS (SELECT 1 FROM u WHERE u.trip_id = t.trip_id AND u.service_date BETWEEN t.gtfs_active_date AND t.gtfs_end_date)), p AS (SELECT DISTINCT * FROM schedule_calls t WHERE EXISTS (SELECT 1 FROM u WHERE u.trip_id = t.trip_id AND u.service_date BETWEEN t.gtfs_active_date AND t.gtfs_end_date)),
d AS (SELECT DISTINCT p.stop_id, c.service_date FROM p, (SELECT DISTINCT service_date FROM c) c WHERE c.service_date BETWEEN p.gtfs_active_date AND p.gtfs_end_date), s AS (SELECT DISTINCT * FROM schedule_stops s WHERE EXISTS (SELECT 1 FROM d WHERE d.stop_id = s.stop_id AND d.service_date BETWEEN s.gtfs_active_date AND s.gtfs_end_date))
SELECT 'replay' AS name, count(*) AS n FROM c UNION ALL SELECT 'trips', count(*) FROM t UNION ALL SELECT 'calls', count(*) FROM p UNION ALL SELECT 'stops', count(*) FROM s""",
    "replay_expectations": f"""{_R}, b AS (SELECT seen // 3600 * 3600 + 1800 AS m FROM r WHERE seen > 0 GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1), pl AS (SELECT DISTINCT trip_id, stop_sequence, stop_id, {_seconds('arrival_time')} AS a, {_seconds('departure_time')} AS d FROM schedule_calls),
k AS (SELECT r.*, coalesce(seen >= m - 43200 AND seen < m + 43200, false) AS inside, EXISTS (SELECT 1 FROM schedule_trips t WHERE t.trip_id = r.trip_id) AS t, EXISTS (SELECT 1 FROM schedule_trips t WHERE t.trip_id = r.trip_id AND t.route_id IS NOT DISTINCT FROM r.route_id AND CAST(t.direction_id AS INT) IS NOT DISTINCT FROM r.direction_id) AS li,
  EXISTS (SELECT 1 FROM pl WHERE pl.trip_id = r.trip_id AND pl.stop_sequence = r.stop_sequence) AS c, EXISTS (SELECT 1 FROM pl WHERE pl.trip_id = r.trip_id AND pl.stop_sequence = r.stop_sequence AND pl.stop_id IS NOT DISTINCT FROM r.stop_id) AS st,
  EXISTS (SELECT 1 FROM pl WHERE pl.trip_id = r.trip_id AND pl.stop_sequence = r.stop_sequence AND pl.stop_id IS NOT DISTINCT FROM r.stop_id AND pl.a IS NOT DISTINCT FROM r.scheduled_arrival_time AND pl.d IS NOT DISTINCT FROM r.scheduled_departure_time) AS tm, EXISTS (SELECT 1 FROM schedule_stops s WHERE s.stop_id = r.stop_id) AS h FROM r, b),
v AS (SELECT unnest(list_filter([CASE WHEN NOT inside THEN 'outside the interval' END, CASE WHEN NOT t THEN 'trip not planned' END, CASE WHEN NOT c THEN 'call not planned' END, CASE WHEN NOT h THEN 'stop unknown' END, CASE WHEN t AND NOT li THEN 'route or direction differs' END, CASE WHEN c AND NOT st THEN 'stop differs' END, CASE WHEN st AND NOT tm THEN 'time differs' END], lambda x: x IS NOT NULL)) AS rule FROM k
UNION ALL SELECT 'call repeated' FROM r GROUP BY service_date, start_time, trip_id, stop_sequence HAVING count(*) > 1) SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "snapshot_fingerprint": _SNAP + """, t AS (SELECT 'trip' AS kind, service_date, start_time, trip_id, CAST(NULL AS VARCHAR) AS vehicle_id, CASE WHEN vehicle_id IS NULL THEN 'CANCELED' ELSE 'SCHEDULED' END AS what, seen FROM c UNION ALL SELECT 'vehicle', service_date, start_time, trip_id, vehicle_id, CAST(stop_sequence AS VARCHAR), seen FROM c WHERE vehicle_id IS NOT NULL),
h AS (SELECT sha256(concat_ws(chr(1), kind, coalesce(CAST(seen AS VARCHAR), chr(2)), coalesce(CAST(service_date AS VARCHAR), chr(2)), coalesce(CAST(start_time AS VARCHAR), chr(2)), coalesce(trip_id, chr(2)), coalesce(vehicle_id, chr(2)), coalesce(what, chr(2)))) AS h FROM t)
SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), """ + ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {16 * i + 1}, 15) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)) + ")) AS fingerprint FROM h",
} | {f"clock_audit_{s}": _clock_sql(s) for s in (30, 60, 300)}
