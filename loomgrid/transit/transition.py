"""What two snapshots of a feed say together: findings, and which facts may be used.

A snapshot is a frame of trips (INSTANCE, relationship, observed_at) and one of vehicles (INSTANCE, vehicle_id, observed_at, stop_sequence) at one generation time. Absence
from a snapshot is no deletion. Blocking findings of the feed as a whole make nothing eligible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.single import with_row

INSTANCE = ["service_date", "start_time", "trip_id"]
#: Codes of findings and what they do: "blocking" ones contradict what was said before, "policy" ones exceed a limit.
SEVERITY = {
    "FEED_GENERATION_REGRESSED": "blocking", "CONTENT_CHANGED_WITHOUT_GENERATION": "blocking", "FEED_GAP_EXCEEDED": "policy", "ACTIVE_AFTER_TERMINAL": "blocking", "VEHICLE_STOP_REGRESSED": "blocking",
    "TRIP_OBSERVATION_STALE": "policy", "VEHICLE_OBSERVATION_STALE": "policy",
}
_COLUMNS = ["code", "severity", *INSTANCE, "vehicle_id", "before", "now", "limit"]


@dataclass(frozen=True)
class Policy:
    max_feed_gap_seconds: int
    max_trip_age_seconds: int
    max_vehicle_age_seconds: int


@dataclass(frozen=True)
class Snapshot:
    generated_at: int
    trips: DataFrame
    vehicles: DataFrame


def fingerprint(frame: DataFrame) -> DataFrame:
    """(rows, fingerprint): a hash of the rows in any order. Every row's SHA-256 is split in four numbers, which are added up, so that no task sorts or holds all rows."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in sorted(frame.columns)])
    digest = frame.select(F.sha2(text, 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = digest.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(part(i), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def content(snapshot: Snapshot) -> DataFrame:
    """One frame of a snapshot's trips and vehicles, for its fingerprint."""
    trips = snapshot.trips.select(F.lit("trip").alias("kind"), *INSTANCE, F.lit(None).cast("string").alias("vehicle_id"), F.col("relationship").alias("what"), "observed_at")
    return trips.unionByName(snapshot.vehicles.select(F.lit("vehicle").alias("kind"), *INSTANCE, "vehicle_id", F.col("stop_sequence").cast("string").alias("what"), "observed_at"))


def _finding(frame: DataFrame, code: str, before: Column | None = None, now: Column | None = None, limit: int | None = None, keyed: bool = True) -> DataFrame:
    n = lambda c: (F.lit(None) if c is None else c).cast("long")
    ids = [F.col(c) for c in INSTANCE] if keyed else [F.lit(None).cast(t).alias(c) for c, t in zip(INSTANCE, ("int", "int", "string"))]
    vehicle = F.col("vehicle_id") if keyed and "vehicle_id" in frame.columns else F.lit(None).cast("string")
    return frame.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), *ids, vehicle.alias("vehicle_id"), n(before).alias("before"), n(now).alias("now"), F.lit(limit).cast("long").alias("limit"))


def findings(previous: Snapshot, current: Snapshot, as_of: int, policy: Policy) -> DataFrame:
    """One row for each finding."""
    if as_of < current.generated_at:
        raise ValueError("the time of judgement precedes the current snapshot")
    if min(policy.max_feed_gap_seconds, policy.max_trip_age_seconds, policy.max_vehicle_age_seconds) < 0:
        raise ValueError("limits are not negative")
    spark = current.trips.sparkSession
    one = spark.range(1)
    before, now = previous.generated_at, current.generated_at
    feed = lambda code, limit=None: _finding(one, code, F.lit(before), F.lit(now), limit, keyed=False)
    out = []
    if now < before:
        out.append(feed("FEED_GENERATION_REGRESSED"))
    elif now == before:
        changed = with_row(fingerprint(content(previous)), fingerprint(content(current)).select(F.col("fingerprint").alias("other"))).filter("fingerprint <> other")
        out.append(_finding(changed, "CONTENT_CHANGED_WITHOUT_GENERATION", F.lit(before), F.lit(now), keyed=False))
    if now - before > policy.max_feed_gap_seconds:
        out.append(feed("FEED_GAP_EXCEEDED", policy.max_feed_gap_seconds))
    ended = previous.trips.filter("relationship = 'CANCELED'").select(*INSTANCE)
    out.append(_finding(current.trips.filter("relationship <> 'CANCELED'").join(ended, INSTANCE, "left_semi"), "ACTIVE_AFTER_TERMINAL"))
    old = lambda limit: F.lit(as_of) - F.col("observed_at") > limit
    out.append(_finding(current.trips.filter(old(policy.max_trip_age_seconds)), "TRIP_OBSERVATION_STALE", None, F.col("observed_at"), policy.max_trip_age_seconds))
    was = previous.vehicles.select(*INSTANCE, "vehicle_id", F.col("stop_sequence").alias("_was"))
    back = current.vehicles.join(was, [*INSTANCE, "vehicle_id"]).filter("stop_sequence < _was")
    out.append(_finding(back, "VEHICLE_STOP_REGRESSED", F.col("_was"), F.col("stop_sequence")))
    out.append(_finding(current.vehicles.filter(old(policy.max_vehicle_age_seconds)), "VEHICLE_OBSERVATION_STALE", None, F.col("observed_at"), policy.max_vehicle_age_seconds))
    every = out[0]
    for f in out[1:]:
        every = every.unionByName(f)
    return every.select(*_COLUMNS)


def eligible(current: Snapshot, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips, vehicles) of the current snapshot that no finding excludes: none at all after a blocking finding of the feed; a trip that is active again takes its vehicles with it."""
    blocked = found.filter("severity = 'blocking' and trip_id is null").agg(F.count(F.lit(1)).alias("_blocked"))
    free = lambda f: with_row(f, blocked).filter("_blocked = 0").drop("_blocked")
    of = lambda *codes: found.filter(F.col("code").isin(*codes) & F.col("trip_id").isNotNull())
    trips = free(current.trips.select(*INSTANCE).distinct()).join(of("ACTIVE_AFTER_TERMINAL", "TRIP_OBSERVATION_STALE").select(*INSTANCE), INSTANCE, "left_anti")
    vehicles = free(current.vehicles.select(*INSTANCE, "vehicle_id").distinct()).join(of("ACTIVE_AFTER_TERMINAL").select(*INSTANCE), INSTANCE, "left_anti")
    return trips, vehicles.join(of("VEHICLE_STOP_REGRESSED", "VEHICLE_OBSERVATION_STALE").select(*INSTANCE, "vehicle_id"), [*INSTANCE, "vehicle_id"], "left_anti")


def projection(stops: DataFrame, segments: DataFrame, trips: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph of stops with what is observed there. stops: stop_id; segments: route_id, from_stop_id, to_stop_id; trips: INSTANCE, relationship, delay, all eligible;
    vehicles: INSTANCE, vehicle_id, stop_id, all eligible. Nodes bear delay, observed and vehicle_count: 0, false and 0 where nothing is known."""
    at = vehicles.join(trips.select(*INSTANCE, "relationship", "delay"), INSTANCE, "left")
    known = F.coalesce((F.col("relationship") == "SCHEDULED") & F.col("delay").isNotNull(), F.lit(False))
    seen = at.groupBy("stop_id").agg(F.avg(F.when(known, F.col("delay"))).alias("delay"), F.max(known).alias("observed"), F.count(F.lit(1)).alias("vehicle_count"))
    nodes = stops.select("stop_id").distinct().join(seen, "stop_id", "left").select("stop_id", F.coalesce("delay", F.lit(0.0)).alias("delay"), F.coalesce("observed", F.lit(False)).alias("observed"), F.coalesce("vehicle_count", F.lit(0)).cast("long").alias("vehicle_count"))
    return nodes, segments.select("route_id", F.col("from_stop_id").alias("source"), F.col("to_stop_id").alias("target"))
