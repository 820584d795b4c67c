"""Full snapshots of a realtime feed, checked against the schedule, all or nothing.

A message is one JSON text. ``facts`` gives trips, predictions and vehicles as frames; ``violations`` gives every broken rule as (rule, key). Entities are joined with the schedule's tables;
a message of any size is exploded and never walked on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.service import service_date, service_seconds
from loomgrid.transit.schedule import in_frequency, service_active

_EVENT = "struct<delay: int, time: bigint>"
SCHEMA = (
    "struct<header: struct<incrementality: string, timestamp: bigint>, entities: array<struct<id: string, is_deleted: boolean, alert: string, "
    "trip: struct<trip_id: string, route_id: string, start_date: string, start_time: string, schedule_relationship: string>, "
    "vehicle: struct<vehicle_id: string, timestamp: bigint, current_stop_sequence: int, current_stop_id: string, current_status: string>, "
    f"trip_update: struct<timestamp: bigint, delay: int, delay_at_stop_sequence: int, stop_time_updates: array<struct<stop_sequence: int, stop_id: string, arrival: {_EVENT}, departure: {_EVENT}>>>>>>"
)
INSTANCE = ["trip_id", "service_date", "start_time"]
STATUSES = ("INCOMING_AT", "STOPPED_AT", "IN_TRANSIT_TO")
RELATIONSHIPS = ("SCHEDULED", "CANCELED")


class RealtimeError(ValueError):
    """A message breaks its rules."""


@dataclass(frozen=True)
class Snapshot:
    """trips (entity, INSTANCE, route_id, relationship, observed_at, delay), vehicles (entity, INSTANCE, vehicle_id, observed_at, stop_id, stop_sequence, status), predictions."""

    trips: DataFrame
    vehicles: DataFrame
    predictions: DataFrame
    header: DataFrame


def facts(messages: DataFrame, text: str = "value") -> Snapshot:
    """The facts of messages as they are, unchecked. Every row bears its message's generated_at."""
    parsed = messages.select(F.from_json(F.col(text), SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).select("m.header.incrementality", F.col("m.header.timestamp").alias("generated_at"), "m.entities")
    e = parsed.select("generated_at", F.explode("entities").alias("e")).select(
        "generated_at", F.col("e.id").alias("entity"), "e.is_deleted", "e.alert", F.col("e.trip.trip_id").alias("trip_id"), service_date(F.col("e.trip.start_date")).alias("service_date"), service_seconds(F.col("e.trip.start_time")).alias("start_time"),
        F.col("e.trip.route_id").alias("route_id"), F.col("e.trip.schedule_relationship").alias("relationship"), "e.vehicle", "e.trip_update",
    )
    canceled = F.col("relationship") == "CANCELED"
    trips = e.select("generated_at", "entity", *INSTANCE, "route_id", "relationship", F.when(canceled, F.col("generated_at")).otherwise(F.col("trip_update.timestamp")).alias("observed_at"), F.col("trip_update.delay").alias("delay"), F.col("trip_update.delay_at_stop_sequence").alias("delay_sequence"), "is_deleted", "alert", F.col("vehicle").isNotNull().alias("has_vehicle"), F.col("trip_update").isNotNull().alias("has_update"))
    vehicles = e.filter("vehicle is not null").select("generated_at", "entity", *INSTANCE, "vehicle.vehicle_id", F.col("vehicle.timestamp").alias("observed_at"), F.col("vehicle.current_stop_id").alias("stop_id"), F.col("vehicle.current_stop_sequence").alias("stop_sequence"), F.col("vehicle.current_status").alias("status"))
    predictions = e.select("generated_at", "entity", *INSTANCE, F.col("vehicle.current_stop_sequence").alias("at_sequence"), F.posexplode("trip_update.stop_time_updates").alias("place", "u")).select("generated_at", "entity", *INSTANCE, "at_sequence", "place", "u.*")
    return Snapshot(trips, vehicles, predictions, parsed.select("incrementality", "generated_at"))


def violations(s: Snapshot, schedule: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key) of a snapshot's facts against the schedule (trips, stop_times, calendar, calendar_dates, frequencies)."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("key")
    rule = lambda f, name, c="entity": f.select(F.lit(name).alias("rule"), key(c))
    many = lambda f, *cs: f.groupBy("generated_at", *cs).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    planned = s.trips.join(schedule["trips"].select("trip_id", F.col("route_id").alias("_route"), "service_id"), "trip_id")
    exceptions = schedule["calendar_dates"].select("service_id", F.col("date").alias("service_date"), (F.col("exception_type") == 1).alias("added"))
    active = service_active(schedule["calendar"], exceptions, s.trips.select("service_date").distinct())
    calls = schedule["stop_times"].select("trip_id", "stop_sequence", F.col("stop_id").alias("_stop"), F.col("departure_time").alias("_departure"))
    first = calls.groupBy("trip_id").agg(F.min_by("_departure", "stop_sequence").alias("_first"))
    frequent = schedule["frequencies"].select("trip_id").distinct()
    order = Window.partitionBy("generated_at", "entity").orderBy("place")
    p = s.predictions.withColumn("_before", F.lag("stop_sequence").over(order))
    live = s.trips.filter("relationship = 'SCHEDULED'")
    moved = s.vehicles.join(s.trips.select("generated_at", "entity", "delay_sequence"), ["generated_at", "entity"])
    found = [
        rule(s.header.filter("incrementality <> 'FULL_DATASET' or incrementality is null"), "only full messages", "generated_at"),
        rule(s.header.filter("generated_at is null or generated_at < 1"), "message without time", "generated_at"),
        rule(many(s.trips, "entity"), "entity repeated"),
        rule(s.trips.filter("is_deleted or alert is not null"), "deleted entity or alert"),
        rule(s.trips.filter(~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False))), "unknown relationship"),
        rule(s.trips.filter("trip_id is null or service_date is null or start_time is null"), "instance incomplete"),
        rule(s.trips.join(schedule["trips"].select("trip_id"), "trip_id", "left_anti"), "trip not planned"),
        rule(planned.filter("not (route_id <=> _route)"), "route differs"),
        rule(planned.join(active.filter("not active"), ["service_id", "service_date"], "left_semi"), "service inactive"),
        rule(s.trips.join(frequent, "trip_id", "left_semi").join(in_frequency(s.trips.select("generated_at", "entity", "trip_id", "start_time"), schedule["frequencies"]).select("generated_at", "entity"), ["generated_at", "entity"], "left_anti"), "start outside frequencies"),
        rule(s.trips.join(frequent, "trip_id", "left_anti").join(first, "trip_id").filter("start_time <> _first"), "start differs from first departure"),
        rule(s.trips.filter("relationship = 'CANCELED' and (has_vehicle or has_update)"), "canceled trip is active"),
        rule(live.filter("not has_vehicle or not has_update"), "active trip without vehicle or update"),
        rule(live.filter("observed_at > generated_at or observed_at < 1 or observed_at is null"), "update newer than feed"),
        rule(s.vehicles.filter("observed_at > generated_at or observed_at < 1 or observed_at is null"), "vehicle newer than feed"),
        rule(s.vehicles.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "unknown status"),
        rule(s.vehicles.join(calls, ["trip_id", "stop_sequence"], "left_anti"), "vehicle at no planned call"),
        rule(s.vehicles.join(calls, ["trip_id", "stop_sequence"]).filter("not (stop_id <=> _stop)"), "vehicle at another stop"),
        rule(moved.filter("not (delay_sequence <=> stop_sequence)"), "delay of another stop"),
        rule(p.filter("stop_sequence <= at_sequence"), "prediction of the past"),
        rule(p.filter("_before >= stop_sequence"), "predictions out of order"),
        rule(p.join(calls, ["trip_id", "stop_sequence"], "left_anti"), "prediction of no planned call"),
        rule(p.join(calls, ["trip_id", "stop_sequence"]).filter("not (stop_id <=> _stop)"), "prediction of another stop"),
        rule(p.filter("arrival is null and departure is null"), "prediction without event"),
        rule(p.filter("(arrival is not null and arrival.delay is null and arrival.time is null) or (departure is not null and departure.delay is null and departure.time is null)"), "event without delay and time"),
        rule(p.filter("departure.time < arrival.time"), "departure before arrival"),
        rule(many(s.trips, *INSTANCE).withColumn("entity", F.col("trip_id")), "instance repeated"),
        rule(many(s.vehicles, "vehicle_id"), "vehicle repeated", "vehicle_id"),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def normalise(messages: DataFrame, schedule: Mapping[str, DataFrame], text: str = "value") -> Snapshot:
    """The facts, if no rule is broken."""
    s = facts(messages, text)
    first = violations(s, schedule).limit(5).collect()
    if first:
        raise RealtimeError("; ".join(f"{r['rule']}: {r['key']}" for r in first))
    return s
