"""Audit of a whole population of observed calls: plans that were valid, departures, headways and runs.

Frames are those of the tables: observed calls with a unique row_id, plans with first and last day of validity. The steps are functions of frames; what several of them
read (departures and their relations) is written once by ``Audit``.

Dates of observation are a calendar and come as one list in one row. Windows are over the calls of a trip of a day or over the departure times of a lane of a day. Joins are equi-joins and
left to the optimiser.

Defined cases: the order of a trip's calls is by time, calls without time last; trips with two calls at one time are ambiguous and leave the order-dependent steps (rows of null trips, which match
none, stay and are ordered by row_id). Null members of a key count as a value in distinct counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.service import occurred_at, service_seconds, source_kind
from loomgrid.functions.single import with_row
from loomgrid.session import written

TRIP = ["service_date", "route_id", "trip_id"]
EVENT = ["service_date", "vehicle_id", "parent_station", "direction_id", "departure_timestamp"]
LANE = ["service_date", "parent_station", "trunk_route_id", "direction_id"]
TARGET = ["target_vehicle_id", "target_parent_station", "target_direction_id", "target_timestamp"]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, nulls being equal to nulls."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _dates(frame: DataFrame, rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The frame's rows once for each service date of the observed rows from start to end."""
    days = rows.agg(F.array_sort(F.collect_set("service_date")).alias("_days"))
    return with_row(frame, days).withColumn("service_date", F.explode(F.filter("_days", lambda d: (d >= start) & (d <= end)))).drop("_days")


def planned_calls(observed: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame) -> DataFrame:
    """Distinct planned calls of each service date for which trip, call and stop are valid: (service_date, trip_id, route_id, direction_id, parent_station, arrival, departure)."""
    valid = lambda frame, p, *columns: frame.select(*columns, F.col("gtfs_active_date").alias(f"_{p}a"), F.col("gtfs_end_date").alias(f"_{p}z"))
    c = valid(calls, "c", "trip_id", "stop_id", service_seconds(F.col("arrival_time")).alias("arrival"), service_seconds(F.col("departure_time")).alias("departure"))
    t = valid(trips, "t", "trip_id", "route_id", "direction_id")
    s = valid(stops, "s", "stop_id", F.coalesce("parent_station", "stop_id").alias("parent_station"))
    every = c.distinct().join(t.distinct(), "trip_id").join(s.distinct(), "stop_id")
    dated = _dates(every, observed, F.greatest("_ca", "_ta", "_sa"), F.least("_cz", "_tz", "_sz"))
    return dated.select("service_date", "trip_id", "route_id", "direction_id", "parent_station", "arrival", "departure").distinct()


def resolved(observed: DataFrame, planned: DataFrame) -> DataFrame:
    """Observed calls with schedule_resolved, whether a planned call agrees in all seven columns, and the kind of their trip."""
    plan = planned.select("service_date", "trip_id", "route_id", F.col("direction_id").cast("int").alias("_d"), "parent_station", F.col("arrival").alias("scheduled_arrival_time"), F.col("departure").alias("scheduled_departure_time"), F.lit(True).alias("_plan"))
    keys = ["service_date", "trip_id", "route_id", "_d", "parent_station", "scheduled_arrival_time", "scheduled_departure_time"]
    out = observed.withColumn("_d", F.col("direction_id").cast("int")).join(plan, keys, "left")
    return out.select(*observed.columns, F.col("_plan").isNotNull().alias("schedule_resolved"), source_kind(F.col("trip_id")).alias("source_kind"))


def ambiguous_trips(observed: DataFrame) -> DataFrame:
    """Trips with two calls at one time (or without time)."""
    return observed.groupBy(*TRIP, occurred_at().alias("_at")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*TRIP).distinct()


def ordered(observed: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Calls of the other trips with their position and the departure: the time at which the trip's next call was left for."""
    trip = Window.partitionBy(*TRIP).orderBy(occurred_at().asc_nulls_last(), "row_id")
    return observed.join(ambiguous, TRIP, "left_anti").select(
        "*", F.row_number().over(trip).alias("trip_position"), F.lead("stop_id").over(trip).alias("following_stop_id"), F.lead("stop_sequence").over(trip).alias("following_stop_sequence"), F.lead("move_timestamp").over(trip).alias("departure_timestamp")
    )


def departures(ordered_calls: DataFrame) -> DataFrame:
    """Calls with a departure, of trips of more than one stop."""
    return ordered_calls.filter("stop_count > 1 and departure_timestamp is not null")


def physical_events(aliases: DataFrame) -> DataFrame:
    """Departures of one vehicle at one place and time are one event; how many records name it, trunks and labels they give."""
    return aliases.groupBy(*EVENT).agg(
        F.min("trunk_route_id").alias("trunk_route_id"), F.max("headway_trunk_seconds").alias("source_headway_seconds"), F.count(F.lit(1)).alias("aliases"), F.count_distinct("trunk_route_id").alias("trunk_routes"), F.count_distinct("headway_trunk_seconds").alias("source_labels")
    )


def lane_times(events: DataFrame) -> DataFrame:
    return events.groupBy(*LANE, "departure_timestamp").agg(F.count(F.lit(1)).alias("event_count"))


def headway_relations(times: DataFrame) -> DataFrame:
    """Consecutive departures of a lane and day, each alone at its time: how many seconds lie between."""
    lane = Window.partitionBy(*LANE).orderBy("departure_timestamp")
    before = times.select("*", F.lag("departure_timestamp").over(lane).alias("source_timestamp"), F.lag("event_count").over(lane).alias("source_count"))
    return before.filter("event_count = 1 and source_count = 1").withColumn("elapsed_seconds", F.col("departure_timestamp") - F.col("source_timestamp"))


def run_relations(aliases: DataFrame) -> DataFrame:
    """Departures of a trip's neighbouring calls, forward in time, each pair once."""
    trip = Window.partitionBy(*TRIP).orderBy("trip_position")
    nxt = {"target_vehicle_id": "vehicle_id", "target_parent_station": "parent_station", "target_direction_id": "direction_id", "target_timestamp": "departure_timestamp"}
    after = aliases.select("*", F.lead("trip_position").over(trip).alias("_next"), *[F.lead(c).over(trip).alias(n) for n, c in nxt.items()])
    return after.filter("_next = trip_position + 1 and departure_timestamp < target_timestamp").select("service_date", "route_id", *EVENT[1:], *TARGET).distinct()


def run_conflicts(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with several targets, targets with several sources)."""
    many = lambda by, of: runs.groupBy(*by).agg(F.count_distinct(F.struct(*of)).alias("_n")).filter("_n > 1").select(*by)
    return many(EVENT, TARGET), many(["service_date", *TARGET], EVENT[1:])


def exact_runs(runs: DataFrame) -> DataFrame:
    sources, targets = run_conflicts(runs)
    return runs.join(sources, EVENT, "left_anti").join(targets, ["service_date", *TARGET], "left_anti")


def feed_versions(observed: DataFrame, feeds: DataFrame, version: str = "feed_version") -> DataFrame:
    """(service_date, feed_versions): the versions valid on each date, in order, joined."""
    dated = _dates(feeds.select(version, "gtfs_active_date", "gtfs_end_date"), observed, F.col("gtfs_active_date"), F.col("gtfs_end_date"))
    return dated.groupBy("service_date").agg(F.array_join(F.array_sort(F.collect_list(version)), " | ").alias("feed_versions"))


def rollup(rows: DataFrame) -> DataFrame:
    """Counts by date and route of the resolved population."""
    unresolved = ~F.col("schedule_resolved")
    kind = lambda k: F.count_if(unresolved & (F.col("source_kind") == k))
    return rows.groupBy("service_date", "route_id").agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_distinct(F.struct("start_time", "trip_id")).alias("trip_instances"), F.count_distinct("vehicle_id").alias("vehicles"), F.count_if(F.col("move_timestamp").isNull()).alias("missing_movement"),
        F.count("headway_trunk_seconds").alias("source_headways"), F.count_if("schedule_resolved").alias("schedule_resolved"), F.count_if(unresolved).alias("schedule_unresolved"),
        kind("added").alias("unresolved_added"), kind("nonrevenue").alias("unresolved_nonrevenue"), kind("other").alias("unresolved_other"),
    )


@dataclass(frozen=True)
class Audit:
    """The order-dependent part over one population; shared steps are written once."""

    observed: DataFrame

    @cached_property
    def ambiguous(self) -> DataFrame:
        return written(ambiguous_trips(self.observed))

    @cached_property
    def aliases(self) -> DataFrame:
        columns = ["row_id", *TRIP, "vehicle_id", "direction_id", "stop_id", "parent_station", "stop_sequence", "move_timestamp", "stop_timestamp", "trunk_route_id", "headway_trunk_seconds", "stop_count"]
        return written(departures(ordered(self.observed.select(*columns), self.ambiguous)))

    @cached_property
    def events(self) -> DataFrame:
        return written(physical_events(self.aliases))

    @cached_property
    def times(self) -> DataFrame:
        return lane_times(self.events)

    @cached_property
    def headways(self) -> DataFrame:
        return written(headway_relations(self.times))

    @cached_property
    def runs(self) -> DataFrame:
        return written(run_relations(self.aliases))

    @cached_property
    def exact_runs(self) -> DataFrame:
        return exact_runs(self.runs)

    def labels(self) -> DataFrame:
        """Departure records with the derived headway of their lane and time."""
        lane = [*LANE, "departure_timestamp"]
        return self.aliases.join(self.headways.select(*lane, "elapsed_seconds"), lane)

    def battery(self) -> DataFrame:
        """One row of measures. Each is an aggregate of its own frame; their single rows are put together by name."""
        label = F.col("headway_trunk_seconds")
        one = F.count(F.lit(1))
        sources, targets = run_conflicts(self.runs)
        labels = self.labels().agg(F.count_if(label == F.col("elapsed_seconds")).alias("exact_headways"), F.count_if(label.isNotNull() & (label != F.col("elapsed_seconds"))).alias("mismatched_headways"))
        unlabelled = self.headways.join(self.events.select(*LANE, "departure_timestamp", "source_headway_seconds"), [*LANE, "departure_timestamp"]).agg(F.count_if(F.col("source_headway_seconds").isNull()).alias("derived_only_headways"))
        zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
        parts = [
            self.ambiguous.agg(one.alias("ambiguous_order_trips")),
            self.observed.select(*TRIP, "row_id").join(self.ambiguous, TRIP, "left_semi").agg(one.alias("ambiguous_order_rows")),
            self.aliases.agg(one.alias("represented_source_rows")),
            self.events.agg(one.alias("physical_departures"), zero(F.sum(F.col("aliases") - 1), "duplicate_aliases"), F.count_if((F.col("trunk_routes") > 1) | (F.col("source_labels") > 1)).alias("conflicting_aliases"), F.count_distinct(F.struct("parent_station", "trunk_route_id", "direction_id")).alias("station_directions")),
            self.times.agg(F.count_if(F.col("event_count") > 1).alias("simultaneous_groups"), zero(F.sum(F.when(F.col("event_count") > 1, F.col("event_count"))), "simultaneous_events")),
            self.exact_runs.agg(one.alias("run_relations")),
            sources.agg(one.alias("ambiguous_run_sources")),
            targets.agg(one.alias("ambiguous_run_targets")),
            self.headways.agg(one.alias("headway_relations"), F.min("elapsed_seconds").alias("minimum_gap_seconds"), F.max("elapsed_seconds").alias("maximum_gap_seconds"), *[F.expr(f"percentile_disc({p}) within group (order by elapsed_seconds)").cast("long").alias(n) for p, n in ((0.5, "median_gap_seconds"), (0.95, "p95_gap_seconds"))]),
            labels,
            unlabelled,
            self.observed.agg(F.count("headway_trunk_seconds").alias("source_headways")),
        ]
        names = [c for p in parts for c in p.columns]
        long = reduce(DataFrame.unionByName, [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("long").alias("v")) for c in p.columns])).alias("e")).select("e.*") for p in parts])
        row = long.agg(*[F.max(F.when(F.col("m") == c, F.col("v"))).alias(c) for c in names])
        return row.withColumn("boundary_only_headways", F.col("source_headways") - F.col("exact_headways") - F.col("mismatched_headways")).drop("source_headways")

    def groups(self) -> DataFrame:
        """The carrier's counts by date and route: 0 where a group has none."""
        by = ["service_date", "route_id"]
        event = F.struct(*EVENT[1:])
        label, gap = F.col("headway_trunk_seconds"), F.col("elapsed_seconds")
        carrier = self.aliases.groupBy(*by).agg(F.count(F.lit(1)).alias("represented_source_rows"), F.count_distinct(event).alias("physical_departures"), F.count_distinct(F.struct("parent_station", "trunk_route_id", "direction_id")).alias("lanes"), F.min("departure_timestamp").alias("first_departure_timestamp"), F.max("departure_timestamp").alias("last_departure_timestamp"))
        carrier = carrier.withColumn("duplicate_aliases", F.col("represented_source_rows") - F.col("physical_departures"))
        labels = self.labels().groupBy(*by).agg(
            F.count(F.lit(1)).alias("headway_relations"), F.count_if(label == gap).alias("exact_headways"), F.count_if(label.isNotNull() & (label != gap)).alias("mismatched_headways"), F.count_if(label.isNull()).alias("derived_only_headways"),
            F.expr("percentile_disc(0.5) within group (order by elapsed_seconds)").cast("long").alias("median_gap_seconds"), F.expr("percentile_disc(0.95) within group (order by elapsed_seconds)").cast("long").alias("p95_gap_seconds"), F.max(gap).alias("maximum_gap_seconds"),
        )
        unclear = self.observed.select(*TRIP).join(self.ambiguous, TRIP).groupBy(*by).agg(F.count_distinct("trip_id").alias("ambiguous_order_trips"), F.count(F.lit(1)).alias("ambiguous_order_rows"))
        runs = self.exact_runs.groupBy(*by).agg(F.count(F.lit(1)).alias("run_relations"))
        out = self.observed.select(*by).distinct()
        for part in (carrier, labels, unclear, runs):
            out = out.join(part, by, "left")
        return out.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c not in by])


def decision(battery: DataFrame, unresolved: int) -> DataFrame:
    """Whether what was measured suffices to go on: exact labels and no contradicting ones."""
    enough = (F.col("exact_headways") > 0) & (F.col("conflicting_aliases") == 0)
    return battery.select("exact_headways", "conflicting_aliases", F.when(enough & F.lit(unresolved > 0), "advance with a mask of the schedule").when(enough, "advance").otherwise("stop").alias("decision"))
