"""The exact mesh of departures: planned succession decides which calls neighbour each other.

rows: observed calls with service_date, start_time, trip_id (the instance), vehicle_id, route_id, direction_id, stop_id, parent_station, stop_sequence, move_timestamp,
trunk_route_id and headway_trunk_seconds, one record a call (``one_record``). calls: planned (trip_id, stop_sequence).

Events are keyed by (service_date, vehicle_id, parent_station, direction_id, departure_timestamp); relations by kind, source and target event. Contradictions are
not dropped silently: ``violations`` lists them, and events or runs that contradict each other are in no relation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.single import with_row

INSTANCE = ["service_date", "start_time", "trip_id"]
KEY = ["service_date", "vehicle_id", "parent_station", "direction_id", "departure_timestamp"]
LANE = ["parent_station", "trunk_route_id", "direction_id"]


def one_record(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The first record of each instance, vehicle and call; rows with a null in any of those are none."""
    keys = [*INSTANCE, "vehicle_id", "stop_sequence"]
    whole = rows.filter(" and ".join(f"{k} is not null" for k in keys))
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.col(row_id)).alias("_r")).select(*keys, "_r.*")


def successors(calls: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, next_sequence) in planned order."""
    trip = Window.partitionBy("trip_id").orderBy("stop_sequence")
    return calls.select("trip_id", "stop_sequence").distinct().select("trip_id", "stop_sequence", F.lead("stop_sequence").over(trip).alias("next_sequence")).filter("next_sequence is not null")


def departures(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls left at a known time: that at which the vehicle was seen leaving for the planned next call. Planned successor, then an equi-join with that very call."""
    nxt = rows.select(*INSTANCE, "vehicle_id", F.col("stop_sequence").alias("next_sequence"), F.col("stop_id").alias("following_stop_id"), F.col("move_timestamp").alias("departure_timestamp")).filter("departure_timestamp is not null")
    return rows.join(successors(calls), ["trip_id", "stop_sequence"]).join(nxt, [*INSTANCE, "vehicle_id", "next_sequence"])


def events(left: DataFrame) -> DataFrame:
    """One row for each physical departure and how many records name it; the records themselves are the rows of `departures` with its key."""
    return left.groupBy(*KEY).agg(F.min("trunk_route_id").alias("trunk_route_id"), F.count(F.lit(1)).alias("aliases"), F.count_distinct("trunk_route_id").alias("trunks"), F.count_distinct("headway_trunk_seconds").alias("labels"), F.max("headway_trunk_seconds").alias("label"))


def runs(left: DataFrame) -> DataFrame:
    """(source key as s_..., target key as t_...): departures of planned neighbours of one instance and vehicle, each pair once."""
    mine = left.select(*INSTANCE, "next_sequence", *KEY[1:])
    then = left.select(*INSTANCE, F.col("stop_sequence").alias("next_sequence"), "vehicle_id", *[F.col(k).alias(f"t_{k}") for k in KEY[2:]])
    pairs = mine.join(then, [*INSTANCE, "vehicle_id", "next_sequence"])
    s = [F.col(k).alias(f"s_{k}") for k in KEY]
    return pairs.select(*s, F.col("service_date").alias("t_service_date"), F.col("vehicle_id").alias("t_vehicle_id"), *[f"t_{k}" for k in KEY[2:]]).distinct()


@dataclass(frozen=True)
class EventMesh:
    events: DataFrame  # KEY, trunk_route_id, aliases, trunks, labels, label
    relations: DataFrame  # kind, s_..., t_..., elapsed_seconds

    def violations(self) -> DataFrame:
        """(rule, n): broken rules of events and relations and how often."""
        s, t = [f"s_{k}" for k in KEY], [f"t_{k}" for k in KEY]
        r = self.relations
        known = self.events.select(*KEY)
        names = lambda p: known.select(*[F.col(k).alias(f"{p}_{k}") for k in KEY])
        rule = lambda f, name: f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        found = [
            rule(self.events.groupBy(*KEY).count().filter("count > 1"), "event repeated"),
            rule(self.events.filter("aliases < 1"), "event without record"),
            rule(self.events.filter("trunks <> 1"), "event of several trunks"),
            rule(self.events.filter("labels > 1"), "event of several labels"),
            rule(r.filter("kind not in ('run', 'headway')"), "unknown kind"),
            rule(r.join(names("s"), s, "left_anti"), "source is no event"),
            rule(r.join(names("t"), t, "left_anti"), "target is no event"),
            rule(r.filter(" and ".join(f"{a} <=> {b}" for a, b in zip(s, t))), "self edge"),
            rule(r.filter("s_departure_timestamp >= t_departure_timestamp"), "time does not advance"),
            rule(r.filter("elapsed_seconds <> t_departure_timestamp - s_departure_timestamp"), "elapsed time contradicts"),
            rule(r.groupBy("kind", *s, *t).count().filter("count > 1"), "relation repeated"),
            rule(r.groupBy(*s, *t).agg(F.count_distinct("kind").alias("k")).filter("k > 1"), "kinds contradict"),
            rule(r.filter("kind = 'headway'").join(self.events.select(*[F.col(k).alias(f"t_{k}") for k in KEY], "label"), t).filter("label <> elapsed_seconds"), "label contradicts headway"),
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.filter("n > 0")

    def prefix(self, cutoff: int) -> EventMesh:
        """What was known before a time: its events and the relations with both ends among them."""
        inside = self.events.filter(F.col("departure_timestamp") < cutoff)
        kept = self.relations.filter((F.col("s_departure_timestamp") < cutoff) & (F.col("t_departure_timestamp") < cutoff))
        return EventMesh(inside, kept)

    def cut_audit(self, cutoff: int) -> DataFrame:
        """(retained_events, excluded_events, retained_relations, crossing_relations) of one cutoff: events and relations are read once."""
        early = F.col("departure_timestamp") < cutoff
        s, t = F.col("s_departure_timestamp") < cutoff, F.col("t_departure_timestamp") < cutoff
        rows = self.events.select(early.alias("a"), (~early).alias("b"), F.lit(False).alias("c"), F.lit(False).alias("d")).unionByName(self.relations.select(F.lit(False).alias("a"), F.lit(False).alias("b"), (s & t).alias("c"), (s != t).alias("d")))
        return rows.agg(*[F.count_if(c).alias(n) for c, n in (("a", "retained_events"), ("b", "excluded_events"), ("c", "retained_relations"), ("d", "crossing_relations"))])

    def degrees(self) -> DataFrame:
        """(largest_in, largest_out)."""
        ends = self.relations.select(F.struct(*[F.col(f"t_{k}").alias(k) for k in KEY]).alias("at"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(self.relations.select(F.struct(*[F.col(f"s_{k}").alias(k) for k in KEY]).alias("at"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        return ends.groupBy("at").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).agg(F.coalesce(F.max("i"), F.lit(0)).alias("largest_in"), F.coalesce(F.max("o"), F.lit(0)).alias("largest_out"))

    def labelled(self) -> DataFrame:
        """Headway targets whose label is known: the lane and the time."""
        target = self.events.filter("label is not null").select(*[F.col(k).alias(f"t_{k}") for k in KEY], "trunk_route_id")
        return self.relations.filter("kind = 'headway'").join(target, [f"t_{k}" for k in KEY]).select(F.col("t_parent_station").alias("parent_station"), "trunk_route_id", F.col("t_direction_id").alias("direction_id"), F.col("t_departure_timestamp").alias("departure_timestamp"))

    def clock_audit(self, start: int, end: int, seconds: int) -> DataFrame:
        """What a clock of so many seconds from the interval's start does to the labelled targets: cells, occupied, empty and colliding ones, merged events, most in a cell."""
        cell = F.floor((F.col("departure_timestamp") - start) / F.lit(seconds))
        cells = self.labelled().groupBy(*LANE, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        ticks = -(-(end - start) // seconds)
        out = cells.agg(F.count_distinct(F.struct(*LANE)).alias("lanes"), F.count(F.lit(1)).alias("occupied_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("target_events"), F.count_if(F.col("n") > 1).alias("colliding_cells"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged_events"), F.coalesce(F.max("n"), F.lit(0)).alias("max_events_per_cell"))
        return out.select(F.lit(seconds).alias("seconds"), (F.col("lanes") * ticks).alias("cells"), "occupied_cells", (F.col("lanes") * ticks - F.col("occupied_cells")).alias("empty_cells"), "target_events", "colliding_cells", "merged_events", "max_events_per_cell", (F.col("colliding_cells") > 0).alias("aggregation_required"))


def headways(found: DataFrame) -> DataFrame:
    """(s_..., t_..., elapsed_seconds): consecutive departures of each lane; those at one time are ordered by key. A lane's departures are spread over days:
    windows are by lane and day, and a day's first departure is tied to the last one before by a join of the days' ends."""
    order = [k for k in KEY if k != "departure_timestamp"]
    whole = F.struct("departure_timestamp", *order)
    day = F.floor(F.col("departure_timestamp") / F.lit(86_400))
    rows = found.filter("trunks = 1 and labels <= 1").withColumn("_day", day).withColumn("_me", whole)
    inside = Window.partitionBy(*LANE, "_day").orderBy("_me")
    marked = rows.withColumn("_before", F.lag("_me").over(inside))
    ends = rows.groupBy(*LANE, "_day").agg(F.max("_me").alias("_last"))
    # one row for each lane and day
    ends = ends.withColumn("_last_before", F.lag("_last").over(Window.partitionBy(*LANE).orderBy("_day"))).select(*[F.col(c).alias(f"e_{c}") for c in [*LANE, "_day"]], "_last_before")
    on = F.col("_day") == F.col("e__day")
    for c in LANE:
        on = on & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    tied = marked.join(ends, on).withColumn("_p", F.coalesce("_before", "_last_before")).filter("_p is not null")
    return tied.select(*[F.col(f"_p.{k}").alias(f"s_{k}") for k in KEY], *[F.col(k).alias(f"t_{k}") for k in KEY], (F.col("departure_timestamp") - F.col("_p.departure_timestamp")).alias("elapsed_seconds"))


def lower(rows: DataFrame, calls: DataFrame) -> EventMesh:
    """The mesh of observed calls: runs with one successor and one predecessor, and headways that advance."""
    left = departures(rows, calls)
    found = events(left)
    pairs = runs(left)
    s, t = [f"s_{k}" for k in KEY], [f"t_{k}" for k in KEY]
    many = lambda by, of: pairs.groupBy(*by).agg(F.count_distinct(F.struct(*of)).alias("_n")).filter("_n > 1").select(*by)
    clear = pairs.join(many(s, t), s, "left_anti").join(many(t, s), t, "left_anti").filter("s_departure_timestamp < t_departure_timestamp")
    clear = clear.select(F.lit("run").alias("kind"), *s, *t, (F.col("t_departure_timestamp") - F.col("s_departure_timestamp")).alias("elapsed_seconds"))
    apart = headways(found).filter("elapsed_seconds > 0").select(F.lit("headway").alias("kind"), *s, *t, "elapsed_seconds")
    return EventMesh(found, clear.unionByName(apart))


def topology(calls: DataFrame) -> DataFrame:
    """(trip_id, stop_sequence, from_stop, to_stop): the planned edge into each call. calls: trip_id, stop_sequence, stop_id."""
    trip = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id")
    return calls.select("trip_id", "stop_sequence", "stop_id").distinct().select("trip_id", "stop_sequence", F.lag("stop_id").over(trip).alias("from_stop"), F.col("stop_id").alias("to_stop")).filter("from_stop is not null")


def active_edges(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(from_stop, to_stop, active): the distinct planned edges and whether an observed call used them."""
    incoming = topology(calls)
    used = rows.select("trip_id", "stop_sequence").distinct().withColumn("_u", F.lit(1))
    return incoming.join(used, ["trip_id", "stop_sequence"], "left").groupBy("from_stop", "to_stop").agg(F.coalesce(F.max("_u"), F.lit(0)).alias("u")).select("from_stop", "to_stop", (F.col("u") == 1).alias("active"))


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, distinct instances, vehicles, stops, and nulls of each column) in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct(F.struct(*INSTANCE)).alias("trip_instances"), F.count_distinct("vehicle_id").alias("vehicles"), F.count_distinct("stop_id").alias("stops"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def replay_headway_audit(mesh: EventMesh, seconds: int = 300) -> DataFrame:
    """Derived headways against labels, and the epoch-aligned bins of those that agree."""
    target = mesh.events.select(*[F.col(k).alias(f"t_{k}") for k in KEY], "label")
    judged = mesh.relations.filter("kind = 'headway'").join(target, [f"t_{k}" for k in KEY])
    exact = F.col("label") == F.col("elapsed_seconds")
    bins = judged.filter(exact).groupBy("t_parent_station", "t_direction_id", (F.floor(F.col("t_departure_timestamp") / F.lit(seconds)) * seconds).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sums = judged.agg(F.count(F.lit(1)).alias("derived_values"), F.count_if(exact).alias("exact_matches"), F.count_if(F.col("label") != F.col("elapsed_seconds")).alias("mismatches"), F.count_if(F.col("label").isNull()).alias("derived_only"))
    binned = bins.agg(F.count(F.lit(1)).alias("target_bins"), F.count_if(F.col("n") > 1).alias("colliding_target_bins"), F.coalesce(F.max("n"), F.lit(0)).alias("max_targets_per_bin"))
    return with_row(sums, binned)
