"""A bounded part of the observed calls with the plans it refers to, and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.service import occurred_at, service_seconds
from loomgrid.functions.single import with_row

INSTANCE = ["service_date", "start_time", "trip_id"]


def selected(rows: DataFrame, start: int, end: int, routes: list[str] | None = None) -> DataFrame:
    """Calls observed from start up to, not including, end; of some routes, if named. Both filters reach the scan as far as the time of observation allows."""
    inside = rows.filter((occurred_at() >= start) & (occurred_at() < end))
    return inside if routes is None else inside.filter(F.col("route_id").isin(*routes))


def extract(rows: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame, start: int, end: int, routes: list[str] | None = None) -> dict[str, DataFrame]:
    """The selected calls, and the planned trips, calls and stops that they name on their service dates: semi-joins, so no plan is repeated by its uses."""
    chosen = selected(rows, start, end, routes)
    named = chosen.filter("trip_id is not null").select("trip_id", "service_date").distinct()

    def valid(frame: DataFrame, key: str, uses: DataFrame) -> DataFrame:
        on = [frame[key] == uses[key], uses["service_date"].between(frame["gtfs_active_date"], frame["gtfs_end_date"])]
        return frame.join(uses, on, "left_semi").distinct()

    planned = valid(calls, "trip_id", named)
    days = chosen.select("service_date").distinct()
    held = planned.select("stop_id", "gtfs_active_date", "gtfs_end_date").distinct()
    touched = _on_days(held, days)
    return {"replay": chosen, "trips": valid(trips, "trip_id", named), "calls": planned, "stops": valid(stops, "stop_id", touched)}


def _on_days(held: DataFrame, days: DataFrame) -> DataFrame:
    """Stops on each of the days, a calendar, on which their calls are valid."""
    every = with_row(held, days.agg(F.collect_set("service_date").alias("_days")))
    return every.select("stop_id", F.explode(F.filter("_days", lambda d: (d >= F.col("gtfs_active_date")) & (d <= F.col("gtfs_end_date")))).alias("service_date")).distinct()


def violations(rows: DataFrame, trips: DataFrame, calls: DataFrame, stops: DataFrame, start: int, end: int, row_id: str = "row_id") -> DataFrame:
    """(rule, key): repeated calls of an instance, calls outside the interval, and calls that the plan does not have or has otherwise."""
    key = F.col(row_id).cast("string").alias("key")
    rule = lambda f, name: f.select(F.lit(name).alias("rule"), key)
    plan = calls.select("trip_id", "stop_sequence", F.col("stop_id").alias("_stop"), service_seconds(F.col("arrival_time")).alias("_arrival"), service_seconds(F.col("departure_time")).alias("_departure")).groupBy("trip_id", "stop_sequence").agg(F.collect_set(F.struct("_stop", "_arrival", "_departure")).alias("_plans"))
    lines = trips.select("trip_id", "route_id", F.col("direction_id").cast("int").alias("direction_id")).groupBy("trip_id").agg(F.collect_set(F.struct("route_id", "direction_id")).alias("_lines"))
    known = rows.join(plan, ["trip_id", "stop_sequence"], "left").join(lines, "trip_id", "left").join(stops.select("stop_id").distinct().withColumn("_held", F.lit(True)), "stop_id", "left")
    at = occurred_at()
    agrees = F.exists("_plans", lambda p: p["_stop"].eqNullSafe(F.col("stop_id")))
    timed = F.exists("_plans", lambda p: p["_stop"].eqNullSafe(F.col("stop_id")) & p["_arrival"].eqNullSafe(F.col("scheduled_arrival_time")) & p["_departure"].eqNullSafe(F.col("scheduled_departure_time")))
    lined = F.exists("_lines", lambda x: x["route_id"].eqNullSafe(F.col("route_id")) & x["direction_id"].eqNullSafe(F.col("direction_id").cast("int")))
    checks = {
        "outside the interval": ~F.coalesce((at >= start) & (at < end), F.lit(False)), "trip not planned": F.col("_lines").isNull(), "call not planned": F.col("_plans").isNull(), "stop unknown": F.col("_held").isNull(),
        "route or direction differs": ~lined, "stop differs": ~agrees, "time differs": agrees & ~timed,
    }
    each = known.select(row_id, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule")).select("rule", key)
    repeated = rows.groupBy(*INSTANCE, "stop_sequence").agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias(row_id)).filter("n > 1")
    return each.unionByName(rule(repeated, "call repeated"))
