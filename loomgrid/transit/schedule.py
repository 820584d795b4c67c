"""Planned service: typed tables, their checks and what follows from them.

``parse`` types the text tables of a schedule archive; cells that don't parse are null and listed with file and line. ``violations`` returns all broken rules as rows
(rule, key), so a caller may audit or refuse; ``require`` refuses.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.service import service_date, service_seconds
from loomgrid.functions.single import with_row

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Columns that each table has to have, and those that are typed.
REQUIRED = {
    "agency": ("agency_id", "agency_timezone"), "calendar": ("service_id", *WEEKDAYS, "start_date", "end_date"), "calendar_dates": ("service_id", "date", "exception_type"), "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id", "agency_id", "route_type"), "trips": ("route_id", "service_id", "trip_id"), "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"), "frequencies": ("trip_id", "start_time", "end_time", "headway_secs"),
}
_CLOCKS, _DATES = ("arrival_time", "departure_time", "start_time", "end_time"), ("start_date", "end_date", "date")
_WHOLE, _REAL = ("stop_sequence", "direction_id", "route_type", "exception_type", "headway_secs", "exact_times", *WEEKDAYS), ("stop_lat", "stop_lon")


class ScheduleError(ValueError):
    """A schedule breaks its rules."""


def _typed(name: str) -> Column:
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    if name in _CLOCKS:
        return service_seconds(text)
    if name in _DATES:
        return service_date(text)
    if name in _WHOLE:
        return text.try_cast("int")
    return text.try_cast("double") if name in _REAL else text


def parse(texts: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, unparsed). texts: by table, all columns as strings and `line`; unparsed: (rule, key) of missing columns and cells that are of no such type."""
    tables, bad = {}, None
    for table, frame in texts.items():
        absent = set(REQUIRED.get(table, ())) - set(frame.columns)
        if absent:
            raise ScheduleError(f"{table}: columns {sorted(absent)} are missing")
        columns = [c for c in frame.columns if c != "line"]
        wrong = F.filter(F.array(*[F.when((F.trim(F.col(c)) != "") & _typed(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
        found = frame.select(F.explode(wrong).alias("c"), "line").select(F.concat(F.lit("unreadable "), "c").alias("rule"), F.concat_ws(":", F.lit(table), F.col("line").cast("string")).alias("key"))
        bad = found if bad is None else bad.unionByName(found)
        tables[table] = frame.select(*[_typed(c).alias(c) for c in columns], "line")
    return tables, bad


def violations(t: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key): repeated ids, dangling references, values out of range, trips of less than two calls, terminal calls without times, times that run back and
    overlapping frequencies. Each rule is an aggregate or an anti-join."""
    key = lambda *cs: F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs]).alias("key")
    rule = lambda f, name, *cs: f.select(F.lit(name).alias("rule"), key(*cs))
    repeated = lambda n, *cs: rule(t[n].groupBy(*cs).count().filter("count > 1"), f"{n} repeated", *cs)
    loose = lambda n, c, to, c2=None: rule(t[n].filter(F.col(c).isNotNull()).join(t[to].select(F.col(c2 or c).alias(c)), c, "left_anti").select(c).distinct(), f"{n}.{c} dangling", c)
    unique = {"agency": ["agency_id"], "calendar": ["service_id"], "stops": ["stop_id"], "routes": ["route_id"], "trips": ["trip_id"], "calendar_dates": ["service_id", "date"], "stop_times": ["trip_id", "stop_sequence"]}
    refers = [("routes", "agency_id", "agency"), ("trips", "route_id", "routes"), ("trips", "service_id", "calendar"), ("calendar_dates", "service_id", "calendar"), ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops"), ("frequencies", "trip_id", "trips")]
    out = [repeated(n, *cs) for n, cs in unique.items() if n in t] + [loose(*r) for r in refers if r[0] in t and r[2] in t]
    ranges = {
        "stops": ("stop_lat not between -90 and 90 or stop_lon not between -180 and 180", "stop_id"), "calendar": ("end_date < start_date or " + " or ".join(f"{d} not in (0, 1)" for d in WEEKDAYS), "service_id"),
        "calendar_dates": ("exception_type not in (1, 2)", "service_id"), "stop_times": ("departure_time < arrival_time or stop_sequence < 0", "trip_id"), "frequencies": ("end_time <= start_time or headway_secs <= 0", "trip_id"),
    }
    out += [rule(t[n].filter(c), f"{n} out of range", k) for n, (c, k) in ranges.items() if n in t]
    if "trips" in t and "stop_times" in t:
        ends = t["stop_times"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), *[f(F.struct("stop_sequence", "arrival_time", "departure_time")).alias(n) for f, n in ((F.min, "a"), (F.max, "z"))])
        out.append(rule(t["trips"].join(ends, "trip_id", "left").filter("n is null or n < 2"), "trip of less than two calls", "trip_id"))
        out.append(rule(ends.filter("a.arrival_time is null or a.departure_time is null or z.arrival_time is null or z.departure_time is null"), "terminal call without time", "trip_id"))
    if "frequencies" in t:
        trip = Window.partitionBy("trip_id").orderBy("start_time", "end_time")
        out.append(rule(t["frequencies"].select("trip_id", "start_time", "end_time", F.lead("start_time").over(trip).alias("_n")).filter("_n < end_time"), "frequencies overlap", "trip_id"))
    every = out[0]
    for f in out[1:]:
        every = every.unionByName(f)
    return every


def require(*found: DataFrame) -> None:
    """Refuses if any violation is found, naming the first ones."""
    for f in found:
        first = f.orderBy("rule", "key").limit(5).collect()
        if first:
            raise ScheduleError("; ".join(f"{r['rule']}: {r['key']}" for r in first))


def ordered_calls(calls: DataFrame, by: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Calls with their place in the trip, from 0."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("stop_sequence", "stop_id")) - 1
    return calls.select(*by, place.alias("place"), "stop_sequence", "stop_id", "arrival_time", "departure_time")


def next_calls(calls: DataFrame, by: tuple[str, ...] = ("trip_id",), tie: str | None = None) -> DataFrame:
    """Adds next_stop_id and next_sequence within the trip."""
    trip = Window.partitionBy(*by).orderBy("stop_sequence", *([tie] if tie else []))
    return calls.select("*", F.lead("stop_id").over(trip).alias("next_stop_id"), F.lead("stop_sequence").over(trip).alias("next_sequence"))


def segment_occurrences(trips: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, from_stop_id, to_stop_id, trip_id, from_sequence, to_sequence): every pair of neighbouring calls."""
    pairs = next_calls(calls).filter("next_stop_id is not null").join(trips.select("trip_id", "route_id"), "trip_id")
    return pairs.select("route_id", F.col("stop_id").alias("from_stop_id"), F.col("next_stop_id").alias("to_stop_id"), "trip_id", F.col("stop_sequence").alias("from_sequence"), F.col("next_sequence").alias("to_sequence"))


def segments(trips: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, from_stop_id, to_stop_id, occurrences, first_trip): the distinct pairs of neighbouring stops of each route and how often trips use them."""
    return segment_occurrences(trips, calls).groupBy("route_id", "from_stop_id", "to_stop_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("trip_id").alias("first_trip"))


def service_active(services: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(service_id, service_date, active): weekday and range, unless an exception (added or not) of that day says otherwise.
    services: service_id, start_date, end_date and a column for each weekday; exceptions: service_id, service_date, added; dates: service_date (type date), a calendar."""
    days = dates.agg(F.collect_set("service_date").alias("_days"))
    each = with_row(services, days).withColumn("service_date", F.explode("_days"))
    runs = F.element_at(F.array(*[F.col(d) == 1 for d in WEEKDAYS]), F.weekday("service_date") + 1)
    base = (F.col("service_date") >= F.col("start_date")) & (F.col("service_date") <= F.col("end_date")) & runs
    said = exceptions.groupBy("service_id", "service_date").agg(F.max("added").alias("_added"))
    return each.join(said, ["service_id", "service_date"], "left").select("service_id", "service_date", F.coalesce("_added", base).alias("active"))


def in_frequency(instances: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Instances (trip_id, start_time) whose start lies in one of their trip's half-open frequency intervals."""
    same = [instances["trip_id"] == frequencies["trip_id"], instances["start_time"] >= frequencies["start_time"], instances["start_time"] < frequencies["end_time"]]
    return instances.join(frequencies, same, "left_semi")
