"""Service days: dates as YYYYMMDD and clock times that may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours may pass 24; minutes and seconds are two digits below 60.
CLOCK = r"\A\s*[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]\s*\z"


def service_seconds(text: Column) -> Column:
    """Seconds of the service day of H:MM:SS; null for anything else."""
    part = lambda i: F.split_part(F.trim(text), F.lit(":"), F.lit(i)).cast("int")
    return F.when(text.rlike(CLOCK), part(1) * 3600 + part(2) * 60 + part(3))


def service_date(number: Column) -> Column:
    """The date of YYYYMMDD, as number or text; null where it is none."""
    text = number.cast("string")
    return F.when(text.rlike(r"\A[0-9]{8}\z"), F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def occurred_at(move: str = "move_timestamp", stop: str = "stop_timestamp") -> Column:
    """When a call was observed: its departure if known, else its arrival."""
    return F.coalesce(F.col(move), F.col(stop))


def source_kind(trip_id: Column) -> Column:
    return F.when(trip_id.like("ADDED-%"), "added").when(trip_id.like("NONREV-%"), "nonrevenue").otherwise("other")
