"""Streams of realtime observations: keyed state, clocks and causal prefixes.

``transitions`` is the streaming twin of ``pairwise``: both compare each observation of an instance with the one before it, whenever that was (absence is no deletion). State
is a few numbers for each instance; an instance that ended stays ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgrid.session import ship

INSTANCE = ["service_date", "start_time", "trip_id"]
#: The result of both twins.
RESULT = "service_date int, start_time int, trip_id string, generated_at long, code string, before long, now long"
_STATE = "generated_at long, stop_sequence long, canceled boolean"


def _judge(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Observations of one instance in the order of their generation within a batch; across batches, a generation that goes back is a finding and changes nothing."""
    last = state.get if state.exists else (None, None, False)
    out = []
    rows = pd.concat(list(pdfs)).sort_values(["generated_at", "stop_sequence", "canceled"], kind="stable")
    for generated, sequence, canceled in zip(rows.generated_at, rows.stop_sequence, rows.canceled):
        generated, canceled = int(generated), bool(canceled)
        sequence = None if pd.isna(sequence) else int(sequence)
        seen, place, ended = last
        if seen is not None and generated < seen:
            out.append((*key, generated, "GENERATION_REGRESSED", seen, generated))
            continue
        if ended and not canceled:
            out.append((*key, generated, "ACTIVE_AFTER_TERMINAL", None, None))
        if place is not None and sequence is not None and sequence < place:
            out.append((*key, generated, "STOP_REGRESSED", place, sequence))
        last = (generated, sequence if sequence is not None else place, ended or canceled)
    state.update(last)
    frame = pd.DataFrame(out, columns=[c.strip().split()[0] for c in RESULT.split(",")])
    yield frame.astype({"before": "Int64", "now": "Int64"})


def transitions(observations: DataFrame) -> DataFrame:
    """Findings of a stream of (INSTANCE, generated_at, stop_sequence, canceled)."""
    ship(observations.sparkSession)
    return observations.groupBy(*INSTANCE).applyInPandasWithState(_judge, RESULT, _STATE, "append", GroupStateTimeout.NoTimeout)


def pairwise(observations: DataFrame) -> DataFrame:
    """The same over a table in the order of generations, in window functions over an instance's observations."""
    before = Window.partitionBy(*INSTANCE).orderBy("generated_at", F.col("stop_sequence").asc_nulls_last(), "canceled").rowsBetween(Window.unboundedPreceding, -1)
    rows = observations.select(*INSTANCE, "generated_at", "stop_sequence", "canceled", F.last("stop_sequence", ignorenulls=True).over(before).alias("_place"), F.max("canceled").over(before).alias("_ended"))
    found = F.array_compact(F.array(
        F.when(F.col("_ended") & ~F.col("canceled"), F.struct(F.lit("ACTIVE_AFTER_TERMINAL").alias("code"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("now"))),
        F.when(F.col("stop_sequence") < F.col("_place"), F.struct(F.lit("STOP_REGRESSED").alias("code"), F.col("_place").cast("long").alias("before"), F.col("stop_sequence").cast("long").alias("now"))),
    ))
    return rows.select(*INSTANCE, "generated_at", F.explode(found).alias("f")).select(*INSTANCE, F.col("generated_at").cast("long").alias("generated_at"), "f.*")


def stale(observations: DataFrame, as_of: int, limit: int, observed: str = "observed_at") -> DataFrame:
    """Observations older than a limit: found, not dropped. Stateless, for tables and streams."""
    return observations.filter(F.lit(as_of) - F.col(observed) > limit)


def prefix(events: DataFrame, cutoff, time: str = "ts") -> DataFrame:
    """What happened before a cutoff, for tables and streams."""
    return events.filter(F.col(time) < F.lit(cutoff))


def clock(events: DataFrame, keys: list[str], size: str, slide: str | None = None, time: str = "ts", late: str | None = None, value: str | None = None) -> DataFrame:
    """(keys..., start, end, n[, total]): counts by windows of time, tumbling or sliding. With `late`, a stream's state is dropped after that delay."""
    rows = events.withWatermark(time, late) if late else events
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(*keys, F.window(time, size, slide) if slide else F.window(time, size)).agg(*sums).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(["n", "total"] if value else ["n"]))


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """(keys..., start, end, n): runs of events no further apart than a gap."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote. Complete results go through a table of the batch that replaces the one before."""
    spark, path = stream.sparkSession, f"{folder.rstrip('/')}/rows"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder.rstrip('/')}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder.rstrip('/')}/log").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
