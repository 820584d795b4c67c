"""Irregular readings onto a regular grid.

Readings are aggregated into epoch-aligned periods first, with partial aggregation before the shuffle. Each source then gets
its sequence of periods from the first to the last reading; the buckets are joined to it from the left. A period without
reading takes the last bucket before it if that lies within ``max_gap`` seconds ("carried"), else it stays empty ("missing").

The last observation is carried by spreading every bucket over the few periods it may fill and keeping the nearest, so no
window spans a source. Sequences are made in blocks of a day: a wrong reading years away lengthens the series, not one array.

Defined cases: rows without positive time or without a value in a required column are no readings. Null in another source
column is a source of its own. Readings at the same second are counted each. No reading, no series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a period, and how long an observation is carried forward.
STEP, MAX_GAP = 300, 900


def regular_series(rows: DataFrame, source: list[Column], time: Column, required: Column, step: int = STEP, max_gap: int = MAX_GAP) -> DataFrame:
    """The source columns, period_start, readings, last_reading (of the period or carried), age_s and status (observed, carried, missing)."""
    named = [c.alias(f"_s{i}") for i, c in enumerate(source)]
    names = [rows.select(c).columns[0] for c in source]
    keys = [f"_s{i}" for i in range(len(source))]
    readings = rows.select(*named, time.cast("long").alias("_t"), required.alias("_ok")).filter("_ok and _t > 0")
    period = F.expr(f"(_t div {step}) * {step}")
    buckets = readings.groupBy(*keys, period.alias("period_start")).agg(F.count(F.lit(1)).alias("readings"), F.max("_t").alias("last_reading"))

    day = 86_400 // step * step
    spans = buckets.groupBy(*keys).agg(F.min("period_start").alias("a"), F.max("period_start").alias("z"))
    blocks = spans.select(*keys, "a", "z", F.explode(F.expr(f"sequence(a, z, {day}L)")).alias("block"))
    grid = blocks.select(*keys, F.explode(F.expr(f"sequence(block, least(z, block + {day - step}L), {step}L)")).alias("period_start"))

    reach = max_gap // step
    spread = buckets.select(*keys, "period_start", "readings", "last_reading", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("k"))
    nearest = (
        spread.withColumn("period_start", F.col("period_start") + F.col("k").cast("long") * step)
        .groupBy(*keys, "period_start")
        .agg(F.min(F.struct("k", "readings", "last_reading")).alias("o"))
    )
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col("g.period_start") == F.col("o.period_start")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = grid.alias("g").join(nearest.alias("o"), on, "left")
    return joined.select(
        *[F.col(f"g.{k}").alias(n) for k, n in zip(keys, names)],
        F.col("g.period_start").alias("period_start"),
        F.when(F.col("o.o.k") == 0, F.col("o.o.readings")).otherwise(F.lit(0)).alias("readings"),
        F.col("o.o.last_reading").alias("last_reading"),
        (F.col("g.period_start") + step - 1 - F.col("o.o.last_reading")).alias("age_s"),
        F.when(F.col("o.o.k").isNull(), "missing").when(F.col("o.o.k") == 0, "observed").otherwise("carried").alias("status"),
    )
