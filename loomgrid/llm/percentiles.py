"""Percentiles of very large numeric columns, exact, from summaries that can be combined.

A summary holds how often each value occurs in each group (and day): it is made by partial aggregation, and summaries of separate
partitions or days are combined by adding counts, so their error is none. Percentiles come from one distributed sort of the
combined summary by group and value, whose ranges split groups of any size. Counts per group and sorted partition give each partition's
offset in the group; partitions then locate the target positions among their rows, and neighbouring order statistics are interpolated.

The sorted summary is written to the checkpoint folder: its passes see the same ranges. Partitions are read as streams of
batches with one carried count. Only the counts per group and partition are shuffled again.

Whole numbers and decimals stay what they are: order statistics of any size are exact, and positions and interpolation are decimal. Other numbers are doubles.

Defined cases: null and NaN values are left out; groups of nulls are groups, and group columns of any comparable type keep their full precision. A group without value has no percentiles.
All values of a group may be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.session import cut, ship


def _exact(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DecimalType))


def summarise(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n): the summary of a column."""
    kind = rows.schema[value].dataType
    v = F.col(value).cast("long") if isinstance(kind, T.IntegralType) else F.col(value) if _exact(kind) else F.col(value).cast("double")
    there = "value is not null" if _exact(kind) else "value is not null and not isnan(value)"
    return rows.select(*by, v.alias("value")).filter(there).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: DataFrame, by: list[str]) -> DataFrame:
    """One summary of several (days, partitions), for the groups of the columns by."""
    return summaries.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, with g and n, get the count of the group's rows up to them in the partition."""
    last, carried = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g, n = b.column("g").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
        upto = np.cumsum(n)
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        base = np.concatenate(([0], upto))[starts]
        upto = upto - np.repeat(base, np.diff(np.append(starts, len(g))))
        if g[0] == last:
            upto[: starts[1] if len(starts) > 1 else len(g)] += carried
        last, carried = g[-1], int(upto[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], names=[*b.schema.names, "upto"])


def _key(summary: DataFrame, by: list[str]) -> Column:
    """One text for each group: every column's own text with its length before it, so that no two groups share one. Texts of numbers, dates and timestamps are exact."""
    text = lambda c: F.hex(c) if isinstance(summary.schema[c].dataType, T.BinaryType) else F.to_json(F.struct(c)) if isinstance(summary.schema[c].dataType, (T.StructType, T.ArrayType)) else F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in by], F.lit(""))


def percentiles(summary: DataFrame, by: list[str], at: list[float], partitions: int | None = None) -> DataFrame:
    """(by..., size, p, low, high, discrete, interpolated): for each p in at (0 to 1), the order statistics around the position p * (size - 1) and
    their interpolation, and the discrete percentile: the smallest value with at least the share p at or below it."""
    spark = summary.sparkSession
    ship(spark)
    names = [f"_b{i}" for i in range(len(by))]
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = summary.select(_key(summary, by).alias("g"), *[F.col(b).alias(n) for b, n in zip(by, names)], "value", "n")
    ordered = cut(rows.repartitionByRange(parts, "g", "value").sortWithinPartitions("g", "value"))
    numbered = ordered.withColumn("part", F.spark_partition_id())
    located = numbered.mapInArrow(_runs, T.StructType([*numbered.schema.fields, T.StructField("upto", T.LongType())]))
    counts = ordered.groupBy("g", F.spark_partition_id().alias("part")).agg(F.sum("n").alias("in_part"))
    offsets = counts.select("g", "part", (F.sum("in_part").over(Window.partitionBy("g").orderBy("part")) - F.col("in_part")).alias("offset"), F.sum("in_part").over(Window.partitionBy("g")).alias("size"))
    # positions, from 1, of the order statistics that are asked for in each partition
    share = lambda p: F.lit(Decimal(str(p))).cast("decimal(18,12)")
    wanted = []
    for p in at:
        place = share(p) * (F.col("size") - 1)
        reached = F.greatest(F.ceil(share(p) * F.col("size")).cast("long"), F.lit(1).cast("long"))
        wanted += [F.struct(F.lit(float(p)).alias("p"), F.lit(k).alias("kind"), c.alias("position")) for k, c in (("low", F.floor(place).cast("long") + 1), ("high", F.ceil(place).cast("long") + 1), ("discrete", reached))]
    placed = located.join(offsets, ["g", "part"]).withColumn("to", F.col("offset") + F.col("upto")).withColumn("from", F.col("to") - F.col("n"))
    hits = placed.select("g", *names, "size", "value", F.explode(F.filter(F.array(*wanted), lambda w: (w["position"] > F.col("from")) & (w["position"] <= F.col("to")))).alias("w"))
    pick = lambda kind: F.max(F.when(F.col("w.kind") == kind, F.col("value"))).alias(kind)
    out = hits.groupBy("g", F.col("w.p").alias("p")).agg(F.max("size").alias("size"), *[F.first(n).alias(n) for n in names], pick("low"), pick("high"), pick("discrete"))
    exact = F.create_map(*[x for p in at for x in (F.lit(float(p)), share(p))])[F.col("p")] * (F.col("size") - 1)
    within = exact - F.floor(exact)
    if _exact(summary.schema["value"].dataType):
        # a difference of 20 digits times a share of 12
        middle = F.col("low") + ((F.col("high") - F.col("low")).cast("decimal(24,4)") * within.cast("decimal(14,12)")).cast("decimal(30,8)")
    else:
        middle = F.col("low") + (F.col("high") - F.col("low")) * within.cast("double")
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "size", "p", "low", "high", "discrete", middle.alias("interpolated"))
