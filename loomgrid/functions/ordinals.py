"""Ordinals of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import cut


def with_ordinal(rows: DataFrame, order: list[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds the row's place, from 0, in an order that has to be total: a range sort, a count per sorted partition, and their running sum."""
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return ordered.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
