"""Running sums in a global order, in two steps: by ranges, then within a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import cut


def running_sum(rows: DataFrame, order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of a column over all rows up to and with this one, in a total order. The range-sorted rows are written to the checkpoint folder; each range's
    window sees its own rows, and the ranges' totals, one row each, are summed up before."""
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, *order)).withColumn("_part", F.spark_partition_id())
    totals = ordered.groupBy("_part").agg(F.sum(value).alias("_in"))
    base = totals.select("_part", (F.sum("_in").over(Window.orderBy("_part")) - F.col("_in")).alias("_base"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order))
    return ordered.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base")
