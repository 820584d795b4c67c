"""One row's values beside every row: a scalar subquery, so no join is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(frame: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a frame of one row (null where it has none)."""
    value = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("_one")).scalar()
    added = frame.withColumn("_one", value)
    return added.select(*frame.columns, *[F.col(f"_one.{c}").alias(c) for c in one.columns])
