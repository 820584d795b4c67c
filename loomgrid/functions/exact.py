"""Sums of doubles that are the same in any order of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that one bin of exponents spans: with a mantissa of 54 bits, 86 bits or 26 decimal digits, which leaves 10^12 rows.
SPAN = 32


def _power(e: Column) -> Column:
    """Two to the power e, in two factors: the smallest doubles have reciprocals that are none."""
    half = F.floor(e / 2)
    return F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def order_free_sums(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by..., values...): the sum of each column by group, null and absent values being 0.

    Every double is an integer times a power of two. Integers are added up exactly, as decimals, for each bin of exponents; the sums of a group's bins, of
    which there can be 70, are then added from the largest power down. Partial aggregation, combination of partitions and the order of rows change nothing.
    """
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    long = rows.select(*by, entry.alias("e")).select(*by, "e.c", F.coalesce("e.v", F.lit(0.0)).alias("v"))
    exponent = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs("v"))).cast("int") - 53)
    long = long.withColumn("b", F.floor(exponent / SPAN).cast("int"))
    scaled = (F.col("v") / _power(F.col("b") * SPAN)).cast("decimal(38,0)")
    bins = long.groupBy(*by, "c", "b").agg(F.sum(scaled.cast("decimal(28,0)")).alias("s"))
    folded = bins.groupBy(*by, "c").agg(F.sort_array(F.collect_list(F.struct("b", "s")), asc=False).alias("bins"))
    total = F.aggregate("bins", F.lit(0.0), lambda a, x: a + x["s"].cast("double") * F.pow(F.lit(2.0), x["b"] * SPAN))
    sums = folded.select(*by, "c", total.alias("t"))
    pick = [F.max(F.when(F.col("c") == i, F.col("t"))).alias(v) for i, v in enumerate(values)]
    return sums.groupBy(*by).agg(*pick)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
