"""The best representative of each duplicate group, field by field.

Records agree if their key columns are equal. For each field the surviving value is that of the record with a usable value that is
trusted most, then arrived last, then has the smallest id; a record of the group is ranked as a whole by the number of its usable fields first.

A group may hold any share of the rows: rows are first reduced to the best of each of ``SPREAD`` parts of a group by partial
aggregation (a minimum of a struct), and the window ordering that picks the first of a group sees at most ``SPREAD`` candidates per field.

Defined cases: records with a null in a key column agree with none. Feeds without rank come after all ranked ones, records without arrival after all others.
Equal records are settled by the smallest id; repeated ids too. A field without usable value gives no row. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group that are reduced before the shuffle to its window.
SPREAD = 16


def _micros(received: str) -> Column:
    """Microseconds of a timestamp with or without zone, whatever the session's zone."""
    return F.expr(f"unix_date(to_date({received})) * 86400000000L + (hour({received}) * 3600L + minute({received}) * 60L) * 1000000L + cast(extract(second from {received}) * 1000000 as bigint)")


def _order(rank: str, received: str, row_id: str) -> list[Column]:
    return [F.coalesce(F.col(rank).cast("long"), F.lit(2**62)).alias("o1"), F.coalesce(-_micros(received), F.lit(2**62)).alias("o2"), F.col(row_id).alias("o3")]


def surviving_values(rows: DataFrame, key: list[str], row_id: str, rank: str, received: str, usable: dict[str, Column], spread: int = SPREAD) -> DataFrame:
    """(first_row_id, field_name, best_row_id): one row for each field with a usable value in each group of two or more records."""
    keyed = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.struct(*_order(rank, received, row_id)).alias("_o"),
        F.col(row_id).alias("_id"),
        *[F.coalesce(u, F.lit(False)).alias(f"_u{i}") for i, u in enumerate(usable.values())],
    )
    keys = [f"_k{i}" for i in range(len(key))]
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    best = [F.min(F.when(F.col(f"_u{i}"), F.col("_o"))).alias(f"_b{i}") for i in range(len(usable))]
    parts = keyed.groupBy(*keys, F.pmod(F.xxhash64("_id"), F.lit(spread)).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), *best)
    group = Window.partitionBy(*keys)
    counted = parts.withColumn("_n", F.sum("_n").over(group)).withColumn("_first", F.min("_first").over(group)).filter("_n > 1")
    names = list(usable)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"_b{i}").alias("b")) for i, n in enumerate(names)]))
    candidates = counted.select(*keys, "_first", each.alias("e")).select(*keys, "_first", "e.field_name", "e.b").filter("b is not null")
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "field_name").orderBy("b")))
    return ranked.filter("_r = 1").select(F.col("_first").alias("first_row_id"), "field_name", F.col("b.o3").alias("best_row_id"))


def best_records(rows: DataFrame, key: list[str], row_id: str, rank: str, received: str, usable: dict[str, Column], spread: int = SPREAD) -> DataFrame:
    """(first_row_id, best_row_id, completeness, records): the record of each group with the most usable fields, then by trust, arrival and id."""
    complete = sum((F.coalesce(u, F.lit(False)).cast("int") for u in usable.values()), F.lit(0))
    keyed = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct((-complete).alias("o0"), *_order(rank, received, row_id)).alias("_o"), F.col(row_id).alias("_id"))
    keys = [f"_k{i}" for i in range(len(key))]
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    parts = keyed.groupBy(*keys, F.pmod(F.xxhash64("_id"), F.lit(spread)).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.min("_o").alias("_b"))
    group = Window.partitionBy(*keys)
    ranked = parts.withColumn("records", F.sum("_n").over(group)).withColumn("first_row_id", F.min("_first").over(group)).withColumn("_r", F.row_number().over(group.orderBy("_b")))
    return ranked.filter("_r = 1 and records > 1").select("first_row_id", F.col("_b.o3").alias("best_row_id"), (-F.col("_b.o0")).alias("completeness"), "records")
