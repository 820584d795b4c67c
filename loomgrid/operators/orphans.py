"""References to records that do not exist, found with bitmaps.

Keys of all domains (a domain is one referenced table) are dictionary-encoded as integers. For every container, that is
65,536 neighbouring codes in one period, the referenced keys and the keys that exist in that period are kept as two bitmaps
of 64-bit words of which the words without a bit are left out. The dangling references are the bits of
``referenced AND NOT existing``; they are decoded through the dictionary.

Everything runs as hash aggregates and windows inside the JVM. A key, however many rows name it, is one row per
period after the first partial aggregation, so no task holds the rows of a hot key. No pair of rows is ever formed.

Defined cases: null and blank keys are no references and no parents. A reference without period has no valid parent. Periods are numbers that order as dates do.
A parent without start or end of validity is never valid. Empty inputs give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.text import reference_key
from loomgrid.session import written

#: Hash buckets of the dictionary: codes are dense within a bucket, and a bucket is sorted by one task.
DICTIONARY_BUCKETS = 1024
#: Stands for the period of references that have none.
NO_PERIOD = -1


def reference_rows(frame: DataFrame, row_id: str, fields: list[str], period: str) -> DataFrame:
    """(row_id, domain, key, period): one row per field and row with a reference that is not null or blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("domain"), reference_key(F.col(f).cast("string")).alias("key")) for f in fields])
    return (
        frame.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(period), F.lit(NO_PERIOD)).alias("period"), F.explode(pairs).alias("r"))
        .select("row_id", "r.domain", "r.key", "period")
        .filter("key is not null")
    )


def parent_rows(frame: DataFrame, domain: str, key: str, start: str, end: str) -> DataFrame:
    return frame.select(F.lit(domain).alias("domain"), reference_key(F.col(key).cast("string")).alias("key"), F.col(start).alias("valid_from"), F.col(end).alias("valid_to")).filter("key is not null and valid_from <= valid_to")


def _existing(parents: DataFrame, counted: DataFrame) -> DataFrame:
    """(domain, key, period): the referenced keys in the periods of their references in which a parent of theirs is valid. A key has one row per period here and one per
    version there, so the join is as large as the references are varied; neither validity ranges nor parents that nothing names are spread out."""
    return counted.select("domain", "key", "period").join(parents.distinct(), ["domain", "key"]).filter("period between valid_from and valid_to").select("domain", "key", "period").distinct()


def _encode(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the dictionary code: the rank of (domain, key) within its hash bucket, above it the bucket's number."""
    bucket = F.pmod(F.xxhash64("domain", "key"), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("domain", "key")).cast("long") - 1
    return rows.withColumn("bucket", bucket).withColumn("rank", rank).withColumn("code", F.shiftleft("bucket", 32).bitwiseOR(F.col("rank"))).drop("bucket", "rank")


def _bit(flag: Column) -> Column:
    return F.bit_or(F.when(flag, F.expr("shiftleft(1L, cast(code & 63 as int))")).otherwise(F.lit(0).cast("long")))


def dangling(references: DataFrame, parents: DataFrame, buckets: int = DICTIONARY_BUCKETS) -> DataFrame:
    """(domain, key, period, n): keys named by n rows of the period that no parent of the domain valid in it has."""
    counted = written(references.groupBy("domain", "key", "period").agg(F.count(F.lit(1)).alias("n")))
    existing = _existing(parents, counted)
    coded = _encode(counted.withColumn("is_ref", F.lit(True)).unionByName(existing.withColumn("n", F.lit(0).cast("long")).withColumn("is_ref", F.lit(False))), buckets)
    words = (
        coded.groupBy("period", F.shiftright("code", 16).alias("range"), F.expr("cast(shiftright(code, 6) & 1023 as int)").alias("word"))
        .agg(_bit(F.col("is_ref")).alias("named"), _bit(~F.col("is_ref")).alias("there"))
    )
    pack = lambda c: F.collect_list(F.when(F.col(c) != 0, F.struct("word", F.col(c).alias("bits"))))
    containers = words.groupBy("period", "range").agg(pack("named").alias("named"), F.map_from_entries(pack("there")).alias("there"))
    # at most 1,024 words in a container
    surviving = containers.select("period", "range", F.explode("named").alias("w"), "there").select(
        "period", "range", F.col("w.word").alias("word"), F.expr("w.bits & ~coalesce(there[w.word], 0L)").alias("bits")
    ).filter("bits != 0")
    codes = surviving.select("period", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1L) = 1L)")).alias("b"), "range", "word").select(
        "period", F.expr("shiftleft(range, 16) | shiftleft(cast(word as bigint), 6) | cast(b as bigint)").alias("code")
    )
    dictionary = coded.filter("is_ref").select("code", "domain", "key", "period", "n")
    return dictionary.join(codes, ["code", "period"]).select("domain", "key", "period", "n")


def dangling_rows(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """The reference rows of dangling keys. Keys named by more than a ten-thousandth of the rows of all orphans, of which there can be only
    ten thousand, are looked up by broadcast, so that no task gets a hot key's rows; the others by a join on the key."""
    hot_from = max(10_000, -(-(orphans.agg(F.sum("n")).first()[0] or 0) // 10_000))
    on = ["domain", "key", "period"]
    hot = F.broadcast(orphans.filter(F.col("n") >= hot_from).select(*on))
    cold = orphans.filter(F.col("n") < hot_from).select(*on)
    return references.join(hot, on, "left_semi").unionByName(references.join(hot, on, "left_anti").join(cold, on, "left_semi"))


def orphan_references(calls: DataFrame, row_id: str, period: str, parents: dict[str, tuple[DataFrame, str, str, str]], buckets: int = DICTIONARY_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(rows, orphans). parents: by referring field, the referenced table with its key and its first and last day of validity."""
    references = reference_rows(calls, row_id, list(parents), period)
    held = reduce(DataFrame.unionByName, [parent_rows(t, f, k, a, z) for f, (t, k, a, z) in parents.items()])
    orphans = written(dangling(references, held, buckets))
    return dangling_rows(references, orphans), orphans
