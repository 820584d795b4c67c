"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.text import BLANKS, NO_VALUE, reference_key, usable_text
from loomgrid.llm.mixing import mix, shares
from loomgrid.llm.percentiles import combine, percentiles, summarise
from loomgrid.llm.subjects import subject_areas
from loomgrid.llm.survivors import best_records, surviving_values
from loomgrid.llm.tokens import count_tokens, encode_corpus
from loomgrid.session import table

CALL = ["service_date", "route_id", "direction_id", "start_time", "stop_sequence"]


def _usable() -> dict:
    words = ("vehicle_id", "trunk_route_id", "trip_id")
    return {w: usable_text(F.col(w)) for w in words} | {"move_timestamp": F.col("move_timestamp") > 0}


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    # feeds: a list made by hand, one row per feed
    feeds = table(spark, folder, "feeds").groupBy("feed").agg(F.min("trust_rank").alias("trust_rank"))
    return table(spark, folder, "replay").join(F.broadcast(feeds), "feed", "left")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_values(_ranked(spark, folder), CALL, "row_id", "trust_rank", "received_at", _usable())


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """The most complete record of each call recorded more than once."""
    return best_records(_ranked(spark, folder), CALL, "row_id", "trust_rank", "received_at", _usable())


PLACE = ["parent_station", "trunk_route_id"]


def _headways(spark: SparkSession, folder: str) -> DataFrame:
    days = summarise(table(spark, folder, "replay"), ["service_date", *PLACE], "headway_trunk_seconds")
    return combine(days, PLACE)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    lanes = table(spark, folder, "trunk_lanes").distinct()
    # only pairs of trunk_lanes are asked for
    wanted = percentiles(_headways(spark, folder).join(lanes, PLACE, "left_semi"), PLACE, [0.5, 0.9])
    pairs = wanted.groupBy(*PLACE).agg(F.max(F.when(F.col("p") == 0.5, F.col("discrete"))).alias("median"), F.max(F.when(F.col("p") == 0.9, F.col("discrete"))).alias("p90"))
    return pairs.filter("p90 >= 3 * median").select(*PLACE)


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles, the 90th and the 99th percentile of headways of each station and trunk, interpolated and discrete."""
    return percentiles(_headways(spark, folder), PLACE, [0.25, 0.5, 0.75, 0.9, 0.99]).select(*PLACE, "size", "p", F.col("discrete").cast("double").alias("discrete"), F.round(F.col("interpolated").cast("double"), 6).alias("interpolated"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    # only documents of the targets' sources are sized; the targets are a list made by hand
    sources = targets.select(reference_key(F.col("source")).alias("wanted")).distinct()
    documents = table(spark, folder, "documents")
    documents = documents.join(F.broadcast(sources), reference_key(F.col("source")) == F.col("wanted"), "left_semi")
    sizes = count_tokens(documents, keep=("source",))
    return mix(sizes, targets), targets


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    mixed, targets = _mix(spark, folder)
    return shares(mixed, targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subject_areas(*[table(spark, folder, t) for t in ("documents", "doc_subjects", "subjects")]).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject area."""
    return p9_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_records, p5_found, p5_percentiles, p7_ids, p8_mix, p8_shares, p9_found, p9_composition)}

_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_WORDS = "(" + ", ".join(map(_QUOTED, NO_VALUE)) + ")"
_CLEAN = lambda c: f"lower(trim({c}, {_QUOTED(BLANKS)}))"
_RECORDS = f"""
WITH r AS (SELECT r.*, coalesce(f.trust_rank, 9999999) AS rank,
  coalesce({_CLEAN('vehicle_id')} NOT IN {_WORDS}, false) AS ok_vehicle_id, coalesce({_CLEAN('trunk_route_id')} NOT IN {_WORDS}, false) AS ok_trunk_route_id,
  coalesce({_CLEAN('trip_id')} NOT IN {_WORDS}, false) AS ok_trip_id, coalesce(move_timestamp > 0, false) AS ok_move_timestamp,
  count(*) OVER g AS records, min(row_id) OVER g AS first_row_id
  FROM replay r LEFT JOIN (SELECT feed, min(trust_rank) AS trust_rank FROM feeds GROUP BY 1) f ON f.feed = r.feed WHERE service_date IS NOT NULL AND route_id IS NOT NULL AND direction_id IS NOT NULL AND start_time IS NOT NULL AND stop_sequence IS NOT NULL WINDOW g AS (PARTITION BY service_date, route_id, direction_id, start_time, stop_sequence)),
d AS (SELECT * FROM r WHERE records > 1)"""

SQL = {
    "p4_found": _RECORDS
    + " UNION ALL ".join(
        f"\n{'SELECT * FROM (' if i == 0 else ''}SELECT first_row_id, '{c}' AS field_name, row_id AS best_row_id FROM d WHERE ok_{c} QUALIFY row_number() OVER (PARTITION BY first_row_id ORDER BY rank, received_at DESC NULLS LAST, row_id) = 1"
        for i, c in enumerate(("vehicle_id", "move_timestamp", "trunk_route_id", "trip_id"))
    )
    + ")",
    "p4_records": _RECORDS
    + """
SELECT first_row_id, row_id AS best_row_id, CAST(ok_vehicle_id AS INT) + CAST(ok_trunk_route_id AS INT) + CAST(ok_trip_id AS INT) + CAST(ok_move_timestamp AS INT) AS completeness, records
FROM d QUALIFY row_number() OVER (PARTITION BY first_row_id ORDER BY completeness DESC, rank, received_at DESC NULLS LAST, row_id) = 1""",
    "p5_found": """
SELECT parent_station, trunk_route_id FROM (
  SELECT parent_station, trunk_route_id, quantile_disc(headway_trunk_seconds, 0.5) AS median, quantile_disc(headway_trunk_seconds, 0.9) AS p90
  FROM replay JOIN (SELECT DISTINCT * FROM trunk_lanes) USING (parent_station, trunk_route_id) WHERE headway_trunk_seconds IS NOT NULL GROUP BY ALL) WHERE p90 >= 3 * median""",
    "p5_percentiles": """
WITH o AS (SELECT parent_station, trunk_route_id, CAST(headway_trunk_seconds AS DOUBLE) AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY parent_station, trunk_route_id) AS size
  FROM replay WHERE headway_trunk_seconds IS NOT NULL WINDOW w AS (PARTITION BY parent_station, trunk_route_id ORDER BY headway_trunk_seconds)),
p AS (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75, 0.9, 0.99]) AS p)
SELECT parent_station, trunk_route_id, size, p, max(v) FILTER (i = greatest(ceil(round(p * size, 9)), 1)) AS discrete,
  round(max(v) FILTER (i = floor(p * (size - 1)) + 1) + (max(v) FILTER (i = ceil(p * (size - 1)) + 1) - max(v) FILTER (i = floor(p * (size - 1)) + 1)) * (p * (size - 1) - floor(p * (size - 1))), 6) AS interpolated
FROM o, p GROUP BY parent_station, trunk_route_id, size, p""",
}
