"""Survivors against a plain version, with ties, nulls and one hot group."""

import datetime
import random

from pyspark.sql import functions as F

from loomgrid.functions.text import usable_text
from loomgrid.llm.survivors import best_records, surviving_values

SCHEMA = "row_id long, k1 int, k2 string, rank int, received timestamp, a string, b long, feed string"


def usable():
    return {"a": usable_text(F.col("a")), "b": F.col("b") > 0}


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    out = set()
    for g in groups.values():
        if len(g) > 1:
            for i, name in ((5, "a"), (6, "b")):
                good = [r for r in g if r[i] is not None and (r[i] > 0 if i == 6 else r[i].strip().lower() not in ("", "n/a", "unknown"))]
                if good:
                    best = min(good, key=lambda r: (r[3] if r[3] is not None else 9**9, -(r[4].timestamp() if r[4] else 0), r[0]))
                    out.add((min(r[0] for r in g), name, best[0]))
    return out


def made(n, seed):
    rng = random.Random(seed)
    t = lambda: rng.choice([None, datetime.datetime(2024, 1, 1, 0, 0, rng.randrange(5), rng.choice([0, 1]))])
    key = lambda: 0 if rng.random() < 0.4 else rng.choice([None, *range(1, n // 3)])
    return [(i, key(), "x", rng.choice([None, 1, 1, 2]), t(), rng.choice([None, " ", "N/A", "v1", "v2 ", "Unknown"]), rng.choice([None, 0, -3, 5]), "f") for i in range(n)]


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = made(300, seed)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert {tuple(r) for r in surviving_values(frame, ["k1", "k2"], "row_id", "rank", "received", usable(), 4).collect()} == brute(rows)


def test_whole_records_and_empty_tables(spark):
    rows = [(5, 1, "x", 2, None, "v", 5, "f"), (3, 1, "x", 1, None, "v", None, "f"), (9, 2, "x", 1, None, "v", 5, "f")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in best_records(frame, ["k1", "k2"], "row_id", "rank", "received", usable()).collect()] == [(3, 5, 2, 2)]
    assert surviving_values(frame.limit(0), ["k1", "k2"], "row_id", "rank", "received", usable()).count() == 0
