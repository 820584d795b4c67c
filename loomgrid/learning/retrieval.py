"""Exact nearest neighbours by cosine, in blocks.

Queries and corpus are dealt to buckets of a bounded size, every pair of buckets meets in one task as two dense matrices, and the best of each query and bucket are reduced. Work is that of the
exact search; no pair of rows is ever a row, and nothing is collected or broadcast.

Defined cases: rows with null or empty vectors or of no length are no neighbours and have none. Ties go to the smallest id. Vectors are of one width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.single import with_row
from loomgrid.session import ship


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 1, query_block: int = 1024, corpus_block: int = 8192, same_too: bool = False) -> DataFrame:
    """(query, neighbour, cosine, place): the k nearest rows of the corpus to each query, itself left out unless same_too."""
    ship(queries.sparkSession)
    rows = lambda f: f.filter(F.size(vector) > 0).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q, c = rows(queries), rows(corpus)
    # bounded blocks: their number follows the rows
    many = lambda f, block: max(1, -(-f.count() // block))
    qs, cs = many(q, query_block), many(c, corpus_block)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "v", place(qs).alias("a")).select("id", "v", "a", each(cs).alias("b"))
    right = c.select("id", "v", place(cs).alias("b")).select("id", "v", each(qs).alias("a"), "b")

    def unit(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        m = np.array(v.tolist(), float)
        n = np.linalg.norm(m, axis=1)
        return m / np.where(n > 0, n, 1.0)[:, None], n > 0

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "cosine": []}).astype({"query": "int64", "neighbour": "int64", "cosine": "float64"})
        y = y.sort_values("id")
        (a, there), (b, known) = unit(x.v), unit(y.v)
        ids = y.id.to_numpy()
        near = a @ b.T
        near[:, ~known] = -np.inf
        if not same_too:
            near[x.id.to_numpy()[:, None] == ids[None, :]] = -np.inf
        order = np.argsort(-np.round(near, 12), axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(near, order, 1)
        keep = np.isfinite(got) & there[:, None]
        row, _ = np.nonzero(keep)
        return pd.DataFrame({"query": x.id.to_numpy()[row], "neighbour": ids[order[keep]], "cosine": got[keep]})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, "query long, neighbour long, cosine double")
    top = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 12)).alias("o"), "neighbour", "cosine"))), 1, k).alias("n"))
    return top.select("query", F.posexplode("n").alias("place", "n")).select("query", "n.neighbour", "n.cosine", "place")


def label_accuracy(found: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(queries, nearest_accuracy, majority_accuracy): how often the nearest row has the query's label, and what the most frequent label (the smallest of equally frequent ones) gives."""
    of = lambda c, n: labels.select(F.col(key).cast("long").alias(c), F.col(label).alias(n))
    judged = found.filter("place = 0").join(of("query", "mine"), "query").join(of("neighbour", "theirs"), "neighbour")
    sums = judged.agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("mine") == F.col("theirs")).cast("double")).alias("nearest_accuracy"))
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    major = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("m")).select("m.l")
    hits = with_row(judged, major).agg(F.avg((F.col("mine") == F.col("l")).cast("double")).alias("majority_accuracy"))
    return with_row(sums, hits)
