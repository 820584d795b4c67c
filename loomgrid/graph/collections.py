"""Collections of small graphs: walks, patches, masks and folds. A collection's frames have a `graph` column beside `node`."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.graph.mesh import MeshGraph
from loomgrid.session import cut


def random_walk_returns(graph: MeshGraph, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., node, p1, ..., p_steps): the probability that a walk along edges, parallel ones counting each, is back after so many steps; 0 for nodes without edges.

    A walk's states are pairs of origin and node within `steps` hops: as many as the neighbourhoods are large, no more. States are cut after each step but the last two.
    """
    edges = graph.edges.select(*by, "source", "target").groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy(*by, "source").agg(F.sum("n").alias("all"))
    moves = edges.join(out, [*by, "source"]).select(*by, "source", "target", (F.col("n") / F.col("all")).alias("p"))
    state = moves.select(*by, F.col("source").alias("origin"), F.col("target").alias("at"), "p")
    back = None
    for k in range(1, steps + 1):
        if k > 1:
            nxt = state.select(*by, "origin", F.col("at").alias("source"), F.col("p").alias("q")).join(moves, [*by, "source"])
            state = nxt.groupBy(*by, "origin", F.col("target").alias("at")).agg(F.sum(F.col("q") * F.col("p")).alias("p"))
            if 1 < k < steps - 1:
                state = cut(state)
        home = state.filter("origin = at").select(*by, F.col("origin").alias("node"), F.lit(k).alias("k"), "p")
        back = home if back is None else back.unionByName(home)
    rows = back.unionByName(graph.nodes.select(*by, "node", F.lit(0).alias("k"), F.lit(0.0).alias("p")))
    return rows.groupBy(*by, "node").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("p"))), F.lit(0.0)).alias(f"p{k}") for k in range(1, steps + 1)])


def permutation(spark: SparkSession, size: int, seed: int) -> DataFrame:
    """(place, at): a shuffle of 0 to size - 1 by Python's seeded generator, for the bounded sets (graphs of a collection, folds) whose order has to be that one."""
    order = list(range(size))
    random.Random(seed).shuffle(order)
    return spark.createDataFrame(list(enumerate(order)), "place long, at long")


def strided(size: int, stride: int, name: str = "node"):
    """The column of a stride permutation: (node * stride) mod size. The stride has to be prime to the size."""
    return F.pmod(F.col(name) * stride, F.lit(size))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `_shuffle`: an order by a seeded hash of the key, 60 bits of its MD5, the same on any number of partitions."""
    return rows.withColumn("_shuffle", seeded_hash(seed, key))


def seeded_hash(seed: int, *keys: str) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int) -> DataFrame:
    """(key, label, fold): the rows of each label in shuffled order, dealt to the folds in turn. Places are counted within blocks of the hash, and blocks follow each other,
    so that a label of any size is spread over tasks."""
    mixed = shuffled(rows.select(key, label), key, seed).withColumn("_block", F.shiftright("_shuffle", 50).cast("int"))
    sizes = mixed.groupBy(label, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(label, "_block", (F.sum("_n").over(Window.partitionBy(label).orderBy("_block")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(label, "_block").orderBy("_shuffle", key)) - 1
    placed = mixed.withColumn("_within", within).join(before, [label, "_block"])
    return placed.select(key, label, F.pmod(F.col("_before") + F.col("_within"), F.lit(folds)).cast("int").alias("fold"))


def balanced_patches(nodes: DataFrame, edges: DataFrame, patches: int, seed: int) -> DataFrame:
    """(graph, patch, node): the nodes of each graph shuffled and dealt to patches in turn, each patch widened by its nodes' neighbours either way."""
    order = F.row_number().over(Window.partitionBy("graph").orderBy(seeded_hash(seed, "graph", "node"), "node")) - 1
    core = nodes.select("graph", "node", F.pmod(order, F.lit(patches)).cast("int").alias("patch"))
    ways = edges.select("graph", "source", "target").unionByName(edges.select("graph", F.col("target").alias("source"), F.col("source").alias("target")))
    near = core.select("graph", "patch", F.col("node").alias("source")).join(ways, ["graph", "source"]).select("graph", "patch", F.col("target").alias("node"))
    return core.select("graph", "patch", "node").unionByName(near).distinct()


def patch_overlaps(patches: DataFrame) -> DataFrame:
    """(graph, patch, other, shared): the nodes that two patches of a graph share. A node's patches are a handful, so pairs are made per node from its list."""
    lists = patches.groupBy("graph", "node").agg(F.sort_array(F.collect_set("patch")).alias("p"))
    pairs = lists.select("graph", F.explode("p").alias("patch"), "p").select("graph", "patch", F.explode("p").alias("other"))
    return pairs.groupBy("graph", "patch", "other").agg(F.count(F.lit(1)).alias("shared"))


def summary_fractions(nodes: DataFrame, edges: DataFrame, node_labels: Sequence[int], edge_labels: Sequence[int]) -> DataFrame:
    """(graph, n_<label>..., e_<label>...): the share of each label among a graph's nodes and edges; 0 for graphs without edges."""
    ns = nodes.groupBy("graph").agg(*[F.avg((F.col("label") == x).cast("double")).alias(f"n_{x}") for x in node_labels])
    es = edges.groupBy("graph").agg(*[F.avg((F.col("label") == x).cast("double")).alias(f"e_{x}") for x in edge_labels])
    return ns.join(es, "graph", "left").select("graph", *[f"n_{x}" for x in node_labels], *[F.coalesce(f"e_{x}", F.lit(0.0)).alias(f"e_{x}") for x in edge_labels])
