"""A simulated transport field: a ring with chords and linear dynamics, for experiments whose truth is known."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.graph.mesh import MeshGraph
from loomgrid.layers.conv import diffusion, diffusion_weights
from loomgrid.session import cut

#: Parts of a node's own value, of what comes along edges and of what comes against them in one step.
LOCAL, FORWARD, REVERSE = 0.25, 0.55, 0.20


def ring_with_chords(spark: SparkSession, nodes: int) -> MeshGraph:
    """Each node leads to the next, each even one also three to five places on; affinities go round in fives and fours."""
    if nodes < 8:
        raise ValueError("at least eight nodes")
    n = F.col("id")
    ring = spark.range(nodes).select(n.alias("edge"), n.alias("source"), F.pmod(n + 1, F.lit(nodes)).alias("target"), (1.0 + 0.05 * (n % 5)).alias("affinity"))
    chords = spark.range(0, nodes, 2).select((nodes + n / 2).cast("long").alias("edge"), n.alias("source"), F.pmod(n + 3 + n % 3, F.lit(nodes)).alias("target"), (0.25 + 0.05 * (n % 4)).alias("affinity"))
    return MeshGraph(spark.range(nodes).select(n.alias("node")), ring.unionByName(chords))


def permutation_column(nodes: int, node: str = "node") -> Column:
    """A fixed other place for each node: the largest stride prime to their number, and one on."""
    stride = next(s for s in range(nodes - 1, 1, -1) if math.gcd(s, nodes) == 1)
    return F.pmod(F.col(node) * stride + 1, F.lit(nodes))


def step(weighted: MeshGraph, field: DataFrame, lanes: list[str]) -> DataFrame:
    """The field one step on. weighted: the graph with its diffusion weights."""
    spread = diffusion(weighted, field, ["value"], lanes)
    return field.join(spread, [*lanes, "node"]).select(*lanes, "node", (LOCAL * F.col("value") + FORWARD * F.col("f0") + REVERSE * F.col("r0")).alias("value"))


def start(spark: SparkSession, nodes: int, count: int, seed: int, pulse: bool = False) -> DataFrame:
    """(trajectory, node, value): starts drawn by Python's seeded generator, their mean taken off. A simulation is as large as its parameters say."""
    draw, rows = random.Random(seed), []
    for k in range(count):
        values = [0.0] * nodes
        if pulse:
            at = draw.sample(range(nodes), 4)
            for a, b in zip(at[::2], at[1::2]):
                values[a] = draw.uniform(0.5, 1)
                values[b] = -values[a]
        else:
            values = [draw.uniform(-1, 1) for _ in range(nodes)]
        mean = sum(values) / nodes
        rows += [(k, i, v - mean) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "trajectory long, node long, value double")


def trajectories(graph: MeshGraph, first: DataFrame, steps: int, every: int = 3) -> DataFrame:
    """(trajectory, step, node, value): so many steps from the first. All trajectories go through one plan a step; the lineage is cut after each few."""
    weighted = MeshGraph(graph.nodes, cut(diffusion_weights(graph, "affinity")))
    state, out = first, first.withColumn("step", F.lit(0))
    for k in range(1, steps):
        state = step(weighted, state, ["trajectory"])
        if k % every == 0:
            state = cut(state)
        out = out.unionByName(state.withColumn("step", F.lit(k)))
    return out.select("trajectory", "step", "node", "value")


def rollout(predict, window: DataFrame, history: int, horizon: int, every: int = 3) -> DataFrame:
    """(trajectory, node, step, value): predictions that enter the window of the next. window: (trajectory, node, x0, ..., x_{history-1}), predict gives a column from those."""
    names, out, state = [f"x{i}" for i in range(history)], None, window
    for k in range(horizon):
        made = predict(state).select("trajectory", "node", F.col("value"))
        done = made.withColumn("step", F.lit(k))
        out = done if out is None else out.unionByName(done)
        state = state.join(made, ["trajectory", "node"]).select("trajectory", "node", *[F.col(b).alias(a) for a, b in zip(names, [*names[1:], "value"])])
        if (k + 1) % every == 0:
            state = cut(state)
    return out


def balanced_graph(spark: SparkSession, nodes: int, degree: int, hub: str | None = None) -> MeshGraph:
    """A graph for measurements: `degree` edges a node, their sources spread evenly, all into one node ("target") or all out of one ("source")."""
    n, k = F.expr(f"id div {degree}"), F.expr(f"id % {degree}")
    source = F.lit(0).cast("long") if hub == "source" else F.pmod(n * 17 + k * 31 + 1, F.lit(nodes))
    target = F.lit(0).cast("long") if hub == "target" else n
    return MeshGraph(spark.range(nodes).select(F.col("id").alias("node")), spark.range(nodes * degree).select(F.col("id").alias("edge"), source.alias("source"), target.alias("target")))
