"""Edges weighed by the places of their ends. Positions are frames (node, px, py); edges with an end without place have no distance and are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.single import with_row
from loomgrid.graph.mesh import MeshGraph


def distances(graph: MeshGraph, position: DataFrame) -> DataFrame:
    """(edge, source, target, dx, dy, distance): the displacement from source to target."""
    at = lambda end, p: position.select(F.col("node").alias(end), F.col("px").alias(f"_{p}x"), F.col("py").alias(f"_{p}y"))
    ends = graph.edges.select("edge", "source", "target").join(at("source", "s"), "source").join(at("target", "t"), "target")
    dx, dy = F.col("_tx") - F.col("_sx"), F.col("_ty") - F.col("_sy")
    return ends.select("edge", "source", "target", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("distance"))


def radial_messages(graph: MeshGraph, position: DataFrame, field: DataFrame, values: Sequence[str], decay: float) -> DataFrame:
    """Sums of in-neighbours, each times exp(-decay * distance)."""
    weighed = distances(graph, position).select("edge", "source", "target", F.exp(-decay * F.col("distance")).alias("radial"))
    return MeshGraph(graph.nodes, weighed).sum(field, values, "radial")


def inverse_distance(graph: MeshGraph, position: DataFrame) -> DataFrame:
    """(edge, source, target, affinity): 1 by the distance; edges of no length have none."""
    return distances(graph, position).filter("distance > 0").select("edge", "source", "target", (F.lit(1.0) / F.col("distance")).alias("affinity"))


def gaussian_affinity(graph: MeshGraph, position: DataFrame, least: float = 0.1) -> DataFrame:
    """(source, target, affinity): exp(-(d / sigma)^2) of each ordered pair, sigma being the population deviation of all distances; pairs below `least` are left out."""
    pairs = distances(graph, position).groupBy("source", "target").agg(F.min("distance").alias("distance"))
    return gaussian_of(pairs, least)


def gaussian_of(pairs: DataFrame, least: float) -> DataFrame:
    """The same for given distances (source, target, distance)."""
    sigma = pairs.agg(F.stddev_pop("distance").alias("sigma"))
    scaled = with_row(pairs, sigma)
    affinity = F.exp(-F.pow(F.col("distance") / F.nullif(F.col("sigma"), F.lit(0.0)), F.lit(2.0)))
    return scaled.select("source", "target", affinity.alias("affinity")).filter(F.col("affinity") >= least)


def changed_affinities(affinities: DataFrame, value: str = "affinity", unit: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """(edges, changed, smallest, largest): how many affinities differ from a unit one."""
    return affinities.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.abs(F.col(value) - unit) > tolerance).alias("changed"), F.min(value).alias("smallest"), F.max(value).alias("largest"))
