"""Loaders of graph signals and collections, checked as they are read.

Files are read by Spark's own readers with given schemas; what a file has wrong comes out as ``DatasetError`` with the rule and the first keys. Wide and nested values become long frames at
once (posexplode, unpivot): nothing is walked on the driver but headers.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.graph.geometry import gaussian_of
from loomgrid.graph.mesh import MeshGraph
from loomgrid.temporal.signal import TemporalSignal, lag_features


class DatasetError(ValueError):
    """A source breaks its rules."""


def _refuse(frame: DataFrame, rule: str) -> None:
    first = frame.limit(3).collect()
    if first:
        raise DatasetError(f"{rule}: {[r.asDict() for r in first]}")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    frame = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if frame.count() != 1:
        raise DatasetError(f"{path}: one JSON object is expected")
    return frame


def _lagged(graph: MeshGraph, names: DataFrame, features: DataFrame, targets: DataFrame, lags: int, steps: int) -> TemporalSignal:
    if lags <= 0 or lags >= steps:
        raise DatasetError(f"lags must be from 1 to {steps - 1}")
    series = features.join(targets, ["node", "t"])
    rows = lag_features(series, "x", lags, steps, "y")
    return TemporalSignal(graph, names, rows.select("node", "t", *[f"x{i}" for i in range(lags)], "y"), tuple(f"x{i}" for i in range(lags)), ("y",), steps - lags)


def chickenpox(spark: SparkSession, path: str, lags: int = 4) -> TemporalSignal:
    """{edges: [[source, target]], node_ids: {name: row}, FX: [[value of each node]]}: features are `lags` steps, the target the next one; all edges weigh 1."""
    one = _json(spark, path, "edges array<array<long>>, node_ids map<string, long>, FX array<array<double>>")
    names = one.select(F.explode("node_ids").alias("node_id", "node")).select("node", "node_id")
    nodes = names.count()
    _refuse(spark.range(nodes).select(F.col("id").alias("node")).join(names, "node", "left_anti"), "rows of nodes are not contiguous from 0")
    edges = one.select(F.posexplode("edges").alias("edge", "e"))
    _refuse(edges.filter("size(e) <> 2 or e[0] is null or e[1] is null"), "edges are pairs of rows")
    edges = edges.select(F.col("edge").cast("long").alias("edge"), F.col("e")[0].alias("source"), F.col("e")[1].alias("target"), F.lit(1.0).alias("weight"))
    rows = one.select(F.posexplode("FX").alias("t", "row"))
    _refuse(rows.filter(F.size("row") != nodes).select("t"), "a step without one value a node")
    values = rows.select(F.col("t").cast("long").alias("t"), F.posexplode("row").alias("node", "x")).select(F.col("node").cast("long").alias("node"), "t", "x")
    _refuse(values.filter("x is null or isnan(x)"), "values are numbers")
    graph = MeshGraph(names.select("node"), edges)
    _refuse(graph.violations(), "graph")
    return _lagged(graph, names, values, values.select("node", "t", F.col("x").alias("y")), lags, rows.count())


@dataclass(frozen=True)
class BusNetwork:
    """A signal of stops with positions (node, px, py) and the road's length on each edge, in metres."""

    signal: TemporalSignal
    position: DataFrame


def montevideo_bus(spark: SparkSession, path: str, lags: int = 4) -> BusNetwork:
    """{directed, multigraph, nodes: [{bus_stop, lon, lat, X: {y: [...]}, y: [...]}], links: [{source, target, weight}]}. Ends of links are stops' ids; rows follow the list of nodes."""
    one = _json(spark, path, "directed boolean, multigraph boolean, nodes array<struct<bus_stop: long, lon: double, lat: double, X: struct<y: array<double>>, y: array<double>>>, links array<struct<source: long, target: long, weight: double>>")
    _refuse(one.filter("not coalesce(directed, false) or coalesce(multigraph, true)").select("directed", "multigraph"), "the graph is directed and no multigraph")
    nodes = one.select(F.posexplode("nodes").alias("node", "n")).select(F.col("node").cast("long").alias("node"), "n.*")
    _refuse(nodes.filter("bus_stop is null or lon is null or lat is null or X.y is null or y is null or size(X.y) <> size(y) or size(y) = 0").select("node"), "a stop without id, place or series of one length")
    _refuse(nodes.groupBy("bus_stop").count().filter("count > 1"), "stops repeat")
    lengths = nodes.agg(F.min(F.size("y")).alias("a"), F.max(F.size("y")).alias("z")).first()
    if lengths["a"] is None or lengths["a"] != lengths["z"]:
        raise DatasetError("all stops need series of one length")
    links = one.select(F.posexplode("links").alias("edge", "l")).select(F.col("edge").cast("long").alias("edge"), "l.*")
    _refuse(links.filter("weight is null or isnan(weight) or weight <= 0").select("edge"), "lengths of links are positive")
    _refuse(links.groupBy("source", "target").count().filter("count > 1"), "links repeat")
    ids = nodes.select("node", "bus_stop")
    ends = links.join(ids.select(F.col("bus_stop").alias("source"), F.col("node").alias("_s")), "source", "left").join(ids.select(F.col("bus_stop").alias("target"), F.col("node").alias("_t")), "target", "left")
    _refuse(ends.filter("_s is null or _t is null").select("edge"), "an end of a link is no stop")
    graph = MeshGraph(ids.select("node"), ends.select("edge", F.col("_s").alias("source"), F.col("_t").alias("target"), F.col("weight").alias("road_distance")))
    long = lambda column, name: nodes.select("node", F.posexplode(column).alias("t", name)).select("node", F.col("t").cast("long").alias("t"), name)
    signal = _lagged(graph, ids.select("node", F.col("bus_stop").cast("string").alias("node_id")), long("X.y", "x"), long("y", "y"), lags, lengths["a"])
    return BusNetwork(signal, nodes.select("node", F.col("lon").alias("px"), F.col("lat").alias("py")))


@dataclass(frozen=True)
class SensorNetwork:
    """Speeds of sensors on a fixed grid of time: speed (t, ts, node, x, observed); a speed of 0 was not observed."""

    graph: MeshGraph
    names: DataFrame
    speed: DataFrame
    steps: int


def metr_la(spark: SparkSession, folder: str, minutes: int = 5, least: float = 0.1, files: tuple[str, str, str] = ("METR-LA.csv", "graph_sensor_ids.txt", "distances_la_2012.csv")) -> SensorNetwork:
    """A wide CSV of speeds, a list of sensors in its order, and road distances (from, to, cost) of which those between sensors count."""
    text = spark.read.text(f"{folder}/{files[1]}", wholetext=True).first()[0].strip()
    sensors = [s.strip() for s in text.split(",")]
    if not all(sensors) or len(set(sensors)) != len(sensors):
        raise DatasetError("sensors are named once each")
    header = spark.read.text(f"{folder}/{files[0]}").first()[0].split(",")
    if [h.strip() for h in header[1:]] != sensors:
        raise DatasetError("columns of speeds differ from the list of sensors")
    columns = [f"s{i}" for i in range(len(sensors))]
    wide = spark.read.csv(f"{folder}/{files[0]}", header=True, enforceSchema=True, mode="FAILFAST", schema="ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))
    first = wide.agg(F.min("ts").alias("a")).first()["a"]
    seconds = lambda c: F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    step = (seconds(F.col("ts")) - seconds(F.lit(first))) / (60 * minutes)
    wide = wide.withColumn("_step", step).withColumn("t", F.floor("_step"))
    steps = wide.count()
    bad = wide.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_step") != F.col("t")).alias("off")).filter(F.col("off") | (F.col("n") > 1) | (F.col("t") >= steps))
    _refuse(bad, f"times are not {minutes} minutes apart")
    speed = wide.select("t", "ts", F.posexplode(F.array(*columns)).alias("node", "x")).select("t", "ts", F.col("node").cast("long").alias("node"), "x", (F.col("x") != 0).alias("observed"))
    _refuse(speed.filter("x is null or isnan(x) or x < 0").select("t", "node"), "speeds are finite and not negative")
    names = spark.createDataFrame(list(enumerate(sensors)), "node long, node_id string")
    head = spark.read.text(f"{folder}/{files[2]}").first()[0].strip()
    if head != "from,to,cost":
        raise DatasetError("columns of distances are from, to, cost")
    roads = spark.read.csv(f"{folder}/{files[2]}", header=True, schema="`from` string, `to` string, cost string").select("from", "to", F.col("cost").try_cast("double").alias("distance"))
    at = lambda c, n: names.select(F.col("node_id").alias(c), F.col("node").alias(n))
    pairs = roads.join(at("from", "source"), "from").join(at("to", "target"), "to").select("source", "target", "distance")
    _refuse(pairs.filter("distance is null or isnan(distance) or distance < 0 or distance = double('infinity')"), "distances are finite and not negative")
    _refuse(pairs.groupBy("source", "target").count().filter("count > 1"), "distances repeat")
    _refuse(names.select("node").join(pairs.filter("source = target and distance = 0").select(F.col("source").alias("node")), "node", "left_anti"), "a sensor without distance 0 to itself")
    near = gaussian_of(pairs, least)
    n = len(sensors)
    return SensorNetwork(MeshGraph(names.select("node"), near.select((F.col("source") * n + F.col("target")).alias("edge"), "source", "target", "affinity")), names, speed, steps)


@dataclass(frozen=True)
class GraphCollection:
    """graphs (graph, label), nodes (graph, node, label), edges (graph, edge, source, target, label); nodes count from 0 within a graph."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _numbered(spark: SparkSession, text: str, name: str, columns: list[str]) -> DataFrame:
    rows = []
    for i, line in enumerate(text.split("\n") if text.strip() else []):
        if not line.strip():
            continue
        try:
            cells = [int(c) for c in line.split(",")]
        except ValueError as wrong:
            raise DatasetError(f"{name} line {i + 1}: whole numbers are expected") from wrong
        if len(cells) != len(columns):
            raise DatasetError(f"{name} line {i + 1}: {len(columns)} values are expected")
        rows.append((len(rows), *cells))
    return spark.createDataFrame(rows, "place long, " + ", ".join(f"{c} long" for c in columns))


def graph_collection(spark: SparkSession, archive: bytes, prefix: str = "MUTAG", node_labels: int = 7, edge_labels: int = 4) -> GraphCollection:
    """A ZIP of the text tables <prefix>_A, _graph_indicator, _node_labels, _edge_labels and _graph_labels, ids from 1. A collection is a file of a bounded size."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            members = {n.rsplit("/", 1)[-1]: n for n in z.namelist()}
            absent = [t for t in ("A", "graph_indicator", "node_labels", "edge_labels", "graph_labels") if f"{prefix}_{t}.txt" not in members]
            if absent:
                raise DatasetError(f"members are missing: {absent}")
            text = lambda t: z.read(members[f"{prefix}_{t}.txt"]).decode("ascii")
            read = lambda t, *cs: _numbered(spark, text(t), t, list(cs))
            indicator, nodes, edges, marks, labels = read("graph_indicator", "graph"), read("node_labels", "label"), read("A", "source", "target"), read("edge_labels", "label"), read("graph_labels", "label")
    except zipfile.BadZipFile as wrong:
        raise DatasetError("a ZIP archive is expected") from wrong
    counts = [f.count() for f in (indicator, nodes, edges, marks, labels)]
    if counts[0] != counts[1] or counts[2] != counts[3]:
        raise DatasetError("one label for each node and edge is expected")
    starts = indicator.groupBy("graph").agg(F.min("place").alias("start"), F.max("place").alias("end"), F.count(F.lit(1)).alias("n"))
    _refuse(starts.filter("end - start + 1 <> n or graph < 1"), "rows of a graph are not together")
    numbers = starts.agg(F.count(F.lit(1)).alias("n"), F.max("graph").alias("z")).first()
    if numbers["n"] != numbers["z"] or numbers["n"] != counts[4]:
        raise DatasetError("graphs are numbered from 1 without gaps, with one label each")
    _refuse(nodes.filter(f"label not between 0 and {node_labels - 1}"), "unknown label of a node")
    _refuse(marks.filter(f"label not between 0 and {edge_labels - 1}"), "unknown label of an edge")
    _refuse(labels.filter("label not in (-1, 1)"), "labels of graphs are -1 or 1")
    of = indicator.select("place", "graph").join(starts.select("graph", "start"), "graph")
    end = lambda c: of.select((F.col("place") + 1).alias(c), F.col("graph").alias(f"_{c}g"), (F.col("place") - F.col("start")).alias(f"_{c}"))
    bonds = edges.join(marks, "place").join(end("source"), "source", "left").join(end("target"), "target", "left")
    _refuse(bonds.filter("_source is null or _target is null").select("place"), "an end of an edge is no node")
    _refuse(bonds.filter("source = target").select("place"), "an edge is a loop")
    _refuse(bonds.filter("_sourceg <> _targetg").select("place"), "an edge crosses graphs")
    _refuse(bonds.groupBy("source", "target").count().filter("count > 1"), "edges repeat")
    _refuse(bonds.select("source", "target", "label").join(bonds.select(F.col("target").alias("source"), F.col("source").alias("target"), "label"), ["source", "target", "label"], "left_anti"), "an edge without its like the other way")
    return GraphCollection(
        labels.select(F.col("place").alias("graph"), F.when(F.col("label") == 1, 1).otherwise(0).alias("label")), nodes.join(of, "place").select((F.col("graph") - 1).alias("graph"), (F.col("place") - F.col("start")).alias("node"), "label"),
        bonds.select((F.col("_sourceg") - 1).alias("graph"), F.col("place").alias("edge"), F.col("_source").alias("source"), F.col("_target").alias("target"), "label"),
    )
