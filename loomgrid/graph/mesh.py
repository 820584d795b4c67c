"""A directed multigraph and its neighbour aggregations.

``nodes`` has the column ``node``; ``edges`` has ``edge`` (a unique id that orders the edges), ``source`` and ``target``. Parallel edges count each. A node
field is a frame with ``node``, its value columns and any lane columns (time, batch); all lanes go through one plan. An edge field has ``edge`` instead.

Every aggregation is one join of edges with a field and one hash aggregate with partial sums before the shuffle, so a hub's edges are reduced where they lie.
Rows of nodes without incoming edges come from zeros that are added to the messages, not from an outer join: results are 0 there, never null.
Joins are left to the optimiser (broadcast by size, skewed sources split by adaptive execution); none is a cross join.

Defined cases: null values count as 0. An edge whose endpoint has no row in the field gives nothing; ``violations`` finds those. A graph without edges gives zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.exact import order_free_sums
from loomgrid.functions.single import with_row

Names = Sequence[str]


@dataclass(frozen=True)
class MeshGraph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(spark: SparkSession, nodes: int, source: Sequence[int], target: Sequence[int], **fields: Sequence[float]) -> MeshGraph:
        """A small graph from lists, checked as they are given; further lists become edge columns."""
        if nodes <= 0:
            raise ValueError("a graph needs at least one node")
        if len(source) != len(target) or any(len(f) != len(source) for f in fields.values()):
            raise ValueError("sources, targets and edge fields must be of one length")
        if any(not 0 <= n < nodes for n in (*source, *target)):
            raise ValueError(f"endpoints must be node ids from 0 to {nodes - 1}")
        rows = [(i, int(s), int(t), *(float(f[i]) for f in fields.values())) for i, (s, t) in enumerate(zip(source, target))]
        schema = "edge long, source long, target long" + "".join(f", {f} double" for f in fields)
        return MeshGraph(spark.range(nodes).select(F.col("id").alias("node")), spark.createDataFrame(rows, schema))

    # -- checks -------------------------------------------------------------------------------------------------------

    def violations(self) -> DataFrame:
        """(rule, key): repeated node or edge ids, null ids and endpoints that are no nodes."""
        text = lambda c: F.col(c).cast("string").alias("key")
        repeated = lambda f, c, rule: f.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(F.lit(rule).alias("rule"), text(c))
        out = repeated(self.nodes, "node", "node repeated").unionByName(repeated(self.edges, "edge", "edge repeated"))
        out = out.unionByName(self.edges.filter("edge is null or source is null or target is null").select(F.lit("null id").alias("rule"), text("edge")))
        for end in ("source", "target"):
            loose = self.edges.filter(F.col(end).isNotNull()).join(self.nodes.select(F.col("node").alias(end)), end, "left_anti")
            out = out.unionByName(loose.select(F.lit(f"{end} is no node").alias("rule"), text("edge")))
        return out

    def edge_count(self) -> int:
        return self.edges.count()

    # -- neighbour aggregation ------------------------------------------------------------------------------------------

    def _onto_nodes(self, messages: DataFrame, values: Names, lanes: Names, zeros: DataFrame | None) -> DataFrame:
        """Messages and the zeros of all nodes (in all lanes that the field has)."""
        rows = self.nodes.select("node") if zeros is None else zeros.select(*lanes, "node")
        return messages.unionByName(rows.select(*lanes, "node", *[F.lit(0.0).alias(v) for v in values]))

    def _messages(self, field: DataFrame, values: Names, lanes: Names, weight: str | None) -> DataFrame:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        edges = self.edges.select("source", "target", *([weight] if weight else []))
        sent = edges.join(field.select(*lanes, F.col("node").alias("source"), *values), "source")
        return sent.select(*lanes, F.col("target").alias("node"), *[F.coalesce(w * F.col(v), F.lit(0.0)).alias(v) for v in values])

    def sum(self, field: DataFrame, values: Names, weight: str | None = None, lanes: Names = (), order_free: bool = False) -> DataFrame:
        """For each node the sum of its in-neighbours' values, times the edges' weight; with order_free, the same to the last bit in any order of edges."""
        rows = self._onto_nodes(self._messages(field, values, lanes, weight), values, lanes, field if lanes else None)
        if order_free:
            return order_free_sums(rows, [*lanes, "node"], list(values))
        return rows.groupBy(*lanes, "node").agg(*[F.sum(v).alias(v) for v in values])

    def mean(self, field: DataFrame, values: Names, lanes: Names = ()) -> DataFrame:
        """The sum over in-neighbours divided by their number, at least 1: 0 where there are none."""
        sent = self._messages(field, values, lanes, None).withColumn("_n", F.lit(1.0))
        rows = self._onto_nodes(sent, [*values, "_n"], lanes, field if lanes else None)
        return rows.groupBy(*lanes, "node").agg(*[(F.sum(v) / F.greatest(F.sum("_n"), F.lit(1.0))).alias(v) for v in values])

    def sum_edges(self, field: DataFrame, values: Names, lanes: Names = ()) -> DataFrame:
        """For each node the sum of an edge field over its incoming edges. With lanes, the nodes of every lane that the field has."""
        sent = field.join(self.edges.select("edge", F.col("target").alias("node")), "edge").select(*lanes, "node", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
        return self._onto_nodes(sent, values, lanes, self._in_lanes(field, lanes)).groupBy(*lanes, "node").agg(*[F.sum(v).alias(v) for v in values])

    def _in_lanes(self, field: DataFrame, lanes: Names) -> DataFrame | None:
        """Every node once in each lane of an edge field: the list of lanes (times, windows) is one row, the nodes are spread where they lie."""
        if not lanes:
            return None
        slots = field.agg(F.collect_set(F.struct(*lanes)).alias("_lanes"))
        return with_row(self.nodes.select("node"), slots).select("node", F.explode("_lanes").alias("_l")).select(*[F.col(f"_l.{c}").alias(c) for c in lanes], "node")

    def edge_values(self, field: DataFrame, values: Names, endpoint: str, lanes: Names = ()) -> DataFrame:
        """The field at one endpoint of each edge."""
        if endpoint not in ("source", "target"):
            raise ValueError("an endpoint is 'source' or 'target'")
        return self.edges.select("edge", F.col(endpoint).alias("node")).join(field.select(*lanes, "node", *values), "node").select(*lanes, "edge", *values)

    def segment_max(self, field: DataFrame, value: str) -> DataFrame:
        """The largest value of an edge field over a node's incoming edges, 0 where there are none."""
        sent = field.join(self.edges.select("edge", F.col("target").alias("node")), "edge").select("node", F.col(value).cast("double").alias(value))
        rows = sent.unionByName(self.nodes.select("node", F.lit(None).cast("double").alias(value)))
        return rows.groupBy("node").agg(F.coalesce(F.max(value), F.lit(0.0)).alias(value))

    def softmax(self, field: DataFrame, score: str, name: str = "p") -> DataFrame:
        """(edge, name): scores normalised over the incoming edges of each target. Two aggregates are joined back, so that no window holds a hub's edges."""
        scored = field.select("edge", F.col(score).cast("double").alias("_s")).join(self.edges.select("edge", "target"), "edge")
        top = scored.groupBy("target").agg(F.max("_s").alias("_top"))
        shifted = scored.join(top, "target").select("edge", "target", F.exp(F.col("_s") - F.col("_top")).alias("_e"))
        total = shifted.groupBy("target").agg(F.sum("_e").alias("_all"))
        return shifted.join(total, "target").select("edge", (F.col("_e") / F.col("_all")).alias(name))

    def in_degree(self) -> DataFrame:
        rows = self.edges.select(F.col("target").alias("node"), F.lit(1).cast("long").alias("degree")).unionByName(self.nodes.select("node", F.lit(0).cast("long").alias("degree")))
        return rows.groupBy("node").agg(F.sum("degree").alias("degree"))

    # -- adjoints -------------------------------------------------------------------------------------------------------

    def sum_adjoint(self, gradient: DataFrame, values: Names, weight: str | None = None, lanes: Names = ()) -> DataFrame:
        """The gradient of a field from that of its (weighted) sum: the same sum over reversed edges."""
        return self.reverse().sum(gradient, values, weight, lanes)

    def weight_adjoint(self, field: DataFrame, gradient: DataFrame, values: Names, lanes: Names = ()) -> DataFrame:
        """(edge, weight): the gradient of each edge's weight, the dot of the source's values with the target's gradient, over all lanes."""
        at = self.edges.select("edge", "source", "target")
        at = at.join(field.select(*lanes, F.col("node").alias("source"), *[F.col(v).alias(f"_x{i}") for i, v in enumerate(values)]), "source")
        at = at.join(gradient.select(*lanes, F.col("node").alias("target"), *[F.col(v).alias(f"_g{i}") for i, v in enumerate(values)]), ["target", *lanes])
        dot = sum((F.coalesce(F.col(f"_x{i}") * F.col(f"_g{i}"), F.lit(0.0)) for i in range(len(values))), F.lit(0.0))
        return at.select("edge", dot.alias("weight")) if not lanes else at.groupBy("edge").agg(F.sum(dot).alias("weight"))

    def gather_adjoint(self, gradient: DataFrame, values: Names, endpoint: str) -> DataFrame:
        """The gradient of a node field from that of its values gathered at an endpoint of the edges."""
        return (self if endpoint == "target" else self.reverse()).sum_edges(gradient, values)

    def sum_edges_adjoint(self, gradient: DataFrame, values: Names) -> DataFrame:
        """The gradient of an edge field from that of its sum at targets."""
        return self.edge_values(gradient, values, "target")

    # -- other topologies -----------------------------------------------------------------------------------------------

    def reverse(self) -> MeshGraph:
        """Edges turned round, with their ids and fields."""
        others = [c for c in self.edges.columns if c not in ("edge", "source", "target")]
        return MeshGraph(self.nodes, self.edges.select("edge", F.col("target").alias("source"), F.col("source").alias("target"), *others))

    def canonical(self) -> DataFrame:
        """Edges in the order of target, source and id, each target's edges numbered from 0: the order in which a row is stored in compressed form.
        Numbers are counts of smaller (source, id): partitions by target, sorted inside."""
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("target").orderBy("source", "edge")) - 1
        return self.edges.select("target", place.cast("long").alias("place"), "source", "edge")

    def without_loops(self) -> MeshGraph:
        return MeshGraph(self.nodes, self.edges.filter(F.col("source") != F.col("target")))

    def self_only(self) -> MeshGraph:
        """Each node tied to itself only."""
        return MeshGraph(self.nodes, self.nodes.select(F.col("node").alias("edge"), F.col("node").alias("source"), F.col("node").alias("target")))

    def with_loops(self) -> MeshGraph:
        """The edges and one loop for each node; loops have null ids."""
        loops = self.nodes.select(F.lit(None).cast(self.edges.schema["edge"].dataType).alias("edge"), F.col("node").alias("source"), F.col("node").alias("target"))
        return MeshGraph(self.nodes, self.edges.select("edge", "source", "target").unionByName(loops))

    def both_ways(self) -> MeshGraph:
        """Every edge and its reverse, with multiplicity: 2e and 2e + 1."""
        ways = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("source").alias("s"), F.col("target").alias("t")), F.struct(F.lit(1).alias("w"), F.col("target").alias("s"), F.col("source").alias("t"))))
        return MeshGraph(self.nodes, self.edges.select("edge", ways.alias("x")).select((F.col("edge") * 2 + F.col("x.w")).alias("edge"), F.col("x.s").alias("source"), F.col("x.t").alias("target")))

    def symmetric(self) -> MeshGraph:
        """One edge for each ordered pair that an edge or its reverse has; ids are those of the first that gives it (2e, or 2e + 1 for a reverse)."""
        first = self.both_ways().edges.groupBy("source", "target").agg(F.min("edge").alias("edge"))
        return MeshGraph(self.nodes, first.select("edge", "source", "target"))

    def asymmetric_edges(self) -> DataFrame:
        """(source, target, forward, backward): ordered pairs whose multiplicity differs from that of the reverse. Empty for symmetric graphs."""
        ways = self.edges.select("source", "target", F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(self.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(0).alias("f"), F.lit(1).alias("b")))
        counts = ways.groupBy("source", "target").agg(F.sum("f").alias("forward"), F.sum("b").alias("backward"))
        return counts.filter("forward <> backward")

    def require_symmetric(self) -> MeshGraph:
        """The graph, if it has no loops and equals its reverse."""
        if not self.edges.filter(F.col("source") == F.col("target")).isEmpty():
            raise ValueError("the graph must not have loops")
        if not self.asymmetric_edges().isEmpty():
            raise ValueError("the graph must be symmetric")
        return self

    def relabelled(self, permutation: DataFrame) -> MeshGraph:
        """Endpoints renamed by (node, to): a control with the same degrees and other places."""
        named = self.edges
        for end in ("source", "target"):
            named = named.join(permutation.select(F.col("node").alias(end), F.col("to").alias(f"_{end}")), end)
        others = [c for c in self.edges.columns if c not in ("edge", "source", "target")]
        return MeshGraph(self.nodes, named.select("edge", F.col("_source").alias("source"), F.col("_target").alias("target"), *others))

    def induced(self, members: DataFrame, by: Names = ()) -> DataFrame:
        """Edges with both ends among the members (by..., node), for each group of them."""
        inner = self.edges.join(members.select(*by, F.col("node").alias("source")), "source")
        return inner.join(members.select(*by, F.col("node").alias("target")), [*by, "target"], "left_semi").select(*by, "edge", "source", "target")

    def cartesian(self, other: MeshGraph, size: int, other_size: int, edges: int | None = None, other_edges: int | None = None) -> MeshGraph:
        """The product over pairs of nodes a * other_size + b, both graphs having nodes 0 to size - 1 and edges from 0. The left factor's edges come first.
        Pairs are generated from ranges; the product is as large as its result and no join is made. Numbers of edges are counted unless given."""
        edges, other_edges = self.edge_count() if edges is None else edges, other.edge_count() if other_edges is None else other_edges
        right = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_size - 1).cast("long")))
        left = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
        across = self.edges.select("edge", "source", "target", right.alias("b")).select(*[(F.col(c) * other_size + F.col("b")).alias(c) for c in ("edge", "source", "target")])
        within = other.edges.select("edge", "source", "target", left.alias("a")).select(
            (F.lit(edges * other_size) + F.col("a") * other_edges + F.col("edge")).alias("edge"), (F.col("a") * other_size + F.col("source")).alias("source"), (F.col("a") * other_size + F.col("target")).alias("target")
        )
        return MeshGraph(self.nodes.sparkSession.range(size * other_size).select(F.col("id").alias("node")), across.unionByName(within))


def disjoint_union(graphs: DataFrame, edges: DataFrame, sizes: str = "size") -> MeshGraph:
    """One graph of a collection: graphs (graph, size), edges (graph, edge, source, target) with nodes from 0 within each graph.
    Node ids are the graph's offset, the nodes of all graphs before it, plus the node; the running sum is over ordinals in ranges."""
    from loomgrid.operators.running import running_sum

    placed = running_sum(graphs.select("graph", F.col(sizes).cast("long").alias("size")), ["graph"], "size", "upto").withColumn("offset", F.col("upto") - F.col("size"))
    nodes = placed.filter("size > 0").select(F.explode(F.sequence(F.col("offset"), F.col("upto") - 1)).alias("node"))
    moved = edges.join(placed.select("graph", "offset"), "graph")
    return MeshGraph(nodes, moved.select("graph", "edge", (F.col("offset") + F.col("source")).alias("source"), (F.col("offset") + F.col("target")).alias("target")))


def pooled_mean(items: DataFrame, groups: DataFrame, owner: str, values: Names) -> DataFrame:
    """The mean of items by owner, 0 for groups without items."""
    rows = items.select(owner, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values], F.lit(1).alias("_n"))
    rows = rows.unionByName(groups.select(owner, *[F.lit(0.0).alias(v) for v in values], F.lit(0).alias("_n")))
    return rows.groupBy(owner).agg(*[(F.sum(v) / F.greatest(F.sum("_n"), F.lit(1))).alias(v) for v in values])


def one_of(name: Column, choices: Names) -> Column:
    """A one-hot list of doubles."""
    return F.array(*[F.when(name == c, 1.0).otherwise(0.0) for c in choices])
