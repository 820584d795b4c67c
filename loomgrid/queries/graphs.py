"""Queries of the graph algebra, geometry and layers, and their SQL.

The main graph is the trade of parts and suppliers: an edge for each line of an order, from the part (odd ids) to its supplier (even ids). Parts and suppliers trade
often, so it is a multigraph, and parts have no incoming edges. The other is the map of stops: an edge for each pair of consecutive calls of a planned trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.ordinals import with_ordinal
from loomgrid.graph.collections import random_walk_returns
from loomgrid.graph.geometry import gaussian_affinity, inverse_distance, radial_messages
from loomgrid.graph.mesh import MeshGraph
from loomgrid.layers import conv
from loomgrid.layers.recurrent import TGCN, DiffusionGRU, GConvGRU, a3tgcn, fold, initial
from loomgrid.session import table, written

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
X = ["x0", "x1"]

# weights of the layers
W_NEIGHBOUR, W_ROOT, BIAS = ((0.5, -0.25), (0.125, 0.75)), ((1.0, 0.5), (-0.5, 0.25)), (0.1, -0.2)
W_EDGE, B_EDGE = ((0.5,), (-0.25,)), (0.05, 0.1)
W_HIDDEN, W_OUT = ((0.3, -0.2), (0.1, 0.4)), ((0.6, 0.2), (-0.3, 0.5))
A_SOURCE, A_TARGET = ((0.7,), (-0.4,)), ((0.2,), (0.3,))
W_CHEB = ((0.4, -0.1, 0.3, 0.2, -0.2, 0.1),)


def rounded(frame: DataFrame, values: list[str], digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(F.col(c), digits).alias(c) if c in values else F.col(c) for c in frame.columns])


def trade(spark: SparkSession, folder: str, ordinals: bool = False) -> MeshGraph:
    nodes = table(spark, folder, "supplier").select((F.col("s_suppkey") * 2).alias("node")).unionByName(table(spark, folder, "part").select((F.col("p_partkey") * 2 + 1).alias("node")))
    lines = table(spark, folder, "lineitem").select(*_ORDER)
    lines = with_ordinal(lines, _ORDER, "edge") if ordinals else lines.withColumn("edge", F.lit(None).cast("long"))
    edges = lines.select("edge", (F.col("l_partkey") * 2 + 1).alias("source"), (F.col("l_suppkey") * 2).alias("target"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") * 10).alias("score"))
    return MeshGraph(nodes, edges)


def trade_field(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select((F.col("s_suppkey") * 2).alias("node"), (F.col("s_acctbal") / 1000).alias("x0"), (F.col("s_nationkey") / 25.0).alias("x1"))
    return suppliers.unionByName(table(spark, folder, "part").select((F.col("p_partkey") * 2 + 1).alias("node"), (F.col("p_retailprice") / 1000).alias("x0"), (F.col("p_size") / 50.0).alias("x1")))


def graph_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(trade(spark, folder).sum(trade_field(spark, folder), X), X)


def graph_weighted_sum(spark: SparkSession, folder: str) -> DataFrame:
    """What each supplier's lines weigh: quantities times the parts' values, 0 for parts."""
    return rounded(trade(spark, folder).sum(trade_field(spark, folder), X, "w"), X)


def graph_exact_sum(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted sum to the last bit, whatever the order of edges."""
    return rounded(trade(spark, folder).sum(trade_field(spark, folder), X, "w", order_free=True), X)


def graph_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(trade(spark, folder).mean(trade_field(spark, folder), X), X)


def graph_in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return trade(spark, folder).in_degree()


def graph_lanes_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Three lanes of one field go through one plan."""
    lanes = trade_field(spark, folder).select("node", "x0", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("lane")).select("lane", "node", (F.col("x0") * (F.col("lane") + 1)).alias("x0"))
    return rounded(trade(spark, folder).sum(lanes, ["x0"], lanes=["lane"]), ["x0"])


def edge_gather_source(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(trade(spark, folder, True).edge_values(trade_field(spark, folder), X, "source"), X)


def edge_gather_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(trade(spark, folder, True).edge_values(trade_field(spark, folder), X, "target"), X)


def edge_sum(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder, True)
    return rounded(g.sum_edges(g.edges.select("edge", "price"), ["price"]), ["price"], 2)


def graph_softmax(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder, True)
    return rounded(g.softmax(g.edges.select("edge", "score"), "score"), ["p"], 9)


def segment_max(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder, True)
    return g.segment_max(g.edges.select("edge", "price"), "price")


def graph_reverse_sum(spark: SparkSession, folder: str) -> DataFrame:
    """The gradient of the parts' values from one of the weighted sum."""
    return rounded(trade(spark, folder).sum_adjoint(trade_field(spark, folder), X, "w"), X)


def edge_dot_grad(spark: SparkSession, folder: str) -> DataFrame:
    field = trade_field(spark, folder)
    return rounded(trade(spark, folder, True).weight_adjoint(field, field, X), ["weight"], 9)


def gather_adjoint(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder, True)
    return rounded(g.gather_adjoint(g.edges.select("edge", F.col("price").alias("g")), ["g"], "source"), ["g"], 2)


def edge_canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    return trade(spark, folder, True).canonical()


def graph_cartesian(spark: SparkSession, folder: str) -> DataFrame:
    """The product of a ring of nations and a chain of regions."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    key = lambda c: F.col(c).cast("long")
    n, r = nations.count(), regions.count()
    ring = MeshGraph(nations.select(key("n_nationkey").alias("node")), nations.select(key("n_nationkey").alias("edge"), key("n_nationkey").alias("source"), F.pmod(key("n_nationkey") + 1, F.lit(n)).alias("target")))
    steps = regions.filter(F.col("r_regionkey") < r - 1)
    chain = MeshGraph(regions.select(key("r_regionkey").alias("node")), steps.select(key("r_regionkey").alias("edge"), key("r_regionkey").alias("source"), (key("r_regionkey") + 1).alias("target")))
    return ring.cartesian(chain, n, r, n, r - 1).edges


def stop_map(spark: SparkSession, folder: str) -> MeshGraph:
    """Stops and the edges between consecutive calls of a trip's period; the edge is the id of the call that it leaves."""
    from pyspark.sql import Window

    stops = table(spark, folder, "schedule_stops").filter("stop_id is not null").select(F.col("stop_id").alias("node")).distinct()
    calls = table(spark, folder, "schedule_calls").filter("trip_id is not null and stop_id is not null")
    trip = Window.partitionBy("trip_id", "gtfs_active_date").orderBy("stop_sequence", "call_id")
    edges = calls.select(F.col("call_id").alias("edge"), F.col("stop_id").alias("source"), F.lead("stop_id").over(trip).alias("target")).filter("target is not null")
    known = stops.select(F.col("node").alias("source"))
    return MeshGraph(stops, edges.join(known, "source", "left_semi").join(stops.select(F.col("node").alias("target")), "target", "left_semi").select("edge", "source", "target"))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """(node, px, py): each stop's place, the smallest of its versions."""
    stops = table(spark, folder, "schedule_stops").filter("stop_id is not null and stop_lat is not null and stop_lon is not null")
    return stops.groupBy(F.col("stop_id").alias("node")).agg(F.min(F.struct("stop_lon", "stop_lat")).alias("p")).select("node", F.col("p.stop_lon").alias("px"), F.col("p.stop_lat").alias("py"))


def graph_no_self_loops(spark: SparkSession, folder: str) -> DataFrame:
    return stop_map(spark, folder).without_loops().edges


def graph_symmetrize(spark: SparkSession, folder: str) -> DataFrame:
    return stop_map(spark, folder).symmetric().edges


def asymmetric_edges(spark: SparkSession, folder: str) -> DataFrame:
    return stop_map(spark, folder).asymmetric_edges().select("source", "target", F.col("forward").cast("long").alias("forward"), F.col("backward").cast("long").alias("backward"))


def graph_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Loops, ordered pairs, reciprocal pairs and the largest multiplicity of the map of stops."""
    pairs = stop_map(spark, folder).edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    back = pairs.select(F.col("source").alias("target"), F.col("target").alias("source"), F.lit(1).alias("back"))
    return pairs.join(back, ["source", "target"], "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("edges"), F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("source") == F.col("target"), F.col("n"))), F.lit(0)).cast("long").alias("loops"),
        F.count_if(F.col("back").isNotNull()).alias("reciprocal_pairs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_multiplicity"),
    )


def radial_message(spark: SparkSession, folder: str) -> DataFrame:
    """Messages between stops that fade with their distance."""
    field = positions(spark, folder).select("node", F.lit(1.0).alias("x"))
    return rounded(radial_messages(stop_map(spark, folder), positions(spark, folder), field, ["x"], decay=25.0), ["x"])


def inverse_distance_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(inverse_distance(stop_map(spark, folder), positions(spark, folder)), ["affinity"])


def gaussian_affinity_graph(spark: SparkSession, folder: str) -> DataFrame:
    g = stop_map(spark, folder).without_loops()
    return rounded(gaussian_affinity(g, positions(spark, folder), least=0.1), ["affinity"])


def rwse(spark: SparkSession, folder: str) -> DataFrame:
    """Return probabilities of random walks over the map of stops after one to three steps."""
    return rounded(random_walk_returns(stop_map(spark, folder).both_ways(), 3), ["p1", "p2", "p3"], 9)


def directed_diffusion(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder)
    weighted = MeshGraph(g.nodes, conv.diffusion_weights(g, "w"))
    return rounded(conv.diffusion(weighted, trade_field(spark, folder), ["x0"]), ["f0", "r0"])


def sage_layer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(conv.sage(trade(spark, folder), trade_field(spark, folder), X, W_NEIGHBOUR, W_ROOT, BIAS), ["o0", "o1"])


def gcn_layer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(conv.gcn(trade(spark, folder).with_loops(), trade_field(spark, folder), X, W_NEIGHBOUR, BIAS), ["o0", "o1"], 9)


def gine_layer(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder, True)
    edges = g.edges.select("edge", (F.col("w") / 50).alias("q"))
    return rounded(conv.gine(g, trade_field(spark, folder), X, edges, ["q"], (W_EDGE, B_EDGE), (W_HIDDEN, BIAS), (W_OUT, BIAS), 0.1), ["o0", "o1"])


def gat_layer(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(conv.gat(trade(spark, folder), trade_field(spark, folder), X, W_NEIGHBOUR, A_SOURCE, A_TARGET, BIAS), ["o0", "o1"])


def cheb_layer(spark: SparkSession, folder: str) -> DataFrame:
    both = trade(spark, folder).both_ways()
    return rounded(conv.cheb(both, trade_field(spark, folder), X, W_CHEB, (0.05,), 3, checked=False), ["o0"])


def _steps(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The field at three steps of time."""
    return [trade_field(spark, folder).select("node", *[(F.col(x) * (1 + 0.5 * t)).alias(x) for x in X]) for t in range(3)]


_GATE = (((0.5, -0.3),), (0.1,)), (((0.2, 0.4),), (-0.1,)), (((0.7, 0.3),), (0.05,))


def _tgcn(spark: SparkSession, folder: str) -> TGCN:
    return TGCN(trade(spark, folder).with_loops(), ((0.5, -0.25), (0.125, 0.75), (-0.4, 0.6)), *_GATE)


def tgcn_step(spark: SparkSession, folder: str) -> DataFrame:
    field = trade_field(spark, folder)
    return rounded(_tgcn(spark, folder).step(field, X, initial(field, 1)), ["h0"])


def tgcn_fold(spark: SparkSession, folder: str) -> DataFrame:
    cell, fields = _tgcn(spark, folder), _steps(spark, folder)
    return rounded(fold(lambda f, s: cell.step(f, X, s), fields, initial(fields[0], 1)), ["h0"])


def a3tgcn_attention(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(a3tgcn(_tgcn(spark, folder), _steps(spark, folder), X, (0.2, -0.1, 0.5)), ["h0"])


def gconv_gru_fold(spark: SparkSession, folder: str) -> DataFrame:
    fields = _steps(spark, folder)
    cell = GConvGRU(trade(spark, folder).both_ways(), (((0.3, -0.2, 0.5, 0.1, 0.2, -0.1), (-0.2, 0.4, 0.1, 0.3, -0.3, 0.2)), (0.1, -0.1)), (((0.4, 0.1, 0.3, -0.2, 0.2, 0.5),), (0.05,)), 2)
    return rounded(fold(lambda f, s: cell.step(f, X, s), fields, initial(fields[0], 1), 1), ["h0"])


def diffusion_gru_fold(spark: SparkSession, folder: str) -> DataFrame:
    g, fields = trade(spark, folder), [f.select("node", "x0") for f in _steps(spark, folder)]
    # the weights are of the topology: made once for all steps
    weighted = MeshGraph(g.nodes, written(conv.diffusion_weights(g, "w")))
    cell = DiffusionGRU(weighted, (((0.3, -0.2, 0.5, 0.1, 0.2, -0.1), (-0.2, 0.4, 0.1, 0.3, -0.3, 0.2)), (0.1, -0.1)), (((0.4, 0.1, 0.3, -0.2, 0.2, 0.5),), (0.05,)))
    return rounded(fold(lambda f, s: cell.step(f, ["x0"], s), fields, initial(fields[0], 1), 1), ["h0"])


_QUERIES = (
    graph_sum, graph_weighted_sum, graph_exact_sum, graph_mean, graph_in_degree, graph_lanes_sum, edge_gather_source, edge_gather_target, edge_sum, graph_softmax, segment_max, graph_reverse_sum, edge_dot_grad,
    gather_adjoint, edge_canonical_order, graph_cartesian, graph_no_self_loops, graph_symmetrize, asymmetric_edges, graph_audit, radial_message, inverse_distance_affinity, gaussian_affinity_graph, rwse,
    directed_diffusion, sage_layer, gcn_layer, gine_layer, gat_layer, cheb_layer, tgcn_step, tgcn_fold, a3tgcn_attention, gconv_gru_fold, diffusion_gru_fold,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# -- SQL ------------------------------------------------------------------------------------------------------------------

_TRADE = f"""WITH e AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS edge, l_partkey * 2 + 1 AS source, l_suppkey * 2 AS target, l_quantity AS w, l_extendedprice AS price, l_discount * 10 AS score FROM lineitem),
n AS (SELECT s_suppkey * 2 AS node, s_acctbal / 1000 AS x0, s_nationkey / 25.0 AS x1 FROM supplier UNION ALL SELECT p_partkey * 2 + 1, p_retailprice / 1000, p_size / 50.0 FROM part)"""


def _row(columns: list[str], weights, bias: float = 0.0) -> str:
    return "(" + " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in zip(columns, weights)) + f" + {bias!r}::DOUBLE)"


def _summed(expression: str, digits: int = 6, join: str = "e.source") -> str:
    at = "target" if join == "e.source" else "source"
    return f"""{_TRADE}, s AS (SELECT e.{at} AS node, {expression} FROM e JOIN n ON n.node = {join} GROUP BY 1)
SELECT n.node, round(coalesce(s.y0, 0), {digits}) AS x0, round(coalesce(s.y1, 0), {digits}) AS x1 FROM n LEFT JOIN s USING (node)"""


_WEIGHTED = "sum(w * x0) AS y0, sum(w * x1) AS y1"
_STOPS = """WITH st AS (SELECT DISTINCT stop_id AS node FROM schedule_stops WHERE stop_id IS NOT NULL),
pairs AS (SELECT call_id AS edge, stop_id AS source, lead(stop_id) OVER (PARTITION BY trip_id, gtfs_active_date ORDER BY stop_sequence, call_id) AS target FROM schedule_calls WHERE trip_id IS NOT NULL AND stop_id IS NOT NULL),
m AS (SELECT * FROM pairs WHERE source IN (SELECT node FROM st) AND target IN (SELECT node FROM st)),
place AS (SELECT stop_id AS node, min(struct_pack(px := stop_lon, py := stop_lat)) AS p FROM schedule_stops WHERE stop_id IS NOT NULL AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL GROUP BY 1)"""
_DISTANCE = _STOPS + ", d AS (SELECT m.*, sqrt((a.p.px - b.p.px) ** 2 + (a.p.py - b.p.py) ** 2) AS distance FROM m JOIN place a ON a.node = m.source JOIN place b ON b.node = m.target)"
_LOOPS = _TRADE + ", l AS (SELECT source, target FROM e UNION ALL SELECT node, node FROM n), deg AS (SELECT target AS node, count(*) AS d FROM l GROUP BY 1)"
_GCN = _LOOPS + ", g AS (SELECT l.target AS node, sum(n.x0 / sqrt(a.d) / sqrt(b.d)) AS y0, sum(n.x1 / sqrt(a.d) / sqrt(b.d)) AS y1 FROM l JOIN n ON n.node = l.source JOIN deg a ON a.node = l.source JOIN deg b ON b.node = l.target GROUP BY 1)"
_Y, _XS = ["y0", "y1"], ["x0", "x1"]


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _tgcn_sql(scale: float, name: str) -> str:
    """h after one step from zero: the projection of the normalised sum scaled by a number."""
    z = [_row([f"y0 * {scale!r}::DOUBLE", f"y1 * {scale!r}::DOUBLE"], w) for w in ((0.5, -0.25), (0.125, 0.75), (-0.4, 0.6))]
    return f"(1 - {_sig(f'{z[0]} * 0.5::DOUBLE + 0.1::DOUBLE')}) * tanh({z[2]} * 0.7::DOUBLE + 0.05::DOUBLE) AS {name}"


def _tgcn_fold_sql() -> str:
    """Three steps of the cell on the normalised sums."""
    steps, h = [], "0.0::DOUBLE"
    for t in range(3):
        z = [_row([f"y0 * {1 + 0.5 * t!r}::DOUBLE", f"y1 * {1 + 0.5 * t!r}::DOUBLE"], w) for w in ((0.5, -0.25), (0.125, 0.75), (-0.4, 0.6))]
        u, r = _sig(f"{z[0]} * 0.5::DOUBLE - {h} * 0.3::DOUBLE + 0.1::DOUBLE"), _sig(f"{z[1]} * 0.2::DOUBLE + {h} * 0.4::DOUBLE - 0.1::DOUBLE")
        steps.append(f"s{t} AS (SELECT *, {u} * {h} + (1 - {u}) * tanh({z[2]} * 0.7::DOUBLE + {h} * {r} * 0.3::DOUBLE + 0.05::DOUBLE) AS h{t} FROM {'g' if t == 0 else f's{t - 1}'})")
        h = f"h{t}"
    return f"{_GCN}, {', '.join(steps)} SELECT node, round(h2, 6) AS h0 FROM s2"


def _attention() -> str:
    from loomgrid.functions.dense import softmax_weights

    return " + ".join(f"h{t} * {p!r}::DOUBLE" for t, p in enumerate(softmax_weights((0.2, -0.1, 0.5))))


def _cheb_sql() -> str:
    shift = lambda of, name, cols: f"{name} AS (SELECT n.node, " + ", ".join(f"coalesce(-sum(s.{c} / sqrt(a.d)) / sqrt(min(b.d)), 0) AS {c}" for c in cols) + f" FROM n LEFT JOIN b2 ON b2.target = n.node LEFT JOIN {of} s ON s.node = b2.source LEFT JOIN deg a ON a.node = b2.source LEFT JOIN deg b ON b.node = n.node GROUP BY 1)"
    both = "b2 AS (SELECT source, target FROM e UNION ALL SELECT target, source FROM e), deg AS (SELECT target AS node, count(*) AS d FROM b2 GROUP BY 1)"
    columns = ["n.x0", "n.x1", "t1.x0", "t1.x1", "(2 * t2.x0 - n.x0)", "(2 * t2.x1 - n.x1)"]
    return f"{_TRADE}, {both}, {shift('n', 't1', _XS)}, {shift('t1', 't2', _XS)} SELECT node, round({_row(columns, W_CHEB[0], 0.05)}, 6) AS o0 FROM n JOIN t1 USING (node) JOIN t2 USING (node)"


def _gat_sql() -> str:
    state = ", ".join(f"{_row(_XS, W_NEIGHBOUR[h])} AS w{h}" for h in range(2))
    score = ", ".join(f"CASE WHEN z{h} >= 0 THEN z{h} ELSE z{h} * 0.2::DOUBLE END AS s{h}" for h in range(2))
    z = ", ".join(f"a.w{h} * {A_SOURCE[h][0]!r}::DOUBLE + b.w{h} * {A_TARGET[h][0]!r}::DOUBLE AS z{h}" for h in range(2))
    out = ", ".join(f"round(coalesce(y{h} / t{h}, 0) + {BIAS[h]!r}::DOUBLE, 6) AS o{h}" for h in range(2))
    return f"""{_TRADE}, st AS (SELECT node, {state} FROM n), zz AS (SELECT e.target, a.w0, a.w1, {z} FROM e JOIN st a ON a.node = e.source JOIN st b ON b.node = e.target),
ss AS (SELECT target, w0, w1, {score} FROM zz), mx AS (SELECT target, max(s0) AS m0, max(s1) AS m1 FROM ss GROUP BY 1),
y AS (SELECT target AS node, sum(exp(s0 - m0)) AS t0, sum(exp(s1 - m1)) AS t1, sum(exp(s0 - m0) * w0) AS y0, sum(exp(s1 - m1) * w1) AS y1 FROM ss JOIN mx USING (target) GROUP BY 1)
SELECT n.node, {out} FROM n LEFT JOIN y USING (node)"""


def _gine_sql() -> str:
    message = ", ".join(f"sum(greatest(x{i} + {_row(['w / 50'], W_EDGE[i], B_EDGE[i])}, 0)) AS m{i}" for i in range(2))
    state = ", ".join(f"1.1::DOUBLE * x{i} + coalesce(m{i}, 0) AS v{i}" for i in range(2))
    hidden = ", ".join(f"greatest({_row(['v0', 'v1'], W_HIDDEN[i], BIAS[i])}, 0) AS h{i}" for i in range(2))
    out = ", ".join(f"round({_row(['h0', 'h1'], W_OUT[i], BIAS[i])}, 6) AS o{i}" for i in range(2))
    return f"{_TRADE}, m AS (SELECT target AS node, {message} FROM e JOIN n ON n.node = e.source GROUP BY 1), v AS (SELECT n.node, {state} FROM n LEFT JOIN m USING (node)), h AS (SELECT node, {hidden} FROM v) SELECT node, {out} FROM h"


SQL = {
    "graph_sum": _summed("sum(x0) AS y0, sum(x1) AS y1"),
    "graph_weighted_sum": _summed(_WEIGHTED),
    "graph_exact_sum": _summed(_WEIGHTED),
    "graph_mean": _summed("avg(x0) AS y0, avg(x1) AS y1"),
    "graph_in_degree": f"{_TRADE} SELECT n.node, count(e.target) AS degree FROM n LEFT JOIN e ON e.target = n.node GROUP BY 1",
    "graph_lanes_sum": f"{_TRADE} SELECT CAST(lane AS INT) AS lane, node, round(coalesce(y, 0) * (lane + 1), 6) AS x0 FROM (SELECT n.node, sum(m.x0) AS y FROM n LEFT JOIN e ON e.target = n.node LEFT JOIN n m ON m.node = e.source GROUP BY 1), range(3) l(lane)",
    "edge_gather_source": f"{_TRADE} SELECT edge, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM e JOIN n ON n.node = e.source",
    "edge_gather_target": f"{_TRADE} SELECT edge, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM e JOIN n ON n.node = e.target",
    "edge_sum": f"{_TRADE} SELECT node, round(coalesce(sum(price), 0), 2) AS price FROM n LEFT JOIN e ON e.target = n.node GROUP BY 1",
    "graph_softmax": f"{_TRADE}, t AS (SELECT *, exp(score - max(score) OVER (PARTITION BY target)) AS x FROM e) SELECT edge, round(x / sum(x) OVER (PARTITION BY target), 9) AS p FROM t",
    "segment_max": f"{_TRADE} SELECT node, coalesce(max(price), 0) AS price FROM n LEFT JOIN e ON e.target = n.node GROUP BY 1",
    "graph_reverse_sum": _summed(_WEIGHTED, join="e.target"),
    "edge_dot_grad": f"{_TRADE} SELECT edge, round(a.x0 * b.x0 + a.x1 * b.x1, 9) AS weight FROM e JOIN n a ON a.node = e.source JOIN n b ON b.node = e.target",
    "gather_adjoint": f"{_TRADE} SELECT node, round(coalesce(sum(price), 0), 2) AS g FROM n LEFT JOIN e ON e.source = n.node GROUP BY 1",
    "edge_canonical_order": f"{_TRADE} SELECT target, row_number() OVER (PARTITION BY target ORDER BY source, edge) - 1 AS place, source, edge FROM e",
    "graph_cartesian": """WITH s AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r), a AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), b AS (SELECT CAST(r_regionkey AS BIGINT) AS k FROM region)
SELECT a.k * r + b.k AS edge, a.k * r + b.k AS source, (a.k + 1) % n * r + b.k AS target FROM a, b, s
UNION ALL SELECT n * r + a.k * (r - 1) + b.k, a.k * r + b.k, a.k * r + b.k + 1 FROM a, b, s WHERE b.k < r - 1""",
    "graph_no_self_loops": f"{_STOPS} SELECT edge, source, target FROM m WHERE source <> target",
    "graph_symmetrize": f"{_STOPS} SELECT min(edge) AS edge, source, target FROM (SELECT edge * 2 AS edge, source, target FROM m UNION ALL SELECT edge * 2 + 1, target, source FROM m) GROUP BY source, target",
    "asymmetric_edges": f"{_STOPS}, c AS (SELECT source, target, count(*) AS n FROM m GROUP BY 1, 2) SELECT coalesce(a.source, b.target) AS source, coalesce(a.target, b.source) AS target, coalesce(a.n, 0) AS forward, coalesce(b.n, 0) AS backward FROM c a FULL JOIN c b ON a.source = b.target AND a.target = b.source WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
    "graph_audit": f"{_STOPS}, c AS (SELECT source, target, count(*) AS n FROM m GROUP BY 1, 2) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS edges, count(*) AS pairs, CAST(coalesce(sum(n) FILTER (WHERE source = target), 0) AS BIGINT) AS loops, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c o WHERE o.source = c.target AND o.target = c.source)) AS reciprocal_pairs, coalesce(max(n), 0) AS largest_multiplicity FROM c",
    "radial_message": f"{_DISTANCE} SELECT st.node, round(coalesce(sum(exp(-25 * distance)), 0), 6) AS x FROM st LEFT JOIN d ON d.target = st.node GROUP BY 1",
    "inverse_distance_affinity": f"{_DISTANCE} SELECT edge, source, target, round(1 / distance, 6) AS affinity FROM d WHERE distance > 0",
    "gaussian_affinity_graph": f"{_DISTANCE}, u AS (SELECT source, target, min(distance) AS distance FROM d WHERE source <> target GROUP BY 1, 2), s AS (SELECT stddev_pop(distance) AS sigma FROM u) SELECT source, target, round(exp(-((distance / sigma) ** 2)), 6) AS affinity FROM u, s WHERE exp(-((distance / sigma) ** 2)) >= 0.1",
    "rwse": f"""{_STOPS}, w AS (SELECT source, target FROM m UNION ALL SELECT target, source FROM m), t AS (SELECT source, target, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM w GROUP BY 1, 2),
t2 AS (SELECT a.source, b.target, sum(a.p * b.p) AS p FROM t a JOIN t b ON b.source = a.target GROUP BY 1, 2), t3 AS (SELECT a.source, b.target, sum(a.p * b.p) AS p FROM t2 a JOIN t b ON b.source = a.target GROUP BY 1, 2)
SELECT node, round(coalesce(a.p, 0), 9) AS p1, round(coalesce(b.p, 0), 9) AS p2, round(coalesce(c.p, 0), 9) AS p3 FROM st LEFT JOIN t a ON a.source = node AND a.target = node LEFT JOIN t2 b ON b.source = node AND b.target = node LEFT JOIN t3 c ON c.source = node AND c.target = node""",
    "directed_diffusion": f"""{_TRADE}, d AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS f, w / sum(w) OVER (PARTITION BY target) AS r FROM e),
fw AS (SELECT target AS node, sum(f * x0) AS y FROM d JOIN n ON n.node = d.source GROUP BY 1), rv AS (SELECT source AS node, sum(r * x0) AS y FROM d JOIN n ON n.node = d.target GROUP BY 1)
SELECT n.node, round(coalesce(fw.y, 0), 6) AS f0, round(coalesce(rv.y, 0), 6) AS r0 FROM n LEFT JOIN fw USING (node) LEFT JOIN rv USING (node)""",
    "sage_layer": f"{_TRADE}, m AS (SELECT n.node, any_value(n.x0) AS x0, any_value(n.x1) AS x1, coalesce(avg(k.x0), 0) AS y0, coalesce(avg(k.x1), 0) AS y1 FROM n LEFT JOIN e ON e.target = n.node LEFT JOIN n k ON k.node = e.source GROUP BY 1) SELECT node, "
    + ", ".join(f"round({_row(_Y, W_NEIGHBOUR[i], BIAS[i])} + {_row(_XS, W_ROOT[i])}, 6) AS o{i}" for i in range(2)) + " FROM m",
    "gcn_layer": f"{_GCN} SELECT node, " + ", ".join(f"round({_row(_Y, W_NEIGHBOUR[i], BIAS[i])}, 9) AS o{i}" for i in range(2)) + " FROM g",
    "gine_layer": _gine_sql(),
    "gat_layer": _gat_sql(),
    "cheb_layer": _cheb_sql(),
    "tgcn_step": f"{_GCN}, h AS (SELECT node, {_tgcn_sql(1.0, 'h')} FROM g) SELECT node, round(h, 6) AS h0 FROM h",
    "tgcn_fold": _tgcn_fold_sql(),
    "a3tgcn_attention": f"{_GCN}, h AS (SELECT node, {', '.join(_tgcn_sql(1 + 0.5 * t, f'h{t}') for t in range(3))} FROM g) SELECT node, round({_attention()}, 6) AS h0 FROM h",
}


