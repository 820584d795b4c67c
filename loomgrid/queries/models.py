"""Queries of collections, learning and streams, and their SQL.

A collection of small graphs is made of orders: a graph for each order, a node for each of its lines (in the order of line numbers and parts), an edge from each line to the next. Vectors are the
embeddings table, streams read the events and replay tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.functions.dense import hyperbola, layer_norm, masked
from loomgrid.graph import collections as C
from loomgrid.graph.mesh import MeshGraph, disjoint_union, one_of, pooled_mean
from loomgrid.layers import conv, encoders
from loomgrid.layers.recurrent import LSTM
from loomgrid.learning import retrieval, training
from loomgrid.operators.running import running_sum
from loomgrid.queries.graphs import rounded, trade, trade_field
from loomgrid.session import checkpoint_folder, table, written
from loomgrid.streaming import transitions as T

FLAGS, SEED, FOLDS, PATCHES = ("A", "N", "R"), 7, 5, 3


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: graph, node, label, status, quantity; edges: graph, edge, source, target)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.row_number().over(order) - 1).cast("long").alias("node"), F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")).alias("label"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))
    edges = lines.filter("node > 0").select("graph", F.col("node").alias("edge"), (F.col("node") - 1).alias("source"), F.col("node").alias("target"))
    return lines, edges


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def cosine_top1(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other vector of each vector whose id is a multiple of 100, among all."""
    v = _vectors(spark, folder)
    found = retrieval.nearest(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding")
    return rounded(found.select("query", "neighbour", "cosine"), ["cosine"])


def label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    found = retrieval.nearest(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding")
    return rounded(retrieval.label_accuracy(found, v, "vec_id", "label"), ["nearest_accuracy", "majority_accuracy"])


def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return C.stratified_folds(_vectors(spark, folder), "vec_id", "label", FOLDS, SEED)


def fold_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over folds of the share of the most frequent label's rows."""
    counts = stratified_folds(spark, folder).groupBy("fold", "label").count().groupBy("fold").agg((F.max("count") / F.sum("count")).alias("share"))
    return rounded(training.fold_metric(counts, "share"), ["mean", "deviation"])


def group_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Means of two components of vectors by label, with one label that no vector has."""
    items = _vectors(spark, folder).select("label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(2)])
    groups = items.select("label").distinct().unionByName(spark.range(1).select(F.lit(-1).alias("label")))
    return rounded(pooled_mean(items, groups, "label", ["x0", "x1"]), ["x0", "x1"])


def graph_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each order's nodes start in the union of all orders."""
    nodes, _ = _orders(spark, folder)
    sizes = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("size"))
    return running_sum(sizes, ["graph"], "size", "upto").select("graph", "size", (F.col("upto") - F.col("size")).alias("offset"))


def graph_union_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """In-degrees over the disjoint union of all orders, and how many nodes have each."""
    nodes, edges = _orders(spark, folder)
    union = disjoint_union(nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("size")), edges)
    return MeshGraph(union.nodes, union.edges).in_degree().groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _orders(spark, folder)
    marked = edges.join(nodes.select("graph", F.col("node").alias("target"), F.when(F.col("status") == "F", 0).otherwise(1).alias("label")), ["graph", "target"])
    return rounded(C.summary_fractions(nodes, marked, (1, 2, 3), (0, 1)), ["n_1", "n_2", "n_3", "e_0", "e_1"])


def graph_patches(spark: SparkSession, folder: str) -> DataFrame:
    return C.balanced_patches(*_orders(spark, folder), PATCHES, SEED)


def patch_overlap(spark: SparkSession, folder: str) -> DataFrame:
    overlaps = C.patch_overlaps(graph_patches(spark, folder))
    return overlaps.filter("patch < other").groupBy("patch", "other", "shared").agg(F.count(F.lit(1)).alias("graphs"))


def patch_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges inside each patch, by patch."""
    nodes, edges = _orders(spark, folder)
    graph = MeshGraph(nodes.select("graph", "node"), edges)
    inner = graph.edges.join(C.balanced_patches(nodes, edges, PATCHES, SEED).withColumnRenamed("node", "source"), ["graph", "source"]).join(C.balanced_patches(nodes, edges, PATCHES, SEED).withColumnRenamed("node", "target"), ["graph", "patch", "target"], "left_semi")
    return inner.groupBy("patch").agg(F.count(F.lit(1)).alias("edges"))


def feature_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Row-wise maps: masks, layer norm, one-hot, a point of the hyperbola."""
    parts = table(spark, folder, "part")
    x = [F.col("p_size") / 50.0, F.col("p_retailprice") / 1000, F.lit(1.0)]
    hot = one_of(F.col("p_type"), ["ECONOMY", "STANDARD", "PROMO"])
    maps = masked(x, F.col("p_partkey"), 3, SEED) + layer_norm(x) + [hot[i] for i in range(3)] + hyperbola(x[0])
    names = [f"masked{i}" for i in range(3)] + [f"norm{i}" for i in range(3)] + [f"hot{i}" for i in range(3)] + ["cosh", "sinh"]
    return rounded(parts.select("p_partkey", *[m.alias(n) for m, n in zip(maps, names)]), names)


def batch_norm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(encoders.batch_norm(trade_field(spark, folder), ["x0", "x1"]), ["x0", "x1"])


def mesh_conv(spark: SparkSession, folder: str) -> DataFrame:
    """Two kinds of relation on the trade graph: quantity and discount."""
    g = trade(spark, folder, True)
    kinds = g.edges.select("edge", (F.col("w") / 50).alias("k0"), (F.col("score") / 10).alias("k1"))
    return rounded(conv.mesh_conv(g, trade_field(spark, folder), ["x0", "x1"], kinds, ["k0", "k1"], ((1.0, 0.5),), (((0.2, 0.1),), ((-0.3, 0.4),))), ["o0"], 9)


def spatial_encoder(spark: SparkSession, folder: str) -> DataFrame:
    out = encoders.spatial(trade(spark, folder), trade_field(spark, folder), ["x0", "x1"], (((0.5, 0.2), (-0.1, 0.3), (0.4, -0.6)), (0.1, 0.0, -0.1)), ((0.2, 0.1), (0.3, -0.2), (0.1, 0.1)), 0.5)
    return rounded(out, ["o0", "o1", "o2"])


def linear_diffusion(spark: SparkSession, folder: str) -> DataFrame:
    g = trade(spark, folder)
    weighted = MeshGraph(g.nodes, conv.diffusion_weights(g, "w"))
    return rounded(encoders.linear_diffusion(weighted, trade_field(spark, folder), "x0", (0.5, 0.3, 0.2)), ["forecast"])


def patch_attention(spark: SparkSession, folder: str) -> DataFrame:
    """Two heads of attention among an order's lines."""
    nodes, _ = _orders(spark, folder)
    tokens = nodes.select("graph", "node", (F.col("quantity") / 50).alias("x0"), (F.col("label") / 3.0).alias("x1"), (F.col("status") == "F").alias("there"))
    maps = ((0.5, -0.2), (0.3, 0.4)), ((0.2, 0.6), (-0.5, 0.1)), ((1.0, 0.0), (0.0, 1.0))
    return rounded(encoders.attention(tokens, ["graph"], "node", ["x0", "x1"], *maps, heads=2), ["o0", "o1"])


def lstm_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of a memory of width 1 over the lines of each order."""
    nodes, _ = _orders(spark, folder)
    cell = LSTM(((0.5,), (0.3,), (0.8,), (0.2,)), ((0.1,), (-0.2,), (0.4,), (0.3,)), (0.0, 1.0, 0.1, -0.1))
    return rounded(cell.over(nodes.select("graph", "node", (F.col("quantity") / 50).alias("x")), ["graph"], "node", ["x"]), ["h0"])


def probe_logreg(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of a linear probe on eight components of vectors, fold 0 held out."""
    v = _vectors(spark, folder).join(stratified_folds(spark, folder).select("vec_id", "fold"), "vec_id")
    rows = written(v.select("fold", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)]))
    a, b = training.probe(rows.filter("fold <> 0").drop("fold"), rows.filter("fold = 0").drop("fold"), [f"x{i}" for i in range(8)], "label", 0.01, 50)
    return spark.createDataFrame([(float(a), float(b))], "train_accuracy double, test_accuracy double")


def probe_least_squares(spark: SparkSession, folder: str) -> DataFrame:
    """A linear fit of the line's price by quantity and discount, over all lines."""
    rows = table(spark, folder, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    w = training.least_squares(rows, ["q", "l_discount"], "y")
    return rounded(spark.createDataFrame([tuple(map(float, w))], "quantity double, discount double, bias double"), ["quantity", "discount", "bias"], 4)


def adam_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Training and validation error by step of a linear model fitted with Adam."""
    rows = table(spark, folder, "part").select((F.col("p_size") / 50).alias("x0"), (F.col("p_retailprice") / 1000).alias("y"), (F.col("p_partkey") % 5 == 0).alias("held"))
    rows = written(rows)
    _, history = training.fit(rows.filter("not held"), rows.filter("held"), ["x0"], "y", 3)
    return spark.createDataFrame([(i, *h) for i, h in enumerate(history)], "step int, loss double, rmse double")


# -- streams ------------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parq*")


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/loomgrid-stream-{uuid.uuid4().hex}"


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _hours(frame: DataFrame, *names: str) -> DataFrame:
    """Starts and ends as hours since 1970: the same in any time zone of the session."""
    return frame.select(*[F.expr(f"unix_seconds({c}) div 3600").alias(c) if c in names else F.col(c) for c in frame.columns])


def stream_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by six hours, from a stream."""
    counted = T.clock(_stamped(_stream(spark, folder, "events")), ["event_type"], "6 hours")
    return _hours(T.drained(counted, _scratch(spark), "complete"), "start", "end")


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Events by sliding windows of twelve hours, every six."""
    counted = T.clock(_stamped(_stream(spark, folder, "events")), ["event_type"], "12 hours", "6 hours")
    return _hours(T.drained(counted, _scratch(spark), "complete"), "start", "end")


def stream_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a stream before the tenth day, by type."""
    import datetime

    rows = T.prefix(_stream(spark, folder, "events"), datetime.datetime(2024, 1, 10)).select("event_id", "event_type")
    return T.drained(rows, _scratch(spark)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def _observations(frame: DataFrame) -> DataFrame:
    at = F.coalesce("move_timestamp", "stop_timestamp")
    rows = frame.select("service_date", "start_time", "trip_id", at.alias("generated_at"), F.col("stop_sequence").cast("long").alias("stop_sequence"), F.col("vehicle_id").isNull().alias("canceled"))
    return rows.filter("generated_at > 0 and start_time is not null and trip_id is not null")


def stream_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of keyed state over the stream of observed calls."""
    return T.drained(T.transitions(_observations(_stream(spark, folder, "replay"))), _scratch(spark))


def batch_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """The same findings from the table."""
    return T.pairwise(_observations(table(spark, folder, "replay")))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each user's events no more than two hours apart."""
    return T.sessions(_stamped(table(spark, folder, "events")), ["user_id"], "2 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_QUERIES = (
    cosine_top1, label_accuracy, stratified_folds, fold_metric, group_mean_pool, graph_offsets, graph_union_degrees, graph_summary, graph_patches, patch_overlap, patch_edges, feature_maps, batch_norm, mesh_conv,
    spatial_encoder, linear_diffusion, patch_attention, lstm_forecast, probe_logreg, probe_least_squares, adam_fit, stream_clock, stream_sliding, stream_prefix, stream_transitions, batch_transitions, event_sessions,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# -- SQL ----------------------------------------------------------------------------------------------------------------------

_LINES = """WITH l AS (SELECT l_orderkey AS graph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS node, list_position(['A', 'N', 'R'], l_returnflag) AS label, l_linestatus AS status, l_quantity AS quantity FROM lineitem),
e AS (SELECT graph, node AS edge, node - 1 AS source, node AS target FROM l WHERE node > 0)"""
_HASH = "CAST('0x' || substr(md5(concat_ws(':', {})), 1, 15) AS BIGINT)"
_FOLDS = f"f AS (SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(f'{SEED}, vec_id')}, vec_id) - 1) % {FOLDS} AS INT) AS fold FROM embeddings)"
_PATCHES = _LINES + f""", c AS (SELECT graph, node, CAST((row_number() OVER (PARTITION BY graph ORDER BY {_HASH.format(f'{SEED}, graph, node')}, node) - 1) % {PATCHES} AS INT) AS patch FROM l),
w AS (SELECT graph, source, target FROM e UNION ALL SELECT graph, target, source FROM e), p AS (SELECT graph, patch, node FROM c UNION SELECT c.graph, c.patch, w.target FROM c JOIN w ON w.graph = c.graph AND w.source = c.node)"""
_NEAR = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v),
t AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, q.label AS mine, c.label AS theirs, list_dot_product(q.x, c.x) / q.n / c.n AS cosine FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(cosine, 12) DESC, c.vec_id) = 1)"""
_SIX = "SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 6 AS h FROM events"
_OBS = """WITH o AS (SELECT service_date, start_time, trip_id, coalesce(move_timestamp, stop_timestamp) AS generated_at, CAST(stop_sequence AS BIGINT) AS s, vehicle_id IS NULL AS c FROM replay WHERE coalesce(move_timestamp, stop_timestamp) > 0 AND start_time IS NOT NULL AND trip_id IS NOT NULL),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS place, bool_or(c) OVER w AS ended FROM o WINDOW w AS (PARTITION BY service_date, start_time, trip_id ORDER BY generated_at, s NULLS LAST, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT service_date, start_time, trip_id, generated_at, 'ACTIVE_AFTER_TERMINAL' AS code, CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS now FROM b WHERE ended AND NOT c UNION ALL SELECT service_date, start_time, trip_id, generated_at, 'STOP_REGRESSED', place, s FROM b WHERE s < place"""


def _normed(columns: list[str], names: list[str], digits: int = 6) -> str:
    n = len(columns)
    mean = f"(({' + '.join(columns)}) / {n})"
    variance = f"(({' + '.join(f'({c} - {mean}) ** 2' for c in columns)}) / {n})"
    return ", ".join(f"round(({c} - {mean}) / sqrt({variance} + 1e-5), {digits}) AS {name}" for c, name in zip(columns, names))


def _tables() -> str:
    from loomgrid.queries.graphs import _TRADE

    return _TRADE


def _spatial_sql() -> str:
    rows = [("(x0 * 0.5::DOUBLE + x1 * 0.2::DOUBLE + 0.1::DOUBLE)", "(m0 * 0.2::DOUBLE + m1 * 0.1::DOUBLE)"), ("(x0 * -0.1::DOUBLE + x1 * 0.3::DOUBLE)", "(m0 * 0.3::DOUBLE + m1 * -0.2::DOUBLE)"), ("(x0 * 0.4::DOUBLE + x1 * -0.6::DOUBLE - 0.1::DOUBLE)", "(m0 * 0.1::DOUBLE + m1 * 0.1::DOUBLE)")]
    t = ", ".join(f"tanh({a} + 0.5::DOUBLE * {b}) AS t{i}" for i, (a, b) in enumerate(rows))
    return f"{_tables()}, m AS (SELECT n.node, any_value(n.x0) AS x0, any_value(n.x1) AS x1, coalesce(avg(k.x0), 0) AS m0, coalesce(avg(k.x1), 0) AS m1 FROM n LEFT JOIN e ON e.target = n.node LEFT JOIN n k ON k.node = e.source GROUP BY 1), t AS (SELECT node, {t} FROM m) SELECT node, {_normed(['t0', 't1', 't2'], ['o0', 'o1', 'o2'])} FROM t"


SQL = {
    "cosine_top1": f"{_NEAR} SELECT query, neighbour, round(cosine, 6) AS cosine FROM t",
    "label_accuracy": f"{_NEAR}, m AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT count(*) AS queries, round(avg(CASE WHEN mine = theirs THEN 1.0::DOUBLE ELSE 0 END), 6) AS nearest_accuracy, round(avg(CASE WHEN mine = (SELECT label FROM m) THEN 1.0::DOUBLE ELSE 0 END), 6) AS majority_accuracy FROM t",
    "stratified_folds": f"WITH {_FOLDS} SELECT * FROM f",
    "fold_metric": f"WITH {_FOLDS}, s AS (SELECT fold, max(n) / sum(n) AS share FROM (SELECT fold, label, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1) SELECT round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS deviation FROM s",
    "group_mean_pool": "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x0, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS x1 FROM embeddings GROUP BY 1 UNION ALL SELECT -1, 0, 0",
    "graph_offsets": "SELECT graph, size, CAST(sum(size) OVER (ORDER BY graph) AS BIGINT) - size AS offset FROM (SELECT l_orderkey AS graph, count(*) AS size FROM lineitem GROUP BY 1)",
    "graph_union_degrees": "SELECT CAST(0 AS BIGINT) AS degree, count(DISTINCT l_orderkey) AS nodes FROM lineitem UNION ALL SELECT 1, count(*) - count(DISTINCT l_orderkey) FROM lineitem HAVING count(*) > count(DISTINCT l_orderkey)",
    "graph_summary": f"{_LINES}, n AS (SELECT graph, {', '.join(f'avg(CASE WHEN label = {i} THEN 1.0::DOUBLE ELSE 0 END) AS n_{i}' for i in (1, 2, 3))} FROM l GROUP BY 1), k AS (SELECT graph, avg(CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS f FROM l WHERE node > 0 GROUP BY 1) SELECT graph, round(n_1, 6) AS n_1, round(n_2, 6) AS n_2, round(n_3, 6) AS n_3, round(coalesce(f, 0), 6) AS e_0, round(coalesce(1 - f, 0), 6) AS e_1 FROM n LEFT JOIN k USING (graph)",
    "graph_patches": f"{_PATCHES} SELECT * FROM p",
    "patch_overlap": f"{_PATCHES}, o AS (SELECT a.graph, a.patch, b.patch AS other, count(*) AS shared FROM p a JOIN p b ON b.graph = a.graph AND b.node = a.node AND b.patch > a.patch GROUP BY 1, 2, 3) SELECT patch, other, shared, count(*) AS graphs FROM o GROUP BY 1, 2, 3",
    "patch_edges": f"{_PATCHES} SELECT a.patch, count(*) AS edges FROM e JOIN p a ON a.graph = e.graph AND a.node = e.source JOIN p b ON b.graph = e.graph AND b.node = e.target AND b.patch = a.patch GROUP BY 1",
    "feature_maps": "SELECT p_partkey, " + ", ".join(f"round(CASE WHEN (p_partkey + {i + SEED}) % 3 = 0 THEN 0 ELSE x{i} END, 6) AS masked{i}" for i in range(3)) + ", " + _normed(["x0", "x1", "x2"], ["norm0", "norm1", "norm2"]) + ", " + ", ".join(f"CASE WHEN p_type = '{t}' THEN 1.0::DOUBLE ELSE 0 END AS hot{i}" for i, t in enumerate(("ECONOMY", "STANDARD", "PROMO"))) + ", round(cosh(x0), 6) AS cosh, round(sinh(x0), 6) AS sinh FROM (SELECT p_partkey, p_type, p_size / 50.0 AS x0, p_retailprice / 1000 AS x1, 1.0::DOUBLE AS x2 FROM part)",
    "batch_norm": f"{_tables()}, s AS (SELECT avg(x0) AS m0, avg(x1) AS m1, var_pop(x0) AS v0, var_pop(x1) AS v1 FROM n) SELECT node, round((x0 - m0) / sqrt(v0 + 1e-5), 6) AS x0, round((x1 - m1) / sqrt(v1 + 1e-5), 6) AS x1 FROM n, s",
    "mesh_conv": f"{_tables()}, s AS (SELECT target AS node, sum(w / 50 * (x0 * 0.2::DOUBLE + x1 * 0.1::DOUBLE) + score / 10 * (x0 * -0.3::DOUBLE + x1 * 0.4::DOUBLE)) AS y FROM e JOIN n ON n.node = e.source GROUP BY 1) SELECT node, round(x0 + x1 * 0.5::DOUBLE + coalesce(y, 0), 9) AS o0 FROM n LEFT JOIN s USING (node)",
    "spatial_encoder": _spatial_sql(),
    "linear_diffusion": f"""{_tables()}, d AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS f, w / sum(w) OVER (PARTITION BY target) AS r FROM e), fw AS (SELECT target AS node, sum(f * x0) AS y FROM d JOIN n ON n.node = d.source GROUP BY 1), rv AS (SELECT source AS node, sum(r * x0) AS z FROM d JOIN n ON n.node = d.target GROUP BY 1)
SELECT node, round(0.5::DOUBLE * x0 + 0.3::DOUBLE * coalesce(y, 0) + 0.2::DOUBLE * coalesce(z, 0), 6) AS forecast FROM n LEFT JOIN fw USING (node) LEFT JOIN rv USING (node)""",
    "patch_attention": f"""{_LINES}, x AS (SELECT graph, node, status = 'F' AS there, quantity / 50 AS a, label / 3.0 AS b FROM l),
s AS (SELECT q.graph, q.node, exp((q.a * 0.5::DOUBLE - q.b * 0.2::DOUBLE) * (k.a * 0.2::DOUBLE + k.b * 0.6::DOUBLE)) AS w0, exp((q.a * 0.3::DOUBLE + q.b * 0.4::DOUBLE) * (k.a * -0.5::DOUBLE + k.b * 0.1::DOUBLE)) AS w1, k.a, k.b FROM x q LEFT JOIN x k ON k.graph = q.graph AND k.there)
SELECT graph, node, round(coalesce(sum(w0 * a) / sum(w0), 0), 6) AS o0, round(coalesce(sum(w1 * b) / sum(w1), 0), 6) AS o1 FROM s GROUP BY 1, 2""",
    "probe_least_squares": """WITH d AS (SELECT l_quantity / 50 AS q, l_discount AS d, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(y) AS my, covar_pop(q, q) AS qq, covar_pop(d, d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy FROM d),
w AS (SELECT (qy * dd - dy * qd) / (qq * dd - qd * qd) AS a, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS b, mq, md, my FROM m) SELECT round(a, 4) AS quantity, round(b, 4) AS discount, round(my - a * mq - b * md, 4) AS bias FROM w""",
    "stream_clock": f'SELECT event_type, h AS start, h + 6 AS "end", count(*) AS n FROM ({_SIX}) GROUP BY 1, 2',
    "stream_sliding": f'SELECT event_type, s AS start, s + 12 AS "end", count(*) AS n FROM (SELECT event_type, unnest([h - 6, h]) AS s FROM ({_SIX})) GROUP BY 1, 2',
    "stream_prefix": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1",
    "stream_transitions": _OBS,
    "batch_transitions": _OBS,
    "event_sessions": "WITH m AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1",
}
