"""Convolutions: deterministic functions of a graph, a field and weights.

A field is a frame with node, lane columns and feature columns; results have the columns o0, o1, ... Neighbour sums run on whichever side of a projection is
narrower: sums commute with linear maps. Degrees, scales and attention are joined as fields and never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.dense import Matrix, leaky_relu, linear, project, relu
from loomgrid.graph.mesh import MeshGraph

Names = Sequence[str]


def named(columns: Sequence[Column], prefix: str = "o") -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def cols(names: Names) -> list[Column]:
    return [F.col(n) for n in names]


def _prefixed(frame: DataFrame, values: Names, lanes: Names, prefix: str) -> tuple[DataFrame, list[str]]:
    new = [f"{prefix}{i}" for i in range(len(values))]
    return frame.select(*lanes, "node", *[F.col(v).alias(n) for v, n in zip(values, new)]), new


def sage(graph: MeshGraph, field: DataFrame, values: Names, neighbour: Matrix, root: Matrix, bias: Sequence[float] | None = None, lanes: Names = ()) -> DataFrame:
    """W_n mean(in-neighbours) + b + W_r x. The bias is added after the mean: nodes without neighbours have it too."""
    means, ms = _prefixed(graph.mean(field, values, lanes), values, lanes, "_m")
    both = field.select(*lanes, "node", *values).join(means, [*lanes, "node"])
    return project(both, [*lanes, "node"], [([*ms, *values], [[*a, *b] for a, b in zip(neighbour, root)], bias, "o")])


def gine(graph: MeshGraph, field: DataFrame, values: Names, edge_field: DataFrame, edge_values: Names, edge: tuple[Matrix, Sequence[float]], hidden: tuple[Matrix, Sequence[float]], output: tuple[Matrix, Sequence[float]], eps: float = 0.0) -> DataFrame:
    """MLP((1 + eps) x + sum over incoming edges of relu(x_source + W e + b))."""
    es, es_names = edge_field.select("edge", *[F.col(v).alias(f"_e{i}") for i, v in enumerate(edge_values)]), [f"_e{i}" for i in range(len(edge_values))]
    gathered = graph.edge_values(field, values, "source").join(es, "edge")
    messages = gathered.select("edge", *[relu(F.col(v) + m).alias(v) for v, m in zip(values, linear(cols(es_names), *edge))])
    sums, ss = _prefixed(graph.sum_edges(messages, values), values, (), "_s")
    state = field.select("node", *values).join(sums, "node").select("node", *[((1.0 + eps) * F.col(v) + F.col(s)).alias(v) for v, s in zip(values, ss)])
    inner = state.select("node", *named([relu(c) for c in linear(cols(values), *hidden)], "_h"))
    return inner.select("node", *named(linear([F.col(f"_h{i}") for i in range(len(hidden[0]))], *output)))


def degree_scale(graph: MeshGraph) -> DataFrame:
    """(node, scale): the in-degree to the power -1/2, 0 for nodes without incoming edges."""
    return graph.in_degree().select("node", F.when(F.col("degree") > 0, F.lit(1.0) / F.sqrt(F.col("degree").cast("double"))).otherwise(0.0).alias("scale"))


def normalised_sum(graph: MeshGraph, field: DataFrame, values: Names, scale: DataFrame, lanes: Names = ()) -> DataFrame:
    """D^-1/2 A D^-1/2 x."""
    scaled = field.join(scale, "node").select(*lanes, "node", *[(F.col(v) * F.col("scale")).alias(v) for v in values])
    return graph.sum(scaled, values, lanes=lanes).join(scale, "node").select(*lanes, "node", *[(F.col(v) * F.col("scale")).alias(v) for v in values])


def gcn(graph: MeshGraph, field: DataFrame, values: Names, weight: Matrix, bias: Sequence[float] | None = None, lanes: Names = ()) -> DataFrame:
    """W (D^-1/2 A D^-1/2 x) + b over the edges given; loops are up to the caller. The projection comes first where it narrows the features."""
    scale = degree_scale(graph)
    if len(weight) < len(values):
        narrow = project(field, [*lanes, "node"], [(values, weight, None, "_p")])
        names = [f"_p{i}" for i in range(len(weight))]
        out = normalised_sum(graph, narrow, names, scale, lanes)
        return out.select(*lanes, "node", *named([F.col(n) + (bias[i] if bias is not None else 0.0) for i, n in enumerate(names)]))
    return project(normalised_sum(graph, field, values, scale, lanes), [*lanes, "node"], [(values, weight, bias, "o")])


def gat(graph: MeshGraph, field: DataFrame, values: Names, weight: Matrix, source_attention: Matrix, target_attention: Matrix, bias: Sequence[float] | None = None, slope: float = 0.2) -> DataFrame:
    """Additive attention: each head normalises its edges' scores over a target's incoming edges; heads are concatenated, the bias comes last.
    weight has heads * width rows; the attentions have a row of width numbers for each head."""
    heads, width = len(source_attention), len(source_attention[0])
    state = field.select("node", *named(linear(cols(values), weight), "_w"))
    score = lambda h, a: sum((F.col(f"_w{h * width + i}") * float(a[h][i]) for i in range(width)), F.lit(0.0))
    sources, targets = [f"_a{h}" for h in range(heads)], [f"_b{h}" for h in range(heads)]
    scored = state.select("node", *[f"_w{i}" for i in range(heads * width)], *[score(h, source_attention).alias(sources[h]) for h in range(heads)], *[score(h, target_attention).alias(targets[h]) for h in range(heads)])
    ends = graph.edges.select("edge", "source", "target").join(scored.select(F.col("node").alias("source"), *[f"_w{i}" for i in range(heads * width)], *sources), "source")
    ends = ends.join(scored.select(F.col("node").alias("target"), *targets), "target")
    edges = ends.select("target", *[f"_w{i}" for i in range(heads * width)], *[leaky_relu(F.col(s) + F.col(t), slope).alias(f"_s{h}") for h, (s, t) in enumerate(zip(sources, targets))])
    # the softmax of all heads at once: maxima by target, then weighted sums and totals in one aggregate
    top = edges.groupBy("target").agg(*[F.max(f"_s{h}").alias(f"_t{h}") for h in range(heads)])
    e = edges.join(top, "target")
    share = [F.exp(F.col(f"_s{h}") - F.col(f"_t{h}")) for h in range(heads)]
    sums = e.groupBy(F.col("target").alias("node")).agg(*[F.sum(share[h]).alias(f"_n{h}") for h in range(heads)], *[F.sum(share[i // width] * F.col(f"_w{i}")).alias(f"_y{i}") for i in range(heads * width)])
    rows = graph.nodes.select("node").join(sums, "node", "left")
    return rows.select("node", *named([F.coalesce(F.col(f"_y{i}") / F.col(f"_n{i // width}"), F.lit(0.0)) + (bias[i] if bias is not None else 0.0) for i in range(heads * width)]))


def chebyshev_basis(graph: MeshGraph, field: DataFrame, values: Names, order: int, lanes: Names = ()) -> tuple[DataFrame, list[str]]:
    """x, -Sx, and each next one twice -S of the one before less the one before that, S being the normalised sum. The graph has to be symmetric and without loops."""
    scale = degree_scale(graph)
    names = [[f"_c{k}_{i}" for i in range(len(values))] for k in range(order)]
    basis = field.select(*lanes, "node", *[F.col(v).alias(n) for v, n in zip(values, names[0])])
    for k in range(1, order):
        shifted = normalised_sum(graph, basis.select(*lanes, "node", *names[k - 1]), names[k - 1], scale, lanes)
        shifted = shifted.select(*lanes, "node", *[(-F.col(n)).alias(f"_n{i}") for i, n in enumerate(names[k - 1])])
        basis = basis.join(shifted, [*lanes, "node"])
        new = [F.col(f"_n{i}") if k == 1 else 2.0 * F.col(f"_n{i}") - F.col(names[k - 2][i]) for i in range(len(values))]
        basis = basis.select(*lanes, "node", *[n for ns in names[:k] for n in ns], *[c.alias(n) for c, n in zip(new, names[k])])
    return basis, [n for ns in names for n in ns]


def cheb(graph: MeshGraph, field: DataFrame, values: Names, weight: Matrix, bias: Sequence[float] | None, order: int, lanes: Names = (), checked: bool = True) -> DataFrame:
    if checked:
        graph.require_symmetric()
    basis, names = chebyshev_basis(graph, field, values, order, lanes)
    return project(basis, [*lanes, "node"], [(names, weight, bias, "o")])


def mesh_conv(graph: MeshGraph, field: DataFrame, values: Names, relations: DataFrame, kinds: Names, root: Matrix, weights: Sequence[Matrix]) -> DataFrame:
    """W_r x + sum over incoming edges and kinds of r_{e,k} W_k x_source: relations has edge and a column for each kind of relation."""
    sent = graph.edges.select("edge", "source", "target").join(relations.select("edge", *kinds), "edge").join(field.select(F.col("node").alias("source"), *values), "source")
    # one weighted sum of the features for each kind; the projections follow on the nodes
    names = [f"_r{k}_{i}" for k in range(len(kinds)) for i in range(len(values))]
    sent = sent.select(F.col("target").alias("node"), *[(F.col(kind) * F.col(v)).alias(f"_r{k}_{i}") for k, kind in enumerate(kinds) for i, v in enumerate(values)])
    rows = sent.unionByName(graph.nodes.select("node", *[F.lit(0.0).alias(n) for n in names])).groupBy("node").agg(*[F.sum(n).alias(n) for n in names])
    flat = [[w for matrix in weights for w in matrix[o]] for o in range(len(root))]
    return rows.join(field.select("node", *values), "node").select("node", *named([a + b for a, b in zip(linear(cols(values), root), linear(cols(names), flat))]))


def diffusion_weights(graph: MeshGraph, affinity: str) -> DataFrame:
    """Edges with forward (affinity by the sum of the source's outgoing ones) and reverse (by the sum of the target's incoming ones). They depend on the topology
    only: write them once where several steps use them."""
    a = F.col(affinity).cast("double")
    out = graph.edges.groupBy("source").agg(F.sum(a).alias("_out"))
    into = graph.edges.groupBy("target").agg(F.sum(a).alias("_in"))
    return graph.edges.select("edge", "source", "target", affinity).join(out, "source").join(into, "target").select("edge", "source", "target", (a / F.col("_out")).alias("forward"), (a / F.col("_in")).alias("reverse"))


def diffusion(weighted: MeshGraph, field: DataFrame, values: Names, lanes: Names = ()) -> DataFrame:
    """Forward sums f0, f1, ... and reverse sums r0, r1, ... of a graph with diffusion weights, in one aggregate: each edge sends to both ends."""
    fs, rs = [f"f{i}" for i in range(len(values))], [f"r{i}" for i in range(len(values))]
    zero = [F.lit(0.0)] * len(values)
    ends = F.explode(F.array(F.struct(F.col("source").alias("at"), F.col("target").alias("node"), F.col("forward").alias("f"), F.lit(0.0).alias("r")), F.struct(F.col("target").alias("at"), F.col("source").alias("node"), F.lit(0.0).alias("f"), F.col("reverse").alias("r"))))
    ways = weighted.edges.select(ends.alias("e")).select("e.*")
    sent = ways.join(field.select(*lanes, F.col("node").alias("at"), *values), "at").select(*lanes, "node", *[(F.col("f") * F.col(v)).alias(n) for v, n in zip(values, fs)], *[(F.col("r") * F.col(v)).alias(n) for v, n in zip(values, rs)])
    rest = (field if lanes else weighted.nodes).select(*lanes, "node", *[z.alias(n) for z, n in zip(zero + zero, fs + rs)])
    return sent.unionByName(rest).groupBy(*lanes, "node").agg(*[F.sum(n).alias(n) for n in fs + rs])
