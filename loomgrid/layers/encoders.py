"""Encoders of windows and of small graphs, made of convolutions and attention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.dense import Matrix, layer_norm, linear
from loomgrid.functions.single import with_row
from loomgrid.graph.mesh import MeshGraph
from loomgrid.layers.conv import cols, diffusion

Names = Sequence[str]


def spatial(graph: MeshGraph, field: DataFrame, values: Names, root: tuple[Matrix, Sequence[float]], neighbour: Matrix, gate: float, lanes: Names = ()) -> DataFrame:
    """layernorm(tanh(W x + b + gate * V mean(in-neighbours))), as o0, o1, ..."""
    means = graph.mean(field, values, lanes).select(*lanes, "node", *[F.col(v).alias(f"_m{i}") for i, v in enumerate(values)])
    both = field.select(*lanes, "node", *values).join(means, [*lanes, "node"])
    near = linear([F.col(f"_m{i}") for i in range(len(values))], neighbour)
    mixed = both.select(*lanes, "node", *[F.tanh(a + gate * b).alias(f"_t{i}") for i, (a, b) in enumerate(zip(linear(cols(values), *root), near))])
    return mixed.select(*lanes, "node", *[c.alias(f"o{i}") for i, c in enumerate(layer_norm([F.col(f"_t{i}") for i in range(len(root[0]))]))])


def batch_norm(field: DataFrame, values: Names, eps: float = 1e-5) -> DataFrame:
    """Features less their mean over all rows, by their population deviation: statistics are one row."""
    stats = field.agg(*[F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)], *[F.var_pop(v).alias(f"_v{i}") for i, v in enumerate(values)])
    joined = with_row(field, stats)
    others = [c for c in field.columns if c not in values]
    return joined.select(*others, *[((F.col(v) - F.col(f"_m{i}")) / F.sqrt(F.col(f"_v{i}") + eps)).alias(v) for i, v in enumerate(values)])


def linear_diffusion(weighted: MeshGraph, field: DataFrame, value: str, weights: tuple[float, float, float], lanes: Names = ()) -> DataFrame:
    """A forecast from a value, its forward and its reverse diffusion: three weights, no bias."""
    spread = diffusion(weighted, field.select(*lanes, "node", value), [value], lanes)
    return field.join(spread, [*lanes, "node"]).select(*lanes, "node", (weights[0] * F.col(value) + weights[1] * F.col("f0") + weights[2] * F.col("r0")).alias("forecast"))


def local_diffusion(own: DataFrame, spread: DataFrame, hidden: int, out: tuple[Sequence[float], float], gated: tuple[Sequence[float], float], gate: float, lanes: Names = ()) -> DataFrame:
    """The readout of a node's own memory (h0, ...) and, through a tanh gate, that of a memory of what diffusion adds to it."""
    h, s = [f"h{i}" for i in range(hidden)], [f"_s{i}" for i in range(hidden)]
    both = own.select(*lanes, "node", *h).join(spread.select(*lanes, "node", *[F.col(a).alias(b) for a, b in zip(h, s)]), [*lanes, "node"])
    read = lambda names, w: linear(cols(names), [w[0]], [w[1]])[0]
    return both.select(*lanes, "node", (read(h, out) + F.tanh(F.lit(gate)) * read(s, gated)).alias("forecast"))


def _scored(at: range, per: int, scaled: bool) -> Column:
    """A head's scores of the tokens that are there, with their values."""

    def one(o: Column) -> Column:
        s = sum((F.col("q")[i] * o["k"][i] for i in at), F.lit(0.0)) / (per**0.5)
        s = s * F.coalesce(F.try_element_at("_f", o["p"]), F.lit(0.0)) if scaled else s
        return F.struct(s.alias("s"), F.array(*[o["v"][i] for i in at]).alias("v"))

    return F.transform(F.filter("_others", lambda o: o["there"]), one)


def _mixed(scored: str, per: int) -> list[Column]:
    """Values mixed by the softmax of their scores; 0 where no token is there."""
    top = F.array_max(F.transform(scored, lambda x: x["s"]))
    total = F.aggregate(scored, F.lit(0.0), lambda a, x: a + F.exp(x["s"] - top))

    def part(j: int) -> Column:
        return F.aggregate(scored, F.lit(0.0), lambda a, x: a + F.exp(x["s"] - top) * x["v"][j])

    return [F.coalesce(part(j) / F.nullif(total, F.lit(0.0)), F.lit(0.0)) for j in range(per)]


def attention(tokens: DataFrame, by: Names, place: str, values: Names, query: Matrix, key: Matrix, value: Matrix, heads: int, multiplier: DataFrame | None = None) -> DataFrame:
    """Scaled dot-product attention among the tokens of a group (a graph's patches: a parameter bounds their number). tokens: by..., place, values, and `there` (false masks a token).
    multiplier (by..., place, other, factor) scales scores. A group's tokens are one list, and each looks at its own group's list inside the JVM. Results are o0, o1, ..."""
    width, per = len(query), len(query) // heads
    maps = tokens.select(*by, place, "there", F.array(*linear(cols(values), query)).alias("q"), F.array(*linear(cols(values), key)).alias("k"), F.array(*linear(cols(values), value)).alias("v"))
    lists = maps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), "there", "k", "v"))).alias("_others"))
    seen = maps.join(lists, list(by))
    if multiplier is not None:
        factors = multiplier.groupBy(*by, place).agg(F.map_from_entries(F.collect_list(F.struct("other", "factor"))).alias("_f"))
        seen = seen.join(factors, [*by, place], "left")
    out = []
    for h in range(heads):
        seen = seen.withColumn(f"_h{h}", _scored(range(h * per, (h + 1) * per), per, multiplier is not None))
        out += _mixed(f"_h{h}", per)
    return seen.select(*by, place, *[c.alias(f"o{i}") for i, c in enumerate(out[:width])])
