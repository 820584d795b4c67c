"""Recurrent cells over a graph: one step is a plan, a fold over time cuts the lineage after each few steps.

The state of a step is a frame with lanes, node and h0, h1, ... All lanes (windows of a batch) go through one plan. In every cell u * h + (1 - u) * c is the new state: the update
gate keeps the old one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.dense import Matrix, linear, project, sigmoid, softmax_weights
from loomgrid.graph.mesh import MeshGraph
from loomgrid.layers.conv import chebyshev_basis, cols, diffusion, gcn
from loomgrid.session import cut

Names = Sequence[str]
Affine = tuple[Matrix, Sequence[float]]


def _h(n: int) -> list[str]:
    return [f"h{i}" for i in range(n)]


def initial(field: DataFrame, hidden: int, lanes: Names = ()) -> DataFrame:
    return field.select(*lanes, "node", *[F.lit(0.0).alias(h) for h in _h(hidden)])


def _gated(update: Sequence[Column], candidate: Sequence[Column], hidden: int) -> list[Column]:
    return [(u * F.col(h) + (F.lit(1.0) - u) * c).alias(h) for u, c, h in zip(update, candidate, _h(hidden))]


@dataclass(frozen=True)
class TGCN:
    """One shared graph convolution to three times the state's width feeds the update, reset and candidate maps."""

    graph: MeshGraph
    projection: Matrix  # (3 * hidden, features)
    update: Affine  # (hidden, 2 * hidden)
    reset: Affine
    candidate: Affine

    def step(self, field: DataFrame, values: Names, state: DataFrame, lanes: Names = ()) -> DataFrame:
        n, keys = len(self.update[0]), [*lanes, "node"]
        spread = gcn(self.graph, field, values, self.projection, None, lanes).join(state, keys)
        part = lambda k: [f"o{k * n + i}" for i in range(n)]
        gates = project(spread, [*keys, *part(2), *_h(n)], [([*part(0), *_h(n)], *self.update, "_u"), ([*part(1), *_h(n)], *self.reset, "_r")])
        mixed = gates.select(*keys, *part(2), *_h(n), *[sigmoid(F.col(f"_u{i}")).alias(f"_u{i}") for i in range(n)], *[(F.col(h) * sigmoid(F.col(f"_r{i}"))).alias(f"_m{i}") for i, h in enumerate(_h(n))])
        new = project(mixed, [*keys, *_h(n), *[f"_u{i}" for i in range(n)]], [([*part(2), *[f"_m{i}" for i in range(n)]], *self.candidate, "_k")])
        return new.select(*keys, *_gated([F.col(f"_u{i}") for i in range(n)], [F.tanh(f"_k{i}") for i in range(n)], n))


@dataclass(frozen=True)
class GConvGRU:
    """Gates and candidate are Chebyshev convolutions of features and state; both gates come from one basis."""

    graph: MeshGraph
    gates: Affine  # (2 * hidden, order * (features + hidden))
    candidate: Affine  # (hidden, order * (features + hidden))
    order: int

    def step(self, field: DataFrame, values: Names, state: DataFrame, lanes: Names = ()) -> DataFrame:
        n = len(self.candidate[0])
        both = field.select(*lanes, "node", *values).join(state, [*lanes, "node"])
        basis, names = chebyshev_basis(self.graph, both, [*values, *_h(n)], self.order, lanes)
        gates = [sigmoid(c).alias(f"_g{i}") for i, c in enumerate(linear(cols(names), *self.gates))]
        known = both.join(basis.select(*lanes, "node", *gates), [*lanes, "node"])
        mixed = known.select(*lanes, "node", *values, *[(F.col(h) * F.col(f"_g{n + i}")).alias(f"_m{i}") for i, h in enumerate(_h(n))])
        second, names = chebyshev_basis(self.graph, mixed, [*values, *[f"_m{i}" for i in range(n)]], self.order, lanes)
        new = second.select(*lanes, "node", *[F.tanh(c).alias(f"_k{i}") for i, c in enumerate(linear(cols(names), *self.candidate))])
        return known.join(new, [*lanes, "node"]).select(*lanes, "node", *_gated([F.col(f"_g{i}") for i in range(n)], [F.col(f"_k{i}") for i in range(n)], n))


@dataclass(frozen=True)
class DiffusionGRU:
    """Gates and candidate are linear in features and state, their forward and their reverse diffusion. The graph bears diffusion weights."""

    graph: MeshGraph
    gates: Affine  # (2 * hidden, 3 * (features + hidden))
    candidate: Affine  # (hidden, 3 * (features + hidden))

    def _basis(self, frame: DataFrame, values: Names, lanes: Names) -> tuple[DataFrame, list[str]]:
        spread = diffusion(self.graph, frame, values, lanes)
        return frame.join(spread, [*lanes, "node"]), [*values, *[f"f{i}" for i in range(len(values))], *[f"r{i}" for i in range(len(values))]]

    def step(self, field: DataFrame, values: Names, state: DataFrame, lanes: Names = ()) -> DataFrame:
        n = len(self.candidate[0])
        both = field.select(*lanes, "node", *values).join(state, [*lanes, "node"])
        basis, names = self._basis(both, [*values, *_h(n)], lanes)
        known = basis.select(*lanes, "node", *values, *_h(n), *[sigmoid(c).alias(f"_g{i}") for i, c in enumerate(linear(cols(names), *self.gates))])
        mixed = known.select(*lanes, "node", *values, *[(F.col(h) * F.col(f"_g{n + i}")).alias(f"_m{i}") for i, h in enumerate(_h(n))])
        second, names = self._basis(mixed, [*values, *[f"_m{i}" for i in range(n)]], lanes)
        new = second.select(*lanes, "node", *[F.tanh(c).alias(f"_k{i}") for i, c in enumerate(linear(cols(names), *self.candidate))])
        return known.join(new, [*lanes, "node"]).select(*lanes, "node", *_gated([F.col(f"_g{i}") for i in range(n)], [F.col(f"_k{i}") for i in range(n)], n))


def period_attention(states: Sequence[DataFrame], weights: Sequence[float], values: Names, lanes: Names = ()) -> DataFrame:
    """The mixture of same-shaped states by the softmax of the weights: one aggregate over their union."""
    if len(states) != len(weights) or not states:
        raise ValueError("as many states as weights, at least one")
    parts = [s.select(*lanes, "node", *[(F.col(v) * p).alias(v) for v in values]) for s, p in zip(states, softmax_weights(weights))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*lanes, "node").agg(*[F.sum(v).alias(v) for v in values])


def a3tgcn(cell: TGCN, fields: Sequence[DataFrame], values: Names, weights: Sequence[float], state: DataFrame | None = None, lanes: Names = ()) -> DataFrame:
    """Each period goes through the cell from the same state; attention mixes the results."""
    n = len(cell.update[0])
    return period_attention([cell.step(f, values, state if state is not None else initial(f, n, lanes), lanes) for f in fields], weights, _h(n), lanes)


def fold(step: Callable[[DataFrame, DataFrame], DataFrame], fields: Sequence[DataFrame], state: DataFrame, every: int = 2) -> DataFrame:
    """The state after all steps; the lineage is cut through the checkpoint folder after so many."""
    for i, field in enumerate(fields):
        state = step(field, state)
        if (i + 1) % every == 0 and i + 1 < len(fields):
            state = cut(state)
    return state


def readout(state: DataFrame, weight: Matrix, bias: Sequence[float] | None, hidden: int, lanes: Names = ()) -> DataFrame:
    """A linear forecast y0, y1, ... of the last state."""
    return state.select(*lanes, "node", *[c.alias(f"y{i}") for i, c in enumerate(linear(cols(_h(hidden)), weight, bias))])


@dataclass(frozen=True)
class LSTM:
    """A node's own memory: no graph. Gate rows are in the order input, forget, cell, output."""

    inputs: Matrix  # (4 * hidden, features)
    states: Matrix  # (4 * hidden, hidden)
    bias: Sequence[float]

    def over(self, series: DataFrame, by: Names, order: str, values: Names) -> DataFrame:
        """The last state of each series. A series is one row of the list of its steps, folded inside the JVM: its length is that of the history."""
        n = len(self.states[0])
        steps = series.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *values))).alias("_steps"))
        zero = F.struct(F.array(*[F.lit(0.0)] * n).alias("h"), F.array(*[F.lit(0.0)] * n).alias("c"))

        def step(a: Column, x: Column) -> Column:
            xs, hs = [x[v].cast("double") for v in values], [a["h"][i] for i in range(n)]
            z = [p + q for p, q in zip(linear(xs, self.inputs, self.bias), linear(hs, self.states))]
            i, f, g, o = (z[k * n : (k + 1) * n] for k in range(4))
            c = [sigmoid(f[k]) * a["c"][k] + sigmoid(i[k]) * F.tanh(g[k]) for k in range(n)]
            return F.struct(F.array(*[sigmoid(o[k]) * F.tanh(c[k]) for k in range(n)]).alias("h"), F.array(*c).alias("c"))

        last = steps.select(*by, F.aggregate("_steps", zero, step).alias("_s"))
        return last.select(*by, *[F.col("_s.h")[i].alias(f"h{i}") for i in range(n)])
