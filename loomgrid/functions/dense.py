"""Dense maths on columns: a node's features are a list of columns, weights are lists of numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.session import ship

Matrix = Sequence[Sequence[float]]


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def linear(columns: Sequence[Column], weight: Matrix, bias: Sequence[float] | None = None) -> list[Column]:
    """One column per row of the weight."""
    return [dot(columns, row) + (F.lit(float(bias[i])) if bias is not None else F.lit(0.0)) for i, row in enumerate(weight)]


#: Weights up to which a map is written as column expressions; larger ones are matrix products on Arrow batches.
NARROW = 256


def project(frame: DataFrame, keep: Sequence[str], maps: Sequence[tuple[Sequence[str], Matrix, Sequence[float] | None, str]]) -> DataFrame:
    """The kept columns and, for each map (inputs, weight, bias, prefix), its results as prefix0, prefix1, ... The shape of the weights decides how: column expressions
    compile for a few features, and would not for hundreds. Null inputs count as 0 in a product on batches."""
    if sum(len(w) * len(i) for i, w, _, _ in maps) <= NARROW:
        return frame.select(*keep, *[c.alias(f"{p}{k}") for i, w, b, p in maps for k, c in enumerate(linear([F.col(n) for n in i], w, b))])
    ship(frame.sparkSession)
    names = list(dict.fromkeys(n for i, _, _, _ in maps for n in i))
    arrays = [([names.index(n) for n in i], np.asarray(w, float).T, np.zeros(len(w)) if b is None else np.asarray(b, float)) for i, w, b, _ in maps]
    outs = [f"{p}{k}" for _, w, _, p in maps for k in range(len(w))]
    rows = frame.select(*keep, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_in{k}") for k, n in enumerate(names)])
    kept = len(keep)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(kept + k).to_numpy(zero_copy_only=False) for k in range(len(names))]) if b.num_rows else np.zeros((0, len(names)))
            y = np.concatenate([x[:, at] @ w + bias for at, w, bias in arrays], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *[pa.array(np.ascontiguousarray(y[:, j])) for j in range(y.shape[1])]], names=[*b.schema.names[:kept], *outs])

    return rows.mapInArrow(products, T.StructType([*rows.schema.fields[:kept], *[T.StructField(o, T.DoubleType()) for o in outs]]))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hyperbola(x: Column) -> list[Column]:
    """The point of the unit hyperbola at an angle."""
    return [F.cosh(x), F.sinh(x)]


def masked(columns: Sequence[Column], node: Column, every: int, seed: int = 0) -> list[Column]:
    """Features with those where (node + index + seed) is a multiple of `every` set to 0."""
    return [F.when(F.pmod(node + F.lit(i + seed), F.lit(every)) == 0, F.lit(0.0)).otherwise(c) for i, c in enumerate(columns)]


def layer_norm(columns: Sequence[Column], scale: Sequence[float] | None = None, shift: Sequence[float] | None = None, eps: float = 1e-5) -> list[Column]:
    """Features of a row less their mean, by their population deviation."""
    n = len(columns)
    mean = sum(columns[1:], columns[0]) / n
    variance = sum([(c - mean) * (c - mean) for c in columns[1:]], (columns[0] - mean) * (columns[0] - mean)) / n
    out = [(c - mean) / F.sqrt(variance + eps) for c in columns]
    return [o * (scale[i] if scale else 1.0) + (shift[i] if shift else 0.0) for i, o in enumerate(out)]


def softmax_weights(weights: Sequence[float]) -> list[float]:
    top = max(weights)
    e = [math.exp(w - top) for w in weights]
    return [x / sum(e) for x in e]
