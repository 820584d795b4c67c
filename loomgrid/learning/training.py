"""Training on distributed rows: gradients are sums over rows, made by aggregates; weights are small and stay with the driver.

Gradients of graph layers come from the adjoints of their aggregations. ``fit`` is a loop of such sums with Adam, the best weights by validation, a rate that falls on plateaus and an
early stop. ``probe`` standardises on training rows and fits a classifier with the library's own solver.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.dense import linear
from loomgrid.functions.single import with_row
from loomgrid.graph.mesh import MeshGraph


def fingerprint(weights: dict[str, np.ndarray]) -> str:
    """A hash of weights: equal before and after a stage that has to leave them alone."""
    plain = {k: np.asarray(v, float).tolist() for k, v in weights.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def moving_average(target: dict[str, np.ndarray], online: dict[str, np.ndarray], keep: float) -> dict[str, np.ndarray]:
    """The target encoder's weights drawn to the online one's; no gradient goes through them."""
    return {k: keep * target[k] + (1 - keep) * online[k] for k in target}


@dataclass
class Adam:
    rate: float = 1e-3
    decay: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    step: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def update(self, weights: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.step += 1
        a, b = self.decay
        out = {}
        for k, w in weights.items():
            g = gradient[k]
            self.first[k] = a * self.first.get(k, np.zeros_like(g)) + (1 - a) * g
            self.second[k] = b * self.second.get(k, np.zeros_like(g)) + (1 - b) * g * g
            m, v = self.first[k] / (1 - a**self.step), self.second[k] / (1 - b**self.step)
            out[k] = w - self.rate * m / (np.sqrt(v) + self.eps)
        return out


@dataclass
class Plateau:
    """Halves the rate after `patience` rounds without a better score and stops below `least`."""

    patience: int = 10
    factor: float = 0.5
    least: float = 1e-5
    best: float = math.inf
    waited: int = 0

    def next(self, score: float, rate: float) -> tuple[float, bool]:
        """(rate, whether to stop)."""
        if score < self.best:
            self.best, self.waited = score, 0
            return rate, False
        self.waited += 1
        if self.waited >= self.patience:
            self.waited, rate = 0, rate * self.factor
        return rate, rate < self.least


def linear_gradient(rows: DataFrame, x: Sequence[str], y: str, weights: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float, int]:
    """(gradient, loss, rows) of the mean squared error of w x + b: one aggregate of products."""
    error = linear([F.col(c) for c in x], [weights["w"].tolist()], [float(weights["b"][0])])[0] - F.col(y)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("l"), F.sum(error).alias("b"), *[F.sum(error * F.col(c)).alias(f"g{i}") for i, c in enumerate(x)]).first()
    n = max(r["n"], 1)
    return {"w": np.array([2 * (r[f"g{i}"] or 0.0) / n for i in range(len(x))]), "b": np.array([2 * (r["b"] or 0.0) / n])}, (r["l"] or 0.0) / n, r["n"]


def fit(train: DataFrame, validation: DataFrame, x: Sequence[str], y: str, steps: int, rate: float = 0.05, plateau: Plateau | None = None) -> tuple[dict[str, np.ndarray], list[tuple[float, float]]]:
    """(weights with the least validation RMSE, (training loss, validation RMSE) by step). Both splits should be written tables: every step reads them."""
    weights = {"w": np.zeros(len(x)), "b": np.zeros(1)}
    adam, history, best = Adam(rate), [], (math.inf, weights)
    for _ in range(steps):
        gradient, loss, _ = linear_gradient(train, x, y, weights)
        weights = adam.update(weights, gradient)
        rmse = math.sqrt(linear_gradient(validation, x, y, weights)[1])
        history.append((loss, rmse))
        if rmse < best[0]:
            best = (rmse, {k: v.copy() for k, v in weights.items()})
        if plateau:
            adam.rate, stop = plateau.next(rmse, adam.rate)
            if stop:
                break
    return best[1], history


def sage_step(graph: MeshGraph, values: DataFrame, target: DataFrame, weight: float, rate: float) -> tuple[float, float, float]:
    """(loss, gradient, new weight) of one step of a mean convolution with one weight: loss is the mean squared error over the nodes that have a target (node, y)."""
    means = graph.mean(values, ["x"]).withColumnRenamed("x", "m")
    rows = means.join(target, "node")
    error = F.lit(weight) * F.col("m") - F.col("y")
    r = rows.agg(F.avg(error * error).alias("l"), F.avg(2 * error * F.col("m")).alias("g")).first()
    return r["l"], r["g"], weight - rate * r["g"]


def standardised(train: DataFrame, rows: DataFrame, columns: Sequence[str], sample: bool = True) -> DataFrame:
    """Columns of rows less the training mean, by the training deviation (1 where that is tiny): statistics are one row."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    stats = train.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[deviation(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    joined = with_row(rows, stats)
    scale = lambda i: F.when(F.col(f"_s{i}") > 1e-6, F.col(f"_s{i}")).otherwise(1.0)
    others = [c for c in rows.columns if c not in columns]
    return joined.select(*others, *[((F.col(c) - F.col(f"_m{i}")) / scale(i)).alias(c) for i, c in enumerate(columns)])


def probe(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str, strength: float = 0.0, rounds: int = 100) -> tuple[float, float]:
    """(train accuracy, test accuracy) of a softmax regression on standardised columns."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    together = VectorAssembler(inputCols=list(columns), outputCol="features")
    as_rows = lambda f: together.transform(standardised(train, f, columns)).select("features", F.col(label).cast("double").alias("label"))
    a, b = as_rows(train), as_rows(test)
    model = LogisticRegression(maxIter=rounds, regParam=strength, family="multinomial").fit(a)
    right = lambda f: model.transform(f).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return right(a), right(b)


def least_squares(rows: DataFrame, x: Sequence[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Weights and, last, the bias of a linear fit, from the normal equations: one aggregate of products, solved on the driver."""
    names = [F.col(c).cast("double") for c in x] + [F.lit(1.0)]
    n = len(names)
    sums = [F.sum(names[i] * names[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(names[i] * F.col(y)).alias(f"b{i}") for i in range(n)]
    r = rows.agg(*sums).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge * np.diag([1.0] * (n - 1) + [0.0])
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(n)]), rcond=None)[0]


def latent_loss(predicted: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(loss): the mean squared distance of predicted and target embeddings."""
    other = target.select(*keys, *[F.col(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    error = sum(((F.col(c) - F.col(f"_t{i}")) * (F.col(c) - F.col(f"_t{i}")) for i, c in enumerate(columns)), F.lit(0.0))
    return predicted.join(other, list(keys)).agg((F.sum(error) / (F.count(F.lit(1)) * len(columns))).alias("loss"))


def fold_metric(scores: DataFrame, value: str) -> DataFrame:
    """(mean, deviation) over folds, the deviation that of a population."""
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def residual(rows: DataFrame, forecast: Column, anchor: str) -> DataFrame:
    """The forecast of what a persistence anchor leaves, with the anchor added back."""
    return rows.withColumn("forecast", forecast + F.col(anchor))
