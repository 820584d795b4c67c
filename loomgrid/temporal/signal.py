"""Regular series of nodes as long frames (node, t, values) and the windows cut from them.

Shifts, lags and windows are made by spreading each value over the few rows that use it and one aggregate by (node, t): no window function holds a whole series, a node with a
third of all rows is reduced where its rows lie, and a row's group has as many values as the window is long.

Defined cases: t counts from 0 without gaps (``dense`` fills them). Windows that would reach over either end are left out. A node without rows has no windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.graph.mesh import MeshGraph

Names = Sequence[str]


def dense(rows: DataFrame, steps: int, values: Names) -> DataFrame:
    """Every node at every step from 0 to steps - 1; values of absent rows are 0. rows: one per node and step."""
    grid = rows.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t"))
    every = rows.select("node", "t", *[F.col(v).cast("double").alias(v) for v in values]).unionByName(grid.select("node", "t", *[F.lit(0.0).alias(v) for v in values]))
    return every.groupBy("node", "t").agg(*[F.sum(v).alias(v) for v in values])


def spread(series: DataFrame, value: str, offsets: Sequence[int], names: Names, first: int, last: int) -> DataFrame:
    """(node, t, names...): at t, the value at t + offset under each name, for t from first to last where all of them exist."""
    ks = F.explode(F.array(*[F.lit(o) for o in offsets]))
    moved = series.select("node", F.col("t").alias("_t"), F.col(value).alias("_v"), ks.alias("_k")).select("node", (F.col("_t") - F.col("_k")).alias("t"), "_k", "_v")
    moved = moved.filter(F.col("t").between(first, last))
    out = moved.groupBy("node", "t").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("_k") == o, F.col("_v"))).alias(n) for o, n in zip(offsets, names)])
    return out.filter(F.col("_n") == len(offsets)).drop("_n")


def lag_features(series: DataFrame, value: str, lags: int, steps: int, target: str | None = None) -> DataFrame:
    """(node, t, x0, ..., y): the values at t to t + lags - 1 and the target at t + lags."""
    names = [f"x{i}" for i in range(lags)]
    if target is None or target == value:
        return spread(series, value, range(lags + 1), [*names, "y"], 0, steps - lags - 1)
    xs = spread(series, value, range(lags), names, 0, steps - lags - 1)
    return xs.join(series.select("node", (F.col("t") - lags).alias("t"), F.col(target).alias("y")), ["node", "t"])


def sliding_windows(series: DataFrame, value: str, target: str, history: int, steps: int) -> DataFrame:
    """(node, start, x0, ..., y): windows of `history` steps and the target at the last of them."""
    if history <= 0 or history > steps:
        raise ValueError("history must be from 1 to the number of steps")
    xs = spread(series, value, range(history), [f"x{i}" for i in range(history)], 0, steps - history)
    return xs.join(series.select("node", (F.col("t") - (history - 1)).alias("t"), F.col(target).alias("y")), ["node", "t"]).withColumnRenamed("t", "start")


@dataclass(frozen=True)
class Span:
    """Targets from `first` to `stop` - 1: windows start where the whole horizon lies inside; their history may reach back before it."""

    name: str
    first: int
    stop: int
    history: int
    horizon: int

    @property
    def windows(self) -> int:
        return self.stop - self.horizon - self.first + 1

    @property
    def last(self) -> int:
        return self.stop - self.horizon


def split_spans(steps: int, history: int, horizon: int) -> list[Span]:
    """70, 10 and 20 % of the steps, in order."""
    train, validation = int(0.7 * steps), int(0.8 * steps)
    spans = [Span("train", history, train, history, horizon), Span("validation", train, validation, history, horizon), Span("test", validation, steps, history, horizon)]
    if any(s.windows <= 0 for s in spans):
        raise ValueError("the series is too short for windows in every split")
    return spans


def horizon_windows(series: DataFrame, value: str, spans: Sequence[Span]) -> DataFrame:
    """(split, node, start, h0, ..., f0, ...): history before the start, horizon from it."""
    out = None
    for s in spans:
        names = [f"h{i}" for i in range(s.history)] + [f"f{i}" for i in range(s.horizon)]
        rows = spread(series, value, range(-s.history, s.horizon), names, s.first, s.last)
        rows = rows.select(F.lit(s.name).alias("split"), "node", F.col("t").alias("start"), *names)
        out = rows if out is None else out.unionByName(rows)
    return out


def in_split(series: DataFrame, steps: int, context: int = 0) -> DataFrame:
    """Adds the split of each row; with context, later splits also have that many rows before their first (as history, not as targets)."""
    train, validation = int(0.7 * steps), int(0.8 * steps)
    if not 0 < train < validation < steps:
        raise ValueError("every split needs rows")
    t = F.col("t")
    names = F.array_compact(F.array(F.when(t < train, F.lit("train")), F.when((t >= train - context) & (t < validation), F.lit("validation")), F.when(t >= validation - context, F.lit("test"))))
    return series.withColumn("split", F.explode(names))


@dataclass(frozen=True)
class TemporalSignal:
    """A series of features x and targets y over one graph, with names of nodes. Frames: series (node, t, x..., y...), names (node, node_id)."""

    graph: MeshGraph
    names: DataFrame
    series: DataFrame
    x: tuple[str, ...]
    y: tuple[str, ...]
    steps: int

    def violations(self) -> DataFrame:
        """(rule, key): rows of unknown nodes or outside the steps, nodes without all steps, null values, blank or repeated names, and the graph's own."""
        key = lambda *cs: F.concat_ws(" ", *[F.col(c).cast("string") for c in cs]).alias("key")
        rule = lambda f, r, *cs: f.select(F.lit(r).alias("rule"), key(*cs))
        any_null = " or ".join(f"{c} is null or isnan({c})" for c in (*self.x, *self.y))
        out = [
            rule(self.series.filter(any_null), "value is null or no number", "node", "t"),
            rule(self.series.filter((F.col("t") < 0) | (F.col("t") >= self.steps)), "step outside the signal", "node", "t"),
            rule(self.series.join(self.graph.nodes, "node", "left_anti"), "row of no node", "node", "t"),
            rule(self.graph.nodes.join(self.series, "node", "left").groupBy("node").agg(F.countDistinct("t").alias("n"), F.count("t").alias("all")).filter((F.col("n") != self.steps) | (F.col("all") != self.steps)), "node without one row a step", "node"),
            rule(self.names.filter("node_id is null or trim(node_id) = ''"), "blank name", "node"),
            rule(self.names.groupBy("node_id").count().filter("count > 1"), "repeated name", "node_id"),
        ]
        every = self.graph.violations()
        for f in out:
            every = every.unionByName(f)
        return every

    def part(self, start: int, stop: int) -> TemporalSignal:
        """A contiguous part, its steps counted from 0."""
        if not 0 <= start < stop <= self.steps:
            raise ValueError("a part is contiguous, forward and within the signal")
        inside = self.series.filter(F.col("t").between(start, stop - 1)).withColumn("t", F.col("t") - start)
        return TemporalSignal(self.graph, self.names, inside, self.x, self.y, stop - start)

    def split(self, ratio: float) -> tuple[TemporalSignal, TemporalSignal]:
        at = int(ratio * self.steps)
        if not 0 < ratio < 1 or at in (0, self.steps):
            raise ValueError("both parts need steps")
        return self.part(0, at), self.part(at, self.steps)

    def windows(self, history: int) -> DataFrame:
        """(node, start, <x>_0, ..., y...): all features of each window, with the targets of its last step."""
        if history <= 0 or history > self.steps:
            raise ValueError("history must be from 1 to the number of steps")
        out = self.series.select("node", (F.col("t") - (history - 1)).alias("t"), *self.y).filter("t >= 0")
        for v in self.x:
            out = out.join(spread(self.series, v, range(history), [f"{v}_{i}" for i in range(history)], 0, self.steps - history), ["node", "t"])
        return out.withColumnRenamed("t", "start")


def trajectory_windows(rows: DataFrame, value: str, history: int, horizon: int) -> DataFrame:
    """(trajectory, node, start, h0, ..., f0, ...): the windows within each trajectory (trajectory, step, node, value); none reaches from one into another."""
    names = [f"h{i}" for i in range(history)] + [f"f{i}" for i in range(horizon)]
    moved = rows.select("trajectory", "node", F.col("step").alias("_t"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(history + horizon - 1))).alias("_k"))
    moved = moved.withColumn("start", F.col("_t") - F.col("_k")).filter("start >= 0")
    out = moved.groupBy("trajectory", "node", "start").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(n) for k, n in enumerate(names)])
    return out.filter(F.col("_n") == len(names)).drop("_n")


def numbered_batches(windows: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """Adds `batch`: windows by start, `size` starts a batch; with a seed, starts are dealt in the order of a seeded hash. Starts are as many as steps."""
    starts = windows.select("start").distinct()
    order = F.col("start") if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("start").cast("string")))
    dealt = starts.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order, "start")) - 1) / F.lit(size)))
    return windows.join(dealt, "start")


def position_patches(spark: SparkSession, samples: int) -> DataFrame:
    """(sample, place, x, y, role) of a square grid of samples (a, b) over [-2, 2]: three context nodes and, on either side of them, three nodes of each target patch, which a predictor can
    only tell apart by its position."""
    side = math.isqrt(samples)
    if side < 2 or side * side != samples:
        raise ValueError("samples are a square number, 4 at least")
    along = lambda c: c * (4.0 / (side - 1)) - 2.0
    grid = spark.range(samples).select(F.col("id").alias("sample"), along(F.col("id") % side).alias("a"), along(F.floor(F.col("id") / F.lit(side))).alias("b"))
    # The nodes of each patch as expressions of a and b.
    patches = {"context": [("a", "0"), ("a", "b"), ("0", "b")], "right": [("a + b + 2", "a - b + 2"), ("a + 2", "b + 2"), ("b + 2", "a + 2")], "left": [("2 * a - b - 2", "a + b - 2"), ("-a - 2", "b - 2"), ("b - 2", "-a - 2")]}
    nodes = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(k).alias("place"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for role, ns in patches.items() for k, (x, y) in enumerate(ns)])
    return grid.select("sample", F.explode(nodes).alias("n")).select("sample", "n.*")
