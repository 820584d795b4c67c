"""Statistics of training rows, baselines and scores of forecasts.

Frames: series (node, t, x, observed). Statistics come from rows before `train_end` only; nothing later can change them. Tables of one row or one row per node and phase are joined
where they are needed, the optimiser choosing how.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.single import with_row
from loomgrid.graph.mesh import MeshGraph
from loomgrid.temporal.signal import Span


def moments(series: DataFrame, train_end: int) -> DataFrame:
    """(mean, scale): of the observed training values; the population deviation, 1 where it is 0."""
    seen = series.filter((F.col("t") < train_end) & F.col("observed"))
    return seen.agg(F.avg("x").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def standardised(series: DataFrame, train_end: int) -> DataFrame:
    """Adds z: standardised values, 0 where nothing was observed."""
    z = F.when(F.col("observed"), (F.col("x") - F.col("mean")) / F.col("scale")).otherwise(0.0)
    return with_row(series, moments(series, train_end)).withColumn("z", z).drop("mean", "scale")


def node_means(series: DataFrame, train_end: int) -> DataFrame:
    """(node, mean): each node's observed training mean, that of all for nodes without any."""
    train = series.filter(F.col("t") < train_end)
    means = series.select("node").distinct().join(train.filter("observed").groupBy("node").agg(F.avg("x").alias("own")), "node", "left")
    return with_row(means, train.filter("observed").agg(F.avg("x").alias("every"))).select("node", F.coalesce("own", "every").alias("mean"))


def phase_means(series: DataFrame, train_end: int, period: int, start: int = 0) -> DataFrame:
    """(node, phase, mean, seen): observed training means by phase, (t + start) mod period; the node's mean for phases without any."""
    phase = F.pmod(F.col("t") + start, F.lit(period))
    seen = series.filter((F.col("t") < train_end) & F.col("observed")).groupBy("node", phase.alias("phase")).agg(F.avg("x").alias("own"))
    grid = node_means(series, train_end).select("node", F.col("mean").alias("fallback"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long"))).alias("phase"))
    return grid.join(seen, ["node", "phase"], "left").select("node", "phase", F.coalesce("own", "fallback").alias("mean"), F.col("own").isNotNull().alias("seen"))


def day_phase(time: Column) -> Column:
    return (F.hour(time) * 60 + F.minute(time)) / F.lit(1440.0)


def calendar(time: Column) -> dict[str, Column]:
    """Sine and cosine of the phase of the day and of the week (from Monday)."""
    day, week = day_phase(time), (F.weekday(time) + day_phase(time)) / F.lit(7.0)
    tau = F.lit(2 * math.pi)
    return {"sin_day": F.sin(tau * day), "cos_day": F.cos(tau * day), "sin_week": F.sin(tau * week), "cos_week": F.cos(tau * week)}


def linear_time(times: DataFrame, time: str, train_end: int) -> DataFrame:
    """Adds time_of_day: the phase of the day, standardised on training rows (population deviation)."""
    day = times.withColumn("_day", day_phase(F.col(time)))
    stats = day.filter(F.col("t") < train_end).agg(F.avg("_day").alias("_mean"), F.stddev_pop("_day").alias("_scale"))
    return with_row(day, stats).withColumn("time_of_day", (F.col("_day") - F.col("_mean")) / F.nullif(F.col("_scale"), F.lit(0.0))).drop("_day", "_mean", "_scale")


def targets(series: DataFrame, span: Span) -> DataFrame:
    """(node, start, h, t, y): the observed targets of each window of a span."""
    h = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(span.horizon - 1).cast("long")))
    rows = series.filter("observed").filter(F.col("t").between(span.first, span.stop - 1)).select("node", "t", F.col("x").alias("y"), h.alias("h"))
    return rows.withColumn("start", F.col("t") - F.col("h")).filter(F.col("start").between(span.first, span.last))


def anchors(series: DataFrame, span: Span, means: DataFrame) -> DataFrame:
    """(node, start, anchor): the last value observed within the history of each window, else the node's mean."""
    ahead = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(span.history).cast("long")))
    seen = series.filter("observed").select("node", "t", "x", ahead.alias("k")).withColumn("start", F.col("t") + F.col("k")).filter(F.col("start").between(span.first, span.last))
    latest = seen.groupBy("node", "start").agg(F.max_by("x", "t").alias("last"))
    grid = means.select("node", "mean", F.explode(F.sequence(F.lit(span.first).cast("long"), F.lit(span.last).cast("long"))).alias("start"))
    return grid.join(latest, ["node", "start"], "left").select("node", "start", F.coalesce("last", "mean").alias("anchor"))


def scores(errors: DataFrame, by: Sequence[str], error: str = "error") -> DataFrame:
    """(by..., targets, mae, rmse): sums over sums, so groups of any size add up rightly."""
    e = F.col(error)
    return errors.groupBy(*by).agg(F.count(e).alias("targets"), (F.sum(F.abs(e)) / F.count(e)).alias("mae"), F.sqrt(F.sum(e * e) / F.count(e)).alias("rmse"))


def horizon_scores(errors: DataFrame, by: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Scores of all horizons pooled (horizon 0) and of single ones, counted from 1: one pass, each error going to the groups it counts in."""
    marked = errors.withColumn("horizon", F.explode(F.array_compact(F.array(F.lit(0).cast("long"), F.when((F.col("h") + 1).isin(*horizons), F.col("h") + 1)))))
    return scores(marked, [*by, "horizon"])


def loss(error: Column, kind: str, weight: Column | None = None) -> Column:
    """An aggregate: mean (squared, absolute or Huber) loss, weighted; null without weight."""
    w = F.lit(1.0) if weight is None else weight
    a = F.abs(error)
    each = {"mse": error * error, "mae": a, "huber": F.when(a <= 1.0, 0.5 * error * error).otherwise(a - 0.5)}[kind]
    return F.sum(each * w) / F.nullif(F.sum(w), F.lit(0.0))


def baseline_errors(series: DataFrame, span: Span, train_end: int, period: int) -> DataFrame:
    """(baseline, node, start, h, error): the training mean, persistence of the last observed value and the phase's mean."""
    means = node_means(series, train_end)
    rows = targets(series, span)
    rows = rows.join(means, "node").join(anchors(series, span, means).select("node", "start", "anchor"), ["node", "start"])
    rows = rows.withColumn("phase", F.pmod("t", F.lit(period))).join(phase_means(series, train_end, period).select("node", "phase", F.col("mean").alias("seasonal")), ["node", "phase"])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), (F.col(c) - F.col("y")).alias("error")) for n, c in (("train_mean", "mean"), ("persistence", "anchor"), ("seasonal", "seasonal"))]))
    return rows.select("node", "start", "h", each.alias("e")).select("e.baseline", "node", "start", "h", "e.error")


def floor_errors(series: DataFrame, start: int, stop: int, train_end: int, day: int = 24, week: int = 168) -> DataFrame:
    """(baseline, rank, node, t, y, error) of five floors of the next step: zero, the value a step, a day and a week before, the mean of the hour of the week.
    A floor that would need values before the first step has fewer rows."""
    y = series.filter(F.col("t").between(start, stop - 1)).select("node", "t", F.col("x").alias("y"))
    before = lambda k, name: series.select("node", (F.col("t") + k).alias("t"), F.col("x").alias(name))
    phases = phase_means(series.withColumn("observed", F.lit(True)), train_end, week).select("node", "phase", F.col("mean").alias("hour_of_week"))
    rows = y.withColumn("phase", F.pmod("t", F.lit(week))).join(phases, ["node", "phase"])
    for k, name in ((1, "persistence"), (day, "daily"), (week, "weekly")):
        rows = rows.join(before(k, name), ["node", "t"], "left")
    kinds = [("zero", F.lit(0.0)), *[(n, F.col(n)) for n in ("persistence", "daily", "weekly", "hour_of_week")]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(i).alias("rank"), (c - F.col("y")).alias("error")) for i, (n, c) in enumerate(kinds)]))
    return rows.select("node", "t", "y", each.alias("e")).select("e.baseline", "e.rank", "node", "t", "y", "e.error").filter("error is not null")


def best(candidates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first candidate of each group by the columns of order, as they are: the smallest struct."""
    rest = [c for c in candidates.columns if c not in (*by, *order)]
    one = F.min(F.struct(*order, *rest)).alias("_b")
    out = candidates.groupBy(*by).agg(one) if by else candidates.agg(one)
    return out.select(*by, *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])


def block_of(t: Column, start: int, stop: int, blocks: int = 3) -> Column:
    """The block of a step when steps are dealt to blocks in order, the first ones a step longer where they can't be equal."""
    size, extra = divmod(stop - start, blocks)
    place = t - start
    return F.when(place < (size + 1) * extra, F.floor(place / F.lit(size + 1))).otherwise(extra + F.floor((place - (size + 1) * extra) / F.lit(max(size, 1)))).cast("int")


def delayed_candidates(graphs: dict[str, tuple[MeshGraph, DataFrame]], residual: DataFrame, base: DataFrame, lags: Sequence[int], train_end: int) -> tuple[DataFrame, DataFrame]:
    """(alphas, predictions). graphs: by name, a graph and the field (node, t, r) whose in-neighbours' mean, so many steps before, helps the residual.
    alphas: (structure, lag, alpha), least squares on training steps, 0 without any signal; predictions: (structure, lag, node, t, y, prediction)."""
    moved = None
    for name, (graph, field) in graphs.items():
        means = graph.mean(field, ["r"], lanes=["t"]).select(F.lit(name).alias("structure"), "node", "t", F.col("r").alias("m"))
        moved = means if moved is None else moved.unionByName(means)
    lagged = moved.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select("structure", "lag", "node", (F.col("t") + F.col("lag")).alias("t"), "m")
    paired = lagged.join(residual.select("node", "t", "r"), ["node", "t"]).join(base.select("node", "t", "y", "base"), ["node", "t"])
    train = F.col("t") < train_end
    alphas = paired.filter(train).groupBy("structure", "lag").agg(F.coalesce(F.sum(F.col("m") * F.col("r")) / F.nullif(F.sum(F.col("m") * F.col("m")), F.lit(0.0)), F.lit(0.0)).alias("alpha"))
    predicted = paired.filter(~train).join(alphas, ["structure", "lag"]).select("structure", "lag", "node", "t", "y", (F.col("base") + F.col("alpha") * F.col("m")).alias("prediction"))
    return alphas, predicted


def directions(whole: DataFrame, blocks: DataFrame, by: Sequence[str], chosen: str) -> DataFrame:
    """(by..., other, mae, rmse, mae_blocks, rmse_blocks, passed): whether the chosen structure's errors are smaller than each other's, overall and in how many blocks;
    passed: both overall and in two blocks at least. whole: (by..., structure, mae, rmse), blocks with block beside."""
    def against(frame: DataFrame, keys: list[str]) -> DataFrame:
        mine = frame.filter(F.col("structure") == chosen).select(*keys, F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
        return frame.filter(F.col("structure") != chosen).join(mine, keys).select(*keys, F.col("structure").alias("other"), (F.col("_mae") < F.col("mae")).alias("mae"), (F.col("_rmse") < F.col("rmse")).alias("rmse"))

    wins = against(blocks, [*by, "block"]).groupBy(*by, "other").agg(F.count_if("mae").alias("mae_blocks"), F.count_if("rmse").alias("rmse_blocks"))
    out = against(whole, list(by)).join(wins, [*by, "other"])
    return out.withColumn("passed", F.col("mae") & F.col("rmse") & (F.col("mae_blocks") >= 2) & (F.col("rmse_blocks") >= 2))
