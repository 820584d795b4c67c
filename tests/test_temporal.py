"""Windows, splits, statistics and scores of signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.graph.mesh import MeshGraph
from loomgrid.learning import training
from loomgrid.temporal import protocol as P
from loomgrid.temporal import signal as S
from loomgrid.temporal import transport

T, N, HISTORY, HORIZON = 30, 4, 2, 3


@pytest.fixture(scope="module")
def speeds():
    x = np.fromfunction(lambda t, n: 10 + t + 3 * n + (t * n) % 5, (T, N))
    for t, n in ((1, 1), (20, 0), (22, 2)):
        x[t, n] = 0
    return x


def frame(spark, x):
    return spark.createDataFrame([(n, t, float(x[t, n]), bool(x[t, n] != 0)) for t in range(len(x)) for n in range(x.shape[1])], "node long, t long, x double, observed boolean")


def test_spans(spark):
    train, validation, test = S.split_spans(T, HISTORY, HORIZON)
    assert (train.stop, validation.stop) == (21, 24) and (train.windows, validation.windows, test.windows) == (17, 1, 4)
    with pytest.raises(ValueError):
        S.split_spans(10, 2, 5)


def test_windows_stay_inside(spark, speeds):
    rows = S.horizon_windows(frame(spark, speeds), "x", S.split_spans(T, HISTORY, HORIZON)).collect()
    assert len(rows) == (17 + 1 + 4) * N
    for r in rows:
        want = speeds[r.start - HISTORY : r.start + HORIZON, r.node]
        assert [r.h0, r.h1, r.f0, r.f1, r.f2] == list(want)


def test_lags_and_sliding_windows(spark, speeds):
    series = frame(spark, speeds)
    lags = S.lag_features(series, "x", 3, T).collect()
    assert len(lags) == (T - 3) * N and all([r.x0, r.x1, r.x2, r.y] == list(speeds[r.t : r.t + 4, r.node]) for r in lags)
    windows = S.sliding_windows(series, "x", "x", T, T).collect()
    assert len(windows) == N and all(r.y == speeds[T - 1, r.node] for r in windows)
    with pytest.raises(ValueError):
        S.sliding_windows(series, "x", "x", T + 1, T)


def test_signal_parts_and_checks(spark, speeds):
    g = MeshGraph.of(spark, N, [0, 1], [1, 2])
    names = spark.createDataFrame([(i, f"n{i}") for i in range(N)], "node long, node_id string")
    series = frame(spark, speeds).select("node", "t", "x", F.col("x").alias("y"))
    signal = S.TemporalSignal(g, names, series, ("x",), ("y",), T)
    assert signal.violations().count() == 0
    a, b = signal.split(0.7)
    assert (a.steps, b.steps) == (21, 9) and b.series.agg(F.min("t"), F.max("t")).first()[0:2] == (0, 8)
    assert signal.windows(5).count() == (T - 4) * N
    bad = S.TemporalSignal(g, names.unionByName(names.limit(1)), series.filter("not (node = 2 and t = 3)"), ("x",), ("y",), T)
    assert {r.rule for r in bad.violations().collect()} == {"repeated name", "node without one row a step"}
    for ratio in (0.0, 1.0, 0.01):
        with pytest.raises(ValueError):
            signal.split(ratio)
    with pytest.raises(ValueError):
        signal.part(5, 5)


def test_statistics_do_not_see_the_future(spark, speeds):
    """Whatever comes after the training rows, statistics and anchors before it stay the same."""
    later = speeds.copy()
    later[21:] *= 100
    span = S.Span("train", HISTORY, 21, HISTORY, HORIZON)
    for of in (lambda f: P.moments(f, 21), lambda f: P.node_means(f, 21), lambda f: P.phase_means(f, 21, 7), lambda f: P.anchors(f, span, P.node_means(f, 21)), lambda f: P.standardised(f, 21).filter("t < 21")):
        a, b = (sorted(map(str, of(frame(spark, x)).collect())) for x in (speeds, later))
        assert a == b


def test_statistics(spark, speeds):
    f, seen = frame(spark, speeds), speeds[:21] != 0
    m = P.moments(f, 21).first()
    assert np.isclose(m["mean"], speeds[:21][seen].mean()) and np.isclose(m["scale"], speeds[:21][seen].std())
    means = {r.node: r["mean"] for r in P.node_means(f, 21).collect()}
    assert all(np.isclose(means[n], speeds[:21, n][seen[:, n]].mean()) for n in range(N))
    hidden = f.withColumn("observed", F.col("observed") & (F.col("node") != 3))
    assert np.isclose({r.node: r["mean"] for r in P.node_means(hidden, 21).collect()}[3], speeds[:21, :3][seen[:, :3]].mean())
    flat = spark.createDataFrame([(0, t, 5.0, True) for t in range(5)], "node long, t long, x double, observed boolean")
    assert P.moments(flat, 5).first()["scale"] == 1.0
    phases = {(r.node, r.phase): (r["mean"], r.seen) for r in P.phase_means(f, 21, 24).collect()}
    assert len(phases) == 24 * N and phases[(0, 23)] == (means[0], False) and phases[(0, 3)][1]


def test_anchor_is_the_last_observed_value(spark, speeds):
    span = S.Span("x", 19, 26, HISTORY, HORIZON)
    f = frame(spark, speeds)
    got = {(r.node, r.start): r.anchor for r in P.anchors(f, span, P.node_means(f, 19)).collect()}
    assert got[(0, 21)] == speeds[19, 0] and got[(0, 22)] == speeds[21, 0] and got[(2, 23)] == speeds[21, 2]


def test_scores_are_pooled(spark):
    errors = spark.createDataFrame([("b", 0, 1.0), ("b", 0, -3.0), ("b", 1, 2.0), ("b", 2, 6.0)], "baseline string, h long, error double")
    got = {r.horizon: (r.targets, r.mae, round(r.rmse, 6)) for r in P.horizon_scores(errors, ["baseline"], [1, 3]).collect()}
    assert got == {0: (4, 3.0, round(12.5**0.5, 6)), 1: (2, 2.0, round(5**0.5, 6)), 3: (1, 6.0, 6.0)}
    w = errors.agg(*[P.loss(F.col("error"), k, (F.col("h") < 2).cast("double")).alias(k) for k in ("mse", "mae", "huber")]).first()
    assert np.allclose(list(w), [14 / 3, 2, (0.5 + 2.5 + 1.5) / 3])


@pytest.mark.parametrize("steps, want", [(11, [4, 4, 3]), (9, [3, 3, 3]), (3, [1, 1, 1]), (4, [2, 1, 1])])
def test_blocks(spark, steps, want):
    out = spark.range(5, 5 + steps).select(P.block_of(F.col("id"), 5, 5 + steps).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in out] == want and [r.b for r in out] == [0, 1, 2]


def test_delayed_edge_is_found(spark):
    """Node 1 repeats half of node 0's residual two steps later: the lag of two has that coefficient and no error."""
    rng = np.random.default_rng(0)
    r = np.zeros((40, 2))
    r[:, 0] = rng.normal(size=40)
    r[2:, 1] = 0.5 * r[:-2, 0]
    rows = spark.createDataFrame([(n, t, float(r[t, n])) for t in range(40) for n in range(2)], "node long, t long, r double")
    base = rows.select("node", "t", F.lit(0.0).alias("base"), F.col("r").alias("y"))
    g = MeshGraph.of(spark, 2, [0], [1])
    alphas, predicted = P.delayed_candidates({"real": (g, rows), "reverse": (g.reverse(), rows)}, rows, base, (1, 2), 30)
    assert np.isclose({(x.structure, x.lag): x.alpha for x in alphas.collect()}[("real", 2)], 0.5)
    errors = P.scores(predicted.filter("node = 1").withColumn("error", F.col("prediction") - F.col("y")), ["structure", "lag"])
    chosen = P.best(errors, ["structure"], ["rmse", "mae", "lag"])
    assert {x.structure: x.lag for x in chosen.collect()}["real"] == 2


def test_transport_keeps_the_sum_and_rolls(spark):
    g = transport.ring_with_chords(spark, 12)
    assert g.violations().count() == 0 and g.edge_count() == 18
    rows = transport.trajectories(g, transport.start(spark, 12, 2, 5), 4).groupBy("trajectory", "step").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == 8 and all(r.n == 12 for r in rows) and all(abs(r.s) < 1e-12 for r in rows if r.step == 0)
    assert transport.start(spark, 12, 1, 5, pulse=True).filter("abs(value) > 0.3").count() == 4
    with pytest.raises(ValueError):
        transport.ring_with_chords(spark, 7)
    window = spark.createDataFrame([(0, 0, 1.0, 2.0)], "trajectory long, node long, x0 double, x1 double")
    out = transport.rollout(lambda w: w.withColumn("value", F.col("x0") + F.col("x1")), window, 2, 4)
    assert [r.value for r in out.orderBy("step").collect()] == [3.0, 5.0, 8.0, 13.0]


def test_training(spark):
    rows = spark.createDataFrame([(i / 10, 2 * i / 10 + 1) for i in range(20)], "x double, y double")
    assert np.allclose(training.least_squares(rows, ["x"], "y"), [2, 1])
    weights, history = training.fit(rows, rows, ["x"], "y", 6, 0.3)
    assert history[-1][1] < history[0][1] and set(weights) == {"w", "b"}
    g = MeshGraph.of(spark, 4, [0, 1], [2, 3])
    x = spark.createDataFrame([(0, 1.0), (1, -1.0), (2, 0.0), (3, 0.0)], "node long, x double")
    y = spark.createDataFrame([(2, 1.0), (3, -1.0)], "node long, y double")
    assert training.sage_step(g, x, y, 0.0, 0.5) == (1.0, -2.0, 1.0)
    assert training.sage_step(g, x, y, 1.0, 0.5)[0] == 0.0
    plateau, rate = training.Plateau(2, 0.5, 0.2), 1.0
    for score in (3.0, 2.0, 2.0, 2.0, 2.0, 2.0):
        rate, stop = plateau.next(score, rate)
    assert rate == 0.25 and not stop
    w = {"a": np.ones(2)}
    assert training.fingerprint(w) == training.fingerprint({"a": np.ones(2)}) != training.fingerprint({"a": np.zeros(2)})
    assert np.allclose(training.moving_average(w, {"a": np.zeros(2)}, 0.9)["a"], 0.9)


def test_trajectory_windows_and_batches(spark):
    rows = spark.createDataFrame([(k, 0, s, float(10 * k + s)) for k in range(2) for s in range(5)], "trajectory long, node long, step int, value double")
    got = {(r.trajectory, r.start): (r.h0, r.h1, r.f0) for r in S.trajectory_windows(rows, "value", 2, 1).collect()}
    assert got == {(k, s): (10 * k + s, 10 * k + s + 1, 10 * k + s + 2) for k in range(2) for s in range(3)}
    windows = spark.range(10).selectExpr("id as start")
    plain = {r.start: r.batch for r in S.numbered_batches(windows, 4).collect()}
    assert plain == {s: s // 4 for s in range(10)}
    mixed = [{r.start: r.batch for r in S.numbered_batches(w, 4, 3).collect()} for w in (windows, windows.repartition(3))]
    assert mixed[0] == mixed[1] != plain and sorted(mixed[0].values()) == sorted(plain.values())


def test_position_patches(spark):
    rows = {(r.sample, r.role, r.place): (r.x, r.y) for r in S.position_patches(spark, 4).collect()}
    assert len(rows) == 36 and rows[(1, "context", 1)] == (2.0, -2.0) and rows[(1, "right", 0)] == (2.0, 6.0) and rows[(2, "left", 0)] == (-8.0, -2.0)
    with pytest.raises(ValueError):
        S.position_patches(spark, 5)


def test_probe_tells_what_is_apart(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(float(rng.normal(3 * (i % 2))), float(rng.normal()), i % 2, i) for i in range(400)], "a double, b double, label int, i int")
    train, test = training.probe(rows.filter("i % 4 <> 0"), rows.filter("i % 4 = 0 or i % 4 = 3"), ["a", "b"], "label", 0.01, 20)
    assert train > 0.9 and test > 0.9
