"""Layers and cells against dense numpy versions."""

import numpy as np
import pytest

from loomgrid.graph.mesh import MeshGraph
from loomgrid.layers import conv, encoders
from loomgrid.layers.recurrent import LSTM, TGCN, DiffusionGRU, GConvGRU, a3tgcn, fold, initial, period_attention

N, RNG = 5, np.random.default_rng(3)
SOURCE, TARGET = [0, 1, 1, 2, 3, 0], [1, 2, 2, 0, 1, 2]
X = RNG.normal(size=(N, 2)).round(3)
W, V, B = RNG.normal(size=(3, 2)).round(3), RNG.normal(size=(3, 2)).round(3), RNG.normal(size=3).round(3)
A = np.zeros((N, N))
for s, t in zip(SOURCE, TARGET):
    A[t, s] += 1
sig = lambda x: 1 / (1 + np.exp(-x))


def frame(spark, x, prefix="x"):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node long, " + ", ".join(f"{prefix}{i} double" for i in range(x.shape[1])))


def got(out, prefix):
    names = sorted((c for c in out.columns if c.startswith(prefix)), key=lambda c: int(c[1:]))
    return np.array([r[1:] for r in sorted(map(tuple, out.select("node", *names).collect()))])


@pytest.fixture(scope="module")
def graph(spark):
    return MeshGraph.of(spark, N, SOURCE, TARGET, a=[1, 3, 2, 4, 2, 1])


def normal(a):
    d = a.sum(1)
    s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
    return s[:, None] * a * s


def test_sage(spark, graph):
    want = (A / np.maximum(A.sum(1), 1)[:, None]) @ X @ W.T + B + X @ V.T
    assert np.allclose(got(conv.sage(graph, frame(spark, X), ["x0", "x1"], W, V, B), "o"), want)


@pytest.mark.parametrize("rows", [1, 3])
def test_gcn_narrow_and_wide(spark, graph, rows):
    want = normal(A + np.eye(N)) @ X @ W[:rows].T + B[:rows]
    assert np.allclose(got(conv.gcn(graph.with_loops(), frame(spark, X), ["x0", "x1"], W[:rows], B[:rows]), "o"), want)


def test_gine(spark, graph):
    e = RNG.normal(size=(6, 1)).round(3)
    we, be, wh, bh, wo, bo = RNG.normal(size=(2, 1)), RNG.normal(size=2), RNG.normal(size=(3, 2)), B, RNG.normal(size=(2, 3)), RNG.normal(size=2)
    m = np.zeros((N, 2))
    for i, (s, t) in enumerate(zip(SOURCE, TARGET)):
        m[t] += np.maximum(X[s] + we @ e[i] + be, 0)
    want = np.maximum((1.3 * X + m) @ wh.T + bh, 0) @ wo.T + bo
    edges = spark.createDataFrame([(i, float(v[0])) for i, v in enumerate(e)], "edge long, q double")
    assert np.allclose(got(conv.gine(graph, frame(spark, X), ["x0", "x1"], edges, ["q"], (we, be), (wh, bh), (wo, bo), 0.3), "o"), want)


def test_gat_of_two_heads(spark, graph):
    w, a, b, bias = RNG.normal(size=(4, 2)), RNG.normal(size=(2, 2)), RNG.normal(size=(2, 2)), RNG.normal(size=4)
    state = (X @ w.T).reshape(N, 2, 2)
    want = np.tile(bias, (N, 1))
    for h in range(2):
        score = np.array([state[s, h] @ a[h] + state[t, h] @ b[h] for s, t in zip(SOURCE, TARGET)])
        score = np.where(score >= 0, score, 0.2 * score)
        for n in range(N):
            into = [i for i, t in enumerate(TARGET) if t == n]
            if into:
                p = np.exp(score[into] - score[into].max())
                want[n, 2 * h : 2 * h + 2] += (p / p.sum()) @ np.array([state[SOURCE[i], h] for i in into])
    assert np.allclose(got(conv.gat(graph, frame(spark, X), ["x0", "x1"], w, a, b, bias), "o"), want)


def both(graph):
    return graph.both_ways(), A + A.T


def cheb_basis(a, x, order):
    s, t = normal(a), [x]
    if order > 1:
        t.append(-s @ x)
    for _ in range(2, order):
        t.append(2 * (-s @ t[-1]) - t[-2])
    return np.concatenate(t, 1)


def test_cheb(spark, graph):
    g, a = both(graph)
    w = RNG.normal(size=(2, 6))
    assert np.allclose(got(conv.cheb(g, frame(spark, X), ["x0", "x1"], w, B[:2], 3), "o"), cheb_basis(a, X, 3) @ w.T + B[:2])
    with pytest.raises(ValueError):
        conv.cheb(graph, frame(spark, X), ["x0", "x1"], w, B[:2], 3)


def gates(n, m):
    return RNG.normal(size=(n, m)).round(3), RNG.normal(size=n).round(3)


def tgcn(x, h, p, u, r, c):
    z = normal(A + np.eye(N)) @ x @ p.T
    n = h.shape[1]
    up = sig(np.concatenate((z[:, :n], h), 1) @ u[0].T + u[1])
    re = sig(np.concatenate((z[:, n : 2 * n], h), 1) @ r[0].T + r[1])
    new = np.tanh(np.concatenate((z[:, 2 * n :], h * re), 1) @ c[0].T + c[1])
    return up * h + (1 - up) * new


def test_tgcn_fold_and_attention(spark, graph):
    p, u, r, c = RNG.normal(size=(6, 2)), gates(2, 4), gates(2, 4), gates(2, 4)
    cell = TGCN(graph.with_loops(), p, u, r, c)
    xs, h = [X, 2 * X, -X], np.zeros((N, 2))
    for x in xs:
        h = tgcn(x, h, p, u, r, c)
    frames = [frame(spark, x) for x in xs]
    out = fold(lambda f, s: cell.step(f, ["x0", "x1"], s), frames, initial(frames[0], 2), 1)
    assert np.allclose(got(out, "h"), h)
    w = np.exp([0.2, -0.1, 0.4]) / np.exp([0.2, -0.1, 0.4]).sum()
    want = sum(k * tgcn(x, np.zeros((N, 2)), p, u, r, c) for k, x in zip(w, xs))
    assert np.allclose(got(a3tgcn(cell, frames, ["x0", "x1"], (0.2, -0.1, 0.4)), "h"), want)
    with pytest.raises(ValueError):
        period_attention(frames, (1.0,), ["x0"])


def test_gconv_gru(spark, graph):
    g, a = both(graph)
    k, c = gates(2, 6), gates(1, 6)
    h = np.zeros((N, 1))
    for x in (X, 2 * X):
        z = sig(cheb_basis(a, np.concatenate((x, h), 1), 2) @ k[0].T + k[1])
        new = np.tanh(cheb_basis(a, np.concatenate((x, h * z[:, 1:]), 1), 2) @ c[0].T + c[1])
        h = z[:, :1] * h + (1 - z[:, :1]) * new
    cell, frames = GConvGRU(g, k, c, 2), [frame(spark, X), frame(spark, 2 * X)]
    assert np.allclose(got(fold(lambda f, s: cell.step(f, ["x0", "x1"], s), frames, initial(frames[0], 1)), "h"), h)


def test_diffusion_and_its_gru(spark, graph):
    """Parallel edges keep their weights apart; forward weights of a source add up to 1, reverse ones of a target too."""
    w = np.array([1, 3, 2, 4, 2, 1], float)
    forward, reverse = np.zeros((N, N)), np.zeros((N, N))
    for s, t, a in zip(SOURCE, TARGET, w):
        forward[t, s] += a / sum(b for q, b in zip(SOURCE, w) if q == s)
        reverse[s, t] += a / sum(b for q, b in zip(TARGET, w) if q == t)
    weighted = MeshGraph(graph.nodes, conv.diffusion_weights(graph, "a"))
    out = conv.diffusion(weighted, frame(spark, X), ["x0", "x1"])
    assert np.allclose(got(out, "f"), forward @ X) and np.allclose(got(out, "r"), reverse @ X)
    basis = lambda v: np.concatenate((v, forward @ v, reverse @ v), 1)
    k, c, h = gates(2, 9), gates(1, 9), np.zeros((N, 1))
    for x in (X, 3 * X):
        z = sig(basis(np.concatenate((x, h), 1)) @ k[0].T + k[1])
        new = np.tanh(basis(np.concatenate((x, h * z[:, 1:]), 1)) @ c[0].T + c[1])
        h = z[:, :1] * h + (1 - z[:, :1]) * new
    cell, frames = DiffusionGRU(weighted, k, c), [frame(spark, X), frame(spark, 3 * X)]
    assert np.allclose(got(fold(lambda f, s: cell.step(f, ["x0", "x1"], s), frames, initial(frames[0], 1)), "h"), h)


def test_lstm(spark):
    i, s, b = RNG.normal(size=(8, 1)), RNG.normal(size=(8, 2)), RNG.normal(size=8)
    h, c = np.zeros(2), np.zeros(2)
    for x in (0.5, -1.0, 2.0):
        z = i[:, 0] * x + s @ h + b
        c = sig(z[2:4]) * c + sig(z[:2]) * np.tanh(z[4:6])
        h = sig(z[6:]) * np.tanh(c)
    rows = spark.createDataFrame([(0, 2, 2.0), (0, 0, 0.5), (0, 1, -1.0)], "node long, t long, x double")
    assert np.allclose(got(LSTM(i, s, b).over(rows, ["node"], "t", ["x"]), "h")[0], h)


def test_attention_masks_and_scales(spark):
    q, k, v = RNG.normal(size=(2, 2)), RNG.normal(size=(2, 2)), RNG.normal(size=(2, 2))
    there = np.array([True, True, False, True, True])
    factor = RNG.uniform(0.5, 1.5, (N, N)).round(3)
    Q, K, U = X @ q.T, X @ k.T, X @ v.T
    want = np.zeros((N, 2))
    for h in range(2):
        s = np.outer(Q[:, h], K[:, h]) * factor
        e = np.exp(s) * there
        want[:, h] = (e / e.sum(1, keepdims=True)) @ U[:, h]
    tokens = spark.createDataFrame([(0, i, *map(float, x), bool(there[i])) for i, x in enumerate(X)], "g int, node long, x0 double, x1 double, there boolean")
    scale = spark.createDataFrame([(0, i, j, float(factor[i, j])) for i in range(N) for j in range(N)], "g int, node long, other long, factor double")
    assert np.allclose(got(encoders.attention(tokens, ["g"], "node", ["x0", "x1"], q, k, v, 2, scale), "o"), want)
    none = tokens.selectExpr("g", "node", "x0", "x1", "false as there")
    assert np.allclose(got(encoders.attention(none, ["g"], "node", ["x0", "x1"], q, k, v, 2), "o"), 0)


def test_wide_maps_are_products_on_batches(spark, graph, monkeypatch):
    """The same results, however a map is computed; keys of any type pass through."""
    from loomgrid.functions import dense

    p, u, r, c = RNG.normal(size=(6, 2)), gates(2, 4), gates(2, 4), gates(2, 4)
    cell, x = TGCN(graph.with_loops(), p, u, r, c), frame(spark, X)
    want = [got(conv.sage(graph, x, ["x0", "x1"], W, V, B), "o"), got(conv.gcn(graph.with_loops(), x, ["x0", "x1"], W, B), "o"), got(cell.step(x, ["x0", "x1"], initial(x, 2)), "h")]
    monkeypatch.setattr(dense, "NARROW", 0)
    for a, b in zip(want, [got(conv.sage(graph, x, ["x0", "x1"], W, V, B), "o"), got(conv.gcn(graph.with_loops(), x, ["x0", "x1"], W, B), "o"), got(cell.step(x, ["x0", "x1"], initial(x, 2)), "h")]):
        assert np.allclose(a, b)
    keyed = dense.project(x.selectExpr("string(node) as name", "x0", "if(node = 1, null, x1) as x1"), ["name"], [(["x0", "x1"], [[1.0, 1.0]], [0.5], "y")]).orderBy("name").collect()
    assert [r.name for r in keyed] == list("01234") and abs(keyed[1].y0 - X[1, 0] - 0.5) < 1e-9
