"""Queries of signals, baselines and scores, and their SQL.

The signal is made of the events table: nodes are the types of events, a step is an hour, x is the number of events and value their mean value (none in hours without events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.graph.mesh import MeshGraph
from loomgrid.queries.graphs import rounded
from loomgrid.session import table, written
from loomgrid.temporal import protocol as P
from loomgrid.temporal import signal as S
from loomgrid.temporal import transport

#: Hours from 1970 to the first step.
EPOCH = 473_352
HISTORY, HORIZON, DAY, WEEK, LAGS = 12, 3, 24, 168, (1, 2, 3, 6)


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    """(node, t, x, total): events and sum of values of each type and hour that has any."""
    hour = F.unix_date(F.to_date("ts")).cast("long") * 24 + F.hour("ts") - EPOCH
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("node"), hour.alias("t")).agg(F.count(F.lit(1)).alias("x"), F.sum("value").alias("total"))


def _steps(hours: DataFrame) -> int:
    return hours.agg(F.max("t")).first()[0] + 1


def _signal(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    hours = _hours(spark, folder)
    steps = _steps(hours)
    return S.dense(hours, steps, ["x", "total"]), steps


def _observed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(node, t, x, observed): mean values, observed in hours with events."""
    series, steps = _signal(spark, folder)
    return series.select("node", "t", F.coalesce(F.col("total") / F.nullif(F.col("x"), F.lit(0.0)), F.lit(0.0)).alias("x"), (F.col("x") > 0).alias("observed")), steps


def hourly_signal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_signal(spark, folder)[0], ["total"], 4)


def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _signal(spark, folder)
    return S.lag_features(series, "x", 4, steps)


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _signal(spark, folder)
    return rounded(S.sliding_windows(series, "x", "total", 4, steps), ["y"], 4)


def history_horizon_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of each split: ends of their history and horizon and their sums."""
    series, steps = _signal(spark, folder)
    rows = S.horizon_windows(series, "x", S.split_spans(steps, HISTORY, HORIZON))
    total = lambda p, n: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    return rows.select("split", "node", "start", "h0", F.col(f"h{HISTORY - 1}").alias("h_last"), total("h", HISTORY).alias("history_sum"), "f0", F.col(f"f{HORIZON - 1}").alias("f_last"), total("f", HORIZON).alias("horizon_sum"))


def time_split_702010(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of each split with three hours of context before later ones."""
    series, steps = _signal(spark, folder)
    return S.in_split(series, steps, 3).groupBy("split").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("rows"), F.sum("x").cast("long").alias("events"))


def train_standardize(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _observed(spark, folder)
    return rounded(P.standardised(series, int(0.7 * steps)), ["x", "z"])


def node_mean_fallback(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _observed(spark, folder)
    return rounded(P.node_means(series, int(0.7 * steps)), ["mean"], 9)


def slot_seasonal_mean(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _observed(spark, folder)
    return rounded(P.phase_means(series, int(0.7 * steps), DAY), ["mean"], 9)


def hour_of_week_mean(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _observed(spark, folder)
    return rounded(P.phase_means(series, int(0.7 * steps), WEEK), ["mean"], 9)


def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    steps = _steps(_hours(spark, folder))
    times = spark.range(steps).select(F.col("id").alias("t"), F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, cast(id + {EPOCH} as int))").alias("ts"))
    rows = P.linear_time(times, "ts", int(0.7 * steps)).select("t", "time_of_day", *[c.alias(n) for n, c in P.calendar(F.col("ts")).items()])
    return rounded(rows, ["time_of_day", "sin_day", "cos_day", "sin_week", "cos_week"])


def persistence_anchor(spark: SparkSession, folder: str) -> DataFrame:
    series, steps = _observed(spark, folder)
    span = S.split_spans(steps, HISTORY, HORIZON)[1]
    return rounded(P.anchors(series, span, P.node_means(series, int(0.7 * steps))), ["anchor"], 9)


def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Training mean, persistence and hour of the day on validation and test, pooled (horizon 0) and by horizon."""
    series, steps = _observed(spark, folder)
    out = None
    for span in S.split_spans(steps, HISTORY, HORIZON)[1:]:
        errors = P.baseline_errors(series, span, int(0.7 * steps), DAY)
        one = P.horizon_scores(errors, ["baseline"], [1, 2, 3]).withColumn("split", F.lit(span.name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["mae", "rmse"])


def _floors(spark: SparkSession, folder: str, split: int) -> tuple[DataFrame, int, int]:
    series, steps = _signal(spark, folder)
    bounds = [int(0.7 * steps), int(0.8 * steps), steps]
    return P.floor_errors(series, bounds[split], bounds[split + 1], bounds[0], DAY, WEEK), bounds[split], bounds[split + 1]


def seasonal_floor_scores(spark: SparkSession, folder: str) -> DataFrame:
    errors, _, _ = _floors(spark, folder, 0)
    return rounded(P.scores(errors, ["baseline", "rank"]), ["mae", "rmse"])


def seasonal_floor_select(spark: SparkSession, folder: str) -> DataFrame:
    """The floor with the least error on validation, by RMSE, MAE and order; its scores on test; zero share of the test targets."""
    errors, _, _ = _floors(spark, folder, 0)
    chosen = P.best(P.scores(errors, ["baseline", "rank"]), [], ["rmse", "mae", "rank"]).select("baseline")
    test, _, _ = _floors(spark, folder, 1)
    zero = F.avg((F.col("y") == 0).cast("double")).alias("zero_share")
    out = P.scores(test, ["baseline"]).join(test.groupBy("baseline").agg(zero), "baseline").join(chosen, "baseline")
    return rounded(out, ["mae", "rmse", "zero_share"])


def constant_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series that never change in each split, and the share of zeros."""
    series, steps = _signal(spark, folder)
    each = S.in_split(series, steps).groupBy("split", "node").agg(F.stddev_pop("x").alias("s"), F.count_if(F.col("x") == 0).alias("z"), F.count(F.lit(1)).alias("n"))
    return rounded(each.groupBy("split").agg(F.count_if(F.col("s") == 0).alias("constant"), (F.sum("z") / F.sum("n")).alias("zero_share")), ["zero_share"])


def _delayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    series, steps = _signal(spark, folder)
    train = int(0.7 * steps)
    # types of events are a handful
    ids = series.select("node").distinct().withColumnRenamed("node", "name")
    names = [r[0] for r in ids.orderBy("name").collect()]
    n = len(names)
    at = F.array_position(F.array(*map(F.lit, names)), F.col("node")) - 1
    series = series.select(at.alias("node"), "t", "x", F.lit(True).alias("observed"))
    phases = P.phase_means(series, train, WEEK)
    base = series.withColumn("phase", F.pmod("t", F.lit(WEEK))).join(phases.select("node", "phase", F.col("mean").alias("base")), ["node", "phase"]).select("node", "t", F.col("x").alias("y"), "base", (F.col("x") - F.col("base")).alias("r"))
    base = written(base)
    graph = MeshGraph.of(spark, n, [*range(n), 0], [*((i + 1) % n for i in range(n)), 2 % n])
    residual = base.select("node", "t", "r")
    graphs = {"real": (graph, residual), "reverse": (graph.reverse(), residual), "permuted": (graph, residual.withColumn("node", F.pmod(F.col("node") - 1, F.lit(n))))}
    alphas, predicted = P.delayed_candidates(graphs, residual, base, LAGS, train)
    return alphas, written(predicted), base, steps


def delayed_edge_alpha(spark: SparkSession, folder: str) -> DataFrame:
    """Each structure's coefficient and validation scores by lag."""
    alphas, predicted, _, steps = _delayed(spark, folder)
    errors = predicted.filter(F.col("t") < int(0.8 * steps)).withColumn("error", F.col("prediction") - F.col("y"))
    return rounded(P.scores(errors, ["structure", "lag"]).join(alphas, ["structure", "lag"]), ["alpha", "mae", "rmse"])


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(whole, blocks): scores of each structure at its selected lag and of the floor, in validation and test."""
    _, predicted, base, steps = _delayed(spark, folder)
    train, validation = int(0.7 * steps), int(0.8 * steps)
    errors = predicted.withColumn("error", F.col("prediction") - F.col("y"))
    chosen = P.best(P.scores(errors.filter(F.col("t") < validation), ["structure", "lag"]), ["structure"], ["rmse", "mae", "lag"]).select("structure", "lag")
    floor = base.filter(F.col("t") >= train).select(F.lit("floor").alias("structure"), "t", (F.col("base") - F.col("y")).alias("error"))
    every = errors.join(chosen, ["structure", "lag"]).select("structure", "t", "error").unionByName(floor)
    every = every.withColumn("split", F.when(F.col("t") < validation, "validation").otherwise("test")).withColumn("block", F.when(F.col("t") < validation, P.block_of(F.col("t"), train, validation)).otherwise(P.block_of(F.col("t"), validation, steps)))
    every = written(every)
    return P.scores(every, ["split", "structure"]), P.scores(every, ["split", "structure", "block"])


def three_block_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_judged(spark, folder)[1], ["mae", "rmse"])


def gate_directions(spark: SparkSession, folder: str) -> DataFrame:
    whole, blocks = (rounded(f, ["mae", "rmse"], 9) for f in _judged(spark, folder))
    return P.directions(whole, blocks, ["split"], "real")


def masked_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Squared, absolute and Huber loss of the training mean on observed hours, by type."""
    series, steps = _observed(spark, folder)
    error = F.col("x") - F.col("mean")
    rows = series.join(P.node_means(series, int(0.7 * steps)), "node")
    w = F.col("observed").cast("double")
    return rounded(rows.groupBy("node").agg(*[P.loss(error, k, w).alias(k) for k in ("mse", "mae", "huber")]), ["mse", "mae", "huber"])


def sample_variation(spark: SparkSession, folder: str) -> DataFrame:
    """The mean over nodes of the sample deviation over time."""
    series, _ = _signal(spark, folder)
    return rounded(series.groupBy("node").agg(F.stddev_samp("x").alias("s")).agg(F.avg("s").alias("variation")), ["variation"])


def transport_step(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps of the transport field over the suppliers, from a start made of their ids."""
    n = table(spark, folder, "supplier").count()
    graph = transport.ring_with_chords(spark, n)
    first = spark.range(n).select(F.lit(0).cast("long").alias("trajectory"), F.col("id").alias("node"), (F.pmod(F.col("id") * 7, F.lit(11)) / 11.0 - 0.5).alias("value"))
    return rounded(transport.trajectories(graph, first, 3), ["value"], 9)


def transport_rollout(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts by the mean of the last two steps that enter the next window."""
    series, _ = _signal(spark, folder)
    window = S.spread(series, "x", range(4), [f"x{i}" for i in range(4)], 0, 99).select(F.col("t").alias("trajectory"), "node", "x0", "x1", "x2", "x3")
    return rounded(transport.rollout(lambda w: w.withColumn("value", (F.col("x2") + F.col("x3")) / 2), window, 4, 3), ["value"], 9)


_QUERIES = (
    hourly_signal, lag_features, sliding_windows, history_horizon_windows, time_split_702010, train_standardize, node_mean_fallback, slot_seasonal_mean, hour_of_week_mean, calendar_features, persistence_anchor,
    baseline_scores, seasonal_floor_scores, seasonal_floor_select, constant_series, delayed_edge_alpha, three_block_scores, gate_directions, masked_losses, sample_variation, transport_step, transport_rollout,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# -- SQL ------------------------------------------------------------------------------------------------------------------

_SIGNAL = f"""WITH ev AS (SELECT event_type AS node, CAST(floor(epoch(ts) / 3600) AS BIGINT) - {EPOCH} AS t, value FROM events),
k AS (SELECT max(t) + 1 AS n, CAST(floor(0.7::DOUBLE * (max(t) + 1)) AS BIGINT) AS a, CAST(floor(0.8::DOUBLE * (max(t) + 1)) AS BIGINT) AS b FROM ev),
g AS (SELECT node, unnest(range(0, n)) AS t FROM (SELECT DISTINCT node FROM ev), k),
s AS (SELECT g.node, g.t, CAST(count(ev.t) AS DOUBLE) AS x, coalesce(sum(ev.value), 0) AS total FROM g LEFT JOIN ev USING (node, t) GROUP BY 1, 2)"""
_SEEN = _SIGNAL + ", o AS (SELECT node, t, CASE WHEN x > 0 THEN total / x ELSE 0 END AS x, x > 0 AS observed FROM s)"
_MEANS = _SEEN + ", nm AS (SELECT node, coalesce(avg(x) FILTER (WHERE observed AND t < a), (SELECT avg(x) FROM o, k WHERE observed AND t < a)) AS mean FROM o, k GROUP BY 1)"
_W = "WINDOW w AS (PARTITION BY node ORDER BY t)"


def _phase(period: int, of: str = "o") -> str:
    return f"(SELECT p.node, p.phase, coalesce(avg(x) FILTER (WHERE observed AND t < a), any_value(mean)) AS mean, count(x) FILTER (WHERE observed AND t < a) > 0 AS seen FROM (SELECT node, mean, unnest(range({period})) AS phase FROM nm) p LEFT JOIN {of} ON {of}.node = p.node AND {of}.t % {period} = p.phase, k GROUP BY 1, 2)"


_SPANS = f"spans AS (SELECT 'train' AS split, CAST({HISTORY} AS BIGINT) AS f, a AS z FROM k UNION ALL SELECT 'validation', a, b FROM k UNION ALL SELECT 'test', b, n FROM k)"
_BASE = _MEANS + f""", ph AS {_phase(DAY)},
{_SPANS}, tg AS (SELECT split, node, t - h AS start, h, t, x AS y FROM o, range({HORIZON}) r(h), spans WHERE split <> 'train' AND observed AND t - h >= f AND t - h <= z - {HORIZON} AND t < z),
an AS (SELECT DISTINCT tg.split, tg.node, tg.start, coalesce((SELECT max_by(x, t) FROM o WHERE o.node = tg.node AND observed AND o.t >= tg.start - {HISTORY} AND o.t < tg.start), mean) AS anchor FROM tg JOIN nm USING (node)),
er AS (SELECT split, node, start, h, unnest([{{'baseline': 'train_mean', 'error': nm.mean - y}}, {{'baseline': 'persistence', 'error': anchor - y}}, {{'baseline': 'seasonal', 'error': ph.mean - y}}]) AS e FROM tg JOIN nm USING (node) JOIN an USING (split, node, start) JOIN ph ON ph.node = tg.node AND ph.phase = tg.t % {DAY})"""
_FLOORS = _SIGNAL + f""", o AS (SELECT *, true AS observed FROM s), nm AS (SELECT node, avg(x) FILTER (WHERE t < a) AS mean FROM o, k GROUP BY 1), ph AS {_phase(WEEK)},
fl AS (SELECT o.node, o.t, o.x AS y, ph.mean AS how, lag(o.x) OVER w AS p1, lag(o.x, {DAY}) OVER w AS p2, lag(o.x, {WEEK}) OVER w AS p3 FROM o JOIN ph ON ph.node = o.node AND ph.phase = o.t % {WEEK} WINDOW w AS (PARTITION BY o.node ORDER BY o.t)),
fe AS (SELECT CASE WHEN t < b THEN 'validation' ELSE 'test' END AS split, node, t, y, unnest([{{'baseline': 'zero', 'rank': 0, 'error': -y}}, {{'baseline': 'persistence', 'rank': 1, 'error': p1 - y}}, {{'baseline': 'daily', 'rank': 2, 'error': p2 - y}}, {{'baseline': 'weekly', 'rank': 3, 'error': p3 - y}}, {{'baseline': 'hour_of_week', 'rank': 4, 'error': how - y}}]) AS e FROM fl, k WHERE t >= a),
fs AS (SELECT split, e.baseline AS baseline, e.rank AS rank, count(*) AS targets, avg(abs(e.error)) AS mae, sqrt(avg(e.error ** 2)) AS rmse, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM fe WHERE e.error IS NOT NULL GROUP BY 1, 2, 3)"""
_DELAYED = _SIGNAL + f""", ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT node FROM s)),
o AS (SELECT i AS node, c, t, x, true AS observed FROM s JOIN ids USING (node)), nm AS (SELECT node, avg(x) FILTER (WHERE t < a) AS mean FROM o, k GROUP BY 1), ph AS {_phase(WEEK)},
bs AS (SELECT o.node, o.c, o.t, o.x AS y, ph.mean AS base, o.x - ph.mean AS r FROM o JOIN ph ON ph.node = o.node AND ph.phase = o.t % {WEEK}),
ed AS (SELECT i AS source, (i + 1) % c AS target FROM ids UNION ALL SELECT 0, 2 % any_value(c) FROM ids),
st AS (SELECT 'real' AS structure, source, target FROM ed UNION ALL SELECT 'reverse', target, source FROM ed UNION ALL SELECT 'permuted', (source + 1) % c, target FROM ed, (SELECT any_value(c) AS c FROM ids)),
ag AS (SELECT structure, target AS node, t, avg(r) AS m FROM st JOIN bs ON bs.node = st.source GROUP BY 1, 2, 3),
af AS (SELECT structure, node, t, coalesce(m, 0) AS m FROM (SELECT DISTINCT structure FROM st) CROSS JOIN (SELECT node, t FROM bs) LEFT JOIN ag USING (structure, node, t)),
pr AS (SELECT af.structure, lag, bs.node, bs.t, bs.y, bs.base, bs.r, af.m FROM (SELECT unnest([{', '.join(map(str, LAGS))}]) AS lag) l, af JOIN bs ON bs.node = af.node AND bs.t = af.t + lag),
al AS (SELECT structure, lag, coalesce(sum(m * r) FILTER (WHERE t < a) / nullif(sum(m * m) FILTER (WHERE t < a), 0), 0) AS alpha FROM pr, k GROUP BY 1, 2),
er AS (SELECT structure, lag, node, t, base + alpha * m - y AS error FROM pr JOIN al USING (structure, lag), k WHERE t >= a),
vs AS (SELECT structure, lag, count(*) AS targets, avg(abs(error)) AS mae, sqrt(avg(error ** 2)) AS rmse FROM er, k WHERE t < b GROUP BY 1, 2)"""
_JUDGED = _DELAYED + """, ch AS (SELECT structure, lag FROM vs QUALIFY row_number() OVER (PARTITION BY structure ORDER BY rmse, mae, lag) = 1),
ev2 AS (SELECT structure, t, error FROM er JOIN ch USING (structure, lag) UNION ALL SELECT 'floor', t, base - y FROM bs, k WHERE t >= a),
bl AS (SELECT t, CASE WHEN t < b THEN 'validation' ELSE 'test' END AS split, ntile(3) OVER (PARTITION BY t < b ORDER BY t) - 1 AS block FROM (SELECT DISTINCT t FROM ev2), k),
wh AS (SELECT split, structure, avg(abs(error)) AS mae, sqrt(avg(error ** 2)) AS rmse FROM ev2 JOIN bl USING (t) GROUP BY 1, 2),
bk AS (SELECT split, structure, CAST(block AS INT) AS block, count(*) AS targets, avg(abs(error)) AS mae, sqrt(avg(error ** 2)) AS rmse FROM ev2 JOIN bl USING (t) GROUP BY 1, 2, 3)"""

SQL = {
    "hourly_signal": f"{_SIGNAL} SELECT node, t, x, round(total, 4) AS total FROM s",
    "lag_features": f"{_SIGNAL}, l AS (SELECT node, t, x AS x0, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, lead(x, 4) OVER w AS y FROM s {_W}) SELECT * FROM l WHERE y IS NOT NULL",
    "sliding_windows": f"{_SIGNAL}, l AS (SELECT node, t - 3 AS start, lag(x, 3) OVER w AS x0, lag(x, 2) OVER w AS x1, lag(x) OVER w AS x2, x AS x3, round(total, 4) AS y FROM s {_W}) SELECT * FROM l WHERE start >= 0",
    "history_horizon_windows": f"""{_SIGNAL}, {_SPANS}, l AS (SELECT node, t, lag(x, {HISTORY}) OVER w AS h0, lag(x) OVER w AS h_last, sum(x) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING) AS history_sum,
x AS f0, lead(x, {HORIZON - 1}) OVER w AS f_last, sum(x) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING) AS horizon_sum FROM s {_W})
SELECT split, node, t AS start, h0, h_last, history_sum, f0, f_last, horizon_sum FROM l, spans WHERE t >= f AND t <= z - {HORIZON}""",
    "time_split_702010": f"""{_SIGNAL} SELECT split, min(t) AS first, max(t) AS last, count(*) AS rows, CAST(sum(x) AS BIGINT) AS events FROM (SELECT 'train' AS split, * FROM s, k WHERE t < a UNION ALL SELECT 'validation', * FROM s, k WHERE t >= a - 3 AND t < b
UNION ALL SELECT 'test', * FROM s, k WHERE t >= b - 3) GROUP BY 1""",
    "train_standardize": f"{_SEEN}, st AS (SELECT avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS scale FROM o, k WHERE observed AND t < a) SELECT node, t, round(x, 6) AS x, observed, round(CASE WHEN observed THEN (x - mean) / scale ELSE 0 END, 6) AS z FROM o, st",
    "node_mean_fallback": f"{_MEANS} SELECT node, round(mean, 9) AS mean FROM nm",
    "slot_seasonal_mean": f"{_MEANS} SELECT node, phase, round(mean, 9) AS mean, seen FROM {_phase(DAY)}",
    "hour_of_week_mean": f"{_MEANS} SELECT node, phase, round(mean, 9) AS mean, seen FROM {_phase(WEEK)}",
    "calendar_features": f"""{_SIGNAL}, c AS (SELECT t, ({EPOCH} + t) % 24 / 24 AS d, (({EPOCH} + t) // 24 + 3) % 7 AS wd FROM (SELECT unnest(range(0, n)) AS t FROM k)), st AS (SELECT avg(d) AS m, stddev_pop(d) AS s FROM c, k WHERE t < a)
SELECT t, round((d - m) / s, 6) AS time_of_day, round(sin(2 * pi() * d), 6) AS sin_day, round(cos(2 * pi() * d), 6) AS cos_day, round(sin(2 * pi() * (wd + d) / 7), 6) AS sin_week, round(cos(2 * pi() * (wd + d) / 7), 6) AS cos_week FROM c, st""",
    "persistence_anchor": f"""{_MEANS}, w AS (SELECT node, unnest(range(a, b - {HORIZON} + 1)) AS start, mean FROM nm, k)
SELECT node, start, round(coalesce((SELECT max_by(x, t) FROM o WHERE o.node = w.node AND observed AND o.t >= w.start - {HISTORY} AND o.t < w.start), mean), 9) AS anchor FROM w""",
    "baseline_scores": f"{_BASE}, hh AS (SELECT split, e.baseline AS baseline, e.error AS error, unnest([CAST(0 AS BIGINT), h + 1]) AS horizon FROM er) SELECT baseline, split, horizon, count(*) AS targets, round(avg(abs(error)), 6) AS mae, round(sqrt(avg(error ** 2)), 6) AS rmse FROM hh GROUP BY 1, 2, 3",
    "seasonal_floor_scores": f"{_FLOORS} SELECT baseline, CAST(rank AS INT) AS rank, targets, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM fs WHERE split = 'validation'",
    "seasonal_floor_select": f"{_FLOORS} SELECT baseline, targets, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(CAST(zero_share AS DOUBLE), 6) AS zero_share FROM fs WHERE split = 'test' AND baseline = (SELECT baseline FROM fs WHERE split = 'validation' ORDER BY rmse, mae, rank LIMIT 1)",
    "constant_series": f"{_SIGNAL}, c AS (SELECT CASE WHEN t < a THEN 'train' WHEN t < b THEN 'validation' ELSE 'test' END AS split, node, stddev_pop(x) AS d, count(*) FILTER (WHERE x = 0) AS z, count(*) AS m FROM s, k GROUP BY 1, 2) SELECT split, count(*) FILTER (WHERE d = 0) AS constant, round(sum(z) / sum(m), 6) AS zero_share FROM c GROUP BY 1",
    "delayed_edge_alpha": f"{_DELAYED} SELECT structure, CAST(lag AS INT) AS lag, targets, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(alpha, 6) AS alpha FROM vs JOIN al USING (structure, lag)",
    "three_block_scores": f"{_JUDGED} SELECT split, structure, block, targets, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM bk",
    "gate_directions": f"""{_JUDGED}, w9 AS (SELECT split, structure, round(mae, 9) AS mae, round(rmse, 9) AS rmse FROM wh), b9 AS (SELECT split, structure, block, round(mae, 9) AS mae, round(rmse, 9) AS rmse FROM bk),
c AS (SELECT o.split, o.structure AS other, count(*) FILTER (WHERE r.mae < o.mae) AS mae_blocks, count(*) FILTER (WHERE r.rmse < o.rmse) AS rmse_blocks FROM b9 o JOIN b9 r ON r.split = o.split AND r.block = o.block AND r.structure = 'real' WHERE o.structure <> 'real' GROUP BY 1, 2)
SELECT c.split, c.other, r.mae < o.mae AS mae, r.rmse < o.rmse AS rmse, mae_blocks, rmse_blocks, r.mae < o.mae AND r.rmse < o.rmse AND mae_blocks >= 2 AND rmse_blocks >= 2 AS passed FROM c JOIN w9 o ON o.split = c.split AND o.structure = c.other JOIN w9 r ON r.split = c.split AND r.structure = 'real'""",
    "masked_losses": f"{_MEANS}, d AS (SELECT node, x - mean AS e FROM o JOIN nm USING (node) WHERE observed) SELECT node, round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END), 6) AS huber FROM d GROUP BY 1",
    "sample_variation": f"{_SIGNAL} SELECT round(avg(d), 6) AS variation FROM (SELECT stddev_samp(x) AS d FROM s GROUP BY node)",
    "transport_step": """WITH c AS (SELECT count(*) AS n FROM supplier), i AS (SELECT unnest(range(0, n)) AS id, n FROM c),
e AS (SELECT id AS source, (id + 1) % n AS target, 1 + 0.05::DOUBLE * (id % 5) AS w FROM i UNION ALL SELECT id, (id + 3 + id % 3) % n, 0.25 + 0.05::DOUBLE * (id % 4) FROM i WHERE id % 2 = 0),
d AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS f, w / sum(w) OVER (PARTITION BY target) AS r FROM e), m AS (SELECT source AS s, target AS v, 0.55::DOUBLE * f AS p FROM d UNION ALL SELECT target, source, 0.20::DOUBLE * r FROM d UNION ALL SELECT id, id, 0.25::DOUBLE FROM i),
v0 AS (SELECT id AS node, id * 7 % 11 / 11 - 0.5 AS value FROM i), v1 AS (SELECT v AS node, sum(p * value) AS value FROM m JOIN v0 ON v0.node = m.s GROUP BY 1), v2 AS (SELECT v AS node, sum(p * value) AS value FROM m JOIN v1 ON v1.node = m.s GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS trajectory, CAST(step AS INT) AS step, node, round(value, 9) AS value FROM (SELECT 0 AS step, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2)""",
    "transport_rollout": f"""{_SIGNAL}, l AS (SELECT node, t AS trajectory, lead(x, 2) OVER w AS a2, lead(x, 3) OVER w AS a3 FROM s {_W}), p AS (SELECT node, trajectory, (a2 + a3) / 2 AS p0, (a3 + (a2 + a3) / 2) / 2 AS p1 FROM l WHERE trajectory <= 99)
SELECT trajectory, node, CAST(step AS INT) AS step, round(CASE step WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE (p0 + p1) / 2 END, 9) AS value FROM p, range(3) r(step)""",
}
