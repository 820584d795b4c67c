"""Implausible values in measurements: impossible ones, spikes and stuck values.

*Plausibility*: values at or beyond a field's physical limits and the marks that devices write for "no value".

*Spikes*: peaks over threshold. Values are logarithms; the seasonal residual is the value less the 90 % quantile of its source and hour (the 10 %
quantile for low ones). Per source, the excess over a high (and under a low) quantile follows a generalised Pareto law. Its shape and scale
are drawn to the field's usual ones as far as a source's values don't tell them. Both come from quantiles down to a tail of 1.25 %, so
spikes widen it only where they are more than that. The cutoff is the
level that the law exceeds with the probability ``RISK``. A value is a spike if it lies beyond the cutoff of its source's levels and beyond
that of its seasonal residuals: what the source shows at some hour is never one.

*Stuck*: a vehicle's calls in the order of its trips and their stops, repeated records of a call taken together. Neighbouring values are equal by chance with a
probability estimated over the starts of all vehicles' runs; a run is stuck if it is so long that a value starts such a run by chance with a probability of
less than ``RISK``, at any size of the data.

Quantiles come from histograms of logarithms, a few thousand bins per source that add up across partitions: no task holds a source's rows.
Runs are found in windows over a vehicle's calls of one service date.

Defined cases: null values are never found. Sources with null ids are a source of their own. A source with less than ``FEW`` values takes the law
of the whole field around its own median. Rows without vehicle take the vehicle of their trip's other rows, else they are in no run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.text import stripped, usable_text
from loomgrid.session import written

# What devices write for "no value".
MARKS = (32767, 65535, 86400, 99999, 999999, 2147483647)
#: Log bins per unit: a bin is half a percent wide.
BINS = 200
#: Probability with which a regular value exceeds the cutoff or starts a run as long as a stuck one.
RISK = 1e-7
#: Least number of values of which a source's own tail is fitted.
FEW = 60
#: Least share of a route's rows that name a trunk which it serves; rarer ones are written wrongly.
SERVED = 0.05
#: By how much the tails of a field's sources differ, in shape and in the scale's logarithm; and standard errors of the scale added to it.
SHAPES_DIFFER, SCALES_DIFFER, MARGIN = 0.1, 0.3, 2.0


@dataclass(frozen=True)
class Measure:
    name: str
    source: tuple[str, ...]
    #: Values at or below this one, or above the other, can't be.
    at_most_impossible: int
    most: int


MEASURES = (
    Measure("dwell_time_seconds", ("stop",), -1, 6 * 3600),
    Measure("travel_time_seconds", ("stop",), 0, 6 * 3600),
    Measure("headway_trunk_seconds", ("station", "trunk", "direction_id"), 0, 24 * 3600),
)


def _majority(counted: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equally frequent ones. counted: rows with their number n."""
    return counted.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v"))).alias("m")).select(*by, F.col("m.v").alias(name))


def _served(counted: DataFrame) -> DataFrame:
    """The trunks that a route serves: those of a fair share of its rows."""
    each = counted.filter("route_id is not null and own_trunk is not null").groupBy("route_id", "own_trunk").agg(F.sum("n").alias("n"))
    return each.withColumn("all", F.sum("n").over(Window.partitionBy("route_id"))).filter(F.col("n") >= SERVED * F.col("all")).select("route_id", "own_trunk", F.lit(True).alias("served"))


def prepared(replay: DataFrame) -> DataFrame:
    """Rows with ids in one form. A row without usable trunk, station or vehicle takes that of most rows of its route, stop or trip; so does one whose trunk its route doesn't serve."""
    word = lambda c: F.when(usable_text(F.col(c)), F.upper(stripped(F.col(c))))
    trip = ["service_date", "route_id", "direction_id", "start_time"]
    rows = replay.select(
        "row_id", *trip, "stop_sequence", word("stop_id").alias("stop"), word("parent_station").alias("own_station"),
        F.regexp_replace(word("trunk_route_id"), "^T-", "").alias("own_trunk"), F.regexp_replace(word("vehicle_id"), "[^A-Z0-9]", "").alias("own_vehicle"),
        F.coalesce(F.when(F.col("stop_timestamp") > 0, F.col("stop_timestamp")), F.when(F.col("move_timestamp") > 0, F.col("move_timestamp"))).alias("at"),
        *[m.name for m in MEASURES],
    )
    # stops and routes are places: one count of their combinations gives what is usual for each; the joins are left to the optimiser
    places = written(rows.groupBy("stop", "own_station", "route_id", "own_trunk").agg(F.count(F.lit(1)).alias("n")))
    vehicles = rows.groupBy(*trip, "own_vehicle").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(_majority(places, ["stop"], "own_station", "usual_station"), "stop", "left")
    rows = rows.join(_majority(places, ["route_id"], "own_trunk", "usual_trunk"), "route_id", "left")
    rows = rows.join(_served(places), ["route_id", "own_trunk"], "left")
    rows = rows.join(_majority(vehicles, trip, "own_vehicle", "usual_vehicle"), trip, "left")
    return rows.select(
        "row_id", *trip, "stop_sequence", "stop", F.coalesce("own_station", "usual_station").alias("station"),
        # the route tells the trunk more surely than a word written by hand
        F.coalesce(F.when(F.col("served"), F.col("own_trunk")), F.col("usual_trunk"), F.col("own_trunk")).alias("trunk"), F.coalesce("usual_vehicle", "own_vehicle").alias("vehicle"), "at", *[m.name for m in MEASURES],
    )


def _long(rows: DataFrame) -> DataFrame:
    """One row per row and field with a value: its source, its hour and the logarithm's bin."""
    each = []
    for m in MEASURES:
        v = F.col(m.name)
        impossible = (v <= m.at_most_impossible) | (v > m.most) | v.isin(*MARKS)
        source = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in m.source])
        each.append(F.struct(F.lit(m.name).alias("field"), source.alias("source"), v.alias("value"), impossible.alias("impossible")))
    out = rows.select("row_id", "service_date", "vehicle", "at", "route_id", "direction_id", "start_time", "stop_sequence", F.explode(F.array(*each)).alias("e"))
    out = out.select(*out.columns[:-1], "e.*").filter("value is not null")
    return out.withColumn("hour", F.coalesce(F.expr("cast(pmod(at div 3600, 24) as int)"), F.lit(-1))).withColumn("bin", F.when(~F.col("impossible"), F.round(F.log(F.greatest(F.col("value"), F.lit(1)).cast("double") + 1.0) * BINS).cast("int")))


def _quantiles(bins: DataFrame, by: list[str], at: dict[str, float], step: Column | float | None = None) -> DataFrame:
    """Quantiles of weighted bins (columns by, bin, n): the bin itself or, with a step, a place within the step that its values stand for."""
    order = Window.partitionBy(*by).orderBy("bin")
    cumulated = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    place = F.col("bin")
    reached = lambda p: F.col("upto") >= F.ceil(F.col("all") * p)
    within = lambda p: place if step is None or p == 0.5 else place + F.lit(1.0) * step * ((F.col("all") * p - F.col("upto") + F.col("n")) / F.col("n") - 0.5)
    return cumulated.groupBy(*by).agg(F.max("all").alias("size"), *[F.min_by(F.when(reached(p), within(p)), F.when(reached(p), F.col("bin"))).alias(n) for n, p in at.items()])


_TAIL = {"l4": 0.0125, "l3": 0.025, "l2": 0.05, "l1": 0.10, "mid": 0.5, "h1": 0.90, "h2": 0.95, "h3": 0.975, "h4": 0.9875}


def _step(bin: Column) -> Column:
    """Bins between a whole second and the next."""
    return F.greatest(F.lit(1.0), BINS / F.exp(bin / BINS))


def _shapes(quantiles: DataFrame) -> DataFrame:
    """Adds each tail's own shape and scale: how the steps between quantiles, each at half the tail of the one before, widen outwards, and the logarithm of two of them."""
    apart = lambda a, b: F.greatest(F.abs(F.col(a) - F.col(b)), F.lit(0.25))
    out = quantiles.withColumns({f"{t}_near": apart(f"{t}1", f"{t}2") for t in "lh"} | {f"{t}_far": apart(f"{t}3", f"{t}4") for t in "lh"} | {f"{t}_scale": F.log(apart(f"{t}1", f"{t}3")) for t in "lh"})
    return out.withColumns({f"{t}_shape": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log2(F.col(f"{t}_far") / F.col(f"{t}_near")) / 2)) for t in "lh"})


def _cutoff(t: str, step: Column | float) -> Column:
    """The level exceeded with probability RISK. Shape and scale are the tail's own as far as their errors allow, else the field's usual ones: the errors are those
    of the quantiles of so many values, and of whole seconds. The shape lies between that of a regular law and that of a power law of the values; the
    scale is taken with a margin for what is left of its error, and is at least the tail's own: a second, rare kind of values is no error."""
    coarse = lambda width: F.pow(F.lit(1.0) * step / width, F.lit(2.0))
    drawn = lambda c, own: own * F.col(f"{t}_{c}") + (1 - own) * F.coalesce(f"{t}_usual_{c}", f"{t}_{c}")
    own_shape = SHAPES_DIFFER**2 / (SHAPES_DIFFER**2 + 54.0 / F.col("size") + 0.17 * coarse(F.col(f"{t}_near")))
    shape = F.least(F.lit(-0.01), F.greatest(F.lit(-0.5), drawn("shape", own_shape)))
    error = 15.6 / F.col("size") + coarse(F.exp(f"{t}_scale")) / 6
    own_scale = SCALES_DIFFER**2 / (SCALES_DIFFER**2 + error)
    scale = F.exp(F.greatest(F.col(f"{t}_scale"), drawn("scale", own_scale) + MARGIN * F.sqrt(own_scale * error)))
    level = scale * F.expm1(shape * math.log(0.1 / RISK)) / F.expm1(shape * math.log(4.0))
    return F.col(f"{t}1") + level if t == "h" else F.col(f"{t}1") - level


def _with_cutoffs(quantiles: DataFrame, usual: DataFrame, prefix: str, step: Column | float = 1.0) -> DataFrame:
    # a row for each kind and field
    out = quantiles.join(F.broadcast(usual), [c for c in ("kind", "field") if c in usual.columns], "left")
    keys = [c for c in ("kind", "field", "source") if c in quantiles.columns]
    return out.select(*keys, F.col("size").alias(f"{prefix}_size"), F.col("mid").alias(f"{prefix}_mid"), _cutoff("l", step).alias(f"{prefix}_low"), _cutoff("h", step).alias(f"{prefix}_high"))


def _usual_shapes(shapes: DataFrame) -> DataFrame:
    """Per field the median shape and scale of its sources, by their values: sources are places, and few."""
    return shapes.filter(F.col("size") >= FEW).groupBy(*[c for c in ("kind", "field") if c in shapes.columns]).agg(*[F.percentile(f"{t}_{c}", 0.5, F.col("size")).alias(f"{t}_usual_{c}") for t in "lh" for c in ("shape", "scale")])


def cutoffs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, seasons): per field and source the cutoffs of levels and residuals, per field, source and hour the median and the thresholds."""
    bins = written(rows.filter("bin is not null").groupBy("field", "source", "hour", "bin").agg(F.count(F.lit(1)).alias("n")))
    seasons = _quantiles(bins, ["field", "source", "hour"], {"season_low": 0.1, "season": 0.5, "season_high": 0.9}).withColumnRenamed("size", "season_size")
    shaped = written(_shapes(_quantiles(bins.groupBy("field", "source", "bin").agg(F.sum("n").alias("n")), ["field", "source"], _TAIL, _step(F.col("bin")))))
    levels = _with_cutoffs(shaped, _usual_shapes(shaped), "level", _step(F.col("mid")))
    # the thresholds of an hour with few values are those of its source
    own = F.col("season_size") >= FEW
    base = shaped.select("field", "source", *[F.round(c).cast("int").alias(c) for c in ("l1", "mid", "h1")])
    seasons = seasons.join(base, ["field", "source"]).select("field", "source", "hour", *[F.when(own, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("season_low", "l1"), ("season", "mid"), ("season_high", "h1"))])
    seasons = written(seasons)
    # the residuals' laws: below the low threshold, above the high one, and around the median for the whole field
    kinds = (("low", "season_low", F.col("source")), ("high", "season_high", F.col("source")), ("pooled", "season", F.lit("")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), of.alias("source"), (F.col("bin") - F.col(t)).alias("bin")) for k, t, of in kinds]))
    folded = bins.join(seasons, ["field", "source", "hour"]).select("field", each.alias("e"), "n").groupBy("e.kind", "field", "e.source", "e.bin").agg(F.sum("n").alias("n"))
    law = written(_shapes(_quantiles(folded, ["kind", "field", "source"], _TAIL, 1.0)))
    usual = _usual_shapes(law.filter("kind <> 'pooled'")).unionByName(_usual_shapes(shaped).withColumn("kind", F.lit("pooled")))
    cut = _with_cutoffs(law, usual, "r")
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col(f"r_{k}"))).alias(f"residual_{k}")
    residuals = cut.filter("kind <> 'pooled'").groupBy("field", "source").agg(side("low"), side("high"))
    pooled = cut.filter("kind = 'pooled'").select("field", F.col("r_low").alias("pooled_low"), F.col("r_high").alias("pooled_high"))
    # three fields
    return levels.join(residuals, ["field", "source"]).join(F.broadcast(pooled), "field"), seasons


def spikes(rows: DataFrame) -> DataFrame:
    levels, seasons = cutoffs(rows)
    # one row for each source and hour: the rows are joined once, by a key that spreads a source over its hours
    limits = written(seasons.join(levels, ["field", "source"]))
    judged = rows.filter("bin is not null").join(limits, ["field", "source", "hour"])
    few = F.col("level_size") < FEW
    level = F.col("bin") - F.when(few, F.col("level_mid")).otherwise(F.lit(0))
    above, below = [F.col("bin") - F.when(few, F.col("season")).otherwise(F.col(c)) for c in ("season_high", "season_low")]
    high = (level > F.when(few, F.col("pooled_high")).otherwise(F.col("level_high"))) & (above > F.when(few, F.col("pooled_high")).otherwise(F.col("residual_high")))
    low = (level < F.when(few, F.col("pooled_low")).otherwise(F.col("level_low"))) & (below < F.when(few, F.col("pooled_low")).otherwise(F.col("residual_low")))
    return judged.filter(high | low)


def stuck(rows: DataFrame) -> DataFrame:
    """Rows whose value is part of a run that is too long for chance."""
    call = ["service_date", "vehicle", "field", "route_id", "direction_id", "start_time", "stop_sequence"]
    known = rows.filter("vehicle is not null")
    lane = ["service_date", "vehicle", "field"]
    # one exchange by lane serves the distinct calls and both windows; a lane is a vehicle's day
    calls = known.select(*call, "value").repartition(*lane).distinct()
    order = Window.partitionBy(*lane).orderBy("start_time", "route_id", "direction_id", "stop_sequence", "value")
    marked = calls.withColumn("before", F.lag("value").over(order)).withColumn("after", F.lead("value").over(order)).withColumn("new", F.when(F.col("before").eqNullSafe(F.col("value")), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order))
    sized = runs.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy(*lane, "run")))
    # chance: how often a run's first value is followed by an equal one, so that a stuck run counts once, whatever its length
    started = (F.col("new") == 1) & F.col("after").isNotNull()
    chance = runs.groupBy("field").agg((F.count_if(started & (F.col("after") == F.col("value"))) / F.nullif(F.count_if(started), F.lit(0))).alias("p"))
    least = chance.select("field", (1 + F.ceil(math.log(RISK) / F.log(F.least(F.greatest(F.col("p"), F.lit(0.002)), F.lit(0.9))))).alias("least"))
    long_runs = sized.join(F.broadcast(least), "field").filter(F.col("length") >= F.greatest(F.col("least"), F.lit(5)))
    same = F.lit(True)
    for c in [*call, "value"]:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}"))
    return known.alias("k").join(long_runs.select(*call, "value").alias("r"), same, "left_semi")


def implausible(replay: DataFrame) -> DataFrame:
    """(row_id, field_name, reason): every value that is impossible, a spike or stuck."""
    rows = written(_long(prepared(replay)))
    found = [rows.filter("impossible").withColumn("reason", F.lit("impossible")), spikes(rows).withColumn("reason", F.lit("spike")), stuck(rows).withColumn("reason", F.lit("stuck"))]
    out = found[0].select("row_id", "field", "reason")
    for f in found[1:]:
        out = out.unionByName(f.select("row_id", "field", "reason"))
    return out.groupBy("row_id", F.col("field").alias("field_name")).agg(F.min("reason").alias("reason"))
