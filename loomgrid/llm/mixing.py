"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, shuffled by a hash, form a queue. A document's virtual finish time is the number of tokens of its source up to and
with it, divided by the source's target weight; a source may go through its queue up to ``max_repeats`` times. Documents are taken in the order of
finish times until the total budget is used up, so sources keep to their weights for as long as their queues last, and what an exhausted source leaves
is taken by the others in proportion to their weights. The shares reached are reported beside the targets.

Running sums are made in two steps, over ranges and within a range: a source of any size is spread over contiguous ranges of its hash, and the final order over as many ranges of
finish time. Ranges are as many as the rows need (about ``IN_RANGE`` in each); the order is that of the hash alone, so their number changes nothing. No task holds a source or the whole order.

Defined cases: sources compare without outer white space and letter case; documents of sources without a target are left out. Documents without tokens come at no cost
with their neighbours in the queue. Ties of finish time are settled by source, repeat and document. Null ids are rejected. A source listed twice has the larger repeats and the sum of weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.text import reference_key
from loomgrid.session import written

#: Rows that a range should have.
IN_RANGE = 100_000


def _targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy(reference_key(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").cast("int").alias("repeats")).filter("weight > 0 and repeats > 0")


def _virtual_end(supplies: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources of (weight, tokens with repeats) have given the budget."""
    time, left, open_ = 0.0, budget, sorted((c / w, w) for w, c in supplies if c > 0)
    while open_:
        step = (open_[0][0] - time) * sum(w for _, w in open_)
        if step >= left:
            return time + left / sum(w for _, w in open_)
        left -= step
        time = open_.pop(0)[0]
    return time


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, ranges: int | None = None) -> DataFrame:
    """(source, doc_id, repeat, tokens, finish, upto): the mix in its order of `upto`, the tokens up to and with the record. sizes: doc_id, source, tokens.
    The budget is, unless given, the tokens of all documents of the targets' sources."""
    wanted = _targets(targets)
    # one row per source of the targets' table: a list made by hand
    rows = sizes.filter("doc_id is not null").withColumn("source", reference_key(F.col("source"))).join(F.broadcast(wanted), "source")
    rows = written(rows.select("source", "doc_id", "tokens", "weight", "repeats", F.xxhash64(F.lit(seed), "doc_id").alias("place")))
    supplies = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w"), (F.sum("tokens") * F.max("repeats")).alias("c"), F.sum("tokens").alias("s"), F.max("tokens").alias("longest")).collect()  # one row per target
    bits = max(6, math.ceil(math.log2(max(sum(r["n"] for r in supplies), 1) / IN_RANGE))) if ranges is None else max(1, math.ceil(math.log2(ranges)))
    ranges = 1 << bits
    rows = rows.withColumn("range", F.shiftright("place", 64 - bits).cast("int"))
    in_range = rows.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    base = in_range.select("source", "range", (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("base"), F.sum("in_range").over(Window.partitionBy("source")).alias("supply"))
    total = budget if budget is not None else sum(r["s"] for r in supplies)
    end = _virtual_end([(r["w"], r["c"]) for r in supplies], float(total))
    # a range is a small part of a source; the base of each is joined by its own key
    within = Window.partitionBy("source", "range").orderBy("place", "doc_id")
    queued = rows.join(base, ["source", "range"]).withColumn("sum", F.col("base") + F.sum("tokens").over(within))
    # a queue lags behind its share by a document at most; what an open source's longest one takes is offered beyond the end
    lag = max((r["longest"] / r["w"] for r in supplies if r["c"] / r["w"] > end), default=0.0)
    slack = end + lag + 2.0 * end / ranges + 1e-9
    last_repeat = F.least(F.col("repeats") - 1, F.floor(F.greatest(F.lit(0.0), (F.lit(slack) * F.col("weight") - F.col("sum")) / F.greatest(F.col("supply"), F.lit(1)))).cast("int"))
    offered = queued.withColumn("repeat", F.explode(F.sequence(F.lit(0), last_repeat))).withColumn("finish", (F.col("repeat") * F.col("supply") + F.col("sum")) / F.col("weight"))
    step = max(slack, 1e-9) / ranges
    offered = offered.filter(F.col("finish") <= slack).withColumn("slot", F.floor(F.col("finish") / step).cast("int")).select("source", "doc_id", "repeat", "tokens", "finish", "slot")
    offered = written(offered)
    slots = offered.groupBy("slot").agg(F.sum("tokens").alias("in_slot"))
    start = slots.select("slot", (F.sum("in_slot").over(Window.orderBy("slot")) - F.col("in_slot")).alias("before"))  # a row per range of finish times
    order = Window.partitionBy("slot").orderBy("finish", "source", "repeat", "doc_id")
    placed = offered.join(start, "slot").withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    return placed.filter(F.col("upto") <= total).select("source", "doc_id", "repeat", "tokens", "finish", "upto")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, records, most_repeats): what each source gives to the mix."""
    given = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), (F.max("repeat") + 1).alias("most_repeats"))
    every = _targets(targets).join(given, "source", "left").select("source", "weight", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "most_repeats")])
    all_tokens, all_weights = F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return every.select("source", (F.col("weight") / all_weights).alias("target_share"), (F.col("tokens") / F.greatest(all_tokens, F.lit(1))).alias("share"), "tokens", "records", "most_repeats")
