"""Exact percentiles: against numpy, of large whole numbers, decimals and groups of any type."""

import datetime
from decimal import Decimal

import numpy as np
import pytest

from loomgrid.llm.percentiles import combine, percentiles, summarise


def test_equals_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.integers(0, 50, 900))] + [("hot", None), ("hot", float("nan")), (None, 4.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    days = [summarise(f, ["g"], "v") for f in (frame.filter("v < 20 or g is null"), frame.filter("v >= 20 and g is not null"))]
    out = percentiles(combine(days[0].unionByName(days[1]), ["g"]), ["g"], [0.0, 0.37, 0.5, 1.0], 5).collect()
    for r in out:
        values = np.sort([v for g, v in rows if g == r.g and v is not None and v == v])
        assert r.size == len(values) and np.isclose(r.interpolated, np.percentile(values, 100 * r.p))
        assert r.discrete == values[max(int(np.ceil(round(r.p * len(values), 9))), 1) - 1]
    assert {r.g for r in out} == {g for g, _ in rows}


def test_large_whole_numbers_and_decimals_are_exact(spark):
    big = 2**53
    rows = spark.createDataFrame([(1, big + 1), (1, big + 3)], "g int, v long")
    r = percentiles(summarise(rows, ["g"], "v"), ["g"], [0.5], 2).first()
    assert (r.low, r.high, r.interpolated) == (big + 1, big + 3, big + 2)
    tenths = spark.createDataFrame([(1, Decimal("0.1")), (1, Decimal("0.2")), (1, Decimal("0.4"))], "g int, v decimal(10,1)")
    assert percentiles(summarise(tenths, ["g"], "v"), ["g"], [0.5], 2).first().discrete == Decimal("0.2")


def test_groups_of_a_microsecond(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t + datetime.timedelta(microseconds=i), "a:b" if i % 2 else None, i) for i in range(4)], "t timestamp, s string, v long")
    out = percentiles(summarise(rows, ["t", "s"], "v"), ["t", "s"], [0.5], 3).collect()
    assert sorted((r.t, r.s, r.size, r.discrete) for r in out) == sorted((r.t, r.s, 1, r.v) for r in rows.collect())


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_has_no_percentiles(spark, rows):
    assert percentiles(summarise(spark.createDataFrame(rows, "g int, v long"), ["g"], "v"), ["g"], [0.5]).count() == 0
