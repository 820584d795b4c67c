"""Looking at plans: what an operator must not do at scale can be asserted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Joins that form all pairs of rows.
PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def operators(frame: DataFrame) -> dict[str, int]:
    """How often each physical operator occurs."""
    names = re.findall(r"^[\s:+\-|*()\d]*([A-Z]\w+)", physical(frame), re.MULTILINE)
    return {n: names.count(n) for n in sorted(set(names))}


def forms_pairs(frame: DataFrame) -> list[str]:
    """Operators of the plan that would meet every row with every other."""
    found = operators(frame)
    return [p for p in PAIRS if found.get(p)]


def read_columns(frame: DataFrame) -> list[set[str]]:
    """The columns that each scan reads."""
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", physical(frame))]


def pushed_filters(frame: DataFrame) -> list[str]:
    return [f for f in re.findall(r"PushedFilters: \[(.*?)\]", physical(frame)) if f]
