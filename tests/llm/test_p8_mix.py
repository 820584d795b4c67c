"""The mix against a plain queue, for any number of ranges."""

import pytest

from loomgrid.llm.mixing import mix, shares

TARGETS = [("a", 0.5, 3), (" B ", 0.3, 1), ("c", 0.2, 2)]


def made(spark, n=60, long=0):
    return spark.createDataFrame([(i, "abcd"[i % 4], (i * 37) % 50 + (long if i % 9 == 0 else 0)) for i in range(n)], "doc_id long, source string, tokens long")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")


def brute(spark, sizes, budget):
    """Every record of every repeat in the order of finish times, as far as the budget goes."""
    rows = sizes.selectExpr("doc_id", "source", "tokens", "xxhash64(7, doc_id) as place").collect()
    offered = []
    for name, weight, repeats in TARGETS:
        queue = sorted((r for r in rows if r.source == name.strip().lower()), key=lambda r: (r.place, r.doc_id))
        done = 0
        for k in range(repeats):
            for r in queue:
                done += r.tokens
                offered.append((done / weight, name.strip().lower(), k, r.doc_id, r.tokens))
    out, used = [], 0
    for finish, source, k, doc, tokens in sorted(offered):
        used += tokens
        if used > budget:
            break
        out.append((source, doc, k))
    return out


@pytest.mark.parametrize("long, budget", [(0, 300), (0, 1500), (900, 4000), (0, 10**9)])
def test_equals_a_queue(spark, long, budget):
    sizes = made(spark, long=long)
    want = brute(spark, sizes, budget)
    for ranges in (None, 2, 4096):
        taken = mix(sizes, targets(spark), budget, ranges=ranges).orderBy("upto", "finish").collect()
        assert sorted((r.source, r.doc_id, r.repeat) for r in taken) == sorted(want)
        assert sum(r.tokens for r in taken) == max((r.upto for r in taken), default=0) <= budget


def test_long_documents_fill_the_budget(spark):
    """The mix is as long as the order of all records lets it be, though its documents are long beside the budget."""
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 900 + i) for i in range(20)], "doc_id long, source string, tokens long")
    both = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_weight double, max_repeats int")
    taken = mix(sizes, both, 5000).collect()
    assert 5000 - max(r.upto for r in taken) < 920


def test_shares_and_empty_sources(spark):
    got = {r.source: r for r in shares(mix(made(spark), targets(spark), 800), targets(spark)).collect()}
    assert set(got) == {"a", "b", "c"} and abs(got["a"].share - 0.5) < 0.1 and got["b"].most_repeats <= 1
    none = shares(mix(made(spark).limit(0), targets(spark)), targets(spark)).collect()
    assert all(r.tokens == 0 and r.share == 0 for r in none) and len(none) == 3
