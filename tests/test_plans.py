"""What plans must not do: meet every row with every other, read more columns than asked, or filter after the scan."""

import pytest

from loomgrid.plans import forms_pairs, operators, pushed_filters, read_columns
from loomgrid.queries import graphs, quality, signals, transit

SMALL = "/root/testdata/sf0.001"
NO_PAIRS = {
    graphs: ["graph_sum", "graph_weighted_sum", "graph_mean", "graph_in_degree", "graph_softmax", "segment_max", "edge_dot_grad", "graph_cartesian", "directed_diffusion", "sage_layer", "gcn_layer", "gine_layer", "gat_layer", "cheb_layer", "rwse"],
    signals: ["hourly_signal", "lag_features", "history_horizon_windows", "train_standardize", "slot_seasonal_mean", "persistence_anchor", "baseline_scores"],
    transit: ["interval_valid_join", "date_route_rollup", "population_battery", "calendar_service_active", "mesh_relations", "segments"],
    quality: ["p1_found", "p2_found", "p3_found", "p6_found"],
}


@pytest.mark.parametrize("module, name", [(m, n) for m, names in NO_PAIRS.items() for n in names])
def test_no_pairs(spark, module, name):
    assert forms_pairs(module.QUERIES[name](spark, SMALL)) == []


def test_graph_sums_aggregate_before_the_shuffle(spark):
    found = operators(graphs.graph_weighted_sum(spark, SMALL))
    assert found["HashAggregate"] == 2 and not found.get("SortMergeJoin", 0) > 1


def test_only_needed_columns_are_read(spark):
    scans = read_columns(graphs.graph_in_degree(spark, SMALL))
    assert {"l_suppkey"} in [s - {"l_partkey"} for s in scans] and all("l_extendedprice" not in s for s in scans)


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SMALL}/replay.parquet").filter("move_timestamp >= 5 and move_timestamp < 9").select("row_id")
    assert "GreaterThanOrEqual(move_timestamp,5)" in pushed_filters(rows)[0]
