"""Plans keep the shape that holds at scale."""

import pytest

from tessella.plans import QUERIES

#: Joins of two one-row aggregates, and of every peer with the whole current version.
PRODUCTS = {"similarity", "merkle_verify", "daemon_status", "incremental_diff"}
#: The chunker and the ordered folds; everything else is built in.
PYTHON = {"cdc_chunks", "cdc_dedup", "pack_by_size", "pack_round_trip", "checkpoint_cadence", "circuit_breaker", "rate_limit", "session_states", "checkpoint_updates"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_python_but_where_meant(name, spark, small):
    told = plan(QUERIES[name](spark, small))
    assert ("CartesianProduct" in told or "NestedLoopJoin" in told) == (name in PRODUCTS)
    assert any(x in told for x in ("MapInArrow", "MapInPandas", "PythonUDF", "FlatMapGroups", "ArrowEvalPython")) == (name in PYTHON)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_window_over_all_rows_in_one_task(name, spark, small):
    lines = [x.strip(" +-:*()0123456789") for x in plan(QUERIES[name](spark, small)).split("\n")]
    windows = [i for i, x in enumerate(lines) if x.startswith("Window ")]
    assert not any("SinglePartition" in x for i in windows for x in lines[i + 1 : i + 3])


def test_scans_read_only_the_columns_that_are_used(spark, small):
    told = plan(QUERIES["latency_percentiles"](spark, small))
    schema = told[told.index("ReadSchema") :].split(">")[0]
    assert "l_quantity" in schema and "l_extendedprice" not in schema and "l_comment" not in schema


def test_filters_reach_the_scan(spark, small):
    told = plan(QUERIES["rename_by_file_id"](spark, small))
    assert "PushedFilters" in told
    told = plan(QUERIES["largest_objects"](spark, small))
    assert "TakeOrderedAndProject" in told


def test_last_rows_are_limited_before_the_shuffle(spark, small):
    for name in ("file_upsert", "latest_manifest", "insert_or_ignore", "latency_percentiles"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, small)), name
