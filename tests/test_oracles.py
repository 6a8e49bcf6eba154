"""Registered queries against their SQL twins (all of them with LODESTAR_ALL=1)."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
DEFAULT = [
    "dedupe_events",
    "dead_letter_split",
    "sessionize",
    "item_ctr",
    "user_embedding",
    "cold_start_embedding",
    "category_topk",
    "similar_items",
    "personalized_feed",
    "experiment_assignment",
    "experiment_rollup",
    "mann_whitney_u",
    "canary_gate",
    "uniform_negatives",
    "shown_negatives",
    "evaluation_report",
    "top_features",
    "trending_stream",
    "session_stream",
]
NAMES = sorted(oracle_sql()) if os.environ.get("LODESTAR_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
