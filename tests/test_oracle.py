"""Registered queries against DuckDB at the smallest scale; BOXLEDGER_ALL=1 runs every one."""

import os

import pytest

from boxledger.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = [
    "L3_upsert_ledger", "L4_upsert_outcome", "K6_cell_audit", "K6_clean_ledger", "R2_attach_readings", "E16_clip_box", "D6_nms", "D15_build_hierarchy",
    "D28_suppress_chains", "A3_field_anchors", "M9_assign_greedy", "C5_consensus", "V4_validate_structural", "V12_validate_geometry", "S10_compat_signature",
    "F9_object_stats", "B5_stream_ledger", "S3_S4_ledger_csv",
]
NAMES = sorted(QUERIES) if os.environ.get("BOXLEDGER_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
