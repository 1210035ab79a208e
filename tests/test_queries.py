"""Every registered query against its SQL, and the entry points."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points
from glyphmill.plans.all import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, con, name):
    q = CATALOG[name]
    assert q.sql is not None
    assert compare(q.build(spark, SF), con, q.sql) is None


def test_entry_counts_known_statuses(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["status"] for r in rows} <= {
        "kept",
        "filtered_low_conf",
        "filtered_oov",
        "filtered_invalid_bbox",
        "filtered_dup",
        "filtered_text_leak",
    }
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
