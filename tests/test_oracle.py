"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect
from conftest import SF

import __spark_entry__ as entry
from wavetrail.plans.registry import ORACLES, QUERIES

# On the smallest tables these thresholds are met by nothing.
MAY_BE_EMPTY = {
    "joi15_stream_correlation", "stm10_correlation_rule",
    "stm05_threshold_rule", "stm07_rate_change_rule", "stm08_cardinality_rule", "stm08b_cardinality_per_radio", "agg04_having",
    "agg32_body_context", "prj17_body_template", "prj18_derived_events", "prj18b_source_links", "udx02_rule_defined_events", "src02_event_by_id",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_states_its_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    state, note = compare(spark, con, name, SF, QUERIES, ORACLES)
    assert state in ("ok", "rows") or (state == "EMPTY" and name in MAY_BE_EMPTY), f"{state}: {note}"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time_bucket", "tg", "agg_value"]
    assert df.count() > 0
