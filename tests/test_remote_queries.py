"""Queries that take a scratch folder, where executors run on other machines."""

import oracle
import pytest

from featloom import catalog, session

SF_DIR = "/root/testdata/sf0.001"

QUERIES = [
    "cdc_state",
    "cdc_tombstones",
    "cdc_unwrapped",
    "golden_set",
    "keyed_offline_upsert",
    "keyed_online_lookup",
    "keyed_online_scan",
    "materialize_both",
    "offline_upsert",
    "profile_batches",
    "registry_save",
    "replay_counts",
    "replay_over_time",
    "retention_partitions",
    "rolling_customer_features",
    "stream_archive",
    "stream_cdc_apply",
    "stream_dead_letter",
    "stream_documents",
    "stream_events_by_app",
    "stream_events_by_type",
]


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql_where_executors_are_elsewhere(spark, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_TRIED", set(), raising=False)
    problem, n = oracle.compare(spark, oracle.connect(SF_DIR), name, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR)
    assert problem is None and n, problem
