"""Every family against DuckDB on the smallest data (tools/check.py compares all queries)."""

import pytest

from plateworks.plans import load
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"met_build"}
SAMPLE = ("agg_stats_states", "evt_last", "evt_notify_dedup", "evt_retry_plan", "src_register_dedup", "src_event_append", "jsn_changed_keys", "jsn_strict_decode", "jn_export_check", "stg_state", "stg_problems",
          "rep_plan", "agg_review_queue", "lim_asset_list", "win_review_neighbour", "txt_grounding", "met_validate", "gate_evaluate", "rdy_evaluate", "pub_decide", "exp_collect", "crv_route", "img_noise_sigma",
          "img_edge_border", "str_latest_state", "str_notify_dedup", "str_ingest", "jsn_fingerprint", "jsn_redact_recursive", "stg_publication", "stg_asset_view", "met_event_rows", "exp_collect_outcome", "exp_collect_all", "src_unreadable_class",
          "src_actor_stamp")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_counterpart_or_is_known_as_rows_only():
    queries, oracles = load()
    assert set(queries) - set(oracles) == ROWS_ONLY
    assert set(oracles) <= set(queries)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, *load(), FOLDER)
    assert ok, note
