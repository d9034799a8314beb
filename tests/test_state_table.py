"""The stored state holds what reports read, and nothing else travels through its projections."""

from plateworks.operators import paging, stages
from plateworks.plans import load, stage_queries
from plateworks.plans.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def test_the_state_table_holds_only_what_reports_read(spark):
    t = Tables(spark, FOLDER)
    stored, rows = stage_queries.state_table(t), stages.pipeline_summary(stage_queries.derived(t))
    assert set(stored.columns) == {*stage_queries.REPORTED, *stage_queries.REPORTED_MEMBERS} < set(rows.columns)
    wanted = ["asset_id", "state", *[f"{c} IS NULL AS no_{c}" for c in stage_queries.REPORTED_MEMBERS], *[f"{c}.{m[0]} AS of_{c}" for c, m in stage_queries.REPORTED_MEMBERS.items()]]
    a, b = stored.selectExpr(*wanted), rows.selectExpr(*wanted)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lists_store_only_the_columns_they_show(spark, monkeypatch):
    stored = []
    page = paging.page
    monkeypatch.setattr(paging, "page", lambda rows, *a, **k: stored.append(rows.columns) or page(rows, *a, **k))
    for name in ("lim_queue_page", "lim_asset_list"):
        load()[0][name](spark, FOLDER)
    assert stored == [["asset_id", "reasons"], ["asset_id", "filename", "state"]]
