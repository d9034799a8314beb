import json

from pyspark.sql import functions as F

from plateworks.operators import exporting, log
from plateworks.operators.eventstore import EVENT, EventStore

EXPORT = "asset_id bigint, state string, platform string, status string, sha256 string, path string, filename string, text string, has_file boolean, export_event_id bigint"


def exports(spark, *more):
    return spark.createDataFrame([(1, "ready_for_export", "adobe", "ready_for_export", "h1", "p1", "a.jpg", "two words", True, 31), (2, "ready_for_export", "adobe", "ready_for_export", "h2", "p2", "b.jpg", "t", True, 32),
                                  (3, "ready_for_export", "adobe", "stale", "h3", "p3", "c.jpg", "t", True, 33), (4, "rejected", "adobe", "stale", "h4", "p4", "d.jpg", "t", True, 34), *more], EXPORT)


def test_a_second_collection_finds_nothing(spark, tmp_path):
    listing = spark.createDataFrame([("p1", "h1"), ("p2", "changed"), ("p5", "h5")], "path string, sha256 string")
    base = spark.createDataFrame([(100, 9, "OUTBOX", "COLLECTED", '{"platform":"adobe","batch":999,"folder":"publish/adobe/999_2024-02-01","sha256":"x"}')], EVENT)
    store = EventStore(spark, str(tmp_path / "s"), base)
    exporting.collect_into(store, "monday", exports(spark), listing, "2024-03-01")
    exporting.collect_into(store, "monday", exports(spark), listing, "2024-03-02")
    outcome = lambda key: sorted((r.platform, r.outcome, r.asset_id or 0, r.folder or "", r.reason or "") for r in store.result(key, "outcomes").collect())
    assert outcome("monday") == [("adobe", "COLLECTED", 1, "publish/adobe/1000_2024-03-01", ""), ("adobe", "SKIPPED", 2, "", "export file missing or changed"), ("adobe", "SKIPPED", 3, "", "export stale"), ("shutterstock", "NOTHING_TO_COLLECT", 0, "", "")]
    event = store.appended().first()
    assert (event.id, event.asset_id, event.stage, event.status) == (101, 1, "OUTBOX", "COLLECTED")
    assert json.loads(event.message) == {"platform": "adobe", "profile": "adobe-2026-09", "batch": 1000, "folder": "publish/adobe/1000_2024-03-01", "filename": "a.jpg", "sha256": "h1", "export_event_id": 31}
    assert [(r.asset_id, r.words) for r in store.result("monday", "manifest").collect()] == [(1, 2)]
    exporting.collect_into(store, "tuesday", exports(spark), listing, "2024-03-02")
    assert [o for o in outcome("tuesday") if o[1] != "SKIPPED"] == [("adobe", "NOTHING_TO_COLLECT", 0, "", ""), ("shutterstock", "NOTHING_TO_COLLECT", 0, "", "")]
    exporting.collect_into(store, "wednesday", exports(spark, (5, "ready_for_export", "adobe", "ready_for_export", "h5", "p5", "e.jpg", "x", True, 35)), listing, "2024-03-03")
    assert [o[:4] for o in outcome("wednesday") if o[1] == "COLLECTED"] == [("adobe", "COLLECTED", 5, "publish/adobe/1001_2024-03-03")]
    assert log.collected(store.events()).count() == 3


def test_a_long_reason_is_whole(spark, tmp_path):
    status = "stale " + "x" * 3000
    pending = exports(spark).limit(1).withColumns({"outcome": F.lit(f"skipped: export {status}"), "status": F.lit(status)})
    assert exporting.outcomes(exporting.collect(pending, spark.createDataFrame([], "platform string, next_batch bigint"), "d"), pending).filter("outcome = 'SKIPPED'").first().reason == f"export {status}"
