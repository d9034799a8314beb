from plateworks.operators import log

EVENTS = "id long, asset_id long, stage string, status string, message string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_newest_is_by_id_and_plain_text_gives_no_document(spark):
    log_ = events(spark, [(5, 1, "AI", "PASSED", '{"provider":"local"}'), (9, 1, "AI", "PASSED", "saved"), (7, 2, "AI", "PASSED", '{"provider":"local","actor":"human"}')])
    rows = {r["asset_id"]: r for r in log.latest_slots(log_, ("ai_passed",), ("ai_passed",)).collect()}
    assert rows[1]["ai_passed_id"] == 9 and rows[1]["ai_passed"] is None
    assert rows[2]["ai_passed"]["provider"] == "local"


def test_retry_plan_scenarios(spark):
    failed = [(i, 10, "AI", "FAILED", '{"error_type":"E","error":"a"}') for i in (1,)]
    failed += [(i, 11, "AI", "FAILED", '{"error_type":"E","error":"c"}') for i in (2, 3, 4)] + [(i, 12, "AI", "FAILED", '{"error_type":"E"}') for i in (5, 6, 7)]
    failed.append((8, 12, "NOTIFY", "SENT", '{"kind":"retry_exhausted","key":"AI:3"}'))
    todo = spark.createDataFrame([(a, "AI", "asset.process", 0, a != 13) for a in (10, 11, 12, 13)], "asset_id long, stage string, operation string, kind_order int, history_ok boolean")
    plan = log.retry_plan(todo, events(spark, failed))
    assert {r["asset_id"]: r["action"] for r in plan.collect()} == {10: "retry", 11: "exhausted", 12: "exhausted_notified", 13: "history_error"}
    assert [r["asset_id"] for r in log.retry_alert(plan, "2024-01-01").orderBy("asset_id").collect()] == [11, 13]
    assert [r["asset_id"] for r in log.retry_batch(plan).collect()] == [10]


def test_notices_are_recorded_once_and_bad_batches_refused(spark):
    requests = spark.createDataFrame([(1, 1, 1, "k", "a"), (1, 2, 1, "k", "a"), (1, 3, 2, "k", "b"), (2, 4, 1, "k", "c"), (2, 5, 99, "k", "c")], "batch int, pos long, asset_id long, kind string, key string")
    known = spark.createDataFrame([(1,), (2,)], "asset_id long")
    none = spark.createDataFrame([], "asset_id long, kind string, key string")
    first = log.dedupe_notices(requests, none, known)
    assert [r["outcome"] for r in first.orderBy("pos").collect()] == ["RECORDED", "ALREADY_SENT", "RECORDED", "REFUSED", "REFUSED"]
    sent = first.filter("outcome = 'RECORDED'").select("asset_id", "kind", "key")
    again = log.dedupe_notices(requests.filter("batch = 1"), sent, known)
    assert {r["outcome"] for r in again.collect()} == {"ALREADY_SENT"}  # a second run writes nothing


def test_unchanged_inputs_write_nothing(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "asset_id long, fingerprint string")
    last = spark.createDataFrame([(1, "x"), (2, "old")], "asset_id long, last_fingerprint string")
    assert {r["asset_id"]: r["outcome"] for r in log.write_if_changed(now, last).collect()} == {1: "UNCHANGED", 2: "EVALUATED", 3: "EVALUATED"}
