"""Jobs that are stopped and started again give what one run over everything gives."""

import pytest
from pyspark.sql import functions as F

from plateworks.streaming import jobs

EVENTS = "id BIGINT, asset_id BIGINT, stage STRING, status STRING, message STRING, created_at TIMESTAMP_NTZ"


def events():
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 20)
    rows = []
    for i in range(60):
        late = -timedelta(days=15) if i == 55 else timedelta(hours=i)
        rows.append((i, i % 4, "NOTIFY" if i % 2 else "AI", "SENT" if i % 2 else "FAILED", '{"kind":"k","key":"%d"}' % (i % 6), start + late))
    return rows


@pytest.mark.parametrize("job, so_far, key", [
    (jobs.notify_dedup, jobs.notify_dedup_so_far, lambda r: (r["asset_id"], r["kind"], r["key"])),
    (jobs.daily_digest, jobs.daily_digest_so_far, lambda r: (r["day"], r["stage"], r["n"])),
    (jobs.latest_state, jobs.latest_state_so_far, lambda r: (r["asset_id"], r["stage"], r["status"], r["event_id"]))])
def test_restart_equals_the_batch_result(spark, tmp_path, job, so_far, key):
    rows = events()
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")

    def stream():
        return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    for part in (rows[:20], rows[20:40], rows[40:]):  # each part meets a job that is started anew
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        job(stream(), folder).awaitTermination()
    got = [key(r) for r in so_far(spark, folder).collect()]
    whole = spark.createDataFrame(rows, EVENTS)
    if job is jobs.notify_dedup:
        want = {(r[1], "k", str(r[0] % 6)) for r in rows if r[2] == "NOTIFY"}
    elif job is jobs.daily_digest:
        want = {key(r) for r in whole.groupBy(F.to_date("created_at").alias("day"), "stage").agg(F.count("*").alias("n")).collect()}
    else:
        want = {key(r) for r in whole.groupBy("asset_id", "stage", "status").agg(F.max("id").alias("event_id")).collect()}
    assert sorted(map(str, got)) == sorted(map(str, want))


ARRIVAL = "path STRING, extension STRING, file_hash STRING, decodable BOOLEAN"


def test_arrivals_over_batches_register_each_content_once(spark, tmp_path):
    registry = spark.createDataFrame([(7, "old"), (9, "old"), (3, "older")], "id bigint, file_hash string")
    batches = [
        [("b/2", ".en", "h1", True), ("b/1", ".en", "h1", True), ("b/0", ".en", "h1", False), ("b/3", ".xx", "h2", True), ("b/4", ".en", "old", True), ("b/5", ".en", "h3", False)],
        [("a/1", ".EN", "h1", True), ("a/2", ".en", "h2", True), ("a/3", ".en", "h3", True), ("a/4", ".en", None, True)],
        [("0/1", ".en", "h3", True), ("0/2", ".en", "h2", False), ("0/3", ".en", None, True), ("0/4", ".en", "h4", True), ("0/5", ".en", "h4", True)]]
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for part in batches:
        spark.createDataFrame(part, ARRIVAL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.ingest_arrivals(stream, registry, (".en",), folder).awaitTermination()
    got = {r.path: (r.outcome, r.asset_id) for r in jobs.arrivals_so_far(spark, folder).collect()}
    assert got == {
        "b/1": ("REGISTERED", 10), "b/2": ("DUPLICATE", None), "b/0": ("UNDECODABLE", None), "b/3": ("UNSUPPORTED", None), "b/4": ("DUPLICATE", None), "b/5": ("UNDECODABLE", None),
        "a/1": ("DUPLICATE", None), "a/2": ("REGISTERED", 11), "a/3": ("REGISTERED", 12), "a/4": ("REGISTERED", 13),
        "0/1": ("DUPLICATE", None), "0/2": ("UNDECODABLE", None), "0/3": ("DUPLICATE", None), "0/4": ("REGISTERED", 14), "0/5": ("DUPLICATE", None)}


def test_one_content_in_many_chunks_registers_its_smallest_path(monkeypatch):
    import pandas as pd

    class State:
        exists, value = False, None

        def update(self, value):
            self.value = value

    chunks = [pd.DataFrame([(p, "h", False, ok, False) for p, ok in part], columns=["path", "file_hash", "known", "decodable", "refused"]) for part in ([("c", True), ("d", True)], [("b", True), ("0", False)], [("e", True)], [("a", True), ("f", True)])]
    state = State()
    out = pd.concat(jobs._judge(("h",), iter(chunks), state))
    assert dict(zip(out["path"], out["outcome"])) == {"a": "REGISTERED", "0": "UNDECODABLE", **{p: "DUPLICATE" for p in "bcdef"}} and len(out) == 7 and state.value == (True,)


def test_a_micro_batch_reads_no_earlier_output(spark, tmp_path):
    """Everything that earlier batches wrote is taken away between the batches; the outcomes stay right."""
    import shutil

    rows = events()
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    seen = []
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        jobs.notify_dedup(spark.readStream.schema(EVENTS).parquet(source), folder).awaitTermination()
        seen += [(r.asset_id, r.kind, r.key) for r in jobs.notify_dedup_so_far(spark, folder).collect()]
        shutil.rmtree(f"{folder}/out")
        (tmp_path / "job" / "out").mkdir()
    assert sorted(seen) == sorted({(r[1], "k", str(r[0] % 6)) for r in rows if r[2] == "NOTIFY"})


def test_a_table_streams_as_one_file_and_as_a_folder_of_files(spark, tmp_path):
    from plateworks.plans.bindings import Tables
    from plateworks.plans.stream_queries import _stream

    rows = spark.range(40).withColumnRenamed("id", "event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("folder", "file"):
        name = f"streamed_{kind}"
        _stream(Tables(spark, str(tmp_path / kind)), "events").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.event_id for r in spark.table(name).collect()) == list(range(40))
