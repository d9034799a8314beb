"""Idempotent appends: a key once, ids never twice, events and results together."""

import threading

import pytest
from plateworks.operators.eventstore import EVENT, EventStore


def events(spark, assets, status="NORMALIZED"):
    return spark.createDataFrame([(a, "SOURCE", status, "{}") for a in assets], "asset_id bigint, stage string, status string, message string")


def rows(df):
    return sorted((r.id, r.asset_id, r.status) for r in df.collect())


def test_a_repeated_key_appends_nothing_and_ids_follow_the_log(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), spark.createDataFrame([(41, 1, "AI", "PASSED", None)], EVENT))
    first = store.append("a", events(spark, [7, 5, 6]), ("asset_id",), {"t": spark.range(3)})
    again = store.append("a", events(spark, [99]), ("asset_id",), {"t": spark.range(9)})
    assert first.fresh and not again.fresh and (again.number, again.attempt, again.rows) == (1, first.attempt, 3)
    assert rows(store.appended()) == [(42, 5, "NORMALIZED"), (43, 6, "NORMALIZED"), (44, 7, "NORMALIZED")] and store.result("a", "t").count() == 3
    second = store.append("b", events(spark, [1]), ("asset_id",))
    assert (second.first_id, second.last_id, second.number) == (45, 45, 2) and rows(store.appended("b")) == [(45, 1, "NORMALIZED")]
    other = EventStore(spark, str(tmp_path / "s"), spark.createDataFrame([(41, 1, "AI", "PASSED", None)], EVENT))
    assert [c.key for c in other.commits()] == ["a", "b"] and other.events().count() == 5 and not other.append("b", events(spark, [2]), ("asset_id",)).fresh


def test_no_events_are_a_commit_too(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    done = store.append("empty", events(spark, []), ("asset_id",))
    assert done.fresh and done.rows == 0 and store.appended().count() == 0 and store.events().count() == 0
    assert not store.append("empty", events(spark, [1]), ("asset_id",)).fresh
    assert store.append("next", events(spark, [1]), ("asset_id",)).first_id == 1


def test_a_writer_that_is_lost_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "s"))

    def lost(path, text):
        raise RuntimeError("executor gone")

    monkeypatch.setattr(store, "_create", lost)
    with pytest.raises(RuntimeError):
        store.append("a", events(spark, [1]), ("asset_id",), {"t": spark.range(1)})
    fresh = EventStore(spark, str(tmp_path / "s"))
    assert fresh.appended().count() == 0 and fresh.append("a", events(spark, [2]), ("asset_id",)).first_id == 1 and rows(fresh.appended()) == [(1, 2, "NORMALIZED")]


def test_a_record_without_its_marker_counts(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "s"))
    create = store._create
    monkeypatch.setattr(store, "_create", lambda path, text: create(path, text) if "/commits/" in path else True)
    store.append("a", events(spark, [1]), ("asset_id",))
    again = EventStore(spark, str(tmp_path / "s"))
    assert not again.append("a", events(spark, [2]), ("asset_id",)).fresh and rows(again.appended()) == [(1, 1, "NORMALIZED")]
    assert again.append("b", events(spark, [3]), ("asset_id",)).first_id == 2


def test_two_writers_never_share_ids(spark, tmp_path):
    folder, wait, made = str(tmp_path / "s"), threading.Barrier(2), []

    class Slow(EventStore):
        met = False

        def _create(self, path, text):
            if "/commits/" in path and not self.met:
                self.met = True
                wait.wait(120)  # both have reserved the same ids by now
            return super()._create(path, text)

    def write(key, assets):
        made.append(Slow(spark, folder).append(key, events(spark, assets), ("asset_id",)))

    threads = [threading.Thread(target=write, args=a) for a in (("a", [1, 2]), ("b", [3, 4, 5]))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(c.number for c in made) == [1, 2] and all(c.fresh for c in made)
    got = rows(EventStore(spark, folder).appended())
    assert [i for i, *_ in got] == [1, 2, 3, 4, 5] and {a for _, a, _ in got} == {1, 2, 3, 4, 5}
