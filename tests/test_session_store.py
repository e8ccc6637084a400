"""Commits of sessions: all tables at once, two writers, deletion, retention, what vacuum removes."""

import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.session_store import SessionStore


def _rows(spark, sessions, note):
    return spark.createDataFrame([(s, note, k) for s in sessions for k in range(2)], "session_id string, note string, n int")


def _commit(store, spark, sessions, note, names=("sessions", "results")):
    return store.commit({n: _rows(spark, sessions, note) for n in names})


def _seen(store, name="results"):
    return sorted({(r.session_id, r.note) for r in store.table(name).collect()}) if "note" in store.table(name).columns else []


def test_nothing_shows_before_everything_is_there(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store")
    assert store.live().count() == 0 and store.table("results").count() == 0
    failing = _rows(spark, ["a"], "x").withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.commit({"sessions": _rows(spark, ["a"], "x"), "results": failing})
    assert store.live().count() == 0 and store.table("sessions").count() == 0
    assert _commit(store, spark, ["a", "b"], "first") == 0
    assert _seen(store) == _seen(store, "sessions") == [("a", "first"), ("b", "first")]
    assert len(store.vacuum(unpublished_hours=0)) == 1  # what the failed commit left
    assert _seen(store) == [("a", "first"), ("b", "first")]


def test_replacing_deleting_and_keeping_the_newest(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store")
    _commit(store, spark, ["a", "b", "c"], "first")
    _commit(store, spark, ["b"], "second", names=("sessions",))
    # the second commit has no results for b, so b has none any more
    assert _seen(store) == [("a", "first"), ("c", "first")] and _seen(store, "sessions") == [("a", "first"), ("b", "second"), ("c", "first")]
    store.delete(spark.createDataFrame([("a",), ("never",)], "session_id string"))
    assert _seen(store, "sessions") == [("b", "second"), ("c", "first")]
    assert store.vacuum() == []  # c still lives in the first commit
    _commit(store, spark, ["d", "e"], "third")
    store.retain(2)
    assert [s for s, _ in _seen(store, "sessions")] == ["d", "e"]
    assert len(store.vacuum()) == 2 and [s for s, _ in _seen(store)] == ["d", "e"]
    store.retain(1)
    assert [s for s, _ in _seen(store)] == ["d"]
    store.retain(5)
    store.delete()
    assert store.live().count() == 0 and _seen(store) == []


def test_two_writers_lose_no_session(spark, tmp_path):
    store = SessionStore(spark, f"file://{tmp_path}/store")
    numbers = []
    writers = [threading.Thread(target=lambda s=s: numbers.append(_commit(store, spark, [s], "x"))) for s in ("a", "b", "c", "d")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(numbers) == [0, 1, 2, 3] and [s for s, _ in _seen(store)] == ["a", "b", "c", "d"]


def test_query_reads_what_is_committed(spark):
    from palimpsest.plans.queries import ORACLE_SQL, QUERIES
    from tests.oracle import same

    same(spark, QUERIES["session_commits"], ORACLE_SQL["session_commits"])
