"""The stream of session states against the batch, in several divisions into batches, and the timer of interrupted sessions."""

import random
import time
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import sessions
from palimpsest.streaming import session_states as stream

pytest.importorskip("google.protobuf")


def _events(rng):
    start, rows = datetime(2024, 1, 1), []
    for k in range(12):
        seq = 0
        for event in ["created", *rng.choices(["step", "step", "failed", "completed", "step"], k=rng.randrange(0, 6)), *(["deleted"] if k == 5 else [])]:
            rows.append((f"s{k}", seq, event, f"step{seq}", f"why{seq}" if event == "failed" else None, start + timedelta(minutes=len(rows))))
            seq += 1
    return rows


def _run(spark, folder, checkpoint, out):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    events = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))

    def keep(batch, number):
        out.extend((number, *r) for r in batch.collect())

    query = stream.session_states(events, None).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


@pytest.mark.parametrize("seed", [1])
def test_same_rows_in_any_division(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = _events(rng)
    expected = {tuple(r) for r in sessions.state(spark.createDataFrame(rows, sessions.EVENTS)).collect()}
    mixed = rows + rng.sample(rows, 10)  # repeated ones
    rng.shuffle(mixed)  # and late ones
    folder = tmp_path / "events"
    for k in range(3):
        spark.createDataFrame(mixed[k::3], sessions.EVENTS).coalesce(1).write.mode("append").json(str(folder))
    out = []
    _run(spark, folder, tmp_path / "checkpoint", out)
    last = {r[1]: r[1:] for r in sorted(out, key=lambda r: r[0])}
    assert {r for r in last.values() if r[1] != "deleted"} == expected and last["s5"][1] == "deleted"


def test_silent_sessions_fail(spark, tmp_path):
    """The timer fires while the query waits for data, so this one runs until it has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    folder, out, at = tmp_path / "events", [], datetime(2024, 1, 1)
    rows = [("a", 0, "created", "ingestion", None, at), ("b", 0, "created", "ingestion", None, at), ("b", 1, "completed", None, None, at)]
    spark.createDataFrame(rows, sessions.EVENTS).coalesce(1).write.json(str(folder))
    states = stream.session_states(spark.readStream.schema(sessions.EVENTS).json(str(folder)), silence=0.001)
    query = states.writeStream.foreachBatch(lambda batch, number: out.extend((number, *r) for r in batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        until = time.time() + 120
        while time.time() < until and not any(r[2] == "failed" for r in out):
            time.sleep(0.5)
    finally:
        query.stop()
    last = {r[1]: r[1:5] for r in sorted(out, key=lambda r: r[0])}
    assert last["a"] == ("a", "failed", "recovery", stream.INTERRUPTED) and last["b"][1] == "completed"
