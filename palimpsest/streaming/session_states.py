"""Session states from a stream of events, one keyed state a session.

Events are those of `operators.sessions`. What a session's state keeps are extremes (the first failure, the last step, the first and last times), so late and repeated events, and any division into batches, end
in the rows that `sessions.state` gives over all events: completion is final, failures and steps count while a session is processing only, deleted sessions are marked as deleted. A session that is processing
and has been silent for `silence` seconds of processing time fails as interrupted, as it would at a restart; an event that completes it later still does. Without `silence` there are no timers, and a run over what is there (availableNow) ends; with it, the query runs until it is stopped.

Needs the state store provider of RocksDB (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "done boolean, gone boolean, broke bigint, error string, last bigint, step string, created_at timestamp, completed_at timestamp"
ROWS = "session_id string, status string, last_step string, error_message string, created_at timestamp, completed_at timestamp"
INTERRUPTED = "startup_recovery_interrupted"


def _least(a, b, pick=min):
    return b if a is None else a if b is None else pick(a, b)


class _Sessions(StatefulProcessor):
    def __init__(self, silence: float | None) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def _row(self, key: tuple, s: dict) -> pd.DataFrame:
        status = "deleted" if s["gone"] else "completed" if s["done"] else "failed" if s["broke"] is not None else "processing"
        step = "completed" if s["done"] else s["step"]
        error = (s["error"] or "")[:1000] if status == "failed" and s["error"] is not None else None
        made = pd.DataFrame([(key[0], status, step, error, s["created_at"], s["completed_at"])], columns=[c.split()[0] for c in ROWS.split(", ")])
        return made.astype({"created_at": "datetime64[ns]", "completed_at": "datetime64[ns]"})

    def _kept(self) -> dict:
        names = [c.split()[0] for c in STATE.split(", ")]
        values = self.session.get() if self.session.exists() else (False, False, *[None] * 6)
        return dict(zip(names, values, strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._kept()
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            for seq, event, step, detail, ts in zip(batch["seq"], batch["event"], batch["step"], batch["detail"], batch["ts"], strict=True):
                at = None if ts is None else pd.Timestamp(ts).to_pydatetime()
                s["created_at"] = _least(s["created_at"], at)
                if event == "completed":
                    s["done"], s["completed_at"] = True, _least(s["completed_at"], at, max)
                elif event == "deleted":
                    s["gone"] = True
                elif event == "failed" and (s["broke"] is None or seq < s["broke"] or s["error"] == INTERRUPTED and seq == s["broke"]):
                    s["broke"], s["error"] = int(seq), detail
                elif event in ("created", "step") and (s["last"] is None or (seq, step or "") >= (s["last"], s["step"] or "")):
                    s["last"], s["step"] = int(seq), step
        self._keep(s, timerValues)
        yield self._row(key, s)

    def _keep(self, s: dict, timer_values) -> None:
        self.session.update(tuple(s.values()))
        if self.silence is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not s["done"] and not s["gone"] and s["broke"] is None:
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + int(1000 * self.silence))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._kept()
        if not s["done"] and not s["gone"] and s["broke"] is None:
            s["broke"], s["error"], s["step"] = (s["last"] or 0) + 1, INTERRUPTED, "recovery"
            self.session.update(tuple(s.values()))
            yield self._row(key, s)

    def close(self) -> None:
        pass


def session_states(events: DataFrame, silence: float | None = 1800.0) -> DataFrame:
    """events: a stream with the columns of sessions.EVENTS. A row for each session that a batch changes; the last one of a session is its state."""
    rows = events.where("session_id IS NOT NULL").groupBy("session_id")
    return rows.transformWithStateInPandas(statefulProcessor=_Sessions(silence), outputStructType=ROWS, outputMode="Update", timeMode="None" if silence is None else "ProcessingTime")
