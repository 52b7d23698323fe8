"""Alert states over an unbounded series of evaluations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.alerts import STATE_SCHEMA, Carry, advance, ordered_evaluations

_PENDING = "ts bigint, met boolean, suppressed boolean"
_SAVED = "active boolean, count bigint, first bigint, notified bigint, resolved bigint"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(value: pd.Timestamp) -> int | None:
    return None if pd.isna(value) else value.value // 1000


def _time(value: int | None) -> pd.Timestamp:
    return pd.NaT if value is None or pd.isna(value) else pd.Timestamp(int(value), unit="us")


class _InTimeOrder(StatefulProcessor):
    """Holds evaluations back until the watermark has passed them, then applies them in time order."""

    def __init__(self, cooldown: pd.Timedelta, auto_resolve: bool):
        self.cooldown, self.auto_resolve = cooldown, auto_resolve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.saved = handle.getValueState("saved", _SAVED)

    def _wake(self, earliest: int) -> None:
        self.handle.registerTimer(-(-earliest // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for batch in rows:
            if key[0] is None or not len(batch):
                continue  # a mark: it only moves the watermark
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            self.pending.appendList(list(zip(micros.tolist(), batch["met"].tolist(), batch["suppressed"].tolist())))
            least = int(micros.min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.pending.get())
        due = sorted((row for row in held if row[0] <= passed), key=lambda row: (row[0], row[2], row[1]))
        later = [row for row in held if row[0] > passed]
        if not due:
            return
        carry = Carry()
        if self.saved.exists():
            active, count, *times = self.saved.get()
            carry = Carry(active, count, *map(_time, times))
        frame = pd.DataFrame(due, columns=["ts", "met", "suppressed"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
        frame["alert"] = key[0]
        out, carry = advance(frame, carry, self.cooldown, self.auto_resolve)
        times = (carry.first, carry.notified, carry.resolved)
        self.saved.update((carry.active, carry.count, *map(_micros, times)))
        if later:
            self.pending.put(later)
            self._wake(min(row[0] for row in later))
        else:
            self.pending.clear()
        yield out

    def close(self) -> None:
        pass


def alert_state_stream(
    evaluations: DataFrame, cooldown_minutes: int = 15, auto_resolve: bool = True, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming twin of :func:`tidemill.operators.alerts.alert_states`.

    An evaluation may arrive up to ``lateness`` behind the newest one, in any
    micro-batch. It is held back until the watermark passes its time, so states
    follow event time across micro-batches; what comes later still is left out
    by Spark. State is what an alert has pending within that interval and one
    small row. A row without an alert is a mark that moves the watermark and
    nothing else; a source that ends sends one to have the rest applied. The
    session is set to the state store that this kind of state needs.
    """
    evaluations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return (
        ordered_evaluations(evaluations)
        .withWatermark("ts", lateness)
        .groupBy("alert")
        .transformWithStateInPandas(
            _InTimeOrder(pd.Timedelta(minutes=cooldown_minutes), auto_resolve), STATE_SCHEMA, "append", "eventTime"
        )
    )
