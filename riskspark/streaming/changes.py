"""Keyed state over arriving scores: the latest class of every entity, and a row whenever it changes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import q

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TS, TIE, PRED = 2, 3, 4  # places in the processor's input, whose columns arrive without their names
PART = 1 << 16


class ClassChanges(StatefulProcessor):
    """Settles the records of one entity in event order.

    A record waits until the watermark has passed its time, so records may arrive in any order within the
    delay. ``last`` is the settled record; ``waiting`` holds the later ones in parts of up to ``PART`` records, numbered as they
    arrived, since a call to the store costs more than a record. Of records with equal time and tie-breaker the one that
    arrived last counts. One timer per entity stands at its earliest waiting record.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "ts bigint, tie bigint, pred int")
        self._parts = handle.getValueState("parts", "n bigint")
        self._waiting = handle.getMapState("waiting", "nth bigint", "ts bigint, records binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = nth = None
        held = np.zeros((0, 3), np.int64)

        def wait(records: np.ndarray) -> None:
            nonlocal nth
            if nth is None:
                nth = (self._parts.get() or (0,))[0]
            self._hold(nth, records)
            nth += 1

        for batch in rows:
            new = np.column_stack([batch.iloc[:, at].to_numpy(np.int64) for at in (TS, TIE, PRED)])
            new = new[new[:, 0] > settled]
            if len(new):
                first = int(new[:, 0].min())
                earliest = first if earliest is None else min(earliest, first)
                held = np.concatenate([held, new])
                while len(held) >= PART:
                    wait(held[:PART])
                    held = held[PART:]
        if earliest is not None:
            if len(held):
                wait(held)
            self._parts.update((nth,))
            self._remind(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        due, earliest = [], None
        for (nth,), (ts, records) in self._waiting.iterator():
            if ts <= settled:
                due.append((nth, np.frombuffer(records, np.int64).reshape(-1, 3)))
            else:
                earliest = ts if earliest is None else min(earliest, ts)
        due.sort(key=lambda part: part[0])
        for nth, records in due:
            rest = records[records[:, 0] > settled]
            if len(rest):
                first = self._hold(nth, rest)
                earliest = first if earliest is None else min(earliest, first)
            else:
                self._waiting.removeKey((nth,))
        if earliest is not None:
            self._remind(earliest, expiredTimerInfo.getExpiryTimeInMs())
        if not due:
            return iter(())
        records = np.concatenate([r[r[:, 0] <= settled] for _, r in due])
        records = records[np.lexsort((records[:, 1], records[:, 0]))]  # stable: equal ones stay as they arrived
        newest = np.append((records[1:, :2] != records[:-1, :2]).any(axis=1), True)
        ts, tie, after = records[newest].T
        last = self._last.get()
        self._last.update((int(ts[-1]), int(tie[-1]), int(after[-1])))
        before = np.append(last[2] if last else 0, after[:-1])
        first = np.arange(len(after)) == (-1 if last else 0)
        changed = first | (before != after)
        if not changed.any():
            return iter(())
        return iter((pd.DataFrame({
            "_id": [key[0]] * int(changed.sum()), "_ts": ts[changed], "_tie": tie[changed],
            "_before": pd.arrays.IntegerArray(before[changed].astype(np.int32), first[changed]), "_after": after[changed].astype(np.int32),
        }),))

    def _hold(self, nth: int, records: np.ndarray) -> int:
        """Keep records as part ``nth``; gives their earliest time."""
        first = int(records[:, 0].min())
        self._waiting.updateValue((nth,), (first, records.tobytes()))
        return first

    def _remind(self, ts: int, expired: int | None = None) -> None:
        """One timer, at the first whole millisecond at which ``ts`` is settled. An ``expired`` one is still listed, but
        goes when its handler returns."""
        at = -(-ts // 1000)
        others = [t for t in self._handle.listTimers() if t != expired]
        if not any(t <= at for t in others):
            for t in others:
                self._handle.deleteTimer(t)
            self._handle.registerTimer(at)

    def close(self) -> None:
        pass


def class_changes(scored: DataFrame, id_col: str, ts_col: str, tie_col: str, delay: str, pred: str = "pred") -> DataFrame:
    """A row for every settled record whose class differs from that of the entity's record before it.

    ``scored`` is a stream with a timestamp and a whole-number tie-breaker for equal times. Output: id, time, tie-breaker,
    ``class_before`` (null for the first record) and ``class_after``. Records are ordered by time and
    tie-breaker whatever order they arrive in, as long as they come within ``delay`` of the latest time seen;
    later ones are dropped and counted by the stream. Repeated records change nothing. Rows without an
    id, time, tie-breaker or class are left out. Needs the store that ``keyed_state`` sets.
    """
    id_type = scored.schema[id_col].dataType.simpleString()
    rows = scored.selectExpr(
        f"{q(id_col)} as _id", f"{q(ts_col)} as _time", f"unix_micros({q(ts_col)}) as _ts", f"cast({q(tie_col)} as bigint) as _tie",
        f"cast({q(pred)} as int) as _pred",
    ).dropna().withWatermark("_time", delay)
    changed = rows.groupBy("_id").transformWithStateInPandas(
        statefulProcessor=ClassChanges(),
        outputStructType=f"_id {id_type}, _ts bigint, _tie bigint, _before int, _after int",
        outputMode="Append",
        timeMode="EventTime",
    )
    return changed.selectExpr(
        f"_id as {q(id_col)}", f"timestamp_micros(_ts) as {q(ts_col)}", f"_tie as {q(tie_col)}", "_before as class_before", "_after as class_after"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that keyed processors need; the session is left as it was."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def track_changes(
    scored: DataFrame, id_col: str, ts_col: str, tie_col: str, delay: str, sink: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write the class changes of a stream to a parquet sink. Without ``interval`` all that is available is processed once;
    ``checkpoint`` holds offsets and state, so a restart goes on where it stopped."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with keyed_state(scored.sparkSession):
        writer = class_changes(scored, id_col, ts_col, tie_col, delay).writeStream.format("parquet").outputMode("append")
        return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
