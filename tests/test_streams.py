"""Keyed state, windows over arriving scores and the as-of join beside plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators.asof import asof_join
from riskspark.sources.staging import work_path
from riskspark.streaming import changes, windows

SCHEMA = "id long, ts timestamp, tie long, pred int"
START = dt.datetime(2024, 3, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def arrive(spark, folder, name, rows):
    """One more file of arriving records; the name orders the files."""
    spark.createDataFrame([(i, at(s), t, p) for i, s, t, p in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def settle(spark, folder, sink, marks, delay="60 seconds"):
    run = changes.track_changes(stream(spark, folder), "id", "ts", "tie", delay, sink, marks)
    run.awaitTermination()
    return run


def plain_changes(records, upto):
    out, last = [], {}
    for s, t, i, p in sorted({(s, t, i, p) for i, s, t, p in records if s <= upto}):
        if last.get(i) != p:
            out.append((i, s, t, last.get(i), p))
        last[i] = p
    return sorted(out)


def read_changes(spark, sink):
    rows = spark.read.parquet(sink).collect()
    return sorted((r.id, int((r.ts - START).total_seconds()), r.tie, r.class_before, r.class_after) for r in rows)


def files_within_delay(seed, n=240, delay=60):
    """Records of few entities in files whose order of times is shaken by less than the delay, with repeats and equal times."""
    rng = random.Random(seed)
    records = [(rng.choice([1, 1, 1, 2, 3]), 10 * (i // 2), i, rng.randrange(3)) for i in range(n)]
    shaken = sorted(records, key=lambda r: r[1] + rng.uniform(0, delay / 2 - 6))
    shaken += [r for r in shaken[-3:]]
    files = [shaken[k : k + 40] for k in range(0, len(shaken), 40)]
    for before, after in zip(files, files[1:]):
        after.append(before[-1])
    return records, files


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_a_batch_for_any_order_within_the_delay(spark, tmp_path, seed):
    records, files = files_within_delay(seed)
    folder = str(tmp_path / "in")
    for k, rows in enumerate(files):
        arrive(spark, folder, f"{k:03d}", rows)
    sink, marks = work_path(spark, "sink"), work_path(spark, "marks")
    settle(spark, folder, sink, marks)
    latest = max(s for _, s, _, _ in records)
    assert read_changes(spark, sink) == plain_changes(records, latest - 60)


def test_a_restart_goes_on_from_the_checkpoint_and_late_records_change_nothing(spark, tmp_path):
    records, files = files_within_delay(3)
    folder = str(tmp_path / "in")
    sink, marks = work_path(spark, "sink"), work_path(spark, "marks")
    for k, rows in enumerate(files):
        arrive(spark, folder, f"{k:03d}", rows)
        if k % 2:
            settle(spark, folder, sink, marks)
    settle(spark, folder, sink, marks)
    latest = max(s for _, s, _, _ in records)
    assert read_changes(spark, sink) == plain_changes(records, latest - 60)
    arrive(spark, folder, "900", [(1, 0, 5000, 2), (2, 10, 5001, 1), (9, 5, 5002, 0)])
    settle(spark, folder, sink, marks)
    assert read_changes(spark, sink) == plain_changes(records, latest - 60)
    arrive(spark, folder, "901", [(9, latest + 500, 6000, 0)])
    settle(spark, folder, sink, marks)
    assert read_changes(spark, sink) == plain_changes([*records, (9, latest + 500, 6000, 0)], latest + 440)


def test_rows_without_an_id_time_or_class_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, at(0), 1, 0), (None, at(1), 2, 1), (1, None, 3, 1), (1, at(2), None, 1), (1, at(3), 4, None), (1, at(500), 5, 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/0")
    sink = work_path(spark, "sink")
    settle(spark, folder, sink, work_path(spark, "marks"))
    assert read_changes(spark, sink) == [(1, 0, 1, None, 0)]
    assert spark.conf.get(changes.STORE, None) != changes.ROCKSDB


# --- windows ----------------------------------------------------------------------------------------


def window_rows(spark, sink):
    rows = spark.read.parquet(sink).collect()
    return sorted((int((r.window_start - START).total_seconds()), r.n, r.n_high, r.n_medium, r.n_low) for r in rows)


def test_windows_count_in_time_and_drop_late_records(spark, tmp_path):
    """Three files: out of order within the delay, then one record far too late, then one that closes the rest."""
    folder = str(tmp_path / "in")
    first = [(1, 5, 1, 0), (1, 65, 2, 1), (2, 20, 3, 2), (2, 190, 4, 0)]
    for k, rows in enumerate([first, [(1, 150, 5, 1)], [(1, 10, 6, 0)], [(3, 1000, 7, 2)]]):
        arrive(spark, folder, f"{k:03d}", rows)
    sink = work_path(spark, "sink")
    counted = windows.sliding_alerts(stream(spark, folder), "ts", "60 seconds", "120 seconds", "60 seconds")
    run = windows.write_windows(counted, sink, work_path(spark, "marks"))
    run.awaitTermination()
    assert windows.late_rows(run) > 0
    counts = {}
    for _, s, _, p in [*first, (1, 150, 5, 1)]:  # the record at 10 s is late for both of its windows
        for start in (s // 60 * 60, s // 60 * 60 - 60):
            n = counts.setdefault(start, [0, 0, 0, 0])
            n[0] += 1
            n[p + 1] += 1
    assert window_rows(spark, sink) == sorted((k, *v) for k, v in counts.items() if k + 120 <= 940)


def test_sessions_merge_across_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k, rows in enumerate([[(1, 0, 1, 0), (1, 50, 2, 1), (2, 0, 3, 2), (3, 0, 8, 1)], [(1, 25, 4, 1), (1, 80, 5, 0), (2, 30, 6, 0), (3, 31, 9, 1)], [(5, 900, 7, 0)]]):
        arrive(spark, folder, f"{k:03d}", rows)
    sink = work_path(spark, "sink")
    run = windows.write_windows(windows.session_alerts(stream(spark, folder), "id", "ts", "60 seconds", "30 seconds"), sink, work_path(spark, "marks"))
    run.awaitTermination()
    rows = spark.read.parquet(sink).collect()
    got = sorted((r.id, int((r.window_start - START).total_seconds()), int((r.window_end - START).total_seconds()), r.n) for r in rows)
    assert got == [(1, 0, 110, 4), (2, 0, 60, 2), (3, 0, 30, 1), (3, 31, 61, 1)]  # a record at a session's end joins it


# --- as-of join ---------------------------------------------------------------------------------------


def test_asof_join_equals_a_plain_search(spark):
    """One entity has half of all rows; equal times, entities without scores, null keys and times, repeated events."""
    rng = random.Random(4)
    pick = lambda: rng.choice([1] * 8 + [2, 3, 4, 5, 6, 7, 8, None])
    events = [(i, pick(), None if rng.random() < 0.03 else at(rng.randrange(400))) for i in range(600)]
    events += events[:5]
    scores = [(k, None if rng.random() < 0.03 else at(rng.randrange(50, 400)), i, i % 3) for i, k in enumerate([pick() for _ in range(500)]) if k != 5]
    e = spark.createDataFrame(events, "event_id long, id long, ts timestamp").repartition(3)
    s = spark.createDataFrame(scores, "id long, ts timestamp, tie long, pred int").repartition(4)

    def latest(k, ts):
        mine = [(t, tie, p) for j, t, tie, p in scores if k is not None and j == k and t is not None and ts is not None and t <= ts]
        t, tie, p = max(mine, default=(None, None, None))
        return t, tie, p

    key = lambda r: tuple((v is None, v) if not isinstance(v, dt.datetime) else (False, v.timestamp()) for v in r)
    want = sorted(((i, k, ts, *latest(k, ts)) for i, k, ts in events), key=key)
    for buckets in (1, 7):
        rows = asof_join(e, s, "id", "ts", ["tie", "pred"], "tie", buckets)
        assert sorted((tuple(r) for r in rows.collect()), key=key) == want
    kept = asof_join(e, s, "id", "ts", ["tie", "pred"], "tie", inner=True)
    assert sorted((tuple(r) for r in kept.collect()), key=key) == [r for r in want if r[3] is not None]
    assert asof_join(e, s.where("false"), "id", "ts", ["pred"], "tie").where(F.col("pred").isNotNull()).isEmpty()
    assert asof_join(e.where("false"), s, "id", "ts", ["pred"], "tie").isEmpty()


class Store:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def get(self):
        return self._call(self.held.get(()))

    def update(self, value):
        self._call(self.held.update({(): value}))

    def updateValue(self, key, value):
        self._call(self.held.update({key: value}))

    def removeKey(self, key):
        self._call(self.held.pop(key))

    def iterator(self):
        return self._call(iter(list(self.held.items())))


class Handle(changes.StatefulProcessorHandle):
    def __init__(self):
        self.stores, self.timers = {}, set()
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.discard, lambda: iter(set(self.timers))

    def getValueState(self, name, *schemas):
        return self.stores.setdefault(name, Store())

    getMapState = getValueState


@pytest.mark.parametrize("part", [3, 1 << 16])
def test_an_entity_costs_few_calls_to_the_store(monkeypatch, part):
    """600 records in three batches, in any order, with equal times and records that arrive again with another class."""
    monkeypatch.setattr(changes, "PART", part)
    rng = random.Random(part)
    mark, handle, latest, got = 0, Handle(), {}, []
    times = lambda: type("T", (), {"getCurrentWatermarkInMs": lambda self: mark, "getExpiryTimeInMs": lambda self: mark})()
    state = changes.ClassChanges()
    state.init(handle)
    for k in range(3):
        rows = [(rng.randrange(max(1, 300 * k - 100), 300 * (k + 1)) * 1000, rng.randrange(3), rng.randrange(3)) for _ in range(200)]
        latest |= {r[:2]: r[2] for r in rows if r[0] > mark * 1000}
        frames = [pd.DataFrame([(7, None, *r) for r in some]) for some in (rows[:90], rows[90:])]
        assert not list(state.handleInputRows((7,), iter(frames), times()))
        mark = 300 * (k + 1) - 150
        while handle.timers and min(handle.timers) <= mark:
            at = min(handle.timers)
            due = type("D", (), {"getExpiryTimeInMs": lambda self: at})()
            got += [r for frame in state.handleExpiredTimer((7,), times(), due) for r in frame.itertuples(index=False)]
            handle.timers.discard(at)
    want, before = [], None
    for (ts, tie), pred in sorted(latest.items()):
        if ts <= mark * 1000 and pred != before:
            want.append((7, ts, tie, before, pred))
        before = pred
    assert [(r[0], r[1], r[2], None if pd.isna(r[3]) else r[3], r[4]) for r in got] == want
    if part > 200:
        assert sum(s.calls for s in handle.stores.values()) < 40
