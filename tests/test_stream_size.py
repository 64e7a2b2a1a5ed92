"""Streams of very many rows: what a flush holds and what a key costs stays bounded."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from eventloom.streaming import ordered


class Memory:
    """State in memory of one group, with its calls counted."""

    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getValueState(self, name, *schemas):
        return State(self.calls)

    getMapState = getListState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class State:
    def __init__(self, calls):
        self.calls, self.rows, self.value, self.list = calls, {}, None, []

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "put", "appendList", "getValue", "updateValue", "removeKey"):
            object.__getattribute__(self, "calls")[name] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.list) if self.list else self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.list = None, []

    def put(self, rows):
        self.list = list(rows)

    def appendList(self, rows):
        self.list += rows

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[tuple(key)] = value

    def removeKey(self, key):
        del self.rows[key]

    def containsKey(self, key):
        return key in self.rows


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(processor, rows, marks, columns):
    """Frames of results: a share of the rows comes before each mark of the watermark, in frames of 2,000."""
    handle, frames, before = Memory(), [], 0
    processor.init(handle)
    for mark in marks:
        now = [r for r in rows if before <= r[1] < mark + 500]  # some that are not due yet
        rows = [r for r in rows if not before <= r[1] < mark + 500]
        if now:
            processor.handleInputRows((7,), iter([pd.DataFrame(now[a : a + 2000], columns=columns) for a in range(0, len(now), 2000)]), None)
        frames += [f for f in processor.handleExpiredTimer((7,), Mark(mark), None) if len(f)]
        before = mark + 500
    assert not rows
    return handle, frames


def counted(rows, limit, width):
    open_, want = {}, []
    for key, ms, i in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n = open_.get(key, (None, 0))
        if start is None or start + width < ms:
            start, n = ms, 0
        open_[key] = (start, n + 1)
        want.append((key, i, n + 1, n + 1 <= limit))
    return sorted(want)


@pytest.mark.parametrize("keys", [1, 3000])
def test_rows_of_a_flush(monkeypatch, keys):
    for name, value in (("BUFFER", 5000), ("BLOCK", 100), ("MOST", 1000), ("FRAME", 500)):
        monkeypatch.setattr(ordered, name, value, raising=False)
    rnd = random.Random(keys)
    rows = [(rnd.randrange(keys), rnd.randrange(1_000_000) + (10**12 if rnd.random() < 0.5 else 10**12 + 400_000), i) for i in range(40_000)]
    loaded, sorted_ = [], ordered.InOrder._runs if hasattr(ordered.InOrder, "_runs") else None

    def watched(self, *a):
        for run_ in sorted_(self, *a):
            loaded.append(len(run_))
            yield run_

    if sorted_:
        monkeypatch.setattr(ordered.InOrder, "_runs", watched)
    handle, frames = run(ordered.FixedWindow(3, 5000), rows, [10**12 + 300_000, 10**12 + 900_000, 1 << 60], ["key", "ms", "event_id"])
    got = sorted(tuple(r) for f in frames for r in f.itertuples(index=False))
    assert got == counted(rows, 3, 5000)
    assert max(map(len, frames)) <= 500 and max(loaded) <= 2000
    assert sum(handle.calls.values()) < len(rows) / 2


def test_rows_of_one_moment(monkeypatch):
    """A span can't be cut below a ms: its rows come out whole."""
    monkeypatch.setattr(ordered, "MOST", 10)
    rows = [(1, 10**12 + i % 2, i) for i in range(300)]
    _, frames = run(ordered.FixedWindow(100, 5000), rows, [10**12 + 1000, 1 << 60], ["key", "ms", "event_id"])
    assert sorted(tuple(r) for f in frames for r in f.itertuples(index=False)) == counted(rows, 100, 5000)


def test_newest_health_of_a_flush():
    rows = [(k, 10**12 + 10 * i + k, i, float(i % 9), ["success", "failed", "partial"][(i + k) % 3]) for i in range(5000) for k in range(3)]
    _, frames = run(ordered.Health(), rows, [10**12 + 20_000, 1 << 60], ["key", "started_ms", "id", "found", "status"])
    told = defaultdict(list)
    for r in (tuple(r) for f in frames for r in f.itertuples(index=False)):
        told[r[0]].append(r)
    for k in range(3):
        known, want = {"is": None}, []
        for row in sorted(r[1:] for r in rows if r[0] == k):
            want += ordered.Health().step(known, row)
        assert [x[1:] for x in told[k]] == [[w for w in want if w[3] < 10**12 + 20_000][-1], want[-1]]


def test_rows_without_a_key(spark):
    from tests.test_ordered_streams import slices_of

    rows = [(1000 * i, [None, 0, 5][i % 3], i) for i in range(30)]
    found = ordered.run_slices(slices_of(spark, rows, "ms long, user_id long, event_id long", 1, 2), lambda s: ordered.rate_limit(s, 4, 900_000), "t").collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == [(u, i, i // 3 + 1, i // 3 < 4) for _, u, i in rows]
