"""Streams in event time: any way to cut and delay arrivals gives the rows of a plain run over the sorted table."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from eventloom import catalog
from eventloom.session import ship_package
from eventloom.streaming import ordered

BASE = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def slices_of(spark, rows, schema, seed, n, late_s=3600):
    """rows (ms first) in n slices by a random arrival up to late_s after their time."""
    ship_package(spark)
    rnd = random.Random(seed)
    by_arrival = sorted(rows, key=lambda r: (r[0] + rnd.random() * late_s * 1000))
    cut = sorted(rnd.sample(range(1, len(rows)), n - 1)) if n > 1 else []
    parts = [by_arrival[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
    return [spark.createDataFrame([(BASE + dt.timedelta(milliseconds=r[0]), *shifted(r)) for r in p], f"ts timestamp, {schema}") for p in parts]


def shifted(r):
    return (int(BASE.timestamp() * 1000) + r[0], *r[1:])


def test_rate_limit_in_any_slices(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(4 * 3600) * 1000, rnd.randrange(5), i) for i in range(300)]
    want, open_ = set(), {}
    for ms, user, i in sorted(rows, key=lambda r: (r[0], r[2])):
        start, n = open_.get(user, (None, 0))
        if start is None or start + 900_000 < ms:
            start, n = ms, 0
        open_[user] = (start, n + 1)
        want.add((user, i, n + 1, n + 1 <= 3))
    for seed, n in ((1, 1), (2, 3), (3, 5)):
        parts = slices_of(spark, rows, "ms long, user_id long, event_id long", seed, n)
        got = [tuple(r) for r in ordered.run_slices(parts, lambda s: ordered.rate_limit(s, 3, 900_000), "t").collect()]
        assert len(got) == len(rows) and set(got) == want


def simulate(rows, slots, visible, lock):
    """The queue of one domain by plain lists, searched anew for everything."""
    jobs, locks, log = {}, {}, []

    def over(job, ms, seq, wait, told):
        j = jobs[job]
        if locks.get(j["source"], (0, ""))[1] == job:
            del locks[j["source"]]
        tries = ordered.RETRIES[j["kind"]][0]
        if j["n"] < tries:
            log.append((job, ms, seq, told, j["n"], j["worker"]))
            j.update(state="queued", score=ms + wait, ready=ms + wait, worker=-1)
        else:
            log.append((job, ms, seq, "dlq", j["n"], j["worker"]))
            j.update(state="dlq", forget=ms + 7 * ordered.DAY)

    def until(now):
        while True:
            due = [(j["lease"], j["serial"], k) for k, j in jobs.items() if j["state"] == "running" and j["lease"] <= now]
            due += [(j["forget"], j["serial"], k) for k, j in jobs.items() if j["state"] in ("success", "dlq") and j["forget"] <= now]
            if not due:
                return
            at, _, k = min(due)
            if jobs[k]["state"] == "running":
                over(k, at, -1, 0, "expired")
            else:
                del jobs[k]

    for ms, seq, command, job, kind, source, priority, delay, worker in sorted(rows):
        until(ms)
        running = [k for k, j in jobs.items() if j["state"] == "running"]
        if command == "enqueue":
            if job in jobs:
                log.append((job, ms, seq, "duplicate", jobs[job]["n"], -1))
            else:
                jobs[job] = {"state": "queued", "kind": kind, "source": source, "score": ms + delay - 1000 * priority, "ready": ms + delay, "n": 0, "worker": -1, "serial": seq}
                log.append((job, ms, seq, "queued", 0, -1))
        elif command == "pull":
            if len(running) < slots:
                free = [(j["score"], j["serial"], k) for k, j in jobs.items() if j["state"] == "queued" and j["ready"] <= ms and locks.get(j["source"], (0, ""))[0] <= ms]
                if free:
                    k = min(free)[2]
                    j = jobs[k]
                    j.update(state="running", n=j["n"] + 1, worker=worker, lease=ms + visible)
                    locks[j["source"]] = (ms + lock, k)
                    log.append((k, ms, seq, "running", j["n"], worker))
        else:
            own = [(jobs[k]["lease"], k) for k in running if jobs[k]["worker"] == worker]
            if own:
                k = max(own)[1]
                j = jobs[k]
                if command == "fail":
                    over(k, ms, seq, min(1000 * ordered.RETRIES[j["kind"]][1] * 2 ** (j["n"] - 1), 3_600_000), "retry")
                else:
                    if locks.get(j["source"], (0, ""))[1] == k:
                        del locks[j["source"]]
                    j.update(state="success", forget=ms + ordered.DAY)
                    log.append((k, ms, seq, "success", j["n"], worker))
    until(1 << 60)
    return log


def simulated(rows, *how):
    """rows: (domain, then simulate's columns)."""
    own = defaultdict(list)
    for domain, *row in rows:
        own[domain].append(tuple(row))
    return sorted((d, *x) for d, part in own.items() for x in simulate(part, *how))


def test_job_queue_equals_simulator(spark):
    rnd = random.Random(9)
    kinds = list(ordered.RETRIES)
    rows = []
    for i in range(900):
        k = rnd.randrange(60)
        rows.append((rnd.randrange(30 * 3600) * 1000, rnd.randrange(2), i, rnd.choice(["enqueue", "enqueue", "pull", "pull", "done", "fail"]), f"j{k}", kinds[k % 5], k % 4, rnd.choice([0, 0, 900]), rnd.choice([0, 60_000, 1_800_000]), rnd.randrange(3)))
    schema = "ms long, domain long, seq long, command string, job string, kind string, source long, priority long, delay_ms long, worker long"
    start = int(BASE.timestamp() * 1000)
    want = simulated([(r[1], start + r[0], *r[2:]) for r in rows], 2, 300_000, 600_000)
    seen = {w[4] for w in want}
    assert seen == {"queued", "running", "success", "retry", "expired", "dlq", "duplicate"}
    for seed, n in ((1, 1), (2, 6)):
        parts = slices_of(spark, rows, schema, seed, n)
        got = sorted(tuple(r) for r in ordered.run_slices(parts, lambda s: ordered.job_queue(s), "t").collect())
        assert got == want


def test_job_log_query(spark, sf_dir):
    from eventloom.plans.streams import commands

    rows = [tuple(r) for r in commands(spark, sf_dir).select("domain", "ms", "seq", "command", "job", "kind", "source", "priority", "delay_ms", "worker").collect()]
    got = sorted(tuple(r) for r in catalog.queries()["stream_job_log"](spark, sf_dir).collect())
    want = simulated(rows, 2, 3_600_000, 7_200_000)
    assert got == want and {w[4] for w in want} >= {"queued", "running", "success", "retry", "expired", "dlq"}


def test_account_lock_query(spark, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT user_id, event_id, epoch_us(ts) // 1000, CAST(json_extract(props, '$.k') AS INT) % 3 = 0 FROM '{sf_dir}/events.parquet'").fetchall()
    want, state = set(), defaultdict(lambda: [0, 0])
    for user, i, ms, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state[user]
        if ms < s[1]:
            want.add((user, i, "locked"))
            continue
        s[0] = 0 if ok else s[0] + 1
        if s[0] == 5:
            s[:] = [0, ms + 900_000]
        want.add((user, i, "ok" if ok else "failed"))
    assert {tuple(r) for r in catalog.queries()["stream_account_lock"](spark, sf_dir).collect()} == want


def test_silences_query(spark, sf_dir):
    import duckdb

    rows = duckdb.sql(f"SELECT user_id, epoch_us(ts) // 1000 FROM '{sf_dir}/events.parquet' ORDER BY 2").fetchall()
    own, want = defaultdict(list), []
    for user, ms in rows:
        own[user].append(ms)
    for user, times in own.items():
        n = 0
        for a, b in zip(times, [*times[1:], 1 << 60]):
            n += 1
            if b - a > 2 * ordered.DAY:
                want.append((user, a, n))
                n = 0
    got = [tuple(r) for r in catalog.queries()["stream_silent_jobs"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(want) > len(own)


def test_state_runs_out(spark):
    """A key that has been silent for longer than its window is forgotten: no state is left behind the end of the stream."""
    known = {"is": (0, 3)}
    window = ordered.FixedWindow(3, 1000)
    window.due(known, 1000)
    assert known["is"] == (0, 3)
    window.due(known, 1001)
    assert known["is"] is None
    lock = ordered.Lockout(2, 500, 5000)
    known = {"is": None}
    assert lock.step(known, (0, 1, False)) + lock.step(known, (1, 2, False)) + lock.step(known, (2, 3, True)) == [(1, "failed"), (2, "failed"), (3, "locked")]
    lock.due(known, 501)
    assert known["is"] is None


@pytest.mark.parametrize("name", ["stream_job_log", "stream_account_lock", "stream_silent_jobs", "stream_rate_limit", "stream_health"])
def test_empty_table(spark, tmp_path, name):
    import pyarrow.parquet as pq

    for t in ("events", "orders"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert catalog.queries()[name](spark, str(tmp_path)).collect() == []
