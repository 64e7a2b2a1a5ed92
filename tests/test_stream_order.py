"""Streams do not depend on where Arrow batches are cut."""

import datetime as dt
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventloom import catalog
from eventloom.session import ship_package


@pytest.fixture
def small_batches(spark):
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    yield
    spark.conf.set(name, before)


def test_rate_limit(spark, tmp_path, small_batches):
    rows = [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (40 - i))) for i in range(40) for u in (1, 2)]
    pq.write_table(pa.table({"user_id": [r[0] for r in rows], "event_id": [r[1] for r in rows], "ts": pa.array([r[2] for r in rows], pa.timestamp("us"))}), tmp_path / "events.parquet")
    start, n, want = {}, defaultdict(int), set()
    for u, i, ts in sorted(rows, key=lambda r: r[2]):
        if u not in start or ts - start[u] >= dt.timedelta(days=1):
            start[u], n[u] = ts, 0
        n[u] += 1
        want.add((u, i, n[u], n[u] <= 5))
    found = catalog.queries()["stream_rate_limit"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_health(spark, tmp_path, small_batches):
    rows = [(10 * i + 3, dt.datetime(1995, 1, 1) + dt.timedelta(days=(60 - i) * 11), "O" if i < 20 else "F") for i in range(60)]
    pq.write_table(pa.table({"o_orderkey": [r[0] for r in rows], "o_orderdate": pa.array([r[1] for r in rows], pa.timestamp("us")), "o_orderstatus": [r[2] for r in rows]}), tmp_path / "orders.parquet")
    mean, failures, status = 0.0, 0, "unknown"
    for k, _, kind in sorted(rows, key=lambda r: r[1]):
        if kind == "F":
            mean, failures, status = (float(k % 50) if mean == 0 else 0.7 * mean + 0.3 * (k % 50)), 0, "healthy"
        elif kind == "O":
            failures += 1
            status = "dead" if failures >= 5 else "failing" if failures >= 3 else "degraded"
        else:
            status = "degraded"
    found = catalog.queries()["stream_health"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(3, round(mean, 6), failures, status)]


def test_lockout(spark, tmp_path, small_batches):
    rows = [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i), (i * 7 + u) % 9) for i in range(60) for u in (1, 2)]
    pq.write_table(pa.table({"user_id": [r[0] for r in rows], "event_id": [r[1] for r in rows], "ts": pa.array([r[2] for r in rows], pa.timestamp("us")), "props": [f'{{"k": {r[3]}}}' for r in rows]}), tmp_path / "events.parquet")
    failures, until, want = defaultdict(int), {}, set()
    for u, i, ts, k in sorted(rows, key=lambda r: r[2]):
        if u in until and ts < until[u]:
            want.add((u, i, "locked"))
        elif k % 3 == 0:
            failures[u] = 0
            want.add((u, i, "ok"))
        else:
            failures[u] += 1
            if failures[u] >= 3:
                failures[u], until[u] = 0, ts + dt.timedelta(days=2)
            want.add((u, i, "failed"))
    found = catalog.queries()["stream_lockout"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(rows)


def test_heartbeats(spark, tmp_path):
    """Two batches: jobs whose last heartbeat is older than the limit come out once the watermark has passed them."""
    from eventloom.session import ship_package
    from eventloom.streaming import jobs

    ship_package(spark)
    base = dt.datetime(2024, 1, 1)
    for n, beats in enumerate([[(1, 0), (2, 0), (2, 8)], [(2, 9), (3, 30)], [(3, 31)]]):
        pq.write_table(pa.table({"job_id": [b[0] for b in beats], "ts": pa.array([base + dt.timedelta(minutes=b[1]) for b in beats], pa.timestamp("us", "UTC"))}), tmp_path / f"{n}.parquet")
    s = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    from pyspark.sql import functions as F

    out = jobs.run_to_table(jobs.silent_jobs(s.withColumn("ms", F.unix_millis("ts")), 300_000), "beats").collect()
    start = int(base.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert {tuple(r) for r in out} == {(1, start), (2, start + 9 * 60_000)}
