"""Stateful streams whose results do not depend on how rows arrive: a key's rows wait until the watermark has passed them and are
then taken in the order of event time.

Keys are dealt over a fixed number of buckets, and a bucket is what Spark groups by, as each group costs a frame and several calls of
the state. `InOrder` holds a bucket's waiting rows in map state, packed in blocks of a span of event time, so that a flush has a bounded
number of rows in memory at a time. One timer a bucket stands at the first thing that is due. What a processor knows of a bucket's keys is loaded once
for a flush and what has changed is saved after it; deadlines of its own (leases, locks, ends of windows) are due in event time like
rows are, and state that has run out is dropped by them, so no key stays for good. Rows that are later than the watermark allows are
dropped by Spark.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections import defaultdict
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: Groups that keys are dealt over; rows that are held before they are packed, and that a block should have; rows that a flush loads at
#: a time; rows of a frame of results. Spans are powers of eight ms, WIDEST at most.
BUCKETS, BUFFER, BLOCK, MOST, FRAME, WIDEST = 256, 1 << 16, 1 << 10, 1 << 17, 1 << 13, 8**14


class InOrder(StatefulProcessor):
    """Calls `step` with a key's rows in order. Rows begin with ms (event time) and seq (what settles equal times)."""

    #: Schema of the rows that are kept, ms and seq first; columns of the output behind the key's.
    row_schema = "ms long, seq long"
    out: list[str] = []
    #: Only the last result that a flush has for a key is told.
    newest_only = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = ["key", *(f.split()[0] for f in self.row_schema.split(", "))]
        self.waiting = handle.getMapState("waiting", "first long, last long, n long, size long", "block binary")
        self.alarm = handle.getValueState("alarm", "ms long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        first, new = [], []
        for frame in rows:
            own = [frame[c].tolist() for c in self.columns]
            new += zip(own[0], zip(*own[1:], strict=True), strict=True)
            if len(new) >= BUFFER:
                first, new = [min([*first, *(n[0] for n in self._keep(new))])], []
        self._wake(min([*first, *(n[0] for n in self._keep(new))]) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()  # all rows before it are here
        frame = lambda out: pd.DataFrame([(None if key[0] < 0 else k, *o) for k, o in out], columns=self.out)
        every, out, newest = self.load(), [], {}
        for run in self._runs([tuple(n) for n in self.waiting.keys()], WIDEST, mark):
            for k, rows in groupby(run, lambda r: r[0]):
                if k not in every:
                    every[k] = self.fresh()
                known, told = every[k], []
                for _, row in rows:
                    told += self.due(known, row[0])
                    told += self.step(known, row)
                if self.newest_only:
                    newest.update((k, o) for o in told[-1:])
                else:
                    out += [(k, o) for o in told]
            while len(out) >= FRAME:
                yield frame(out[:FRAME])
                out = out[FRAME:]
        for k, known in every.items():
            told = self.due(known, mark - 1)
            out += [(k, o) for o in told]
        self.save(every)
        self.alarm.clear()
        ahead = [n[0] for n in self.waiting.keys()] + [t for t in map(self.deadline, every.values()) if t is not None]
        if ahead:
            self._wake(min(ahead) + 1)
        out += newest.items()
        for at in range(0, len(out), FRAME):
            yield frame(out[at : at + FRAME])

    def _keep(self, rows: list[tuple], width: int | None = None) -> list[tuple]:
        """Let rows (key, row) wait, a block for each span of so many ms, or of as many as fill blocks; the blocks' names: first and last
        time, number, size."""
        if width is None:
            width, least = WIDEST, max((max(r[1][0] for r in rows) - min(r[1][0] for r in rows)) * BLOCK // len(rows), 1) if rows else 1
            while width // 8 >= least:
                width //= 8
        spans = defaultdict(list)
        for r in rows:
            spans[r[1][0] // width].append(r)
        names = []
        for own in spans.values():
            times = [r[1][0] for r in own]
            names.append((min(times), max(times), uuid.uuid4().int >> 65, len(own)))
            self.waiting.updateValue(names[-1], (pickle.dumps([[r[0] for r in own], *zip(*(r[1] for r in own))], 5),))
        return names

    def _take(self, name: tuple) -> list[tuple]:
        """The rows of a block, which no longer waits."""
        keys, *columns = pickle.loads(bytes(self.waiting.getValue(name)[0]))
        self.waiting.removeKey(name)
        return list(zip(keys, zip(*columns)))

    def _runs(self, names: list[tuple], width: int, mark: int):
        """The waiting rows before mark in sorted lists, span after span. A span of too many rows is cut into finer ones, down to a
        single ms."""
        spans = defaultdict(list)
        for name in names:
            if name[0] < mark:
                whole = name[0] // width == name[1] // width
                for part in [name] if whole else self._keep(self._take(name), width):
                    spans[part[0] // width].append(part)
        for at in sorted(spans):
            own = [name for name in spans[at] if name[0] < mark]
            if width > 1 and sum(n[3] for n in own) > MOST:
                yield from self._runs(own, width // 8, mark)
                continue
            ready, later = [], []
            for name in own:
                for r in self._take(name):
                    (ready if r[1][0] < mark else later).append(r)
            if later:
                self._keep(later)
            yield sorted(ready)

    def _wake(self, ms: int) -> None:
        if self.alarm.exists():
            before = self.alarm.get()[0]
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def close(self) -> None:
        pass

    # what a processor adds

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Get the state that holds what is known of a bucket's keys."""

    def load(self) -> dict:
        """What is known of each key, as objects that step and due change."""

    def fresh(self):
        """What is known of a new key."""

    def save(self, every: dict) -> None:
        """Keep what has changed, or drop it where it has run out."""

    def step(self, known, row) -> list[tuple]:
        """Take a row."""
        raise NotImplementedError

    def due(self, known, now: int) -> list[tuple]:
        """Take deadlines up to now."""
        return []

    def deadline(self, known) -> int | None:
        """The next deadline."""
        return None


class _OneValue(InOrder):
    """A processor that knows one tuple of a key, and forgets it at a deadline."""

    state_schema = ""

    def open(self, handle):
        self.values = handle.getMapState("known", "key long", self.state_schema)

    def load(self):
        self.before = {k[0]: tuple(v) for k, v in self.values.iterator()}
        return {k: {"is": v} for k, v in self.before.items()}

    def fresh(self):
        return {"is": None}

    def save(self, every):
        for k, known in every.items():
            was = self.before.get(k)
            if known["is"] is None:
                if was is not None:
                    self.values.removeKey((k,))
            elif known["is"] != was:
                self.values.updateValue((k,), known["is"])

    def due(self, known, now):
        until = self.deadline(known)
        if until is not None and until <= now:
            known["is"] = None
        return []


class FixedWindow(_OneValue):
    """Counts calls in windows that begin with a key's first call; says which are over the limit. A call at the very end of a window
    still belongs to it."""

    row_schema, state_schema = "ms long, event_id long", "start long, n long"
    out = ["user_id", "event_id", "n", "allowed"]

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def step(self, known, row):
        ms, event_id = row
        start, n = known["is"] or (ms, 0)
        known["is"] = (start, n + 1)
        return [(event_id, n + 1, n + 1 <= self.limit)]

    def deadline(self, known):
        return None if known["is"] is None else known["is"][0] + self.window_ms + 1


class Lockout(_OneValue):
    """`limit` failures in a row lock an account for a while; a success forgets them, and so does a day without attempts."""

    row_schema, state_schema = "ms long, event_id long, ok boolean", "failures long, until long, last long"
    out = ["user_id", "event_id", "outcome"]

    def __init__(self, limit: int, lock_ms: int, idle_ms: int | None = None):
        self.limit, self.lock_ms, self.idle_ms = limit, lock_ms, idle_ms

    def step(self, known, row):
        ms, event_id, ok = row
        failures, until, _ = known["is"] or (0, 0, 0)
        if ms < until:
            return [(event_id, "locked")]
        failures = 0 if ok else failures + 1
        if failures >= self.limit:
            failures, until = 0, ms + self.lock_ms
        known["is"] = (failures, until, ms) if failures or until > ms else None
        return [(event_id, "ok" if ok else "failed")]

    def deadline(self, known):
        if known["is"] is None:
            return None
        failures, until, last = known["is"]
        if not failures:
            return until
        return None if self.idle_ms is None else max(until, last + self.idle_ms)


class Health(_OneValue):
    """A source's moving mean of counts, its failures in a row and its health, after every flush. Only successes enter the mean, which
    starts anew after zero; a partial run degrades the health and leaves the rest."""

    row_schema, state_schema = "started_ms long, id long, found double, status string", "mean double, failures long, status string, at long"
    out = ["source_id", "mean", "failures", "status", "at"]
    newest_only = True

    def step(self, known, row):
        ms, _, found, outcome = row
        mean, failures, status, _ = known["is"] or (0.0, 0, "unknown", 0)
        if outcome == "success":
            mean, failures, status = (found if mean == 0 else 0.7 * mean + 0.3 * found), 0, "healthy"
        elif outcome == "failed":
            failures += 1
            status = "dead" if failures >= 5 else "failing" if failures >= 3 else "degraded"
        elif outcome == "partial":
            status = "degraded"
        known["is"] = (mean, failures, status, ms)
        return [(round(mean, 6), failures, status, ms)]


class Silences(_OneValue):
    """Jobs that give no sign of life for longer than a limit: each silence is told once, when the limit has passed."""

    row_schema, state_schema = "ms long, event_id long", "last long, n long"
    out = ["job_id", "silent_since", "beats"]

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def step(self, known, row):
        known["is"] = (row[0], (known["is"] or (0, 0))[1] + 1)
        return []

    def deadline(self, known):
        return None if known["is"] is None else known["is"][0] + self.limit_ms + 1

    def due(self, known, now):
        was = known["is"]
        super().due(known, now)
        return [was] if was is not None and known["is"] is None else []


#: Fixed values: (tries, first delay in s) of each kind of job; delays double up to an hour.
RETRIES = {"crawl": (3, 60), "classify": (2, 30), "score": (2, 30), "geocode": (3, 10), "ingest": (5, 5)}
#: How long a job is remembered: as long as another with its key counts as the same, and dead ones.
KEPT, KEPT_DEAD = DAY, 7 * DAY
_QUEUED, _RUNNING, _DONE = "queued", "running", ("success", "dlq")


class JobQueue(InOrder):
    """The jobs of a domain: priorities, delays, leases, at most `slots` running, one running for each source, retries, dead letters.

    Commands: `enqueue` (a job's key, kind, source, priority, delay) unless a job with that key is remembered; `pull` gives a worker the
    queued job that is ready and has the least score (time of entry + delay - priority seconds), if the domain has a free slot and the
    source no lock; `done` and `fail` end what the worker runs. A job whose lease runs out is given out again (its try counts), or is
    dead when its tries are used up; so is one that fails for the last time. A lock holds until its job ends or for `lock_ms`.
    """

    row_schema = "ms long, seq long, command string, job string, kind string, source long, priority long, delay_ms long, worker long"
    out = ["domain", "job", "ms", "seq", "state", "attempts", "worker"]

    def __init__(self, slots: int = 2, visible_ms: int = 300_000, lock_ms: int = 600_000):
        self.slots, self.visible_ms, self.lock_ms = slots, visible_ms, lock_ms

    def open(self, handle):
        # state, kind, source, score, ready or lease end or time of ending, attempts, worker (-1: none), serial number
        self.jobs = handle.getMapState("jobs", "key long, job string", "state string, kind string, source long, score long, until long, attempts long, worker long, serial long")
        self.locks = handle.getMapState("locks", "key long, source long", "until long, job string")

    def load(self):
        jobs, locks = defaultdict(dict), defaultdict(dict)
        for k, v in self.jobs.iterator():
            jobs[k[0]][k[1]] = list(v)
        for k, v in self.locks.iterator():
            locks[k[0]][k[1]] = tuple(v)
        return {k: self.fresh(jobs[k], locks[k]) for k in {*jobs, *locks}}

    def fresh(self, jobs=None, locks=None):
        jobs = {} if jobs is None else jobs
        heap = [(j[3], j[7], k) for k, j in jobs.items() if j[0] == _QUEUED]
        heapq.heapify(heap)
        ends = [(self._end(j), j[7], k) for k, j in jobs.items() if j[0] != _QUEUED]
        heapq.heapify(ends)
        return {"jobs": jobs, "locks": {} if locks is None else locks, "queue": heap, "ends": ends, "changed": set(), "freed": set(), "running": {k for k, j in jobs.items() if j[0] == _RUNNING}}

    def save(self, every):
        for key, known in every.items():
            for state, now, changed in ((self.jobs, known["jobs"], known["changed"]), (self.locks, known["locks"], known["freed"])):
                for k in changed:
                    if k in now:
                        state.updateValue((key, k), tuple(now[k]))
                    elif state.containsKey((key, k)):
                        state.removeKey((key, k))

    @staticmethod
    def _end(job):
        """When a job that isn't queued is due: its lease ends, or it is forgotten."""
        return job[4] + (0 if job[0] == _RUNNING else KEPT if job[0] == "success" else KEPT_DEAD)

    def _put(self, known, key, job):
        known["jobs"][key] = job
        known["changed"].add(key)
        if job[0] == _QUEUED:
            heapq.heappush(known["queue"], (job[3], job[7], key))
        else:
            heapq.heappush(known["ends"], (self._end(job), job[7], key))

    def _stop(self, known, key, job):
        """The job no longer runs: its slot is free, and its source's lock if it is still its own."""
        known["running"].discard(key)
        if known["locks"].get(job[2], (0, None))[1] == key:
            del known["locks"][job[2]]
            known["freed"].add(job[2])

    def _again(self, known, key, job, ms, seq, wait, told):
        """A try is over without success: queue the job again, or give it up."""
        self._stop(known, key, job)
        if job[5] < RETRIES.get(job[1], (3, 60))[0]:
            self._put(known, key, [_QUEUED, job[1], job[2], ms + wait, ms + wait, job[5], -1, job[7]])
            return [(key, ms, seq, told, job[5], job[6])]
        self._put(known, key, ["dlq", job[1], job[2], job[3], ms, job[5], job[6], job[7]])
        return [(key, ms, seq, "dlq", job[5], job[6])]

    def due(self, known, now):
        out, ends = [], known["ends"]
        while ends and ends[0][0] <= now:
            at, _, key = heapq.heappop(ends)
            job = known["jobs"].get(key)
            if job is None or job[0] == _QUEUED or self._end(job) != at:
                continue  # it has changed since
            if job[0] == _RUNNING:
                out += self._again(known, key, job, at, -1, 0, "expired")
            else:
                del known["jobs"][key]
                known["changed"].add(key)
        return out

    def deadline(self, known):
        ends = known["ends"]
        while ends and ((job := known["jobs"].get(ends[0][2])) is None or job[0] == _QUEUED or self._end(job) != ends[0][0]):
            heapq.heappop(ends)
        return ends[0][0] if ends else None

    def step(self, known, row):
        ms, seq, command, key, kind, source, priority, delay_ms, worker = row
        if command == "enqueue":
            if key in known["jobs"]:
                return [(key, ms, seq, "duplicate", known["jobs"][key][5], -1)]
            self._put(known, key, [_QUEUED, kind, source, ms + delay_ms - 1000 * priority, ms + delay_ms, 0, -1, seq])
            return [(key, ms, seq, _QUEUED, 0, -1)]
        if command == "pull":
            return self._pull(known, ms, seq, worker)
        mine = [(known["jobs"][k][4], k) for k in known["running"] if known["jobs"][k][6] == worker]
        if not mine:
            return []
        key = max(mine)[1]
        job = known["jobs"][key]
        if command == "fail":
            _, first = RETRIES.get(job[1], (3, 60))
            return self._again(known, key, job, ms, seq, min(1000 * first * 2 ** (job[5] - 1), 3_600_000), "retry")
        self._stop(known, key, job)
        self._put(known, key, ["success", job[1], job[2], job[3], ms, job[5], worker, job[7]])
        return [(key, ms, seq, "success", job[5], worker)]

    def _pull(self, known, ms, seq, worker):
        if len(known["running"]) >= self.slots:
            return []
        passed, out = [], []
        while known["queue"] and not out:
            score, serial, key = heapq.heappop(known["queue"])
            job = known["jobs"].get(key)
            if job is None or job[0] != _QUEUED or (job[3], job[7]) != (score, serial):
                continue
            if job[4] > ms or known["locks"].get(job[2], (0, None))[0] > ms:
                passed.append((score, serial, key))
                continue
            known["locks"][job[2]] = (ms + self.lock_ms, key)
            known["freed"].add(job[2])
            known["running"].add(key)
            self._put(known, key, [_RUNNING, job[1], job[2], job[3], ms + self.visible_ms, job[5] + 1, worker, job[7]])
            out.append((key, ms, seq, _RUNNING, job[5] + 1, worker))
        for entry in passed:
            heapq.heappush(known["queue"], entry)
        return out


def _keyed(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    """rows (ts and the processor's columns) by key, each key's in order once the watermark has passed them. Rows without a key are a
    bucket of their own."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")
    dealt = rows.withWatermark("ts", late).where(F.col("ts") < end_of_time()).withColumns({"bucket": bucket, "key": F.coalesce(F.col(key).cast("long"), F.lit(0))})
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def end_of_time() -> Column:
    """A row from here on only moves the watermark: it says that a stream is over."""
    return F.lit("9000-01-01 00:00:00+00:00").cast("timestamp")


def rate_limit(calls: DataFrame, limit: int, window_ms: int, late: str = "2 hours") -> DataFrame:
    """(user_id, event_id, n, allowed) for calls (ts, user_id, event_id, ms)."""
    return _keyed(calls, "user_id", FixedWindow(limit, window_ms), "user_id long, event_id long, n long, allowed boolean", late)


def lockouts(logins: DataFrame, limit: int = 5, lock_ms: int = 900_000, idle_ms: int | None = None, late: str = "2 hours") -> DataFrame:
    """(user_id, event_id, outcome) for logins (ts, user_id, event_id, ms, ok)."""
    return _keyed(logins, "user_id", Lockout(limit, lock_ms, idle_ms), "user_id long, event_id long, outcome string", late)


def source_health(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """(source_id, mean, failures, status, at) after each flush of runs (ts, source_id, id, started_ms, found, status)."""
    return _keyed(runs, "source_id", Health(), "source_id long, mean double, failures long, status string, at long", late)


def silences(beats: DataFrame, limit_ms: int, late: str = "2 hours") -> DataFrame:
    """(job_id, silent_since, beats before it) for signs of life (ts, job_id, event_id, ms)."""
    return _keyed(beats, "job_id", Silences(limit_ms), "job_id long, silent_since long, beats long", late)


def job_queue(commands: DataFrame, slots: int = 2, visible_ms: int = 300_000, lock_ms: int = 600_000, late: str = "2 hours") -> DataFrame:
    """(domain, job, ms, seq, state, attempts, worker): what happens to each job, for commands (ts, domain and JobQueue's columns);
    seq is -1 where a lease has run out."""
    return _keyed(commands, "domain", JobQueue(slots, visible_ms, lock_ms), "domain long, job string, ms long, seq long, state string, attempts long, worker long", late)


def run_slices(slices: list[DataFrame], make, label: str) -> DataFrame:
    """Let slices of rows (with ts) arrive one after the other, each as a micro-batch of its own; then end the stream. make: stream of
    these rows -> stream of results. All results come out as a table of the shared folder; the stream is started anew for every
    slice and goes on from its checkpoint."""
    from eventloom.session import fresh_path

    spark = slices[0].sparkSession
    inbox, path, state = (fresh_path(spark, f"{label}{x}") for x in ("-inbox", "", "-state"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what stateful processors need

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    schema = slices[0].schema
    end = slices[0].sparkSession.range(1).select(*[end_of_time().alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    try:
        for rows in [*slices, end]:
            rows.write.mode("append").parquet(inbox)
            out = make(spark.readStream.schema(schema).parquet(inbox))
            out.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(path)


def arriving(rows: DataFrame, by: str, seconds: int, n: int) -> list[DataFrame]:
    """rows (with ts) in n slices as they would arrive when each is up to `seconds` late, by a hash of column `by`."""
    at = F.col("ts").cast("long") + F.pmod(F.xxhash64(by), F.lit(seconds))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        return [rows]
    width = max(1, -(-(last - first + 1) // n))
    return [rows.where(F.floor((at - first) / width) == k) for k in range(n)]
