"""Streaming forms of the log, rate limit, deduplication and health computations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def term_counts(log: DataFrame, late: str = "1 day", width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """(window, term, n, day) over sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide)
    counts = log.withWatermark("ts", late).groupBy(w.alias("w"), "term").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("until"), "term", "n")


def first_seen(items: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once while its first row is younger than the watermark."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def in_order(rows, *columns: str):
    """A key's rows of a micro-batch in order; they come as several frames, cut wherever an Arrow batch was full."""
    import pandas as pd

    return pd.concat(list(rows)).sort_values(list(columns)).itertuples()


class FixedWindow(StatefulProcessor):
    """Counts calls in windows that begin with a key's first call; says which are over the limit. State is one pair a key."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        start, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for r in in_order(rows, "ms", "event_id"):
            if start is None or r.ms - start >= self.window_ms:
                start, n = r.ms, 0
            n += 1
            out.append((key[0], r.event_id, n, n <= self.limit))
        self.state.update((start, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n", "allowed"])

    def close(self) -> None:
        pass


class Health(StatefulProcessor):
    """A source's moving mean of counts, its failures in a row and its health. Only successes enter the mean, which starts anew
    after zero; a partial run degrades the health and leaves the rest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "mean double, failures long, status string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        mean, failures, status = self.state.get() if self.state.exists() else (0.0, 0, "unknown")
        for r in in_order(rows, "started_ms", "id"):
            if r.status == "success":
                mean, failures, status = (float(r.found) if mean == 0 else 0.7 * mean + 0.3 * r.found), 0, "healthy"
            elif r.status == "failed":
                failures += 1
                status = "dead" if failures >= 5 else "failing" if failures >= 3 else "degraded"
            elif r.status == "partial":
                status = "degraded"
        self.state.update((mean, failures, status))
        yield pd.DataFrame([(key[0], round(mean, 6), failures, status)], columns=["source_id", "mean", "failures", "status"])

    def close(self) -> None:
        pass


class Heartbeats(StatefulProcessor):
    """Jobs that were silent for longer than a limit of event time: a timer for each job, moved on by every heartbeat."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        last = self.state.get()[0] if self.state.exists() else None
        newest = max(int(f["ms"].max()) for f in rows)
        if last is None or newest > last:
            if last is not None:
                self.handle.deleteTimer(last + self.limit_ms)
            self.state.update((newest,))
            self.handle.registerTimer(newest + self.limit_ms)
        yield pd.DataFrame({"job_id": pd.Series([], dtype="int64"), "silent_since": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        last = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame([(key[0], last)], columns=["job_id", "silent_since"])

    def close(self) -> None:
        pass


class Lockout(StatefulProcessor):
    """Accounts that are locked: `limit` failures in a row lock an account for a while, a success forgets them."""

    def __init__(self, limit: int, lock_ms: int):
        self.limit, self.lock_ms = limit, lock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "failures long, until long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        failures, until = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for r in in_order(rows, "ms", "event_id"):
            if r.ms < until:
                out.append((key[0], r.event_id, "locked"))
                continue
            if r.ok:
                failures = 0
            else:
                failures += 1
                if failures >= self.limit:
                    failures, until = 0, r.ms + self.lock_ms
            out.append((key[0], r.event_id, "ok" if r.ok else "failed"))
        self.state.update((failures, until))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    def close(self) -> None:
        pass


def rate_limit(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """(user_id, event_id, n, allowed) for calls (user_id, event_id, ms)."""
    return calls.groupBy("user_id").transformWithStateInPandas(FixedWindow(limit, window_ms), "user_id long, event_id long, n long, allowed boolean", "Append", "None")


def source_health(runs: DataFrame) -> DataFrame:
    """(source_id, mean, failures, status) after each batch of runs (source_id, id, started_ms, found, status)."""
    return runs.groupBy("source_id").transformWithStateInPandas(Health(), "source_id long, mean double, failures long, status string", "Update", "None")


def lockouts(logins: DataFrame, limit: int = 5, lock_ms: int = 900_000) -> DataFrame:
    """(user_id, event_id, outcome) for logins (user_id, event_id, ms, ok)."""
    return logins.groupBy("user_id").transformWithStateInPandas(Lockout(limit, lock_ms), "user_id long, event_id long, outcome string", "Append", "None")


def silent_jobs(beats: DataFrame, limit_ms: int, late: str = "1 minute") -> DataFrame:
    """(job_id, silent_since) for heartbeats (job_id, ts, ms) when the watermark has passed a job's limit."""
    return beats.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(Heartbeats(limit_ms), "job_id long, silent_since long", "Append", "EventTime")


def with_retries(batch: DataFrame, work, tries: int, letters: str) -> DataFrame:
    """A micro-batch's rows for which `work` (a column of struct(ok boolean, value) for a try's number) succeeds within `tries`;
    the others are appended to the dead letters."""
    left, done = batch, None
    for k in range(tries):
        tried = left.withColumn("__r", work(k))
        good = tried.where("__r.ok").withColumn("value", F.col("__r.value")).withColumn("attempts", F.lit(k + 1)).drop("__r")
        done = good if done is None else done.unionByName(good)
        left = tried.where("not coalesce(__r.ok, false)").drop("__r")
    left.withColumn("attempts", F.lit(tries)).write.mode("append").parquet(letters)
    return done


def run_to_table(stream: DataFrame, label: str, mode: str = "append", keep_epoch: bool = False) -> DataFrame:
    """Run a stream over all that is there now, into a table of the shared folder, and read that table; keep_epoch adds the
    number of the micro-batch that a row came out of."""
    from eventloom.session import fresh_path

    spark = stream.sparkSession
    path, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what stateful processors need

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    from pyspark.sql.types import LongType, StructField, StructType

    kept = [*stream.schema.fields, *([StructField("epoch", LongType())] if keep_epoch else [])]
    return spark.read.schema(StructType(kept)).option("recursiveFileLookup", "true").parquet(path)
