"""Progress of recorded jobs, told on each change with the newest rows, and host suppression that forgets: state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.functions import urls
from brindle.operators.ranking import top_per_group
from brindle.streaming.jobs import BLOCK_AT, TTL_MINUTES

LATEST = 5
PROGRESS = "job_id string, status string, result_count long, completed long, total long, latest array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Progress(StatefulProcessor):
    """Counts and the five newest results of a job. Emits when a count has changed; a finished job, and one that was silent for a
    day, is dropped by a timer or with its state's time to live."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "results long, completed long, total long", self.keep_ms)
        self.latest = handle.getListState("latest", "seq long, result string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        results, completed, total = self.counts.get() or (0, 0, 0)
        held = [(int(s), r) for s, r in self.latest.get()]
        before, done = (results, completed), False
        for batch in rows:
            found = batch[batch["kind"] == "result"]
            results += len(found)
            completed += int((batch["kind"] == "keyword").sum())
            total = max([total, *batch.loc[batch["kind"] == "start", "n"].astype(int).tolist()])
            done |= bool((batch["kind"] == "done").any())
            held = sorted([*held, *zip(found["seq"].astype(int).tolist(), found["result"].tolist())])[-LATEST:]
        if done:
            self.counts.clear()
            self.latest.clear()
        else:
            self.counts.update((results, completed, total))
            if held:  # an empty list cannot be stored
                self.latest.put(held)
        if done or (results, completed) != before:
            yield pd.DataFrame({"job_id": [key[0]], "status": ["done" if done else "running"], "result_count": [results], "completed": [completed], "total": [total], "latest": [[r for _, r in held]]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, keep_hours: float = 24) -> DataFrame:
    """A row for each job and micro-batch in which its counts changed, and one when it is done. events: job_id, seq (rising within a job),
    kind (start with n keywords in all, keyword, result, done), n, result. Needs the RocksDB state store. The time to live
    is wall time, for which Spark runs batches without data as well: under ``availableNow`` switch these off, or the query does not end."""
    rows = events.select("job_id", "seq", "kind", "n", "result")
    return rows.groupBy("job_id").transformWithStateInPandas(_Progress(int(keep_hours * 3_600_000)), PROGRESS, "update", "ProcessingTime")


def job_progress_state(events: DataFrame) -> DataFrame:
    """Batch twin: each job's last report. The newest results are cut by a group limit before they are moved."""
    per = events.groupBy("job_id").agg(
        F.when(F.bool_or(F.col("kind") == "done"), "done").otherwise("running").alias("status"), F.count_if(F.col("kind") == "result").alias("result_count"), F.count_if(F.col("kind") == "keyword").alias("completed"),
        F.coalesce(F.max(F.when(F.col("kind") == "start", F.col("n"))), F.lit(0)).cast("long").alias("total"),
    )
    newest = top_per_group(events.where("kind = 'result'"), ["job_id"], [F.desc("seq")], LATEST)
    newest = newest.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "result"))), lambda x: x["result"]).alias("latest"))
    return per.join(newest, "job_id", "left").withColumn("latest", F.coalesce("latest", F.array().cast("array<string>")))


class _Failures(StatefulProcessor):
    """A host's run of failures; the count goes TTL_MINUTES after its last event."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "failures int, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, last = self.state.get() or (0, 0)
        for at, failed in pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")[["at", "failed"]].itertuples(index=False):
            failures = (0 if at - last > self.ttl_ms or not failed else failures) + int(failed)
            last = int(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((failures, last))
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame({"host": [key[0]], "failures": [failures], "blocked": [failures >= BLOCK_AT]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"host": [key[0]], "failures": [0], "blocked": [False]})

    def close(self) -> None:
        pass


def forgetting_suppressed_hosts(events: DataFrame, late: str = "10 minutes", ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """(host, failures, blocked) on each change; when event time has passed a host's last event by the time to live, it is told as free
    and its state goes. events: url, created_at, id, error."""
    at = F.col("created_at").cast("timestamp")
    rows = events.select(urls.host_key(F.col("url")).alias("host"), at.alias("event_time"), F.unix_millis(at).alias("at"), "id", F.col("error").isNotNull().alias("failed")).withWatermark("event_time", late)
    return rows.groupBy("host").transformWithStateInPandas(_Failures(ttl_minutes * 60_000), "host string, failures int, blocked boolean", "update", "EventTime")
