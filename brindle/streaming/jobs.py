"""Structured Streaming jobs, each with a batch twin of the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions import urls

BLOCK_AT = 3
TTL_MINUTES = 180


def request_windows(requests: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Requests and errors per provider and window; batch or stream. A stream drops rows later than ``late``."""
    rows = requests.withColumn("at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return rows.groupBy(w.alias("w"), "provider").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")).select(F.col("w.start").alias("window_start"), "provider", "n", "errors")


def request_sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each provider: requests no further apart than ``gap``."""
    rows = requests.withColumn("at", F.col("created_at").cast("timestamp"))
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("at", gap).alias("w"), "provider").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "provider", "n")


def first_seen(rows: DataFrame, keys: list[str], at: str, keep: str = "24 hours") -> DataFrame:
    """First row of each key within ``keep``; rows with an empty key are never dropped on a batch."""
    if rows.isStreaming:
        return rows.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).where("_n = 1").drop("_n")


def suppressed_hosts(events: DataFrame) -> DataFrame:
    """Batch twin: (host, failures, blocked) after each host's last event. A run of failures ends with a success or after
    TTL_MINUTES without one; three failures block. Windows by host and run, no list of events."""
    host = urls.host_key(F.col("url"))
    rows = events.select(host.alias("host"), F.col("created_at").cast("timestamp").alias("at"), "id", F.col("error").isNotNull().alias("failed"))
    w = Window.partitionBy("host").orderBy("at", "id")
    gap = F.unix_seconds("at") - F.unix_seconds(F.lag("at").over(w)) > TTL_MINUTES * 60
    rows = rows.withColumn("cut", (~F.col("failed") | F.coalesce(gap, F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.groupBy("host").agg(F.max("run").alias("run"))
    out = rows.join(last, ["host", "run"]).groupBy("host").agg(F.sum(F.col("failed").cast("int")).cast("int").alias("failures"))
    return out.withColumn("blocked", F.col("failures") >= BLOCK_AT)


def _suppress(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    failures, last = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values(["seconds", "id"], kind="stable")
    for seconds, failed in zip(rows["seconds"], rows["failed"]):
        if seconds - last > TTL_MINUTES * 60 or not failed:
            failures = 0
        failures, last = failures + int(failed), int(seconds)
    state.update((failures, last))
    yield pd.DataFrame({"host": [key[0]], "failures": [failures], "blocked": [failures >= BLOCK_AT]})


def stream_suppressed_hosts(events: DataFrame) -> DataFrame:
    """The stream: state per host is one count and one time, whatever the number of events."""
    rows = events.select(urls.host_key(F.col("url")).alias("host"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("seconds"), "id", F.col("error").isNotNull().alias("failed"))
    return rows.groupBy("host").applyInPandasWithState(_suppress, "host string, failures int, blocked boolean", "failures int, last long", "update", GroupStateTimeout.NoTimeout)


def job_progress(results: DataFrame) -> DataFrame:
    """Counters of a check job; ``update`` mode on a stream."""
    return results.groupBy("job_id").agg(F.count_if(F.col("exists")).alias("active"), F.count_if(~F.col("exists")).alias("inactive"), F.count_if(F.col("exists").isNull()).alias("errors"), F.count(F.lit(1)).alias("processed"))


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``merge(batch, batch_id)`` on all data there is now; a batch repeated after a failure has the same id."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
