"""Run and company states from an event log.

An event is a function on the few states of a company in a run, so any stretch of a log is a table of six rows: for each state before
it, the state after it, and what it does to the retry count, the times and the error. Such tables compose. Keys of few events are folded as
they are, from the one state they begin in. Those of many are dealt by ranges of key and order, each range folds its stretches into tables,
and a key's tables are composed in order, so a key that holds most of a log is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STATES = ("absent", "queued", "running", "completed", "failed", "skipped")
OPEN = ("queued", "running")
ERROR_WIDTH = 2000
EVENTS = ("queue", "requeue", "retry", "start", "finish", "close")

_TABLE = "struct<state:string,reset:boolean,retries:bigint,has_started:boolean,started:timestamp,has_finished:boolean,finished:timestamp,has_error:boolean,error:string>"


def _unchanged(state: str) -> Column:
    no, none = F.lit(False), F.lit(None)
    return F.struct(F.lit(state).alias("state"), no.alias("reset"), F.lit(0).cast("long").alias("retries"), no.alias("has_started"), none.cast("timestamp").alias("started"), no.alias("has_finished"), none.cast("timestamp").alias("finished"), no.alias("has_error"), none.cast("string").alias("error"))


def _put(a: Column, at: Column, e: Column) -> Column:
    """What stretch ``a`` and then event ``e`` do. Queueing leaves an open or completed company alone, closing one that is not open;
    a retry of an absent company creates it."""
    kind = e["kind"]
    ignored = ((kind == "queue") & a["state"].isin("queued", "running", "completed")) | ((kind == "close") & ~a["state"].isin(*OPEN))
    state = F.when(kind.isin("queue", "requeue"), F.lit("queued")).when(kind == "start", F.lit("running")).when(kind == "retry", F.when(a["state"] == "absent", F.lit("queued")).otherwise(a["state"])).otherwise(e["status"])
    clears, ends = kind.isin("queue", "requeue", "start"), kind.isin("finish", "close")
    out = F.struct(
        state.alias("state"), (a["reset"] | (kind == "queue")).alias("reset"), F.when(kind == "queue", F.lit(0).cast("long")).when(kind == "retry", a["retries"] + 1).otherwise(a["retries"]).alias("retries"),
        (a["has_started"] | clears).alias("has_started"), F.when(kind == "start", at).when(clears, F.lit(None)).otherwise(a["started"]).alias("started"),
        (a["has_finished"] | clears | ends).alias("has_finished"), F.when(ends, at).when(clears, F.lit(None)).otherwise(a["finished"]).alias("finished"),
        (a["has_error"] | (kind != "retry")).alias("has_error"), F.when(kind.isin("requeue", "finish", "close"), F.substring(e["error"], 1, ERROR_WIDTH)).when(kind == "retry", a["error"]).alias("error"),
    )
    return F.when(ignored, a).otherwise(out)


def _then(a: Column, b: Column) -> Column:
    """Stretch ``a`` and then ``b``, which begins in the state that ``a`` ends in."""
    take = lambda has, value: F.when(b[has], b[value]).otherwise(a[value]).alias(value)
    return F.struct(
        b["state"].alias("state"), (a["reset"] | b["reset"]).alias("reset"), F.when(b["reset"], b["retries"]).otherwise(a["retries"] + b["retries"]).alias("retries"),
        (a["has_started"] | b["has_started"]).alias("has_started"), take("has_started", "started"), (a["has_finished"] | b["has_finished"]).alias("has_finished"), take("has_finished", "finished"),
        (a["has_error"] | b["has_error"]).alias("has_error"), take("has_error", "error"),
    )


def company_states(log: DataFrame, keys: list[str], order: list[str], chunk: int = 1024) -> DataFrame:
    """(keys, status, retry_count, started_at, finished_at, last_error) after all events of ``log``.

    log: keys, order columns (together unique within a key), ``kind`` (one of EVENTS), ``at``, ``status`` of a finish or close, ``error``.
    queue: a new company, or one that failed or was skipped, is queued with its retries at 0; requeue: queued again, retries kept; retry: one more;
    start, finish: as they say; close: only open companies end. Unknown kinds are an error. A company that was only ever closed is not there.
    """
    known = F.when(F.col("kind").isin(*EVENTS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no such event: "), F.coalesce("kind", F.lit("null")))))
    many = F.broadcast(log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).drop("_n"))
    dealt = lambda df: df.select(*keys, F.struct(*order).alias("_at"), F.struct(known.alias("kind"), F.col("at"), "status", "error").alias("_event"))
    log = log.select(*dict.fromkeys([*keys, *order, "kind", "at", "status", "error"]))
    events = F.array_sort(F.collect_list(F.struct("_at", "_event")))
    fold = lambda state: F.aggregate(events, _unchanged(state).cast(_TABLE), lambda a, x: _put(a, x["_event"]["at"], x["_event"]).cast(_TABLE))
    few = dealt(log.join(many, keys, "left_anti").repartition(*keys)).groupBy(*keys).agg(fold("absent").alias("s"))
    rows = dealt(log.join(many, keys, "left_semi"))
    rows = rows.repartitionByRange(*keys, "_at").withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at"))
    rows = rows.withColumn("_chunk", F.floor((place - 1) / chunk))
    tables = rows.groupBy(*keys, "_part", "_chunk").agg(F.struct(*[fold(s).alias(s) for s in STATES]).alias("_table"))
    pick = lambda t, state: F.coalesce(*[F.when(state == s, t[s]) for s in STATES])
    last = F.aggregate(F.array_sort(F.collect_list(F.struct("_part", "_chunk", "_table"))), _unchanged("absent").cast(_TABLE), lambda a, x: _then(a, pick(x["_table"], a["state"])).cast(_TABLE))
    out = few.unionByName(tables.groupBy(*keys).agg(last.alias("s"))).where("s.state <> 'absent'")
    return out.select(*keys, F.col("s.state").alias("status"), F.col("s.retries").alias("retry_count"), F.col("s.started").alias("started_at"), F.col("s.finished").alias("finished_at"), F.col("s.error").alias("last_error"))


def with_run_events(log: DataFrame, run_events: DataFrame, run: str, company: str, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The log with the events of a run given to the companies that its log names, as far as they can do anything.

    A close leaves no company open, so of several between two events of a company only the first can do anything, and none before its first
    event: each event of the log gets at most one. Other events of a run, and closes with the status of an open company, go to all its companies.
    Nor can a close right after a finish. The next close is sought within a run and day of ``order``'s first column (a time), then at the first later day that has one."""
    c = F.col
    closed = c("status").isin(*[s for s in STATES if s not in OPEN])
    over = F.coalesce((c("kind") == "close") & closed, F.lit(False))
    others, closes = run_events.where(~over), run_events.where(over)
    named = log.join(others.select(run).distinct(), run, "left_semi").select(run, company).distinct()
    log = log.unionByName(named.join(others, run).select(*log.columns))
    at, day = F.struct(*order).alias("_at"), F.to_date(order[0]).alias("_day")
    shut = F.coalesce(c("kind").isin("finish", "close") & closed, F.lit(False))
    own = log.where(~shut).join(closes.select(run).distinct(), run, "left_semi").select(run, company, at, day)
    firsts = closes.where(c(run).isNotNull()).select(run, at, day).groupBy(run, "_day").agg(F.min("_at").alias("_first"))
    days = own.select(run, "_day").distinct().select("*", F.lit(None).cast(firsts.schema["_first"].dataType).alias("_first")).unionByName(firsts)
    days = days.groupBy(run, "_day").agg(F.max("_first").alias("_first"))
    earlier = Window.partitionBy(run).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    later = days.select(run, "_day", F.last("_first", ignorenulls=True).over(earlier).alias("_close"), F.lit(0).alias("_turn")).where("_close is not null")
    both = own.withColumn("_turn", F.lit(1)).unionByName(closes.select(run, at, day, c("_at").alias("_close")).withColumn("_turn", F.lit(2)), allowMissingColumns=True)
    both = both.unionByName(later, allowMissingColumns=True)
    # Backwards through a day: what the later days hold, then its rows; at one place an event comes before a close, which is not after it.
    back = Window.partitionBy(run, "_day").orderBy(c("_turn") > 0, F.desc("_at"), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    given = both.withColumn("_close", F.last("_close", ignorenulls=True).over(back)).where("_turn = 1 and _close is not null").select(run, company, "_close").distinct()
    closes = closes.withColumn("_place", F.struct(*order)).withColumnRenamed(run, "_run")
    return log.unionByName(given.join(closes, (c(run) == c("_run")) & c("_close").eqNullSafe(c("_place"))).select(*log.columns))


def run_outcomes(states: DataFrame, runs: DataFrame, run: str, as_of: Column, stale_minutes: int = 10) -> DataFrame:
    """(run, companies, completed, open, outcome) of each run that is not over: what its companies' states make of it.

    completed: all companies are over, or there are none and discovery has ended (skipped if a stop was asked for); failed: no
    company is open, not all are over, and it began ``stale_minutes`` ago or longer; else open. runs: run, started_at, finished_at, cancel_requested.
    """
    per = states.groupBy(run).agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin(*OPEN)).alias("open"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    out = runs.join(per, run, "left").withColumns({n: zero(n) for n in ("companies", "completed", "open")})
    over = (F.col("open") == 0) & ((F.col("companies") > 0) | F.col("finished_at").isNotNull())
    stale = (F.col("open") == 0) & (F.col("started_at") <= as_of - F.expr(f"interval {stale_minutes} minutes"))
    outcome = F.when(over, F.when(F.col("cancel_requested"), "skipped").otherwise("completed")).when(stale, "failed").otherwise("open")
    return out.select(run, "companies", "completed", "open", outcome.alias("outcome"))
