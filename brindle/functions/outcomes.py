"""Verdicts on recorded answers of probes, jobs, sources and crawls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.crawl import contains_any

# What a failed probe says about the address, by class of error (can it be tried again, words of the note).
PROBE_ERRORS = {
    "connect": (True, "Connection failed"), "disconnected": (True, "Server disconnected"), "protocol": (False, "SMTP error"), "timeout": (True, "Timeout"), "os": (True, "Network error"),
}
JOB_STATES = {"PENDING": "pending", "STARTED": "processing", "FAILURE": "failed", "SUCCESS": "completed"}
RUNNING_HINTS = ("currently running queries", "slots available now")
LIMITED_HINTS = ("rate_limited", "rate limited")
STARTING_HINTS = ("dispatcher", "database not opened", "not ready")
NO_NAME_HINTS = ("temporary failure in name resolution", "name or service not known")


def domain_verdict(domain: Column, a: Column, aaaa: Column, mx_count: Column, mx_error: Column) -> Column:
    """(valid, domain_exists, mx_found, error) from recorded lookups. a, aaaa: answer, timeout or no_servers, each of
    which lets the domain exist, or anything else. Addresses without a mail host do not make it valid."""
    exists = F.coalesce(a.isin("answer", "timeout", "no_servers"), F.lit(False)) | F.coalesce(aaaa.isin("answer", "timeout", "no_servers"), F.lit(False))
    found = exists & (F.coalesce(mx_count, F.lit(0)) > 0)
    gone = F.concat(F.lit("Domain '"), domain, F.lit("' does not exist"))
    no_mail = F.coalesce(F.when(mx_error != "", mx_error), F.concat(F.lit("No MX records found for '"), domain, F.lit("'")))
    return F.struct(found.alias("valid"), exists.alias("domain_exists"), found.alias("mx_found"), F.when(~exists, gone).when(~found, no_mail).alias("error"))


def probe_error(kind: Column, message: Column) -> Column:
    """(verdict, can_retry, error) of a probe that failed; null for a class that is not known."""
    out = None
    for k, (again, words) in PROBE_ERRORS.items():
        row = F.struct(F.lit("unknown").alias("verdict"), F.lit(again).alias("can_retry"), F.concat(F.lit(f"{words}: "), message).alias("error"))
        out = F.when(kind == k, row) if out is None else out.when(kind == k, row)
    return out


def job_state(state: Column) -> Column:
    """The status a job's record is shown with; null if the state is not known."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv]), state)


def import_stage(mounted: Column, extract: Column, converted: Column) -> Column:
    """Stage of a map source that is being built, from which of its files are there."""
    return F.when(~mounted, "unknown").when(extract & converted, "converting").when(converted, "importing").otherwise("downloading")


def source_status(status_code: Column, text: Column, mounted: Column, extract: Column, converted: Column) -> Column:
    """(summary, stage, ready) of a map source. A good answer decides by its text; without one (null: no answer at all) the files do."""
    by_text = F.when(contains_any(text, RUNNING_HINTS), "healthy").when(contains_any(text, LIMITED_HINTS), "rate_limited").when(contains_any(text, STARTING_HINTS), "bootstrapping").otherwise("healthy")
    good = F.coalesce(status_code.between(200, 299), F.lit(False))
    by_files = F.when(mounted, "bootstrapping").otherwise("unreachable")
    return F.struct(F.when(good, by_text).otherwise(by_files).alias("summary"), F.when(good, "ready").otherwise(import_stage(mounted, extract, converted)).alias("stage"), good.alias("ready"))


def probe_reason(message: Column) -> Column:
    """Why a source that is being built did not answer: refused, no_name, timeout or other."""
    return F.when(contains_any(message, ("connection refused", "errno 111")), "refused").when(contains_any(message, NO_NAME_HINTS), "no_name").when(contains_any(message, ("timed out", "timeout")), "timeout").otherwise("other")


def site_status(any_status: Column, robots_blocked: Column) -> Column:
    """Status of a crawled site: completed if any page answered, and then marked if robots rules were passed over."""
    return F.when(~any_status, "failed").when(robots_blocked, "robots_bypassed").otherwise("completed")


def crawl_outcome(exception: Column, dead: Column, escalate: Column, challenged: Column, shell: Column, crawl_status: Column, tried: Column, attempts: int = 3) -> Column:
    """(run_status, crawl_status, reason) after a crawl: without an exception done or sent to a browser with the reason why; a
    dead host fails at once, any other exception is queued again until ``attempts`` are used up. A null crawl status stays as it is."""
    row = lambda run, status, why: F.struct(F.lit(run).alias("run_status"), status.alias("crawl_status"), why.alias("reason"))
    none, cut = F.lit(None).cast("string"), F.substring(exception, 1, 500)
    why = F.when(challenged, "anti_bot_challenge").when(shell, "js_shell").when(crawl_status.isin("blocked_by_robots", "robots_bypassed"), crawl_status).otherwise("generic")
    again = F.concat(F.lit("Retry "), (tried + 1).cast("string"), F.lit(f"/{attempts} queued: "), cut)
    return (
        F.when(exception.isNull() & escalate, row("queued", crawl_status, why)).when(exception.isNull(), row("completed", crawl_status, none))
        .when(dead, row("failed", F.lit("failed"), F.concat(F.lit("Dead host: "), cut))).when(tried < attempts, row("queued", F.lit("retrying"), again)).otherwise(row("failed", F.lit("failed"), exception))
    )


def cluster_history_bonus(selected: Column, market_selected: Column) -> Column:
    """Bonus of a cluster for how often it was picked, at all and in this market."""
    return F.least(selected, F.lit(5)) * 3 + F.least(market_selected, F.lit(5)) * 4
