"""Plans of prompts over a day: cache, quota, recorded answers, and drafts where an answer fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import answers, prompts
from brindle.operators import lookups
from brindle.operators.drafts import draft_variants
from brindle.operators.ranking import numbered, top_per_group
from brindle.storage import materialize

VERSION, MODEL, ANSWERING, ANSWERING_MODEL = "v1", "heuristic-v1", "openai", "gpt-4o-mini"
VARIANTS = "array<struct<variant_key:string,label:string,strategy:string,fit_score:int>>"
#: Columns of the table of plans, a row for each call that gave one; its key is (cache_key, created_at).
PLANS = f"cache_key string, created_at timestamp, expires_at timestamp, request_id bigint, requested string, provider string, model string, used_fallback boolean, fallback_reason string, cluster string, variants {VARIANTS}, default_key string"
_PLAN = ["expires_at", "provider", "model", "used_fallback", "fallback_reason", "cluster", "variants", "default_key"]


def _keyed(requests: DataFrame) -> DataFrame:
    provider = F.coalesce(F.nullif(F.lower(F.btrim("provider")), F.lit("")), F.lit("heuristic"))
    rows = requests.select("request_id", F.col("at").cast("timestamp").alias("at"), F.btrim("prompt").alias("prompt"), provider.alias("requested"), "answer")
    rows = rows.withColumn("text", prompts.normalize_prompt(F.col("prompt"))).withColumn("asked_model", F.when(F.col("requested") == ANSWERING, ANSWERING_MODEL).otherwise(MODEL))
    key = prompts.cache_key(prompt_fingerprint=prompts.prompt_fingerprint(F.col("text")), requested_provider=F.col("requested"), requested_model=F.col("asked_model"), planner_version=F.lit(VERSION))
    rows = rows.withColumn("cache_key", key).withColumn("given", F.when(F.col("requested") == ANSWERING, answers.read_answer(F.col("answer")))).drop("answer")
    drafted = (F.col("requested") != ANSWERING) | F.col("given.error").isNotNull()
    return rows.withColumn("drafted", drafted).withColumn("when", F.struct("at", "request_id"))


def plan_prompts(requests: DataFrame, plans: DataFrame, hints: DataFrame, templates: DataFrame, cap: int = 0, hours: int = 24, k: int = 6) -> DataFrame:
    """What each request of one day got, in the order of (at, request_id).

    ``requests``: request_id, at, prompt, provider (blank: heuristic), answer (the provider's recorded text); all of one UTC day, an id once. ``plans``: the
    table :data:`PLANS` with all earlier plans. A request is a hit if its key (normalised prompt, provider, model) has a plan made at or before it
    that has not expired. Else it is a call: it fails when the provider's ``cap`` of the day (0: none), of which the plans of the day use one each, is reached, or
    when drafts are needed for a prompt without a word; a failed call uses nothing. Other calls give a plan, by the answer if it can be used, else by drafts
    with the reason of the fallback. As a plan outlasts its day, a key makes at most one plan after its recorded one has ended, so the first
    call of each key decides and later requests of the key are hits; calls are numbered by provider through ranges, so no provider is one task.

    Gives request_id, status (planned, hit, failed), error, cache_key, at, requested and the plan's columns, null when failed. A null or blank prompt fails
    with ``Prompt is required.``, a null time with ``Time is required.``; neither uses the quota. A day in several batches gives what it gives in one, if
    the plans of each are written (:func:`made_plans`) before the next.
    """
    if hours < 24:
        raise ValueError("a plan must outlast its day")
    rows = materialize(_keyed(requests), "planner")
    why = F.when(F.coalesce("prompt", F.lit("")) == "", "Prompt is required.").when(F.col("at").isNull(), "Time is required.")
    sound = rows.where(why.isNull())
    seen = materialize(lookups.latest_before(sound.withColumnRenamed("at", "created_at"), plans, "cache_key", "created_at", ["request_id"], _PLAN).withColumnRenamed("created_at", "at"), "cached")
    hit = F.coalesce(F.col("expires_at") > F.col("at"), F.lit(False))
    hits = seen.where(hit).select(*_head("hit"), *_PLAN)
    missed = seen.where(~hit).drop("found_at", *_PLAN)
    wordless = F.col("drafted") & (F.col("text") == "")
    first = top_per_group(missed.where(~wordless), ["cache_key"], [F.col("at"), F.col("request_id")])
    calls = numbered(first, "requested", ["at", "request_id"])
    days = sound.select(F.to_date("at").alias("day")).distinct()
    used = plans.join(days, F.to_date("created_at") == F.col("day"), "left_semi").groupBy("requested").agg(F.count(F.lit(1)).alias("used"))
    room = F.lit(cap) - F.coalesce("used", F.lit(0))
    calls = materialize(calls.join(used, "requested", "left").withColumn("room", room), "calls")
    made = calls if cap <= 0 else calls.where("n <= room")
    planned = materialize(_make(made, hints, templates, hours, k), "planned")
    full = (calls.where("n = room").select("requested", F.col("when").alias("full_at")) if cap > 0 else calls.where("false").select("requested", F.col("when").alias("full_at")))
    by_key = planned.select("cache_key", F.col("when").alias("made_at"), *_PLAN)
    rest = missed.join(by_key, "cache_key", "left").join(full, "requested", "left").join(used, "requested", "left")
    served = F.coalesce(F.col("when") >= F.col("made_at"), F.lit(False))
    over = F.lit(False) if cap <= 0 else (room <= 0) | F.coalesce(F.col("when") > F.col("full_at"), F.lit(False))
    error = F.when(wordless & ~over, "Prompt cannot be empty.").otherwise("Recipe planner daily quota reached.")
    status = F.when(~served, "failed").when(F.col("when") == F.col("made_at"), "planned").otherwise("hit")
    late = rest.select(*_head(status, F.when(~served, error)), *[F.when(served, F.col(x)).alias(x) for x in _PLAN])
    unsound = rows.where(why.isNotNull()).select(*_head("failed", why), *[F.lit(None).cast(hits.schema[x].dataType).alias(x) for x in _PLAN])
    return hits.unionByName(late).unionByName(unsound)


def _head(status: str | Column, error: Column | None = None) -> list[Column]:
    status = F.lit(status) if isinstance(status, str) else status
    return [F.col("request_id"), status.alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error"), F.col("cache_key"), F.col("at"), F.col("requested")]


def _make(calls: DataFrame, hints: DataFrame, templates: DataFrame, hours: int, k: int) -> DataFrame:
    """Plans of calls: by the answer, or by drafts of the prompt."""
    texts = calls.where("drafted").groupBy(F.col("text").alias("prompt_id")).agg(F.min("prompt").alias("prompt"))
    found = draft_variants(texts, hints, templates, k)
    draft = F.struct("rank", F.col("template_key").alias("variant_key"), "label", "strategy", "fit_score")
    found = found.groupBy(F.col("prompt_id").alias("text")).agg(F.min("cluster").alias("_cluster"), F.array_sort(F.collect_list(draft)).alias("_drafts"))
    drafts = F.transform("_drafts", lambda d: d.dropFields("rank")).cast(VARIANTS)
    reason = F.when(F.col("requested") == ANSWERING, F.concat(F.lit("OpenAI planner fallback: "), F.col("given.error"))).when(
        F.col("requested") != "heuristic", F.format_string("Planner provider '%s' is not configured yet; used heuristic fallback.", "requested"))
    rows = calls.join(found, "text", "left")
    pick = lambda a, b: F.when(F.col("drafted"), a).otherwise(b)
    return rows.select(
        "request_id", "cache_key", "at", "when", "requested", (F.col("at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"), pick(F.lit("heuristic"), F.col("requested")).alias("provider"),
        pick(F.lit(MODEL), F.col("asked_model")).alias("model"), (F.col("drafted") & (F.col("requested") != "heuristic")).alias("used_fallback"), pick(reason, F.lit(None)).alias("fallback_reason"),
        pick(F.col("_cluster"), F.col("given.cluster")).alias("cluster"), pick(drafts, F.col("given.variants").cast(VARIANTS)).alias("variants"), pick(F.col("_drafts")[0]["variant_key"], F.col("given.default_key")).alias("default_key"),
    )


def made_plans(results: DataFrame) -> DataFrame:
    """The rows of :data:`PLANS` that results add."""
    return results.where("status = 'planned'").select("cache_key", F.col("at").alias("created_at"), "expires_at", "request_id", "requested", *_PLAN[1:])


def selected(results: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Results with the variant that counts (``selected``): the ``wanted`` key if the plan has it, else the default, else the first."""
    has = lambda key: F.filter("variants", lambda x: x["variant_key"] == key)
    wanted = F.coalesce(F.lit(None).cast("string") if wanted is None else wanted, F.col("default_key"))
    return results.withColumn("selected", F.coalesce(F.try_element_at(has(wanted), F.lit(1)), F.try_element_at("variants", F.lit(1))))
