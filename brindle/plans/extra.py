"""Registered queries over recorded outcomes: prompts to variants, mail hosts, status labels, retries, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import outcomes, prompts, scores
from brindle.functions.prompts import BROWSER_WORDS, LANGUAGES, PLACES, WEBSITE_WORDS, language_hints, location_hint, strategy_bonus
from brindle.operators import companies as co
from brindle.operators import ranking, runs, upserts
from brindle.plans.catalog import _CANON, ORACLE_SQL, _website_key, cascade, query
from brindle.plans.views import ctes

c = F.col
_CITY = "case prompt_id % 5 when 0 then ' in chiang mai' when 1 then ' bangkok studio' when 2 then ' berlin agency' when 3 then ' luxury paris' else ' tokyo' end"
_HINT = "coalesce(nullif(trim(regexp_extract(t, '\\bin ([a-z][a-z\\s-]+)$', 1)), ''), case " + " ".join(f"when contains(t, '{p}') then '{p}'" for p in PLACES) + " end)"
_LANG = "case " + " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in ws) + f" then '{','.join(ls)}'" for ws, ls in LANGUAGES) + " else 'en' end"


def prompt_hints(p: DataFrame) -> DataFrame:
    city = F.element_at(F.array(*[F.lit(x) for x in (" in chiang mai", " bangkok studio", " berlin agency", " luxury paris", " tokyo")]), (c("prompt_id") % 5 + 1).cast("int"))
    t = p.select("prompt_id", F.concat(F.lower(F.substring("prompt", 1, 12)), city).alias("t"))
    strategy = F.element_at(F.array(*[F.lit(x) for x in ("browser", "website", "hybrid", "map")]), (c("prompt_id") % 4 + 1).cast("int"))
    return t.select("prompt_id", location_hint(c("t")).alias("location"), F.array_join(language_hints(c("t")), ",").alias("languages"), strategy_bonus(strategy, c("t")).alias("bonus"))


_ANY = lambda ws: "(" + " or ".join(f"contains(t, '{w}')" for w in ws) + ")"
query(
    "s33_prompt_hints", "prompts",
    sql=f"select prompt_id, {_HINT} as location, {_LANG} as languages, case prompt_id % 4 when 0 then case when {_ANY(BROWSER_WORDS)} then 4 else 1 end when 1 then case when {_ANY(WEBSITE_WORDS)} then 3 else 1 end when 2 then 2 else 0 end as bonus from (select prompt_id, lower(substr(prompt, 1, 12)) || {_CITY} as t from v_prompts)",
)(prompt_hints)


def draft_variants(p: DataFrame, v: DataFrame) -> DataFrame:
    """Variants of a prompt: templates of the cluster its id points to, scored by priority and word hits, best six.

    Templates of a cluster with the same words hit alike, so only the best six of each such kind can be among a prompt's; those without a hit
    are among the best six of the cluster. Each distinct prompt of a cluster meets the kinds it shares a word with, and the cluster's six."""
    words = F.array_sort(F.array_distinct(F.split(F.lower("label"), " ")))
    templates = v.where("variant_id % 7 = 0").select("variant_id", (c("variant_id") % 20).alias("slot"), words.alias("words"), "priority")
    templates = templates.withColumn("priority", F.when(c("words").isNotNull(), c("priority")))
    best = [F.desc("priority"), c("variant_id")]
    kinds = ranking.top_per_group(templates, ["slot", "words"], best, 6)
    asked = p.select("prompt_id", "prompt", (c("prompt_id") % 20).alias("slot"))
    texts = asked.select("slot", "prompt").distinct()
    tokens = texts.select("slot", "prompt", F.explode(F.array_distinct(F.split(F.lower("prompt"), " "))).alias("word"))
    held = tokens.join(kinds.select("slot", "words").distinct().select("slot", "words", F.explode("words").alias("word")), ["slot", "word"])
    hits = held.groupBy("slot", "prompt", "words").agg(F.count(F.lit(1)).alias("hits"))
    rows = hits.join(kinds, ["slot", "words"]).select("slot", "prompt", "variant_id", (c("priority") + 10 * c("hits").cast("int")).alias("fit"))
    rows = rows.unionByName(texts.where("prompt is not null").join(ranking.top_per_group(templates, ["slot"], best, 6), "slot").select("slot", "prompt", "variant_id", c("priority").alias("fit")))
    rows = rows.unionByName(texts.where("prompt is null").join(ranking.top_per_group(templates, ["slot"], [c("variant_id")], 6), "slot").select("slot", "prompt", "variant_id", F.lit(None).cast("int").alias("fit")))
    rows = rows.groupBy("slot", "prompt", "variant_id").agg(F.max("fit").alias("fit"))
    order = [F.desc("fit"), c("variant_id")]
    rows = ranking.ranked(ranking.top_per_group(rows, ["slot", "prompt"], order, 6), ["slot", "prompt"], order)
    rows = rows.select(c("slot").alias("_slot"), c("prompt").alias("_prompt"), "variant_id", "fit", "rank")
    return asked.join(rows, (c("slot") == c("_slot")) & c("prompt").eqNullSafe(c("_prompt"))).select("prompt_id", "variant_id", "fit", "rank")


query(
    "pl06_prompt_variants", "prompts", "variants",
    sql="""select prompt_id, variant_id, fit, rank from (select *, row_number() over (partition by prompt_id order by fit desc, variant_id) as rank from (
  select prompt_id, variant_id, priority + 10 * len(list_distinct(list_intersect(string_split(lower(prompt), ' '), string_split(lower(label), ' ')))) as fit from v_prompts join v_variants on prompt_id % 20 = variant_id % 20 and variant_id % 7 = 0)) where rank <= 6""",
)(draft_variants)

# --- recorded mail answers
query(
    "s56_domain_verdicts", "emails",
    sql="select email_id, exists_, mx > 0 and exists_ as valid, case when not exists_ then 'no domain' when mx = 0 then 'no mail host' end as error from (select email_id, email_id % 6 <> 0 or email_id % 4 = 0 as exists_, email_id % 3 as mx from v_emails)",
)(
    lambda e: e.select("email_id", ((c("email_id") % 6 != 0) | (c("email_id") % 4 == 0)).alias("exists_"), (c("email_id") % 3).alias("mx")).select(
        "email_id", "exists_", ((c("mx") > 0) & c("exists_")).alias("valid"), F.when(~c("exists_"), "no domain").when(c("mx") == 0, "no mail host").alias("error")
    )
)


def fail_over(r: DataFrame) -> DataFrame:
    """The answer that counts of up to two mail hosts tried in order: the first that is definitive or not a connection error."""
    a = r.select((c("id") / 2).cast("long").alias("probe"), (c("id") % 2).alias("pos"), "code", (c("code") == 220).alias("unreachable"))
    stops = ranking.top_per_group(a.where("not unreachable"), ["probe"], [c("pos")]).select("probe", "pos", "code")
    last = a.groupBy("probe").agg(F.max("pos").alias("last"))
    return last.join(stops, "probe", "left").select("probe", F.coalesce("pos", "last").alias("pos"), F.coalesce("code", F.lit(0)).alias("code"))


query(
    "s57_host_failover", "replies",
    sql="select probe, coalesce(min(pos) filter (not u), max(pos)) as pos, coalesce(arg_min(code, pos) filter (not u), 0) as code from (select id // 2 as probe, id % 2 as pos, code, code = 220 as u from v_replies) group by probe",
)(fail_over)


def probe_errors(r: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in outcomes.PROBE_ERRORS]), (c("id") % 5 + 1).cast("int"))
    return r.select("id", outcomes.probe_error(kind, F.lit("")).alias("x")).select("id", "x.verdict", "x.can_retry")


query("s58_probe_errors", "replies", sql="select id, 'unknown' as verdict, id % 5 <> 2 as can_retry from v_replies")(probe_errors)


def source_status(v: DataFrame) -> DataFrame:
    """Stage of a map source from which of its files are there."""
    t = v.select("variant_id", (c("variant_id") % 5 != 0).alias("mounted"), (c("variant_id") % 2 == 0).alias("pbf"), (c("variant_id") % 3 == 0).alias("bz2"))
    return t.select("variant_id", outcomes.source_status(F.lit(None).cast("int"), F.lit(""), c("mounted"), c("pbf"), c("bz2")).alias("x")).select("variant_id", "x.summary", "x.stage")


query(
    "s60_source_stages", "variants",
    sql="select variant_id, case when variant_id % 5 <> 0 then 'bootstrapping' else 'unreachable' end as summary, case when variant_id % 5 = 0 then 'unknown' when variant_id % 6 = 0 then 'converting' when variant_id % 3 = 0 then 'importing' else 'downloading' end as stage from v_variants",
)(source_status)


def run_note(note: Column) -> Column:
    """A run's note for a list: short ones as they are, known long ones as a sentence with up to three names, else cut at 137."""
    parts = F.filter(F.transform(F.split(F.element_at(F.split(note, "Partial category failures:", 2), 2), " ; "), lambda x: F.btrim(F.substring_index(x, ":", 1))), lambda x: x != "")
    names = F.array_distinct(parts)
    more = F.when(F.size(names) > 3, F.concat(F.lit(" +"), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise("")
    partial = F.when(F.size(names) > 0, F.concat(F.lit("Discovery completed with warnings: "), F.array_join(F.slice(names, 1, 3), ", "), more, F.lit("."))).otherwise("Discovery completed with category warnings.")
    return (
        F.when(note.isNull() | (note == ""), "-").when(F.length(note) <= 140, note).when(note.contains("Partial category failures:"), partial)
        .when(note.startswith("Worker crashed during discovery:"), "Failed: discovery worker crashed.").when(note.startswith("Worker crashed during crawl:"), "Failed: crawl worker crashed.").otherwise(F.concat(F.substring(note, 1, 137), F.lit("...")))
    )


def run_notes(r: DataFrame) -> DataFrame:
    text = (
        F.when(c("run_id") % 4 == 0, "").when(c("run_id") % 4 == 1, "short note").when(c("run_id") % 4 == 2, F.concat(F.lit("Partial category failures: alpha: x ; beta: y ; alpha: z ; gamma: "), F.repeat(F.lit("w"), 120), F.lit(" ; delta: q")))
        .otherwise(F.concat(F.lit("Worker crashed during crawl: "), F.repeat(F.lit("e"), 130)))
    )
    return r.select("run_id", run_note(text).alias("note"))


query(
    "s35_run_notes", "runs",
    sql="select run_id, case run_id % 4 when 0 then '-' when 1 then 'short note' when 2 then 'Discovery completed with warnings: alpha, beta, gamma +1 more.' else 'Failed: crawl worker crashed.' end as note from v_runs",
)(run_notes)
query(
    "d03_proxy_labels", "requests",
    sql="select id, case when id % 11 = 0 then 'auto-disabled' when id % 7 = 0 then 'disabled' when created_at > timestamp '2024-01-15 00:00:00' then 'cooldown until ' || strftime(created_at, '%H:%M UTC') else 'active' end as label from v_requests where used_proxy",
)(
    lambda r: r.where("used_proxy").select(
        "id", F.when(c("id") % 11 == 0, "auto-disabled").when(c("id") % 7 == 0, "disabled").when(c("created_at") > F.expr("timestamp_ntz '2024-01-15 00:00:00'"), F.concat(F.lit("cooldown until "), F.date_format("created_at", "HH:mm"), F.lit(" UTC"))).otherwise("active").alias("label")
    )
)


def retries(r: DataFrame, cap: int = 3) -> DataFrame:
    """Failed requests of a page in order, with the attempt they start and its delay, as long as the cap allows."""
    n = F.row_number().over(Window.partitionBy("url").orderBy("created_at", "id"))
    rows = r.where("error is not null").select("id", "url", n.alias("attempt"))
    return rows.where(c("attempt") <= cap).select("id", "attempt", scores.retry_delay_ms(F.lit(45), c("attempt")).alias("delay_ms"))


query("st06_retries", "requests", sql="select id, attempt, 45 * least(attempt, 4) * 1000 as delay_ms from (select id, row_number() over (partition by url order by created_at, id) as attempt from v_requests where error is not null) where attempt <= 3")(retries)


def crawl_outcomes(r: DataFrame) -> DataFrame:
    """What a crawl's record calls for: done, a rendered retry, a dead host, or another attempt."""
    dead = scores.dead_host(F.concat("error", F.when(c("id") % 3 == 0, F.lit(" (dns)")).otherwise(F.lit(""))))
    return r.select("id", F.when(c("error").isNull(), "completed").when(dead, "dead_host").when(c("duration_ms").isNull() | (c("duration_ms") > 50), "retry").otherwise("escalate").alias("outcome"))


query("pl02_crawl_outcomes", "requests", sql="select id, case when error is null then 'completed' when id % 3 = 0 then 'dead_host' when duration_ms is null or duration_ms > 50 then 'retry' else 'escalate' end as outcome from v_requests")(crawl_outcomes)


def merge_pages(r: DataFrame) -> DataFrame:
    """One row per company and page: first seen, last crawled, longest duration, whether any visit had no error."""
    return r.groupBy((c("id") % 40).alias("company_id"), "url").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("crawled_at"), F.max("duration_ms").alias("longest"), F.bool_or(c("error").isNull()).alias("ok"))


query("u07_merge_pages", "requests", sql="select id % 40 as company_id, url, min(created_at) as first_seen, max(created_at) as crawled_at, max(duration_ms) as longest, bool_or(error is null) as ok from v_requests group by 1, 2")(merge_pages)


def provenance(e: DataFrame) -> DataFrame:
    """Distinct sources of each address in order of sighting."""
    s = e.groupBy("email").agg(F.array_sort(F.collect_set("source_rank")).alias("sources"))
    return s.select("email", F.array_join(upserts.merge_provenance(c("sources"), F.lit(9)), ",").alias("sources"))


query("m01_provenance", "emails", sql="select email, array_to_string(list_sort(list_distinct(list_append(list(source_rank), 9))), ',') as sources from v_emails group by email")(provenance)
query("m02_json_fields", "places", sql="select seq, cast(json_extract_string('{\"a\": {\"n\": ' || cast(seq as string) || '}}', '$.a.n') as int) as n from v_places")(
    lambda p: p.select("seq", F.get_json_object(F.concat(F.lit('{"a": {"n": '), c("seq").cast("string"), F.lit("}}")), "$.a.n").cast("int").alias("n"))
)
query("m03_context_lines", "variants", sql="select cluster_slug, string_agg(variant_id || ':' || priority, '; ' order by priority desc, variant_id) as line from (select * from v_variants qualify row_number() over (partition by cluster_slug order by priority desc, variant_id) <= 6) group by cluster_slug")(
    lambda v: ranking.top_per_group(v, ["cluster_slug"], [F.desc("priority"), c("variant_id")], 6).groupBy("cluster_slug")
    .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("priority")).alias("p"), "variant_id"))), lambda x: F.concat(x["variant_id"].cast("string"), F.lit(":"), (-x["p"]).cast("string"))), "; ").alias("line"))
)
query("a42_ingest_summary", "places", "companies", "phones", sql="select count(*) as staged, count(distinct seq) as rows_kept from (select * from v_places where place_id <> '' qualify row_number() over (partition by place_id order by seq) = 1 union all select * from v_places where place_id = '')")(
    lambda p, k, ph: co.stage_places(p).agg(F.count("*").alias("staged"), F.countDistinct("seq").alias("rows_kept"))
)
_CASCADE = ORACLE_SQL["j08_match_cascade"].removeprefix(ctes("places", "companies", "phones"))
query(
    "a42_ingest_matches", "places", "companies", "phones", "run_companies",
    sql=f"""select staged, created, staged - created as matched, created + known as queued from (
  select count(*) as staged, count(distinct case when matched_by = 'new' then coalesce(cast(region_id as string) || '/' || key, 'seq ' || cast(seq as string)) end) as created
  from ({_CASCADE}) join (select seq, region_id, {_website_key('website')} as key from v_places) using (seq)),
  (select count(distinct company_id) as known from ({_CASCADE}) where company_id is not null and company_id not in (select company_id from v_run_companies where run_id % 40 = 0 and status in ('queued', 'running', 'completed')))""",
)(lambda p, k, ph, r: co.ingest_summary(co.stage_places(p), cascade(p, k, ph), r.where("run_id % 40 = 0")))
query("a30_draft_counts", "variants", sql="select strategy, count(distinct cluster_slug) as clusters, count(distinct label) as labels, count(*) as templates from v_variants group by strategy")(
    lambda v: v.groupBy("strategy").agg(F.countDistinct("cluster_slug").alias("clusters"), F.countDistinct("label").alias("labels"), F.count("*").alias("templates"))
)
query("s32_titles", "variants", sql="select variant_id, array_to_string(list_transform(list_filter(regexp_split_to_array(label, '[^A-Za-z0-9]+'), lambda w: w <> '')[1:8], lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as title from v_variants")(
    lambda v: v.select("variant_id", F.array_join(F.transform(F.slice(F.filter(F.split("label", "[^A-Za-z0-9]+"), lambda w: w != ""), 1, 8), lambda w: F.initcap(w)), " ").alias("title"))
)
query("s31_cache_keys", "prompts")(lambda p: p.select("prompt_id", prompts.cache_key(prompt=c("prompt"), model=F.lit("heuristic"), market=F.lit("TH")).alias("cache_key")))
query("t18_listing", "variants", sql="select variant_id, label from v_variants where priority > 10 order by priority, label, variant_id limit 200")(lambda v: v.where("priority > 10").orderBy("priority", "label", "variant_id").limit(200).select("variant_id", "label"))
query("pl08_job_completion", "places", sql="select coalesce(keyword, 'none') as keyword, count(*) as found, count(*) filter (place_id <> '') as with_id from v_places group by 1")(
    lambda p: p.groupBy(F.coalesce("keyword", F.lit("none")).alias("keyword")).agg(F.count("*").alias("found"), F.count_if(c("place_id") != "").alias("with_id"))
)
query("u18_clamped_scores", "evals", sql="select eval_id, greatest(0, least(5, judgement)) as judgement from v_evals where judgement is not null")(lambda e: e.where("judgement is not null").select("eval_id", F.greatest(F.lit(0), F.least(F.lit(5), c("judgement"))).alias("judgement")))
query("u21_get_or_create", "runs", sql="select run_id from v_runs where run_id % 2 = 0 union select run_id + 1 from v_runs where run_id % 4 = 0")(
    lambda r: upserts.insert_absent(r.where("run_id % 2 = 0").select("run_id"), r.where("run_id % 4 = 0").select((c("run_id") + 1).alias("run_id")), ["run_id"])
)

# --- A-30, A-39 and U-07 over the whole of their tables
def draft_counts(r: DataFrame, k: DataFrame, s: DataFrame) -> DataFrame:
    """The 20 newest generations, here runs, with their three kinds of children."""
    newest = r.orderBy(F.desc("started_at"), "run_id").limit(20).select(c("run_id").alias("generation_id"), "started_at")
    child = lambda df: df.select(c("run_id").alias("generation_id"))
    return runs.draft_counts(newest, verticals=child(k.where("line % 3 = 0")), clusters=child(s.where("region_id % 2 = 0")), templates=child(k.where("status = 'queued'")))


query(
    "a30_generation_counts", "runs", "run_companies", "run_stats",
    sql="""select g.run_id as generation_id, started_at, coalesce(v.n, 0) as verticals, coalesce(k.n, 0) as clusters, coalesce(t.n, 0) as templates from (select run_id, started_at from v_runs order by started_at desc, run_id limit 20) g
  left join (select run_id, count(*) as n from v_run_companies where line % 3 = 0 group by 1) v on v.run_id = g.run_id left join (select run_id, count(*) as n from v_run_stats where region_id % 2 = 0 group by 1) k on k.run_id = g.run_id
  left join (select run_id, count(*) as n from v_run_companies where status = 'queued' group by 1) t on t.run_id = g.run_id""",
)(draft_counts)


def sample_totals(k: DataFrame) -> DataFrame:
    """Figures over all sampled regions: a name that stands in two of them counts once."""
    name = F.lower(F.btrim("name"))
    t = k.agg(F.count("*").alias("results"), F.count_if(c("website_url") != "").alias("with_website"), F.countDistinct(F.when(c("name") != "", name)).alias("names"))
    rate = lambda n: F.coalesce(F.bround(F.try_divide(n, "results"), 4), F.lit(0.0))
    return t.select("*", rate("with_website").alias("website_rate"), rate("names").alias("name_rate"))


query(
    "a39_sample_totals", "companies",
    sql="select *, coalesce(round_even(with_website / nullif(results, 0), 4), 0) as website_rate, coalesce(round_even(names / nullif(results, 0), 4), 0) as name_rate from (select count(*) as results, count(*) filter (website_url <> '') as with_website, count(distinct lower(trim(name))) filter (name <> '') as names from v_companies)",
)(sample_totals)
_ORDER = "(coalesce(canonical_id, r.company_id) <> r.company_id)::int, r.company_id"
_TO = f"left join ({_CANON}) m on m.company_id = r.company_id"
query(
    "u07_canonical_pages", "requests", "companies",
    sql=f"""select coalesce(canonical_id, r.company_id) as company_id, url, arg_min(title, row({_ORDER}, id)) filter (title <> '') as title, arg_min(status_code, row({_ORDER}, id)) filter (status_code <> 0) as status_code, bool_or(has_contact_form) as has_contact_form,
  arg_min(error, row({_ORDER}, id)) filter (error <> '') as crawl_error, max(created_at) as crawled_at from (select *, id % 1500 as company_id, case when id % 3 = 0 then '' else request_kind end as title, duration_ms as status_code, id % 4 = 0 as has_contact_form from v_requests) r {_TO} group by 1, 2""",
)(
    lambda r, k: co.merge_pages(r.select((c("id") % 1500).alias("company_id"), c("id").alias("page_id"), "url", F.when(c("id") % 3 == 0, "").otherwise(c("request_kind")).alias("title"), c("duration_ms").alias("status_code"), (c("id") % 4 == 0).alias("has_contact_form"), c("error").alias("crawl_error"), c("created_at").alias("crawled_at")), co.canonical(k))
)
query(
    "u07_merge_channels", "channels", "companies",
    sql=f"select coalesce(canonical_id, r.company_id) as company_id, channel_type, lower(trim(value)) as normalized, arg_min(value, row(-length(trim(value)), {_ORDER}, channel_id)) as value, min(channel_id) as first_seen, max(channel_id) as last_seen from v_channels r {_TO} group by 1, 2, 3",
)(lambda ch, k: co.merge_channels(ch, co.canonical(k)))
query(
    "u07_merge_forms", "requests", "companies",
    sql=f"""select coalesce(canonical_id, r.company_id) as company_id, url as page_url, arg_min(action_url, row({_ORDER}, id)) filter (action_url <> '') as action_url, bool_or(error is not null) as has_captcha, bool_or(id % 7 = 0) as is_js_challenge, max(created_at) as last_checked_at
  from (select *, id % 1500 as company_id, case when id % 3 = 0 then null else request_kind end as action_url from v_requests where provider = 'crawler') r {_TO} group by 1, 2""",
)(
    lambda r, k: co.merge_forms(r.where("provider = 'crawler'").select((c("id") % 1500).alias("company_id"), c("id").alias("form_id"), c("url").alias("page_url"), F.when(c("id") % 3 != 0, c("request_kind")).alias("action_url"), c("error").isNotNull().alias("has_captcha"), (c("id") % 7 == 0).alias("is_js_challenge"), c("created_at").alias("last_checked_at")), co.canonical(k))
)
