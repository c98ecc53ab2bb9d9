"""Registered queries over recorded crawl results, recipes and ranking evidence; the rules are library functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import contacts, crawl, html, scores, urls
from brindle.operators import companies as co
from brindle.operators import ranking, upserts
from brindle.plans.catalog import _STATES, query, recommendations

c = F.col


def _any(text: str, words: tuple[str, ...]) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in quoted) + ")"


# --- crawl decisions: P-14, P-17 to P-21, P-23, P-24, S-20, S-21
_BLOCKED = "coalesce(status_code in (401, 403, 429, 503), false)"
query("p19_challenges", "crawled", sql=f"select page_id, {_BLOCKED} or {_any('lower(title || chr(32) || substr(body, 1, 4000))', crawl.CHALLENGE_HINTS)} as is_challenge from v_crawled")(
    lambda p: p.select("page_id", crawl.challenge_page(c("status_code"), c("title"), c("body")).alias("is_challenge"))
)
query("p20_header_retries", "crawled", sql=f"select page_id, not tried_headers and coalesce(status_code in (401, 403), false) and {_any('lower(body)', crawl.RETRY_HINTS)} as retry from v_crawled")(
    lambda p: p.select("page_id", crawl.header_retry(c("status_code"), c("body"), crawl.RETRY_HINTS, c("tried_headers")).alias("retry"))
)
query("p18_transport_errors", "crawled", sql=f"select page_id, (relay_host <> '' and contains(lower(message), lower(relay_host))) or {_any('lower(message)', crawl.TRANSPORT_HINTS)} as is_transport from v_crawled")(
    lambda p: p.select("page_id", crawl.transport_error(c("message"), c("relay_host")).alias("is_transport"))
)
query(
    "p17_dead_responses", "crawled",
    sql="""select page_id, contains(replace(lower(reason), ' ', '_'), 'no_host_connection') or coalesce(status_code in (521, 522, 523, 530), false)
  or coalesce(status_code = 502 and (contains(lower(substr(body, 1, 512)), 'no_host_connection') or contains(lower(substr(body, 1, 512)), 'host connection')), false) as dead_response,
  regexp_matches(lower(message), 'no host connection|temporary failure in name resolution|name or service not known|nodename nor servname provided|getaddrinfo failed|failed to resolve|no address associated with hostname|hostname nor servname provided|server misbehaving|dns|no route to host') as dead_message from v_crawled""",
)(lambda p: p.select("page_id", scores.dead_host_response(c("status_code"), c("reason"), c("body")).alias("dead_response"), scores.dead_host(c("message")).alias("dead_message")))
query("p21_useless_pages", "crawled", sql="select page_id, case when has_contact then false when has_social and text_length >= 160 then false when status_code is null or status_code >= 400 then true else text_length < 160 end as useless from v_crawled")(
    lambda p: p.select("page_id", html.useless_page(c("status_code"), c("text_length"), c("has_contact"), c("has_social")).alias("useless"))
)


def escalated(p: DataFrame) -> DataFrame:
    """One row per site: flags over its pages decide."""
    has = lambda e: F.coalesce(F.bool_or(e), F.lit(False))
    real = c("error").isNotNull() | c("status_code").isNotNull()
    sites = p.groupBy("site_id").agg(
        F.min("crawl_status").alias("crawl_status"), F.count_if(real).alias("pages"), has(c("has_contact")).alias("has_contacts"), has(c("status_code").isin(*crawl.BLOCKED_STATUS)).alias("blocked"),
        has(c("error") == "anti_bot_challenge").alias("challenged"), has(c("error") == "js_shell").alias("shell"), has(c("error") == "cross_domain_redirect_after_ssl_fallback").alias("redirected"),
    )
    flags = ("crawl_status", "pages", "has_contacts", "blocked", "challenged", "shell", "redirected")
    return sites.select("site_id", crawl.escalate_site(*[c(f) for f in flags]).alias("escalate"))


query(
    "p23_escalated_sites", "crawled",
    sql="""select site_id, case when pages = 0 then st in ('blocked_by_robots', 'failed') when has_contacts then false when blocked or challenged or shell then true when redirected then false else st in ('blocked_by_robots', 'robots_bypassed') end as escalate
from (select site_id, min(crawl_status) as st, count(*) filter (error is not null or status_code is not null) as pages, bool_or(has_contact) as has_contacts, coalesce(bool_or(status_code in (401, 403, 429, 503)), false) as blocked,
  coalesce(bool_or(error = 'anti_bot_challenge'), false) as challenged, coalesce(bool_or(error = 'js_shell'), false) as shell, coalesce(bool_or(error = 'cross_domain_redirect_after_ssl_fallback'), false) as redirected from v_crawled group by site_id)""",
)(escalated)
query("p24_phone_contexts", "crawled", sql=f"select page_id, {_any('lower(substr(body, greatest(pos - 40, 0) + 1, pos + 15 + 40 - greatest(pos - 40, 0)))', contacts.PHONE_HINTS)} as has_hint from (select *, strpos(body, '+66 81') - 1 as pos from v_crawled)")(
    lambda p: p.withColumn("pos", F.instr("body", "+66 81") - 1).select("page_id", crawl.phone_in_context(c("body"), c("pos"), F.lit(15)).alias("has_hint"))
)
_DOMAIN = "regexp_extract(asset_email, '^[^@]*@(.*)$', 1)"
query(
    "p14_asset_emails", "crawled",
    sql=f"select page_id, {_DOMAIN} = host or ends_with({_DOMAIN}, '.' || host) or ends_with(host, '.' || {_DOMAIN}) or {_DOMAIN} in ({', '.join(repr(d) for d in contacts.COMMON_MAILBOX_DOMAINS)}) as accepted from v_crawled",
)(lambda p: p.select("page_id", contacts.is_asset_candidate(c("asset_email"), c("host")).alias("accepted")))
query("s20_messenger_digits", "crawled", sql="select page_id, '+' || nullif(regexp_replace(href, '\\D', '', 'g'), '') as digits from v_crawled where contains(href, 'wa.me') or contains(href, 'whatsapp')")(
    lambda p: p.where(c("href").contains("wa.me") | c("href").contains("whatsapp")).select("page_id", crawl.messenger_digits(c("href")).alias("digits"))
)
query("s21_handles", "crawled", sql="select page_id, case when contains(href, 't.me/') then '@' || lower(rtrim(regexp_extract(href, 't\\.me/(.*)$', 1), '/')) else lower(href) end as handle from v_crawled where contains(href, 't.me/') or href like '@%'")(
    lambda p: p.where(c("href").contains("t.me/") | c("href").startswith("@")).select("page_id", contacts.telegram_handle(c("href")).alias("handle"))
)
query("s23_tag_values", "recipes", sql="select recipe_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(tags, ' ', ' ;| '), '[;|]'), lambda x: trim(x)), lambda x: x <> '')) as value from v_recipes")(
    lambda r: r.select("recipe_id", F.explode(contacts.tag_values(F.replace(c("tags"), F.lit(" "), F.lit(" ;| ")))).alias("value"))
)
query("s03_schemes", "places", sql="select seq, case when contains(trim(website), '://') then trim(website) else 'https://' || trim(website) end as url from v_places")(lambda p: p.select("seq", urls.with_scheme(c("website")).alias("url")))
query("s06_place_ids", "crawled", sql="select page_id, 'p' || (page_id % 50) as place from v_crawled")(
    lambda p: p.select("page_id", urls.place_id(F.concat(F.when(c("page_id") % 2 == 0, F.lit("https://maps.example.com/data=!4m5!1s")).otherwise(F.lit("https://maps.example.com/?q=place_id:")), F.lit("p"), (c("page_id") % 50).cast("string"), F.when(c("page_id") % 2 == 0, F.lit("!8m2")).otherwise(F.lit("&hl=en")))).alias("place"))
)
query("d04_sizes", "crawled", sql="select page_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024) else printf('%.1f MB', n / 1048576) end as size from (select page_id, page_id * page_id % 9000000 as n from v_crawled)")(
    lambda p: p.select("page_id", scores.size_label(c("page_id") * c("page_id") % 9000000).alias("size"))
)
query("st07_greylist_retries", "replies", sql="select id, attempt, case when attempt > 4 then 'unknown' else 'retry' end as next_step, case when attempt <= 4 then list_extract([300, 900, 3600, 14400], cast(attempt as int)) end as delay_s from (select id, id % 6 + 1 as attempt from v_replies)")(
    lambda r: r.select("id", (c("id") % 6 + 1).alias("attempt")).select("id", "attempt", F.when(c("attempt") > 4, "unknown").otherwise("retry").alias("next_step"), F.when(c("attempt") <= 4, scores.greylist_delay_s(c("attempt"))).alias("delay_s"))
)
query("st11_daily_uses", "requests", sql="select proxy_id, case when epoch(timestamp '2024-06-01 00:00:00') - epoch(max(created_at)) > 86400 then 0 else count(*) end as uses from v_requests where used_proxy group by proxy_id")(
    lambda r: r.where("used_proxy").groupBy("proxy_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last")).select("proxy_id", crawl.uses_today(c("n"), c("last"), F.to_timestamp(F.lit("2024-06-01 00:00:00"))).alias("uses"))
)
query("st03_queued_companies", "run_companies", sql="select run_id, company_id, status, case when status is null or status in ('failed', 'skipped') then 'queued' else status end as next_status from (select run_id, company_id, arg_max(status, (line, status)) as status from v_run_companies group by run_id, company_id)")(
    lambda r: r.groupBy("run_id", "company_id").agg(F.max_by("status", F.struct("line", "status")).alias("status")).select("run_id", "company_id", "status", crawl.next_status(c("status")).alias("next_status"))
)
query("st02_cooldown", "runs", sql="select region_id, max(started_at) as last_run, epoch(timestamp '1998-06-01 00:00:00') - epoch(cast(max(started_at) as timestamp)) >= 168 * 3600 as refresh from v_runs where status = 'completed' group by region_id")(
    lambda r: r.where("status = 'completed'").groupBy("region_id").agg(F.max("started_at").alias("last_run")).select("region_id", "last_run", (F.unix_timestamp(F.to_timestamp(F.lit("1998-06-01 00:00:00"))) - F.unix_timestamp(c("last_run").cast("timestamp")) >= 168 * 3600).alias("refresh"))
)

# --- ranking: S-43, T-04, T-05, T-06, T-08, T-09, A-34, S-51


def evidence(v: DataFrame) -> DataFrame:
    """Variants with their cluster's evidence and recommendation. Clusters are reduced first, then joined."""
    per = v.groupBy("cluster_slug").agg(F.sum("validation_count").alias("cluster_runs"), F.sum(c("validation_count") * c("validation_score")).alias("weighted"), F.sum("planner_drafted").alias("cluster_adopted"))
    per = per.select("cluster_slug", "cluster_runs", "cluster_adopted", F.when(c("cluster_runs") > 0, F.bround(c("weighted") / c("cluster_runs"), 0).cast("int")).otherwise(0).alias("cluster_score"))
    states = recommendations(v).select("variant_id", c("state"), c("rank_bonus"))
    return v.join(per, "cluster_slug").join(states, "variant_id").withColumn("template_score", c("priority")).withColumn("prompt_match_score", c("variant_id") % 7).withColumn("adopted", c("planner_drafted"))


def fits(v: DataFrame) -> DataFrame:
    e = evidence(v)
    return e.withColumn("fit", scores.fit_score({k: c(k) for k in e.columns}, c("rank_bonus")).cast("long"))


_PART = lambda s, n, f, cap: f"case when {s} <= 0 or {n} <= 0 then 0 else cast(round_even({s} * {f}::double * (least({n}, {cap}) / {cap}), 0) as int) end"
_FITS = f"""(select v.*, state, cluster_runs, cluster_score, cluster_adopted, priority + variant_id % 7 + {_PART('validation_score', 'validation_count', 0.4, 5)}
  + case when cluster_runs <= 0 then 0 else cast(round_even(cluster_score * 0.15::double * (least(cluster_runs, 8) / 8), 0) as int) end + least(planner_drafted, 6) * 2 + least(cluster_adopted, 12)
  + least(planner_selected, 8) + least(planner_drafted, 8) * 2 + least(planner_activated, 8) * 4 + least(market_selected, 6) + least(market_drafted, 6) + least(market_activated, 6) * 2
  + {_PART('production_score', 'production_runs', 0.3, 5)} + {_PART('market_score', 'market_runs', 0.25, 4)} + {_PART('strategy_score', 'strategy_runs', 0.2, 6)}
  + case state when 'suppressed' then -20 when 'trusted' then 12 when 'recommended' then 5 else 0 end as fit
  from v_variants v join (select cluster_slug, sum(validation_count) as cluster_runs, coalesce(cast(round_even(sum(validation_count * validation_score) / nullif(sum(validation_count), 0), 0) as int), 0) as cluster_score, sum(planner_drafted) as cluster_adopted from v_variants group by cluster_slug) using (cluster_slug)
  join (select variant_id, state from ({_STATES})) using (variant_id))"""
query("s43_fit_scores", "variants", sql=f"select variant_id, fit, cluster_score, cast(cluster_runs as bigint) as cluster_runs from {_FITS}")(lambda v: fits(v).select("variant_id", "fit", "cluster_score", "cluster_runs"))
KEYS_13 = ("market_activated", "market_drafted", "planner_activated", "planner_drafted", "market_score", "strategy_score", "production_score", "validation_score", "cluster_score")
query(
    "t05_thirteen_keys", "variants",
    sql=f"select variant_id, row_number() over (partition by cluster_slug order by fit desc, state <> 'trusted', state = 'suppressed', {', '.join(f'{k} desc' for k in KEYS_13)}, label, variant_id) as rank from {_FITS}",
)(lambda v: ranking.ranked(fits(v), ["cluster_slug"], [F.desc("fit"), c("state") != "trusted", c("state") == "suppressed", *[F.desc(k) for k in KEYS_13], c("label"), c("variant_id")]).select("variant_id", "rank"))
KEYS_6 = ("market_activated", "market_drafted", "prompt_activated", "prompt_drafted", "prompt_selected")
query("t06_prompt_order", "variants", sql=f"select variant_id, row_number() over (partition by cluster_slug order by fit desc, {', '.join(f'{k} desc' for k in KEYS_6)}, label, variant_id) as rank from {_FITS}")(
    lambda v: ranking.ranked(fits(v), ["cluster_slug"], [F.desc("fit"), *[F.desc(k) for k in KEYS_6], c("label"), c("variant_id")]).select("variant_id", "rank")
)
query("t08_draft_order", "variants", sql=f"select variant_id, row_number() over (partition by cluster_slug order by fit desc, strategy, label, variant_id) as rank from {_FITS}")(
    lambda v: ranking.ranked(fits(v), ["cluster_slug"], [F.desc("fit"), c("strategy"), c("label"), c("variant_id")]).select("variant_id", "rank")
)
query(
    "t09_compare_order", "variants",
    sql=f"select variant_id, status, row_number() over (partition by cluster_slug order by case status when 'shared' then 0 when 'selected_only' then 1 when 'heuristic_only' then 2 else 9 end, coalesce(selected, fit) desc, label, variant_id) as rank from (select *, case variant_id % 3 when 0 then 'shared' when 1 then 'selected_only' else 'heuristic_only' end as status, case when variant_id % 3 <> 2 then fit + variant_id % 5 end as selected from {_FITS})",
)(
    lambda v: ranking.ranked(
        fits(v).withColumn("status", F.when(c("variant_id") % 3 == 0, "shared").when(c("variant_id") % 3 == 1, "selected_only").otherwise("heuristic_only")).withColumn("selected", F.when(c("variant_id") % 3 != 2, c("fit") + c("variant_id") % 5)),
        ["cluster_slug"], [F.when(c("status") == "shared", 0).when(c("status") == "selected_only", 1).when(c("status") == "heuristic_only", 2).otherwise(9), F.desc(F.coalesce("selected", "fit")), c("label"), c("variant_id")],
    ).select("variant_id", "status", "rank")
)
query("t04_slices", "variants", sql=f"select cluster_slug, strategy, variant_id from (select *, row_number() over (partition by cluster_slug, strategy order by fit desc, variant_id) as r from {_FITS}) where r <= case strategy when 'hybrid' then 12 else 8 end")(
    lambda v: ranking.ranked(fits(v), ["cluster_slug", "strategy"], [F.desc("fit"), c("variant_id")]).where(c("rank") <= F.when(c("strategy") == "hybrid", 12).otherwise(8)).select("cluster_slug", "strategy", "variant_id")
)
query(
    "a34_policy_snapshot", "variants",
    sql=f"select strategy, count(*) as variants, cast(round_even(avg(validation_score), 0) as int) as validation, cast(round_even(avg(production_score), 0) as int) as production, cast(round_even(avg(fit), 0) as int) as rank_score, count(*) filter (state = 'trusted') as trusted, count(*) filter (state = 'recommended') as recommended, count(*) filter (state = 'suppressed') as suppressed from {_FITS} group by strategy",
)(
    lambda v: fits(v).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("variants"), *[F.bround(F.avg(k), 0).cast("int").alias(n) for k, n in (("validation_score", "validation"), ("production_score", "production"), ("fit", "rank_score"))],
        *[F.count_if(c("state") == s).alias(s) for s in ("trusted", "recommended", "suppressed")],
    )
)
_NOW = {"rec_val": 60, "trust_val": 75, "rec_prod": 20, "trust_prod": 40, "sup_val": 35, "sup_prod": 10, "rec_act": 1, "trust_act": 2}


_RANKS = {
    "rec_val": ("validation_score", "validation_count", 0.55), "trust_val": ("validation_score", "validation_count", 0.8), "sup_val": ("validation_score", "validation_count", 0.2),
    "rec_prod": ("production_score", "production_runs", 0.55), "trust_prod": ("production_score", "production_runs", 0.8), "sup_prod": ("production_score", "production_runs", 0.2), "trust_act": ("activations", None, 0.75),
}


def thresholds(v: DataFrame) -> DataFrame:
    """Suggested thresholds per strategy: nearest ranks of the scores of variants that were tried, read from counts per value, and the median
    of activations by planner and prompt; so no group is gathered."""
    v = v.withColumns({"activations": F.greatest(F.lit(0), c("planner_activated") + c("prompt_activated")), **{s: F.greatest(F.lit(0), F.coalesce(s, F.lit(0))) for s in ("validation_score", "production_score")}})
    seen = v.groupBy("strategy").agg(F.bround(F.percentile("activations", F.lit(0.5)), 0).cast("int").alias("rec_act"))
    for name, (score, tried, p) in _RANKS.items():
        seen = seen.join(ranking.nearest_rank_by_counts(v.where(c(tried) > 0) if tried else v, "strategy", score, p, name), "strategy", "left")
    out = scores.suggested_thresholds({k: F.lit(n) for k, n in _NOW.items()}, {k: c(k).cast("int") for k in _NOW}, F.lit(0.5))
    return seen.select("strategy", *[e.alias(f"new_{k}") for k, e in out.items()])


def _clamps(v: str) -> str:
    return f"""select strategy, r_val, greatest(r_val + 5, least(100, {v}trust_val)) as t_val, r_prod, greatest(r_prod + 5, least(100, {v}trust_prod)) as t_prod, greatest(0, least(r_val - 5, {v}sup_val)) as s_val, greatest(0, least(r_prod - 3, {v}sup_prod)) as s_prod, r_act, greatest(r_act + 1, least(5, {v}trust_act)) as t_act
from (select *, greatest(25, least(95, {v}rec_val)) as r_val, greatest(5, least(95, {v}rec_prod)) as r_prod, greatest(0, least(3, {v}rec_act)) as r_act from"""


def _rank(score: str, tried: str | None, p: float) -> str:
    values = f"list(greatest(0, {score}) order by greatest(0, {score}))" + (f" filter ({tried} > 0)" if tried else "")
    return f"list_extract({values}, cast(round_even((len({values}) - 1) * {p}::double, 0) as int) + 1)"


_SEEN = "select strategy, " + ", ".join(f"coalesce({_rank(*of)}, {_NOW[k]}) as o_{k}" for k, of in {**_RANKS, "trust_act": ("planner_activated + prompt_activated", None, 0.75)}.items())
_SEEN += ", cast(round_even(median(greatest(0, planner_activated + prompt_activated)), 0) as int) as o_rec_act from v_variants group by strategy"
_SHORT = {"rec_val": "r_val", "trust_val": "t_val", "rec_prod": "r_prod", "trust_prod": "t_prod", "sup_val": "s_val", "sup_prod": "s_prod", "rec_act": "r_act", "trust_act": "t_act"}
_BLEND = "select strategy, " + ", ".join(f"greatest(0, {_NOW[k]} + cast(round_even(({s} - {_NOW[k]}) * 0.5::double, 0) as int)) as b_{k}" for k, s in _SHORT.items())
query("s51_thresholds", "variants", sql="select strategy, " + ", ".join(f"{s} as new_{k}" for k, s in _SHORT.items()) + f" from ({_clamps('b_')} ({_BLEND} from ({_clamps('o_')} ({_SEEN}))))))")(thresholds)

# --- recipes and listings: P-04, P-27, P-31 to P-33, J-10, J-13, J-22, J-24, J-27, J-28, A-45, A-48, A-49, T-14, T-15, T-17, T-19, X-05, S-61
query("p04_scope", "companies", "regions", sql="select company_id from v_companies where case when 5 is not null then region_id = 5 else region_id in (select region_id from v_regions where country_code = 'NA') end")(
    lambda a, r: co.in_scope(a, r, region_id=5, country_code="NA").select("company_id")
)
query("p04_country_scope", "companies", "regions", sql="select company_id from v_companies where region_id in (select region_id from v_regions where country_code = 'NA')")(lambda a, r: co.in_scope(a, r, country_code="NA").select("company_id"))
query("p27_unknown_emails", "emails", sql="select company_id, count(distinct lower(email)) as unknown from v_emails where source_rank = 0 group by company_id")(
    lambda e: e.where("source_rank = 0").groupBy("company_id").agg(F.countDistinct(F.lower("email")).alias("unknown"))
)
query(
    "p31_promotions", "recipes",
    sql="select recipe_id, case when not lint_passed then 'lint' when target not in ('candidate', 'active', 'deprecated') then 'unsupported' when target = 'active' and not gate_passed then 'gate' else 'ok' end as outcome, case when lint_passed and target in ('candidate', 'active', 'deprecated') and (target <> 'active' or gate_passed) then target else status end as status from v_recipes",
)(lambda r: r.withColumn("outcome", upserts.promotion(c("target"), c("lint_passed"), c("gate_passed"))).select("recipe_id", "outcome", F.when(c("outcome") == "ok", c("target")).otherwise(c("status")).alias("status")))


def effective(r: DataFrame) -> DataFrame:
    """Per category, the latest version of its recipe if that is active, else the category's own columns."""
    top = r.groupBy("category").agg(F.max_by(F.struct("tags", "version", "status"), F.struct("version", "recipe_id")).alias("x"), F.min("label").alias("own"))
    live = c("x.status") == "active"
    return top.select("category", F.when(live, c("x.tags")).otherwise(c("own")).alias("tags"), F.when(live, c("x.version")).alias("version"), F.when(live, "recipe").otherwise("category").alias("source"))


query(
    "p32_effective_config", "recipes",
    sql="select category, case when status = 'active' then tags else own end as tags, case when status = 'active' then version end as version, case when status = 'active' then 'recipe' else 'category' end as source from (select category, arg_max(tags, (version, recipe_id)) as tags, max(version) as version, arg_max(status, (version, recipe_id)) as status, min('own ' || category) as own from v_recipes group by category)",
)(lambda r: effective(r.withColumn("label", F.concat(F.lit("own "), c("category")))))
query("p33_ingestion_checks", "places", "regions", sql="select seq, case when seq % 3 = 0 and seq % 2 = 1 then 'enqueue_needs_materialize' when region_id is null or region_id not in (select region_id from v_regions where is_active) then 'region_unknown' else 'ok' end as verdict from v_places")(
    lambda p, r: p.join(r.where("is_active").select(c("region_id"), F.lit(True).alias("known")), "region_id", "left").select("seq", F.when((c("seq") % 3 == 0) & (c("seq") % 2 == 1), "enqueue_needs_materialize").when(c("known").isNull(), "region_unknown").otherwise("ok").alias("verdict"))
)
query(
    "j10_recipe_fallback", "recipes", "variants",
    sql="""select v.variant_id, coalesce(a.recipe_id, b.recipe_id) as recipe_id, case when a.recipe_id is not null then 'category' when b.recipe_id is not null then 'slug' end as found_by from v_variants v
left join (select category, min(recipe_id) as recipe_id from v_recipes where status = 'active' group by category) a on a.category = v.cluster_slug
left join (select slug, min(recipe_id) as recipe_id from v_recipes group by slug) b on b.slug = 'recipe-' || (v.variant_id % 60)""",
)(
    lambda r, v: v.select("variant_id", "cluster_slug", F.concat(F.lit("recipe-"), (c("variant_id") % 60).cast("string")).alias("slug"))
    .join(r.where("status = 'active'").groupBy(c("category").alias("cluster_slug")).agg(F.min("recipe_id").alias("x")), "cluster_slug", "left").join(r.groupBy("slug").agg(F.min("recipe_id").alias("y")), "slug", "left")
    .select("variant_id", F.coalesce("x", "y").alias("recipe_id"), F.when(c("x").isNotNull(), "category").when(c("y").isNotNull(), "slug").alias("found_by"))
)
query("j13_all_versions", "recipes", sql="select a.slug, b.version, b.status from (select slug, min(recipe_id) as recipe_id from v_recipes group by slug) a join v_recipes b on a.slug = b.slug")(
    lambda r: r.groupBy("slug").agg(F.min("recipe_id").alias("first_id")).join(r, "slug").select("slug", "version", "status")
)
query("j22_phone_channels", "phones", "channels", sql="select ch.channel_id, ph.raw from v_channels ch join (select company_id, phone, min(raw) as raw from v_phones group by company_id, phone) ph on ph.company_id = ch.company_id and ph.phone = '+66' || lpad(cast(ch.channel_id % 700 as string), 9, '0') where ch.channel_type = 'whatsapp'")(
    lambda p, h: h.where("channel_type = 'whatsapp'").withColumn("phone", F.concat(F.lit("+66"), F.lpad((c("channel_id") % 700).cast("string"), 9, "0"))).join(p.groupBy("company_id", "phone").agg(F.min("raw").alias("raw")), ["company_id", "phone"]).select("channel_id", "raw")
)
query("j24_eval_labels", "evals", "recipes", sql="select eval_id, coalesce(slug, 'unknown') as recipe from v_evals left join (select recipe_id, min(slug) as slug from v_recipes group by recipe_id) on recipe_id = eval_id % 3000")(
    lambda e, r: e.withColumn("recipe_id", c("eval_id") % 3000).join(r.groupBy("recipe_id").agg(F.min("slug").alias("slug")), "recipe_id", "left").select("eval_id", F.coalesce("slug", F.lit("unknown")).alias("recipe"))
)
query("j27_variant_recipes", "outcomes", "recipes", sql="select distinct plan_id, variant_key, slug from (select distinct plan_id, variant_key from v_outcomes where drafted) o join v_recipes r on r.template_key = o.variant_key")(
    lambda o, r: o.where("drafted").select("plan_id", "variant_key").distinct().join(r.select(c("template_key").alias("variant_key"), "slug").distinct(), "variant_key").select("plan_id", "variant_key", "slug").distinct()
)
query("j28_templates", "variants", "recipes", sql="select distinct cluster_slug, 'table' as source from v_variants where cluster_slug in (select category from v_recipes where status = 'active' and version = 5) union all select distinct cluster_slug, 'built-in' from v_variants where cluster_slug not in (select category from v_recipes where status = 'active' and version = 5)")(
    lambda v, r: v.select("cluster_slug").distinct().join(r.where("status = 'active' and version = 5").select(c("category").alias("cluster_slug"), F.lit("table").alias("source")).distinct(), "cluster_slug", "left").select("cluster_slug", F.coalesce("source", F.lit("built-in")).alias("source"))
)
query("a45_pool_utilisation", "requests", sql="select provider, count(*) filter (used_proxy) as used, round_even(100.0 * count(*) filter (used_proxy) / count(*), 1)::double as utilisation from v_requests group by provider")(
    lambda r: r.groupBy("provider").agg(F.count_if(c("used_proxy")).alias("used"), F.count(F.lit(1)).alias("n")).select("provider", "used", F.bround(F.lit(100.0) * c("used") / c("n"), 1).alias("utilisation"))
)
query("a48_planner_usage", "outcomes", sql="select provider, region_id, count(*) as used, greatest(0, 200 - count(*)) as remaining from v_outcomes group by provider, region_id")(
    lambda o: o.groupBy("provider", "region_id").agg(F.count(F.lit(1)).alias("used")).withColumn("remaining", F.greatest(F.lit(0), 200 - c("used")))
)
query("a49_pool_stats", "requests", sql="select proxy_id, count(*) as uses, count(*) filter (error is not null) as errors, max(created_at) as last_used from v_requests where used_proxy group by proxy_id")(
    lambda r: r.where("used_proxy").groupBy("proxy_id").agg(F.count(F.lit(1)).alias("uses"), F.count("error").alias("errors"), F.max("created_at").alias("last_used"))
)
query("t14_policy_order", "audits", sql="select policy, count(*) as changes, row_number() over (order by case policy when 3 then 0 else policy + 1 end) as place from v_audits group by policy")(
    # a row per policy, of which there are a handful
    lambda a: a.groupBy("policy").agg(F.count(F.lit(1)).alias("changes")).withColumn("place", F.row_number().over(Window.orderBy(F.when(c("policy") == 3, 0).otherwise(c("policy") + 1))))
)
query("t15_newest_audits", "audits", sql="select policy, audit_id from (select *, row_number() over (partition by policy order by changed_at desc, audit_id desc) as r from v_audits) where r <= 20")(
    lambda a: ranking.ranked(a, ["policy"], [F.desc("changed_at"), F.desc("audit_id")]).where("rank <= 20").select("policy", "audit_id")
)
query("t17_draft_details", "recipes", sql="select recipe_id, row_number() over (partition by category order by slug, version, recipe_id) as place from v_recipes where status = 'draft'")(
    lambda r: ranking.ranked(r.where("status = 'draft'"), ["category"], [c("slug"), c("version"), c("recipe_id")]).select("recipe_id", c("rank").alias("place"))
)
query("t19_regions", "regions", sql="select region_id, row_number() over (partition by country_code order by name, region_id) as place from v_regions")(
    lambda r: ranking.ranked(r, ["country_code"], [c("name"), c("region_id")]).select("region_id", c("rank").alias("place"))
)
query("x05_selected_or_drafted", "outcomes", sql="select plan_id, list_sort(list_distinct(list(variant_key) filter (selected or drafted))) as keys from v_outcomes where selected or drafted group by plan_id")(
    lambda o: o.where("selected or drafted").groupBy("plan_id").agg(F.collect_set(F.when(c("selected"), c("variant_key"))).alias("a"), F.collect_set(F.when(c("drafted"), c("variant_key"))).alias("b")).select("plan_id", F.array_sort(F.array_union("a", "b")).alias("keys"))
)
#: Names of the views' strategies among those that have floors; one of the five has no recipes here.
_FULL_NAMES = {"overpass": "overpass_discovery_enrich", "hybrid": "hybrid_discovery", "google_maps": "browser_assisted_discovery", "directory": "directory_expansion"}
query(
    "s61_strategy_floors", "variants",
    sql="select distinct strategy, unnest(['validation_score', 'validation_runs', 'production_score', 'production_runs']) as kind, unnest(case strategy when 'overpass' then [55, 1, 0, 0] when 'hybrid' then [58, 1, 5, 1] when 'google_maps' then [65, 1, 15, 1] else [60, 1, 10, 1] end) as floor from v_variants",
)(
    lambda v: v.select("strategy").distinct().select("strategy", F.explode(scores.activation_floors(F.coalesce(*[F.when(c("strategy") == k, n) for k, n in _FULL_NAMES.items()]))).alias("f")).select("strategy", "f.*")
)

# --- writes: U-04, U-14, U-19, U-23, U-24
query(
    "u04_channels", "channels",
    sql="select company_id, channel_type, lower(value) as value, count(*) as seen, min(channel_id) as first_id from v_channels group by company_id, channel_type, lower(value)",
)(lambda h: h.groupBy("company_id", "channel_type", F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("seen"), F.min("channel_id").alias("first_id")))
query("u14_approved_drafts", "recipes", sql="select slug, first_id, 1000 + row_number() over (partition by category order by first_id) - 1 as sort_order from (select slug, min(category) as category, min(recipe_id) as first_id from v_recipes where status = 'draft' group by slug)")(
    lambda r: ranking.ranked(r.where("status = 'draft'").groupBy("slug").agg(F.min("category").alias("category"), F.min("recipe_id").alias("first_id")), ["category"], [c("first_id")]).select("slug", "first_id", (c("rank") + 999).alias("sort_order"))
)
query("u19_region_upsert", "regions", "runs", sql="select coalesce(a.region_id, b.region_id) as region_id, coalesce(a.name, 'Region ' || b.region_id) as name, coalesce(b.n, 0) as runs from v_regions a full join (select region_id, count(*) as n from v_runs group by region_id) b on a.region_id = b.region_id")(
    lambda r, x: r.join(x.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")), "region_id", "full").select("region_id", F.coalesce("name", F.concat(F.lit("Region "), c("region_id").cast("string"))).alias("name"), F.coalesce("n", F.lit(0)).alias("runs"))
)
query("u23_subdivisions", "regions", sql="select distinct country_code || '-' || lpad(cast(region_id % 3 as string), 2, '0') as code, country_code as parent from v_regions where is_active")(
    lambda r: r.where("is_active").select(F.concat_ws("-", "country_code", F.lpad((c("region_id") % 3).cast("string"), 2, "0")).alias("code"), c("country_code").alias("parent")).distinct()
)
query("u24_pending_emails", "emails", sql="select company_id, lower(email) as email, max(source_rank) as source_rank, count(*) as pending from v_emails group by company_id, lower(email)")(
    lambda e: e.groupBy("company_id", F.lower("email").alias("email")).agg(F.max("source_rank").alias("source_rank"), F.count(F.lit(1)).alias("pending"))
)
