"""Further registered queries: lookups, sets, quotas, policies, small projections and table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import outcomes, prompts, scores, urls
from brindle.operators import companies as co
from brindle.operators import ranking, runs, upserts
from brindle.plans.catalog import FLOORS, query

c = F.col
one = "*"

# --- filters
query("p02_area_scope", "regions", sql="select region_id, case when contains(code, '-') then 'subdivision' else 'country' end as scope from (select region_id, case when region_id % 2 = 0 then country_code || '-' || cast(region_id as string) else country_code end as code from v_regions)")(
    lambda r: r.select("region_id", F.when(F.when(c("region_id") % 2 == 0, F.concat("country_code", F.lit("-"), c("region_id").cast("string"))).otherwise(c("country_code")).contains("-"), "subdivision").otherwise("country").alias("scope"))
)
query("p03_active_regions", "regions", sql="select region_id, name from v_regions where is_active and level > 2")(lambda r: r.where("is_active and level > 2").select("region_id", "name"))
query("p06_open_items", "run_companies", sql="select run_id, company_id, line from v_run_companies where status not in ('completed', 'failed', 'skipped')")(lambda r: r.where(~c("status").isin(*runs.TERMINAL)).select("run_id", "company_id", "line"))
query("p08_discovery_due", "runs", sql="select region_id, max(started_at) is null or epoch(timestamp '1998-08-02 00:00:00') - epoch(max(started_at)) >= 168 * 3600 as due from v_runs where status = 'completed' group by region_id")(
    lambda r: r.where("status = 'completed'").groupBy("region_id").agg(F.max("started_at").alias("m")).select("region_id", (F.unix_seconds(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_seconds(c("m").cast("timestamp")) >= 168 * 3600).alias("due"))
)
query("p10_valid_cache", "audits", sql="select policy, audit_id from v_audits where changed_at >= timestamp '1995-01-01 00:00:00' qualify row_number() over (partition by policy order by changed_at desc, audit_id) = 1")(
    lambda a: ranking.top_per_group(a.where("changed_at >= timestamp_ntz '1995-01-01 00:00:00'"), ["policy"], [F.desc("changed_at"), c("audit_id")]).select("policy", "audit_id")
)
query("p11_number_search", "phones", sql="select phone_id, phone from v_phones where contains(phone, '12') order by phone, phone_id limit 50")(lambda p: p.where(c("phone").contains("12")).orderBy("phone", "phone_id").limit(50).select("phone_id", "phone"))
query("p25_placeholders", "companies", sql="select company_id, lower(trim(coalesce(name, ''))) = '' or starts_with(lower(trim(name)), 'place-') as placeholder from v_companies")(lambda k: k.select("company_id", co.is_placeholder(c("name")).alias("placeholder")))
query("p28_free_proxies", "requests", sql="select proxy_id from v_requests where used_proxy group by proxy_id having count(*) filter (error is not null and created_at >= timestamp '2024-01-20 00:00:00') < 40")(
    lambda r: r.where("used_proxy").groupBy("proxy_id").agg(F.count_if(c("error").isNotNull() & (c("created_at") >= F.expr("timestamp_ntz '2024-01-20 00:00:00'"))).alias("n")).where("n < 40").select("proxy_id")
)


def gates(v: DataFrame) -> DataFrame:
    """Why a variant may not be activated yet, as a list without nulls."""
    why = F.array_compact(F.array(F.when(c("validation_count") == 0, "no validation"), F.when(c("validation_score") < 35, "validation score"), F.when(c("production_runs") == 0, "no production")))
    return v.select("variant_id", F.array_join(why, "; ").alias("errors"), (F.size(why) == 0).alias("open"))


query(
    "p30_activation_gate", "variants",
    sql="select variant_id, array_to_string(w, '; ') as errors, len(w) = 0 as open from (select variant_id, list_filter([case when validation_count = 0 then 'no validation' end, case when validation_score < 35 then 'validation score' end, case when production_runs = 0 then 'no production' end], lambda x: x is not null) as w from v_variants)",
)(gates)


def lint(v: DataFrame) -> DataFrame:
    """Errors of a recipe's tag lists: repeats, and tags both wanted and unwanted."""
    inc, exc = F.split(F.lower("label"), " "), F.split(F.lower("cluster_slug"), "#")
    return v.select("variant_id", (F.size(inc) - F.size(F.array_distinct(inc))).alias("repeats"), F.array_join(F.array_sort(F.array_intersect(F.array_union(inc, F.array(F.lit("brand"))), exc)), ",").alias("conflicts"))


query(
    "p29_recipe_lint", "variants",
    sql="select variant_id, len(i) - len(list_distinct(i)) as repeats, array_to_string(list_sort(list_intersect(list_append(i, 'brand'), e)), ',') as conflicts from (select variant_id, string_split(lower(label), ' ') as i, string_split(lower(cluster_slug), '#') as e from v_variants)",
)(lint)

# --- joins
query("j04_companies_in_run", "companies", "run_companies", sql="select distinct k.company_id, k.region_id from v_companies k join v_run_companies r on r.company_id = k.company_id where r.status = 'completed'")(
    lambda k, r: k.join(r.where("status = 'completed'").select("company_id").distinct(), "company_id", "left_semi").select("company_id", "region_id")
)
query("j06_phone_lookup", "phones", "companies", sql="select region_id, phone, min(company_id) as company_id from v_phones join v_companies using (company_id) group by region_id, phone")(
    lambda p, k: p.join(k.select("company_id", "region_id"), "company_id").groupBy("region_id", "phone").agg(F.min("company_id").alias("company_id"))
)


def either_key(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with the first row of ``b`` that has the same id or the same slug: two equi-joins, each with one row of ``b`` a key
    (of a slug only the least id can come first), instead of an OR."""
    by_id = a.select("id").join(b.select("id").distinct(), "id").select("id", c("id").alias("own"), c("id").alias("other"))
    least = b.groupBy("slug").agg(F.min("id").alias("other"))
    by_slug = a.join(least, "slug").select("id", F.lit(None).cast(b.schema["id"].dataType).alias("own"), "other")
    return by_id.unionAll(by_slug).groupBy("id").agg(F.coalesce(F.min("own"), F.min("other")).alias("other"))


query(
    "j09_id_or_slug", "variants",
    sql="select a.id, b.id as other from (select variant_id as id, label as slug from v_variants where variant_id % 2 = 0) a join (select variant_id as id, label as slug from v_variants where variant_id % 3 = 0) b on a.id = b.id or a.slug = b.slug qualify row_number() over (partition by a.id order by a.id <> b.id, b.id) = 1",
)(lambda v: either_key(v.where("variant_id % 2 = 0").select(c("variant_id").alias("id"), c("label").alias("slug")), v.where("variant_id % 3 = 0").select(c("variant_id").alias("id"), c("label").alias("slug"))))
query("j21_map_back", "phones", sql="select phone_id, coalesce(r.state, 'error') as state from v_phones p left join (select phone, case when max(seq) % 2 = 0 then 'active' else 'inactive' end as state from v_phones where seq % 4 <> 0 group by phone) r using (phone)")(
    lambda p: p.join(p.where("seq % 4 <> 0").groupBy("phone").agg(F.when(F.max("seq") % 2 == 0, "active").otherwise("inactive").alias("state")), "phone", "left").select("phone_id", F.coalesce("state", F.lit("error")).alias("state"))
)
query("j23_latest_child", "run_stats", sql="select variant_id, arg_max(run_id, (created_at, run_id, region_id)) as run_id, arg_max(score, (created_at, run_id, region_id)) as score from v_run_stats group by variant_id")(
    lambda s: s.groupBy("variant_id").agg(*[F.max_by(x, F.struct("created_at", "run_id", "region_id")).alias(x) for x in ("run_id", "score")])
)


def policy_of(v: DataFrame) -> DataFrame:
    """The strategy's policy if active, else the global one: two lookups and a coalesce."""
    spark = v.sparkSession
    policies = spark.createDataFrame([(s, s != "hybrid", f"policy-{s}") for s in FLOORS] + [("global", True, "policy-global")], "key string, active boolean, policy string").where("active")
    own = policies.select(c("key").alias("strategy"), c("policy").alias("own"))
    return v.join(own, "strategy", "left").join(policies.where("key = 'global'").select(F.lit(True).alias("g"), c("policy").alias("fallback")), F.lit(True) == c("g"), "left").select("variant_id", F.coalesce("own", "fallback").alias("policy"))


query("j25_policy", "variants", sql="select variant_id, case strategy when 'hybrid' then 'policy-global' else 'policy-' || strategy end as policy from v_variants")(policy_of)
query("j26_market_history", "outcomes", sql="select variant_key, region_id, m, g from (select variant_key, region_id, count(*) filter (selected) as m from v_outcomes group by all) join (select variant_key, count(*) filter (selected) as g from v_outcomes group by all) using (variant_key)")(
    lambda o: o.groupBy("variant_key", "region_id").agg(F.count_if("selected").alias("m")).join(o.groupBy("variant_key").agg(F.count_if("selected").alias("g")), "variant_key").select("variant_key", "region_id", "m", "g")
)

# --- aggregates
query("a13_capacity", "requests", sql="select count(distinct proxy_id) as proxies, count(distinct proxy_id) * 3 as capacity from v_requests where used_proxy")(lambda r: r.where("used_proxy").agg(F.countDistinct("proxy_id").alias("proxies"), (F.countDistinct("proxy_id") * 3).alias("capacity")))


def run_yield(rows: DataFrame, emails: DataFrame, phones: DataFrame) -> DataFrame:
    """Companies of each run, and how many have been crawled, have an address and have a phone: one distinct base and flags."""
    base = rows.groupBy("run_id", "company_id").agg(F.bool_or(c("status") == "completed").alias("crawled"))
    has = lambda df, name: df.select("company_id").distinct().withColumn(name, F.lit(True))
    flags = base.join(has(emails, "e"), "company_id", "left").join(has(phones, "p"), "company_id", "left")
    return flags.groupBy("run_id").agg(F.count(one).alias("discovered"), F.count_if("crawled").alias("crawled"), F.count_if("e").alias("email"), F.count_if("p").alias("phone"))


query(
    "a15_run_yield", "run_companies", "emails", "phones",
    sql="select run_id, count(*) as discovered, count(*) filter (crawled) as crawled, count(*) filter (company_id in (select company_id from v_emails)) as email, count(*) filter (company_id in (select company_id from v_phones)) as phone from (select run_id, company_id, bool_or(status = 'completed') as crawled from v_run_companies group by all) group by run_id",
)(run_yield)
query("a19_cluster_figures", "variants", "run_stats", sql="select cluster_slug, count(*) as fan_out, count(distinct v.variant_id) as variants, round_even(avg(v.production_score), 2) as production from v_variants v left join v_run_stats s using (variant_id) group by cluster_slug")(
    lambda v, s: v.join(s.select("variant_id"), "variant_id", "left").groupBy("cluster_slug").agg(F.count(one).alias("fan_out"), F.countDistinct("variant_id").alias("variants"), F.bround(F.avg("production_score"), 2).alias("production"))
)
query("a24_adoption", "outcomes", sql="select variant_key, count(*) filter (activated) as adopted, max(t) as cluster_adopted from (select *, count(*) filter (activated) over (partition by variant_key % 5) as t from v_outcomes) group by variant_key")(
    lambda o: o.groupBy("variant_key").agg(F.count_if("activated").alias("adopted")).join(o.groupBy((c("variant_key") % 5).alias("b")).agg(F.count_if("activated").alias("cluster_adopted")), c("variant_key") % 5 == c("b")).select("variant_key", "adopted", "cluster_adopted")
)
query("a28_prompt_evals", "evals", sql="select provider, count(*) as evals, count(judgement) as scored, max(eval_id) as last from v_evals group by provider")(lambda e: e.groupBy("provider").agg(F.count(one).alias("evals"), F.count("judgement").alias("scored"), F.max("eval_id").alias("last")))
query("a38_experiment_factor", "audits", sql="select policy, case when avg(delta) >= 2 then 1.15 when avg(delta) <= -2 then 0.5 when count(*) filter (outcome = 'degraded') > count(*) filter (outcome = 'improved') then 0.75 else 1.0 end::double as factor from v_audits group by policy")(
    lambda a: a.groupBy("policy").agg(F.when(F.avg("delta") >= 2, 1.15).when(F.avg("delta") <= -2, 0.5).when(F.count_if(c("outcome") == "degraded") > F.count_if(c("outcome") == "improved"), 0.75).otherwise(1.0).alias("factor"))
)
query("a39_sample_metrics", "companies", sql="select region_id, count(*) as n, round_even(avg((website_url is not null)::int), 4) as website_rate, round_even(count(distinct lower(name)) / count(*), 4) as name_rate from v_companies group by region_id")(
    lambda k: k.groupBy("region_id").agg(F.count(one).alias("n"), F.bround(F.avg(c("website_url").isNotNull().cast("int")), 4).alias("website_rate"), F.bround(F.countDistinct(F.lower("name")) / F.count(one), 4).alias("name_rate"))
)
query("a40_job_counters", "replies", sql="select id % 20 as job_id, count(*) filter (code in (250, 251)) as active, count(*) filter (code >= 550) as inactive, count(*) as processed, round_even(100.0::double * count(*) filter (code <> 252) / count(*), 2) as percent from v_replies group by 1")(
    lambda r: r.groupBy((c("id") % 20).alias("job_id")).agg(F.count_if(c("code").isin(250, 251)).alias("active"), F.count_if(c("code") >= 550).alias("inactive"), F.count(one).alias("processed"), F.bround(100.0 * F.count_if(c("code") != 252) / F.count(one), 2).alias("percent"))
)
query("a44_last_crawl", "run_companies", sql="select company_id, max(queued_at) as last from v_run_companies where status = 'completed' group by company_id")(lambda r: r.where("status = 'completed'").groupBy("company_id").agg(F.max("queued_at").alias("last")))
query("a46_site_status", "requests", sql="select regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as site, bool_or(error is null) as reached, case when bool_or(error is null) then 'completed' else 'failed' end as status from v_requests group by 1")(
    lambda r: r.groupBy(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("site")).agg(F.bool_or(c("error").isNull()).alias("reached")).withColumn("status", outcomes.site_status(c("reached"), F.lit(False)))
)
query("a47_quota_snapshot", "requests", sql="select provider, count(*) as used, greatest(5000 - count(*), 0) as remaining from v_requests group by provider")(lambda r: r.groupBy("provider").agg(F.count(one).alias("used"), F.greatest(5000 - F.count(one), F.lit(0)).alias("remaining")))

# --- windows, order, sets
query("w01_latest_version", "run_stats", sql="select variant_id, run_id from v_run_stats qualify row_number() over (partition by variant_id order by run_id desc, region_id) = 1")(lambda s: ranking.top_per_group(s, ["variant_id"], [F.desc("run_id"), c("region_id")]).select("variant_id", "run_id"))
query("w04_rank_positions", "variants", sql="select variant_id, row_number() over (partition by strategy order by production_score desc, variant_id) as position from v_variants")(lambda v: ranking.ranked(v, ["strategy"], [F.desc("production_score"), c("variant_id")], "position").select("variant_id", "position"))
query("t11_job_page", "replies", sql="select id, code from v_replies where code = 250 order by id limit 100 offset 200")(lambda r: r.where("code = 250").orderBy("id").offset(200).limit(100).select("id", "code"))
query("t12_capped_lists", "emails", sql="select company_id, array_to_string(list_sort(list(distinct email))[1:10], ',') as emails from v_emails group by company_id")(lambda e: e.groupBy("company_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("email")), 1, 10), ",").alias("emails")))
query("t13_primary_host", "requests", sql="select provider, arg_min(url, (duration_ms, id)) as first_url from v_requests where duration_ms is not null group by provider")(lambda r: r.where("duration_ms is not null").groupBy("provider").agg(F.min_by("url", F.struct("duration_ms", "id")).alias("first_url")))
query("t16_round_robin", "requests", sql="select id, (row_number() over (partition by provider order by id) - 1) % 4 as slot from v_requests where used_proxy")(lambda r: ranking.numbered(r.where("used_proxy").select("provider", "id"), "provider", ["id"]).select("id", ((c("n") - 1) % 4).alias("slot")))
query("x01_contact_ids", "emails", "phones", "channels", sql="select company_id from v_emails union select company_id from v_phones union select company_id from v_channels")(lambda e, p, ch: e.select("company_id").union(p.select("company_id")).union(ch.select("company_id")).distinct())
query("x04_blocklist", "emails", sql="select distinct split_part(email, '@', 2) as domain from v_emails where split_part(email, '@', 2) not in ('yopmail.com') union select 'added.example' as domain")(
    lambda e: upserts.insert_absent(upserts.remove_keys(e.select(F.substring_index("email", "@", -1).alias("domain")).distinct(), e.sparkSession.createDataFrame([("yopmail.com",)], "domain string"), ["domain"]), e.sparkSession.createDataFrame([("added.example",)], "domain string"), ["domain"])
)
query("x08_staged_once", "places", sql="select seq from v_places where place_id <> '' qualify row_number() over (partition by place_id order by seq) = 1 union all select seq from v_places where place_id = ''")(lambda p: co.stage_places(p).select("seq"))


def changed_fields(v: DataFrame) -> DataFrame:
    """Names of the fields that differ between two states of a row."""
    before, after = {k: c(k) for k in ("validation_score", "production_score", "market_score")}, {"validation_score": c("production_score"), "production_score": c("production_score"), "market_score": c("validation_score")}
    return v.select("variant_id", F.array_join(F.array_compact(F.array(*[F.when(~before[k].eqNullSafe(after[k]), k) for k in sorted(before)])), ",").alias("changed"))


query("x07_changed_fields", "variants", sql="select variant_id, array_to_string(list_filter([case when market_score <> validation_score then 'market_score' end, null, case when validation_score <> production_score then 'validation_score' end], lambda x: x is not null), ',') as changed from v_variants")(changed_fields)

# --- small projections
query("s04_page_keys", "requests", sql="select id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || '|' || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) as page_key from v_requests")(lambda r: r.select("id", urls.resolved_page_key(c("url")).alias("page_key")))
query("s45_thresholds", "variants", sql="select variant_id, greatest(40, " + "case strategy " + " ".join(f"when '{s}' then {v[0]}" for s, v in FLOORS.items()) + " end) as floor from v_variants")(
    lambda v: v.select("variant_id", F.greatest(F.lit(40), F.coalesce(*[F.when(c("strategy") == s, x[0]) for s, x in FLOORS.items()])).alias("floor"))
)
query("s47_cluster_bonus", "outcomes", sql="select variant_key, least(count(*) filter (selected), 5) * 3 + least(count(*) filter (selected and region_id = 3), 5) * 4 as bonus from v_outcomes group by variant_key")(
    lambda o: o.groupBy("variant_key").agg(outcomes.cluster_history_bonus(F.count_if("selected"), F.count_if(c("selected") & (c("region_id") == 3))).alias("bonus"))
)
query("s49_name_scores", "companies", sql="select company_id, length(trim(name)) as n, city is not null as has_city, crawl_status not in ('pending', 'failed', 'no_website') as crawled from v_companies")(
    lambda k: k.select("company_id", F.length(F.btrim("name")).alias("n"), c("city").isNotNull().alias("has_city"), (~c("crawl_status").isin("pending", "failed", "no_website")).alias("crawled"))
)
query("s52_numbers", "places", sql="select seq, cast(replace(reviews, ',', '') as double) as reviews, cast(trunc(cast(replace(reviews, ',', '') as double)) as bigint) as whole from v_places")(lambda p: p.select("seq", prompts.to_number(c("reviews")).alias("reviews"), prompts.to_number(c("reviews"), "int").alias("whole")))
query("s53_dedupe_keys", "places", sql="select seq, coalesce('website:' || nullif(website, ''), 'phone:' || phone, 'source:' || place_id) as dedupe_key from v_places")(
    lambda p: p.select("seq", F.coalesce(F.concat(F.lit("website:"), F.nullif("website", F.lit(""))), F.concat(F.lit("phone:"), c("phone")), F.concat(F.lit("source:"), c("place_id"))).alias("dedupe_key"))
)
query("s54_external_ids", "places", sql="select seq, coalesce(nullif(trim(place_id), ''), nullif(trim(website), ''), trim(name)) as external_id from v_places")(lambda p: p.select("seq", F.coalesce(F.nullif(F.btrim("place_id"), F.lit("")), F.nullif(F.btrim("website"), F.lit("")), F.btrim("name")).alias("external_id")))
query("s59_api_states", "runs", sql="select run_id, case status when 'completed' then 'SUCCESS' when 'running' then 'STARTED' else 'PENDING' end as state from v_runs")(lambda r: r.select("run_id", F.when(c("status") == "completed", "SUCCESS").when(c("status") == "running", "STARTED").otherwise("PENDING").alias("state")))
query("d02_retry_delays", "replies", sql="select id, 45 * least(id % 6 + 1, 4) * 1000 as delay_ms, [300, 900, 3600, 14400][least(id % 6 + 1, 4)] as greylist_s from v_replies")(
    lambda r: r.select("id", scores.retry_delay_ms(F.lit(45), c("id") % 6 + 1).alias("delay_ms"), scores.greylist_delay_s((c("id") % 6 + 1).cast("int")).alias("greylist_s"))
)
query("d05_batch_eta", "emails", sql="select company_id, count(distinct email) * 0.1::double as fast_s, count(distinct email) * 3 as full_s from v_emails group by company_id")(lambda e: e.groupBy("company_id").agg((F.countDistinct("email") * 0.1).alias("fast_s"), (F.countDistinct("email") * 3).alias("full_s")))
query("d01_utc", "runs", sql="select run_id, cast(epoch(started_at) as bigint) as seconds from v_runs")(lambda r: r.select("run_id", F.unix_seconds(c("started_at").cast("timestamp")).alias("seconds")))

# --- table updates
query("u11_variant_upsert", "variants", sql="select coalesce(s.variant_id, t.variant_id) as variant_id, coalesce(s.label, t.label) as label, coalesce(s.priority, t.priority) as priority from (select variant_id, label, priority from v_variants where variant_id % 2 = 0) t full join (select variant_id, upper(label) as label, priority + 1 as priority from v_variants where variant_id % 3 = 0) s using (variant_id)")(
    lambda v: upserts.upsert(v.where("variant_id % 2 = 0").select("variant_id", "label", "priority"), v.where("variant_id % 3 = 0").select("variant_id", F.upper("label").alias("label"), (c("priority") + 1).alias("priority")), ["variant_id"])
)
query("u12_counters", "outcomes", sql="select plan_id, variant_key, sum(selected::int)::bigint as selected, sum(drafted::int)::bigint as drafted, sum(activated::int)::bigint as activated from v_outcomes group by plan_id, variant_key")(
    lambda o: o.groupBy("plan_id", "variant_key").agg(*[F.sum(c(x).cast("int")).alias(x) for x in ("selected", "drafted", "activated")])
)
query("u15_next_version", "audits", sql="select policy, max(audit_id % 50) + 1 as version from v_audits group by policy")(lambda a: upserts.next_version(a.select("policy", (c("audit_id") % 50).alias("version")), "policy"))


def absent_slugs(v: DataFrame) -> DataFrame:
    """Slugs to draft: those that no existing recipe, here every fortieth variant, has."""
    return v.select("slug").distinct().join(v.where("variant_id % 40 = 0").select("slug"), "slug", "left_anti")


_SLUG = "trim(regexp_replace(lower(cluster_slug || ' ' || label), '[^a-z0-9]+', '-', 'g'), '-')"
query("u16_absent_slugs", "variants", sql=f"select distinct {_SLUG} as slug from v_variants where {_SLUG} not in (select {_SLUG} from v_variants where variant_id % 40 = 0)")(
    lambda v: absent_slugs(v.withColumn("slug", prompts.slugify(F.concat_ws(" ", "cluster_slug", "label"))))
)
query("u17_clamped_policies", "audits", sql="select policy, greatest(0, least(100, cast(50 + sum(delta) as int))) as score, count(*) as changes from v_audits group by policy")(lambda a: a.groupBy("policy").agg(F.greatest(F.lit(0), F.least(F.lit(100), (50 + F.sum("delta")).cast("int"))).alias("score"), F.count(one).alias("changes")))
query("st02_state_table", "runs", sql="select region_id, max(started_at) filter (status = 'completed') as fresh_at, count(*) filter (status = 'running') as running from v_runs group by region_id")(
    lambda r: r.groupBy("region_id").agg(F.max(F.when(c("status") == "completed", c("started_at"))).alias("fresh_at"), F.count_if(c("status") == "running").alias("running"))
)


def suppression(r: DataFrame) -> DataFrame:
    from brindle.streaming.jobs import suppressed_hosts

    return suppressed_hosts(r)


query("st01_suppressed_hosts", "requests")(suppression)
query("st08_first_seen", "requests", sql="select url, min(id) as id from v_requests group by url")(lambda r: r.groupBy("url").agg(F.min("id").alias("id")))


def email_pipeline(e: DataFrame) -> DataFrame:
    """Recorded layers of each distinct address in one pass: syntax, lists, typo, score and status."""
    from brindle.functions import contacts
    from brindle.plans.catalog import typo_suggestions

    local, domain = contacts.email_parts(c("email"))
    d = e.groupBy("email").agg(F.min("email_id").alias("email_id"))
    typo = typo_suggestions(d).select("email_id", c("suggested").isNotNull().alias("typo"))
    role, thrown = contacts.role_or_disposable(c("email"))
    none: Column = F.lit(None).cast("string")
    t = d.join(typo, "email_id", "left").select("email", contacts.email_syntax_ok(c("email")).alias("ok"), F.lit(None).cast("boolean").alias("mx"), thrown.alias("thrown"), role.alias("role"), F.coalesce("typo", F.lit(False)).alias("typo"))
    t = t.withColumn("score", scores.email_score(c("ok"), c("mx"), c("thrown"), c("role"), c("typo"), none))
    return t.select("email", "score", scores.email_status(c("score"), c("ok"), c("mx"), none).alias("status"))


query("pl04_email_pipeline", "emails")(email_pipeline)
