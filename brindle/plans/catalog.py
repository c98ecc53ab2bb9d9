"""Every registered query: an operator over a view of the driver's tables, with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import contacts, html, markup, prompts, scores, urls
from brindle.operators import companies as co
from brindle.operators import ranking, requests, runs, upserts
from brindle.plans.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, *views: str, sql: str | None = None):
    """Registers fn(*views) under a name; ``sql`` may use the views as v_<name>."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[view(spark, sf_dir, v) for v in views])

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = ctes(*views) + sql
        return fn

    return register


def table_query(name: str, *tables: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


# --- expressions shared by oracles
_KEY = "case when trim({u}) <> '' then regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') end"


def _website_key(u: str) -> str:
    return _KEY.format(u=u, x=f"case when contains(trim({u}), '://') then trim({u}) else 'https://' || trim({u}) end")


def _host_key(u: str) -> str:
    x = f"case when contains(trim({u}), '://') then trim({u}) else 'https://' || trim({u}) end"
    return f"regexp_replace(regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), ':(80|443)$', '')"


def made_form(n: Column) -> Column:
    """HTML of a page with a form in one of several shapes; every sixth page has none."""
    action, method = F.when(n % 3 != 0, F.concat(F.lit(' action="/send'), (n % 5).cast("string"), F.lit('"'))).otherwise(""), F.when(n % 2 == 0, " METHOD='Post'").otherwise("")
    message, captcha = F.when(n % 7 != 0, '<textarea name="message" placeholder="Text"></textarea>').otherwise(""), F.when(n % 4 == 0, '<div class="G-Recaptcha"></div>').otherwise("")
    form = F.concat(F.lit("<div><form class='x'"), action, method, F.lit('>\n<input type="EMAIL" name="email"'), F.when(n % 5 != 0, " required").otherwise(""), F.lit('><input type="submit">'), message, captcha, F.lit("</form></div>"))
    return F.when(n % 6 == 1, "<p>no form</p>").otherwise(form)


def contact_forms(p: DataFrame) -> DataFrame:
    """A row for each form: its action, method, captcha flag, names of its fields and whether the first is required."""
    rows = p.select("page_id", F.explode(markup.page_parts(c("html"))["forms"]).alias("form"))
    return rows.select("page_id", c("form.action").alias("action_url"), "form.method", "form.has_captcha", F.array_join(c("form.fields.name"), ",").alias("fields"), F.element_at("form.fields", 1)["required"].alias("required"))


_SUMMARY = "count(*) as n, cast(round_even(avg(duration_ms), 0) as int) as mean_ms, max(duration_ms) as max_ms, count(error) as errors"


# --- requests: A-06 .. A-11, W-06, T-02
query("a06_request_summary", "requests", sql=f"select provider, request_kind, case when used_proxy then 'proxy' else 'direct' end as transport, {_SUMMARY} from v_requests group by all")(requests.by_transport)
query("a07_host_summary", "requests", sql=f"select {_host_key('url')} as host, provider, count(*) as n, count(*) filter (used_proxy) as proxied, count(error) as errors, max(created_at) as last_seen from v_requests group by all")(requests.by_host)
query("a08_error_summary", "requests", sql="select provider, request_kind, substr(error, 1, 180) as error, count(*) as n, max(created_at) as last_seen from v_requests where error is not null group by provider, request_kind, substr(error, 1, 180)")(requests.by_error)
query("a09_proxy_summary", "requests", sql=f"select coalesce('proxy-' || cast(proxy_id as string), 'unknown-proxy') as proxy, provider, {_SUMMARY} from v_requests where used_proxy group by all")(requests.by_proxy)
query("a10_signal_summary", "requests", sql="select request_kind, provider, count(*) as n, max(created_at) as last_seen from v_requests where request_kind in ('error', 'signup') group by all")(lambda r: requests.by_signal(r, ("error", "signup")))
query("a11_newest_usage", "requests", sql=f"select provider, {_SUMMARY} from (select * from v_requests order by created_at desc, id desc limit 5000) group by all")(lambda r: requests.summary(requests.newest(r, 5000), ["provider"]))
query("t02_top_hosts", "requests", sql=f"select host, n from (select {_host_key('url')} as host, count(*) as n from v_requests group by all) order by n desc, host limit 20")(
    lambda r: r.groupBy(urls.host_key(c("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(20)
)
query("a43_daily_units", "requests", sql="select cast(created_at as date) as day, provider, count(*) as units from v_requests group by all")(lambda r: r.groupBy(c("created_at").cast("date").alias("day"), "provider").agg(F.count(F.lit(1)).alias("units")))
query("p09_quota", "requests", sql="select day, provider, used, used + 50 <= 120 as ok, greatest(120 - used, 0) as remaining from (select cast(created_at as date) as day, provider, count(*) as used from v_requests group by all)")(
    lambda r: r.groupBy(c("created_at").cast("date").alias("day"), "provider").agg(F.count(F.lit(1)).alias("used")).withColumn("ok", runs.quota_ok(c("used"), F.lit(50), F.lit(120))).withColumn("remaining", F.greatest(120 - c("used"), F.lit(0)))
)
query("p17_dead_hosts", "requests", sql="select id, coalesce(regexp_matches(lower(error), 'dns|timed out on step 3|no route to host'), false) as dead from v_requests")(lambda r: r.select("id", F.coalesce(F.lower("error").rlike("dns|timed out on step 3|no route to host"), F.lit(False)).alias("dead")))
query(
    "w09_failure_streaks", "requests",
    sql="""select provider, max(streak) as longest, count(*) filter (streak >= 3) as cooling, count(*) filter (streak >= 5) as disabled from (
  select *, sum(f) over (partition by provider, island order by created_at, id rows unbounded preceding) as streak from (
    select *, (error is not null)::int as f, sum((error is null)::int) over (partition by provider order by created_at, id rows unbounded preceding) as island from v_requests)) group by provider""",
)(
    lambda r: ranking.failure_streaks(r, "provider", [c("created_at"), c("id")], c("error").isNotNull()).groupBy("provider").agg(F.max("streak").alias("longest"), F.count_if("cooling").alias("cooling"), F.count_if("disabled").alias("disabled"))
)
query("w11_health", "requests")(lambda r: ranking.clamped_fold(r.where("used_proxy"), "proxy_id", "id", F.when(c("error").isNotNull(), -20).otherwise(5)))
query(
    "w10_early_stop", "requests",
    sql=f"""select host, count(*) filter (not (useful = 0 and useless >= 3)) as visited from (select *, coalesce(sum(u) over w, 0) as useless, coalesce(sum(1 - u) over w, 0) as useful from (
  select *, {_host_key('url')} as host, (duration_ms < 60)::int as u from v_requests where duration_ms is not null) window w as (partition by host order by created_at, id rows between unbounded preceding and 1 preceding)) group by host""",
)(
    lambda r: ranking.early_stop(r.where("duration_ms is not null").withColumn("host", urls.host_key(c("url"))), "host", [c("created_at"), c("id")], c("duration_ms") < 60).groupBy("host").agg(F.count_if("visited").alias("visited"))
)
query("st14_request_windows", "requests", sql="select time_bucket(interval 1 hour, created_at) as window_start, provider, count(*) as n, count(error) as errors from v_requests group by all")(
    lambda r: r.groupBy(F.window(c("created_at"), "1 hour").alias("w"), "provider").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")).select(c("w.start").alias("window_start"), "provider", "n", "errors")
)

# --- URL and HTML columns: S-01 .. S-12, P-15
query("s01_website_keys", "companies", sql=f"select company_id, {_website_key('website_url')} as website_key from v_companies")(lambda t: t.select("company_id", urls.website_key(c("website_url")).alias("website_key")))
query("s02_host_keys", "requests", sql=f"select id, {_host_key('url')} as host from v_requests")(lambda t: t.select("id", urls.host_key(c("url")).alias("host")))
table_query(
    "s09_titles", "pages", sql=r"select page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') as title from pages"
)(lambda p: p.select("page_id", html.title(c("html")).alias("title")))


def page_links(p: DataFrame) -> DataFrame:
    """Anchors of each page in order, resolved against it."""
    anchors = p.select("page_id", "url", F.posexplode(markup.page_parts(c("html"))["links"]).alias("pos", "a")).select("*", c("a.href").alias("href"))
    return anchors.select("page_id", "pos", "href", urls.absolute_url(c("url"), c("href")).alias("target"), urls.is_contact_path(c("href")).alias("is_contact"), urls.is_social_or_chat(c("href")).alias("is_social"))


table_query("s10_links", "pages")(page_links)
table_query("s08_visible_text", "pages")(lambda p: p.select("page_id", "html", markup.page_parts(c("html"))["text"].alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"), html.script_shell(c("html"), F.length("text")).alias("is_shell")))
table_query("s13_forms", "pages")(lambda p: p.select("page_id", F.explode(markup.page_parts(c("html"))["forms"]).alias("form")).select("page_id", "form.*"))
query(
    "s13_contact_forms", "crawled",
    sql="""select page_id, case when page_id % 3 = 0 then '' else '/send' || page_id % 5 end as action_url, case when page_id % 2 = 0 then 'post' else 'get' end as method, page_id % 4 = 0 as has_captcha,
  case when page_id % 7 = 0 then 'email' else 'email,message' end as fields, page_id % 5 <> 0 as required from v_crawled where page_id % 6 <> 1""",
)(lambda p: contact_forms(p.select("page_id", made_form(c("page_id")).alias("html"))))
table_query("p23_site_flags", "pages", sql=f"select {_host_key('url')} as host, count(*) as pages, max(length(html)) as longest from pages group by 1")(lambda p: p.groupBy(urls.host_key(c("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.max(F.length("html")).cast("long").alias("longest")))
table_query("p15_page_urls", "pages", sql=f"select page_id, {_website_key('url')} as website_key, {_host_key('url')} as host, regexp_extract(url, '^[^:]+://[^/?#]*', 0) || '/' as root from pages")(
    lambda p: p.select("page_id", urls.website_key(c("url")).alias("website_key"), urls.host_key(c("url")).alias("host"), urls.absolute_url(c("url"), F.lit("/")).alias("root"))
)

# --- contacts: S-17 .. S-28, P-12, P-13, P-24, P-26
table_query("s17_emails", "documents", sql=r"select doc_id, unnest(list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', 1)))) as email from documents")(
    lambda d: d.where(c("text").contains("@")).select("doc_id", F.explode(contacts.extract_emails(c("text"))).alias("email"))
)
table_query("s18_phones", "documents")(lambda d: d.select("doc_id", F.posexplode(contacts.phone_candidates(c("text"))).alias("pos", "raw")).withColumn("phone", contacts.normalize_phone(c("raw"))).withColumn("is_noise", contacts.is_noise_phone(c("raw"))))
query("p12_noise_emails", "emails", sql="select email_id, split_part(email, '@', 1) in ('johnsmith', 'janedoe', 'test', 'example') or email like '%@sentry.io' or email like '%@myemail.com' as noise from v_emails")(lambda e: e.select("email_id", contacts.is_noise_email(c("email")).alias("noise")))
_ROLES, _THROWN = (", ".join(f"'{x}'" for x in xs) for xs in (contacts.ROLE_LOCALS, contacts.DISPOSABLE_SEED))
query("p26_role_disposable", "emails", sql=f"select email_id, split_part(email, '@', 1) in ({_ROLES}) as is_role, split_part(email, '@', 2) in ({_THROWN}) as is_disposable from v_emails")(
    lambda e: e.select("email_id", contacts.role_or_disposable(c("email"))[0].alias("is_role"), contacts.role_or_disposable(c("email"))[1].alias("is_disposable"))
)
query("s19_phone_normal", "phones", sql=r"select phone_id, '+' || regexp_replace(regexp_replace(raw, '\D', '', 'g'), '^00', '') as phone from v_phones")(lambda p: p.select("phone_id", contacts.normalize_phone(c("raw")).alias("phone")))
query("s22_verifier_phone", "phones", sql=r"select phone_id, case when regexp_replace(raw, '[^\d+]', '', 'g') like '+%' then '' else '+' end || regexp_replace(raw, '[^\d+]', '', 'g') as phone from v_phones")(lambda p: p.select("phone_id", contacts.verifier_phone(c("raw")).alias("phone")))
query("s25_email_syntax", "emails", sql=r"select email_id, regexp_matches(email, '^[a-z0-9._-]+@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$') as ok from v_emails")(lambda e: e.select("email_id", contacts.email_syntax_ok(c("email")).alias("ok")))


def typo_suggestions(emails: DataFrame) -> DataFrame:
    """Suggested domain of each address. Only distinct domains meet the fixed list of popular ones (a literal array)."""
    domains = emails.select(contacts.email_parts(c("email"))[1].alias("domain")).distinct().where(~c("domain").isin(*contacts.POPULAR_DOMAINS))
    pairs = domains.select("domain", F.posexplode(F.array(*[F.lit(d) for d in contacts.POPULAR_DOMAINS])).alias("pos", "popular"))
    label, tld = (lambda d: F.substring_index(d, ".", 1)), (lambda d: F.regexp_extract(d, r"^[^.]*\.(.*)$", 1))
    pairs = pairs.withColumn("label_distance", contacts.osa_distance(label(c("domain")), label(c("popular")))).withColumn("tld_distance", contacts.osa_distance(tld(c("domain")), tld(c("popular"))))
    ok = pairs.where((c("label_distance") <= F.when(F.length(label(c("popular"))) <= 4, 1).otherwise(2)) & (c("tld_distance") <= 1))
    best = ok.groupBy("domain").agg(F.min(F.struct((c("label_distance") + c("tld_distance")).alias("distance"), "label_distance", "pos", "popular")).alias("b"))
    found = best.select("domain", c("b.popular").alias("suggested"), c("b.distance").alias("distance"))
    return emails.withColumn("domain", contacts.email_parts(c("email"))[1]).join(found, "domain", "left").select("email_id", "domain", "suggested", "distance")


query("j17_typo_suggestions", "emails")(typo_suggestions)

# --- scores: S-36 .. S-50, D-02
_VERDICT = "case email_id % 6 when 0 then 'valid' when 1 then 'invalid' when 2 then 'catch_all' when 3 then 'greylisted' when 4 then 'unknown' end"
_SIGNALS = f"select email_id, email_id % 17 <> 0 as syntax_valid, case when email_id % 5 = 0 then null else email_id % 7 <> 0 end as mx_found, case when email_id % 4 = 0 then null else email_id % 3 = 0 end as disposable, email_id % 2 = 0 as role, case when email_id % 10 = 0 then null else email_id % 9 = 0 end as typo, {_VERDICT} as verdict from {{}}"


def score_emails(emails: DataFrame) -> DataFrame:
    t = emails.sparkSession.sql(_SIGNALS.format("{emails}"), emails=emails)
    t = t.withColumn("score", scores.email_score(c("syntax_valid"), c("mx_found"), c("disposable"), c("role"), c("typo"), c("verdict")))
    return t.select("email_id", "score", scores.email_status(c("score"), c("syntax_valid"), c("mx_found"), c("verdict")).alias("status"))


query(
    "s36_email_scores", "emails",
    sql=f"""select email_id, score, case when not syntax_valid or mx_found is not distinct from false or verdict = 'invalid' then 'invalid' when verdict in ('greylisted', 'unknown') then 'unknown' when verdict = 'catch_all' then 'risky'
  when verdict is not null then case when score >= 80 then 'valid' when score >= 50 then 'risky' else 'invalid' end when score >= 60 then 'risky' else 'invalid' end as status
from (select *, case when not syntax_valid then 0 when mx_found is not distinct from false then 20 else greatest(0, least(100, 20 + case when mx_found then 20 else 0 end + case when disposable is null then 0 when disposable then -25 else 15 end
  + case when role then -10 else 10 end + case when typo is null then 0 when typo then 0 else 5 end + case verdict when 'valid' then 30 when 'invalid' then -60 when 'catch_all' then -20 when 'greylisted' then -5 when 'unknown' then -5 else 0 end)) end as score
  from ({_SIGNALS.format('v_emails')}))""",
)(score_emails)
query(
    "s38_reply_verdicts", "replies",
    sql="""select id, case when g then 'greylisted' when code in (250, 251) then 'valid' when code in (550, 551, 553, 554) then 'invalid' when code in (421, 450, 451, 452) then 'greylisted' else 'unknown' end as verdict,
  g or code in (421, 450, 451, 452) or (code between 400 and 499 and code not in (421, 450, 451, 452)) as can_retry
from (select *, coalesce(regexp_matches(lower(message), 'greylist|try again|try later|temporarily|come back|too fast'), false) as g from v_replies)""",
)(lambda r: r.select("id", scores.reply_verdict(c("code"), c("message")).alias("v")).select("id", "v.verdict", "v.can_retry"))
query(
    "s39_catch_all", "replies",
    sql="""select id, case when t = 0 then 'invalid' when t = 1 then 'unknown' when a = 0 or b = 0 then 'catch_all' when a = 1 or b = 1 then 'unknown' else 'valid' end as verdict,
  case when t = 0 then false when t = 1 then id % 2 = 0 when a = 0 or b = 0 then false when a = 1 or b = 1 then true else false end as can_retry from (select id, id % 3 as t, id % 5 as a, (id * 3) % 4 as b from v_replies)""",
)(
    lambda r: r.select(
        "id",
        scores.catch_all_verdict(
            F.when(c("id") % 3 == 0, "invalid").when(c("id") % 3 == 1, "greylisted").otherwise("valid"), c("id") % 2 == 0,
            F.array(*[F.when(x == 0, "valid").when(x == 1, "greylisted").otherwise("invalid") for x in (c("id") % 5, (c("id") * 3) % 4)]),
        ).alias("v"),
    ).select("id", "v.verdict", "v.can_retry")
)
query(
    "s40_validation_scores", "variants",
    sql="select variant_id, score, case when n = 0 then 'candidate' when score >= 70 then 'validated' when score >= 35 then 'candidate' else 'draft' end as status from (select variant_id, n, case when n = 0 then 10 else least(100, cast(round_even(least(n, 40) * 1.5::double + w * 35 + d * 25, 0) as int)) end as score from (select variant_id, variant_id % 60 as n, (variant_id % 10) / 16.0::double as w, (variant_id % 8) / 8.0::double as d from v_variants))",
)(
    lambda v: v.select("variant_id", (c("variant_id") % 60).alias("n"), (c("variant_id") % 10 / 16.0).alias("w"), (c("variant_id") % 8 / 8.0).alias("d"))
    .withColumn("score", scores.validation_score(c("n"), c("w"), c("d"))).select("variant_id", "score", scores.validation_status(c("n"), c("score")).alias("status"))
)
query(
    "s42_bonuses", "variants",
    sql="""select variant_id, case when validation_score <= 0 or validation_count <= 0 then 0 else cast(round_even(validation_score * 0.4::double * (least(validation_count, 5) / 5), 0) as int) end as validation,
  case when production_score <= 0 or production_runs <= 0 then 0 else cast(round_even(production_score * 0.3::double * (least(production_runs, 5) / 5), 0) as int) end as production,
  case when market_score <= 0 or market_runs <= 0 then 0 else cast(round_even(market_score * 0.25::double * (least(market_runs, 4) / 4), 0) as int) end as market,
  least(planner_selected, 8) + least(planner_drafted, 8) * 2 + least(planner_activated, 8) * 4 as conversion from v_variants""",
)(
    lambda v: v.select(
        "variant_id", scores.capped_bonus(c("validation_score"), c("validation_count"), 0.4, 5).alias("validation"), scores.capped_bonus(c("production_score"), c("production_runs"), 0.3, 5).alias("production"),
        scores.capped_bonus(c("market_score"), c("market_runs"), 0.25, 4).alias("market"), scores.conversion_bonus(c("planner_selected"), c("planner_drafted"), c("planner_activated")).alias("conversion"),
    )
)
# Evidence floors by strategy (validation score, runs, production score, runs).
FLOORS = {"overpass": (45, 1, 5, 0), "google_maps": (50, 1, 10, 1), "directory": (55, 2, 10, 1), "hybrid": (50, 2, 15, 2)}


def recommendations(variants: DataFrame) -> DataFrame:
    floor = {k: F.coalesce(*[F.when(c("strategy") == s, v[i]) for s, v in FLOORS.items()], F.lit(50)) for i, k in enumerate(("validation_score", "validation_runs", "production_score", "production_runs"))}
    return variants.withColumn("r", scores.recommendation({k: c(k) for k in scores.EVIDENCE}, floor)).select("variant_id", "strategy", "cluster_slug", "r.state", "r.score", "r.rank_bonus")


_FLOOR = lambda i: "case strategy " + " ".join(f"when '{s}' then {v[i]}" for s, v in FLOORS.items()) + " end"
_STATES = f"""select variant_id, strategy, cluster_slug, case when weak then 'suppressed' when trusted then 'trusted' when valid then 'recommended' else 'experimental' end as state,
  cast(case when weak then greatest(s - 25, 0) else s end as int) as score, case when weak then -20 when trusted then 12 when valid then 5 else 0 end as rank_bonus from (
  select *, case when valid then 30 else 0 end + case when production_runs > 0 then least(production_score // 5, 20) else 0 end + case when market_runs > 0 then least(market_score // 8, 10) else 0 end
    + case when strategy_runs > 0 then least(strategy_score // 10, 8) else 0 end + least(market_activated * 4 + market_drafted * 2 + market_selected, 10)
    + case when act > 0 then least(act * 6, 18) when dra > 0 then least(dra * 4, 12) when sel > 0 then least(sel * 2, 8) else 0 end as s,
    validation_count >= greatest(2, vr) and validation_score <= greatest(35, vs - 15) and production_runs >= greatest(1, pr) and production_score <= greatest(5, ps - 5) as weak,
    validation_count >= greatest(vr + 1, 2) and validation_score >= greatest(vs + 10, 65) and production_runs >= greatest(pr, 1) and production_score >= greatest(ps + 10, 15) and (act >= 1 or dra >= 2 or market_runs >= 2) as trusted
  from (select *, validation_count >= vr and validation_score >= vs as valid, planner_activated + market_activated + prompt_activated as act, planner_drafted + market_drafted + prompt_drafted as dra, planner_selected + market_selected + prompt_selected as sel
    from (select *, {_FLOOR(0)} as vs, {_FLOOR(1)} as vr, {_FLOOR(2)} as ps, {_FLOOR(3)} as pr from v_variants)))"""
query("s44_recommendations", "variants", sql=_STATES)(recommendations)
query("a33_state_distribution", "variants", sql=f"select strategy, count(*) filter (state = 'suppressed') as suppressed, count(*) filter (state = 'trusted') as trusted, count(*) filter (state = 'recommended') as recommended, count(*) filter (state = 'experimental') as experimental from ({_STATES}) group by strategy")(
    lambda v: recommendations(v).groupBy("strategy").agg(*[F.count_if(c("state") == s).alias(s) for s in ("suppressed", "trusted", "recommended", "experimental")])
)
query("t05_proposal_order", "variants", sql=f"select variant_id, row_number() over (partition by cluster_slug order by score desc, state = 'trusted' desc, state <> 'suppressed' desc, variant_id) as rank from ({_STATES})")(
    lambda v: ranking.ranked(recommendations(v), ["cluster_slug"], [F.desc("score"), F.desc(c("state") == "trusted"), F.desc(c("state") != "suppressed"), c("variant_id")]).select("variant_id", "rank")
)

# --- prompts: S-29, S-30, S-32


def _normal_sql() -> str:
    t = r"trim(regexp_replace(regexp_replace(replace(replace(replace(lower(trim(prompt)), '&', ' and '), '/', ' '), '-', ' '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    for a, b in prompts.REPLACEMENTS:
        t = f"replace({t}, '{a}', '{b}')"
    stop = ", ".join(f"'{w}'" for w in prompts.STOP_WORDS)
    w = f"list_filter(string_split({t}, ' '), lambda w: w <> '' and w not in ({stop}))"
    return f"array_to_string(list_transform({w}, lambda w: case when length(w) > 4 and w like '%ies' then substr(w, 1, length(w) - 3) || 'y' when length(w) > 4 and w like '%s' and w not like '%ss' then substr(w, 1, length(w) - 1) else w end), ' ')"


query("s29_prompts", "prompts", sql=f"select prompt_id, n as normalized, substr(sha256(n), 1, 24) as fingerprint, substr(trim(regexp_replace(lower(prompt), '[^a-z0-9]+', '-', 'g'), '-'), 1, 96) as slug from (select *, {_normal_sql()} as n from v_prompts)")(
    lambda p: p.withColumn("normalized", prompts.normalize_prompt(c("prompt"))).select("prompt_id", "normalized", prompts.prompt_fingerprint(c("normalized")).alias("fingerprint"), prompts.slugify(c("prompt")).alias("slug"))
)
# A few clusters and their aliases.
CLUSTERS = {"vehicle_rentals": ("car rental", "motorbike rental", "quad"), "beauty": ("nail", "lash", "beauty"), "law": ("law",), "property": ("property",), "diving": ("diving", "diving training"), "spa": ("spa",)}


def rank_clusters(p: DataFrame) -> DataFrame:
    """Score of each cluster per prompt: 100 for each alias whose tokens the prompt has, plus the longest alias.
    The aliases are a literal array, so no join is needed."""
    tokens = F.split(prompts.normalize_prompt(c("prompt")), " ")
    rows = p.withColumn("tokens", tokens)
    one = [
        F.struct(F.lit(k).alias("cluster"), F.filter(F.array(*[F.lit(a) for a in v]), lambda a: F.size(F.array_except(F.split(a, " "), c("tokens"))) == 0).alias("hits")) for k, v in CLUSTERS.items()
    ]
    rows = rows.select("prompt_id", F.explode(F.array(*one)).alias("x")).where(F.size("x.hits") > 0)
    rows = rows.select("prompt_id", "x.cluster", (F.size("x.hits") * 100 + F.array_max(F.transform("x.hits", lambda a: F.length(a)))).alias("score"))
    return ranking.ambiguous(rows, "prompt_id", "score", "cluster")


_ALIASES = ", ".join(f"('{k}', '{a}')" for k, v in CLUSTERS.items() for a in v)
query(
    "j18_cluster_ranks", "prompts",
    sql=f"""select prompt_id, cluster, score, next_score, coalesce(next_score >= greatest(score - 25, 1), false) as ambiguous from (select *, row_number() over w as n, lead(score) over w as next_score from (
  select prompt_id, cluster, cast(count(*) * 100 + max(length(alias)) as int) as score from (select prompt_id, string_split({_normal_sql()}, ' ') as toks from v_prompts) p, (values {_ALIASES}) a(cluster, alias)
  where len(list_filter(string_split(alias, ' '), lambda x: not list_contains(toks, x))) = 0 group by prompt_id, cluster) window w as (partition by prompt_id order by score desc, cluster)) where n = 1""",
)(rank_clusters)

# --- companies: A-01 .. A-05, J-01 .. J-08, W-02, U-01 .. U-09
_P = "select company_id, count(distinct phone_id) as phone_count, max(phone) as top_phone from v_phones group by company_id"
_C = "select company_id, count(distinct case when channel_type = 'whatsapp' then channel_id end) as whatsapp_count, max(case when channel_type = 'whatsapp' then value end) as whatsapp, count(distinct case when channel_type = 'telegram' then channel_id end) as telegram_count, max(case when channel_type = 'telegram' then value end) as telegram from v_channels group by company_id"
query(
    "a03_company_audit", "companies", "emails", "phones", "channels",
    sql=f"""select k.company_id, k.region_id, k.name, coalesce(email_count, 0) as email_count, coalesce(phone_count, 0) as phone_count, coalesce(whatsapp_count, 0) as whatsapp_count, coalesce(telegram_count, 0) as telegram_count, top_email, top_phone, whatsapp, telegram
from v_companies k left join (select company_id, count(distinct email_id) as email_count, max(email) as top_email from v_emails group by company_id) e using (company_id) left join ({_P}) p using (company_id) left join ({_C}) ch using (company_id)""",
)(co.company_audit)
query(
    "j01_email_rows", "emails", "companies", "regions", "phones", "channels",
    sql=f"""select e.email_id, e.email, e.company_id, k.name, r.name as region_name, r.country_code, coalesce(phone_count, 0) as phone_count, coalesce(whatsapp_count, 0) as whatsapp_count, coalesce(telegram_count, 0) as telegram_count, top_phone, whatsapp, telegram
from v_emails e join v_companies k using (company_id) join v_regions r using (region_id) left join ({_P}) p using (company_id) left join ({_C}) ch using (company_id)""",
)(co.email_rows)


def country_options(regions: DataFrame, companies: DataFrame, emails: DataFrame) -> DataFrame:
    per = emails.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    rows = companies.join(per, "company_id", "left").groupBy("region_id").agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("n"), F.lit(0)).alias("emails"))
    return regions.join(rows, "region_id", "left").groupBy("country_code").agg(F.count(F.lit(1)).alias("regions"), F.coalesce(F.sum("companies"), F.lit(0)).alias("companies"), F.coalesce(F.sum("emails"), F.lit(0)).alias("emails"))


query(
    "a04_country_options", "regions", "companies", "emails",
    sql="select country_code, count(distinct r.region_id) as regions, count(distinct k.company_id) as companies, count(e.email_id) as emails from v_regions r left join v_companies k on k.region_id = r.region_id left join v_emails e on e.company_id = k.company_id group by country_code",
)(country_options)
query(
    "a05_region_stats", "regions", "runs", "companies",
    sql="""select r.region_id, coalesce(n_companies, 0) as companies, coalesce(n_runs, 0) as n_runs, coalesce(active, 0) as active, last_status from v_regions r
left join (select region_id, count(*) as n_companies from v_companies group by region_id) k using (region_id)
left join (select region_id, count(*) as n_runs, count(*) filter (status in ('pending', 'running')) as active, arg_max(status, (started_at, run_id)) as last_status from v_runs group by region_id) u using (region_id)""",
)(
    lambda r, u, k: r.join(k.groupBy("region_id").agg(F.count(F.lit(1)).alias("companies")), "region_id", "left")
    .join(u.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(c("status").isin("pending", "running")).alias("active"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status")), "region_id", "left")
    .select("region_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("companies", "n_runs", "active")], "last_status")
)
query(
    "a16_contact_companies", "emails", "phones", "channels",
    sql="""select bucket, count(distinct company_id) as contact_companies, count(distinct case when kind = 'email' then company_id end) as email_companies,
  greatest(count(distinct case when kind = 'phone' then company_id end), count(distinct case when kind = 'channel' then company_id end)) as phone_companies
from (select company_id, 'email' as kind, company_id % 25 as bucket from v_emails union all select company_id, 'phone', company_id % 25 from v_phones union all select company_id, 'channel', company_id % 25 from v_channels) group by bucket""",
)(lambda e, p, ch: co.contact_companies(e, p, ch, c("company_id") % 25))
_CANON = f"""select company_id, coalesce(first_value(company_id) over (partition by region_id, key order by a desc, b desc, c desc, d desc, company_id), company_id) as canonical_id from (
  select *, case when key is null then cast(company_id as string) else key end as k2, (not (lower(trim(name)) = '' or lower(trim(name)) like 'place-%' or lower(trim(name)) like 'node/%' or lower(trim(name)) like 'way/%' or lower(trim(name)) like 'relation/%'))::int as a,
    (crawl_status not in ('pending', 'failed', 'no_website'))::int as b, (city is not null)::int as c, length(trim(name)) as d from (select *, {_website_key('website_url')} as key from v_companies))"""
_CANON = _CANON.replace("partition by region_id, key order", "partition by region_id, k2 order") + ")" if _CANON.count("(") > _CANON.count(")") else _CANON.replace("partition by region_id, key order", "partition by region_id, k2 order")
query("w02_canonical", "companies", sql=_CANON)(co.canonical)
query("u09_reconcile", "companies", sql=f"select canonical_id, count(*) as merged from ({_CANON}) group by canonical_id having count(*) > 1")(lambda k: co.canonical(k).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("merged")).where("merged > 1"))
query(
    "u02_merge_emails", "emails", "companies",
    sql=f"select coalesce(canonical_id, e.company_id) as company_id, email, arg_min(source_rank, seq) as first_source, max(seq) as last_seen, count(*) as sightings from v_emails e left join ({_CANON}) m on m.company_id = e.company_id group by 1, 2",
)(lambda e, k: co.merge_emails(e, co.canonical(k)))
query(
    "u03_merge_phones", "phones", "companies",
    sql=f"select coalesce(canonical_id, p.company_id) as company_id, phone, arg_max(raw, (length(raw), -seq)) as raw, max(seq) as last_seen from v_phones p left join ({_CANON}) m on m.company_id = p.company_id group by 1, 2",
)(lambda p, k: co.merge_phones(p, co.canonical(k)))
query(
    "u08_merge_run_companies", "run_companies",
    sql="select run_id, company_id, arg_max(status, case status when 'completed' then 5 when 'running' then 4 when 'queued' then 3 when 'skipped' then 2 else 1 end) as status, min(queued_at) as queued_at, count(*) as merged from v_run_companies group by run_id, company_id",
)(co.merge_run_companies)
_STAGED = "(select * from v_places where place_id <> '' qualify row_number() over (partition by place_id order by seq) = 1 union all select * from v_places where place_id = '')"


def cascade(places: DataFrame, companies: DataFrame, phones: DataFrame) -> DataFrame:
    records = co.stage_places(places).withColumnRenamed("place_id", "source_id")
    links = companies.where("company_id % 50 = 1").select(F.concat(F.lit("pid"), c("company_id").cast("string")).alias("source_id"), "company_id")
    return co.match_cascade(records, links, companies, phones)


query(
    "j08_match_cascade", "places", "companies", "phones",
    sql=f"""select seq, case when by_link is not null then 'link' when by_website is not null then 'website' when by_phone is not null then 'phone' else 'new' end as matched_by, coalesce(by_link, by_website, by_phone) as company_id from (
  select s.seq, l.company_id as by_link, w.company_id as by_website, p.company_id as by_phone from {_STAGED} s
  left join (select 'pid' || cast(company_id as string) as source_id, company_id from v_companies where company_id % 50 = 1) l on l.source_id = s.place_id
  left join (select region_id, {_website_key('website_url')} as key, min(company_id) as company_id from v_companies group by 1, 2) w on w.key = {_website_key('s.website')} and w.region_id = s.region_id
  left join (select region_id, phone, min(company_id) as company_id from v_phones join v_companies using (company_id) group by 1, 2) p on p.phone = s.phone and p.region_id = s.region_id)""",
)(cascade)
query(
    "a41_query_counts", "places", sql=f"select coalesce(nullif(trim(keyword), ''), 'google_maps') as query_text, count(*) as n, count(nullif(trim(name), '')) as named, sum(cast(trunc(cast(replace(reviews, ',', '') as double)) as bigint))::bigint as reviews from {_STAGED} group by 1"
)(lambda p: co.stage_places(p).groupBy("query_text").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.sum("reviews").alias("reviews")))
query("j16_missing_companies", "emails", "companies", sql="select distinct company_id from v_emails where company_id not in (select company_id from v_companies where crawl_status <> 'pending')")(lambda e, k: e.select("company_id").distinct().join(k.where("crawl_status <> 'pending'"), "company_id", "left_anti"))
query(
    "u13_result_fan_out", "emails",
    sql="select email_id, coalesce(s.status, 'unknown') as status from v_emails e left join (select email, case when max(seq) % 2 = 0 then 'valid' else 'risky' end as status from v_emails where seq % 3 = 0 group by email) s using (email)",
)(
    lambda e: e.select("email_id", "email").join(e.where("seq % 3 = 0").groupBy("email").agg(F.when(F.max("seq") % 2 == 0, "valid").otherwise("risky").alias("status")), "email", "left").select("email_id", F.coalesce("status", F.lit("unknown")).alias("status"))
)
query(
    "u01_upsert", "companies",
    sql="select coalesce(t.company_id, s.company_id) as company_id, coalesce(s.name, t.name) as name, coalesce(t.city, s.city) as city from (select company_id, name, city from v_companies where company_id % 3 <> 0) t full join (select company_id, upper(name) as name, 'new' as city from v_companies where company_id % 4 = 0) s on s.company_id = t.company_id",
)(
    lambda k: upserts.upsert(k.where("company_id % 3 <> 0").select("company_id", "name", "city"), k.where("company_id % 4 = 0").select("company_id", F.upper("name").alias("name"), F.lit("new").alias("city")), ["company_id"], fill_only=("city",))
)

# --- runs, variants, policies: A-14 .. A-38, T-01, T-03, P-05 .. P-08, W-05
query("t01_recent_runs", "runs", sql="select run_id, region_id, status, started_at, cost, true as has_more from v_runs order by started_at desc, run_id desc limit 25 offset 25")(lambda r: ranking.page(r, [F.desc("started_at"), F.desc("run_id")], 25, 25))
query("p05_active_runs", "runs", sql="select region_id, run_id, status from v_runs where status in ('pending', 'running') qualify row_number() over (partition by region_id order by started_at desc, run_id desc) = 1")(
    lambda r: ranking.top_per_group(r.where(c("status").isin("pending", "running")), ["region_id"], [F.desc("started_at"), F.desc("run_id")]).select("region_id", "run_id", "status")
)
query("w03_last_status", "runs", sql="select region_id, arg_max(status, (started_at, run_id)) as status from v_runs group by region_id")(lambda r: r.groupBy("region_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status")))
query(
    "a14_run_progress", "run_companies",
    sql="select run_id, count(*) as total, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'running') as running, count(*) filter (status in ('completed', 'failed', 'skipped')) as ended, round_even(100.0::double * count(*) filter (status in ('completed', 'failed', 'skipped')) / count(*), 2) as percent, count(*) filter (status in ('queued', 'running')) = 0 as done from v_run_companies group by run_id",
)(runs.progress)
query("st04_stale_runs", "runs", sql="select run_id, region_id from v_runs where status = 'running' and started_at < timestamp '1996-01-01 00:00:00' - interval 10 minute")(lambda r: r.where((c("status") == "running") & (c("started_at") < F.expr("timestamp_ntz '1996-01-01 00:00:00' - interval 10 minutes"))).select("run_id", "region_id"))
query(
    "p07_recrawl_due", "companies", "runs",
    sql="select company_id, case when website_url is null or website_url = '' then false when crawl_status in ('pending', 'failed', 'blocked_by_robots') then true when last is null then true else epoch(timestamp '1998-08-02 00:00:00') - epoch(last) >= 72 * 3600 end as due from v_companies left join (select region_id, max(started_at) as last from v_runs where status = 'completed' group by region_id) using (region_id)",
)(
    lambda k, r: k.join(r.where("status = 'completed'").groupBy("region_id").agg(F.max("started_at").alias("last")), "region_id", "left")
    .select("company_id", runs.recrawl_due(c("website_url"), c("crawl_status"), c("last"), F.lit("1998-08-02 00:00:00"), 72).alias("due"))
)
_TOTALS = "count(*) as runs, " + ", ".join(f"sum({x})::bigint as {x}" for x in ("discovered", "crawled", "website", "contact", "email", "phone")) + ", cast(round_even(avg(score), 0) as int) as score"
query("a17_variant_totals", "run_stats", sql=f"select variant_id, {_TOTALS} from v_run_stats group by variant_id")(lambda s: runs.variant_totals(s, ["variant_id"]))
query(
    "s41_yield_scores", "run_stats",
    sql=f"select *, cast(round_even(website / b * 25 + crawled / b * 20 + contact / b * 15 + email / b * 30 + phone / b * 10, 0) as int) as yield_score from (select *, greatest(discovered, 1) as b from (select variant_id, {_TOTALS} from v_run_stats group by variant_id))".replace("select *, cast", "select * exclude (b), cast"),
)(lambda s: runs.yield_scores(runs.variant_totals(s, ["variant_id"])))
query("a18_strategy_figures", "variants", sql="select strategy, count(*) as n, round_even(avg(validation_score), 2) as validation, round_even(avg(production_score), 2) as production, round_even(avg(priority), 2) as priority from v_variants group by strategy")(
    lambda v: v.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(x), 2).alias(y) for x, y in (("validation_score", "validation"), ("production_score", "production"), ("priority", "priority"))])
)
query("a20_market_figures", "run_stats", "regions", sql="select country_code, count(*) as n, count(distinct variant_id) as variants, round_even(avg(score), 2) as score from v_run_stats join v_regions using (region_id) group by country_code")(
    lambda s, r: s.join(r.select("region_id", "country_code"), "region_id").groupBy("country_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("variant_id").alias("variants"), F.bround(F.avg("score"), 2).alias("score"))
)
query("a21_strategy_market", "run_stats", "variants", "regions", sql="select strategy, country_code, count(*) as n, round_even(avg(s.score), 2) as score from v_run_stats s join v_variants v using (variant_id) join v_regions r using (region_id) group by strategy, country_code")(
    lambda s, v, r: s.join(v.select("variant_id", "strategy"), "variant_id").join(r.select("region_id", "country_code"), "region_id").groupBy("strategy", "country_code").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("score"), 2).alias("score"))
)
query("a22_conversions", "outcomes", sql="select variant_key, region_id, count(*) filter (selected) as selected, count(*) filter (drafted) as drafted, count(*) filter (activated) as activated from v_outcomes group by variant_key, region_id")(
    lambda o: o.groupBy("variant_key", "region_id").agg(*[F.count_if(x).alias(x) for x in ("selected", "drafted", "activated")])
)
query(
    "a23_conversion_summary", "outcomes",
    sql="select provider, count(distinct plan_id) as plans, round_even(100.0::double * count(*) filter (selected) / count(*), 2) as selected_rate, round_even(100.0::double * count(*) filter (drafted) / count(*), 2) as drafted_rate, round_even(100.0::double * count(*) filter (activated) / count(*), 2) as activated_rate from v_outcomes group by provider",
)(lambda o: o.groupBy("provider").agg(F.countDistinct("plan_id").alias("plans"), *[F.bround(100.0 * F.count_if(x) / F.count(F.lit(1)), 2).alias(f"{x}_rate") for x in ("selected", "drafted", "activated")]))
query("a25_weighted_history", "run_stats", sql="select region_id, cast(floor(sum(discovered * score) / sum(discovered)) as bigint) as score from v_run_stats group by region_id")(lambda s: s.groupBy("region_id").agg(F.floor(F.sum(c("discovered") * c("score")) / F.sum("discovered")).alias("score")))
query("a27_running_means", "run_stats")(lambda s: ranking.running_mean(s, "variant_id", "run_id", "score"))
query("a29_benchmark_providers", "evals", sql="select provider, model, count(*) as evals, count(judgement) as judged, round_even(avg(judgement), 2) as judgement, max(size) as largest from v_evals group by provider, model")(
    lambda e: e.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("evals"), F.count("judgement").alias("judged"), F.bround(F.avg("judgement"), 2).alias("judgement"), F.max("size").alias("largest"))
)
_FIG = "count(*) as runs, round_even(avg(score), 2) as score, " + ", ".join(f"round_even(100.0::double * sum({x}) / greatest(sum(discovered), 1), 2) as {x}" for x in ("crawled", "contact", "email", "phone"))
query("a31_policy_windows", "audits", "run_stats", sql=f"select audit_id, case when created_at < changed_at then 'before' else 'after' end as side, {_FIG} from v_audits join v_run_stats on created_at >= changed_at - interval 7 day and created_at < changed_at + interval 7 day group by 1, 2")(runs.before_and_after)


def policy_outcomes(audits: DataFrame, stats: DataFrame) -> DataFrame:
    w = runs.before_and_after(audits, stats)
    sides = {s: {k: F.max(F.when(c("side") == s, c(v))) for k, v in (("runs", "runs"), ("score", "score"), ("contact", "contact"), ("email", "email"), ("phone", "phone"), ("crawl", "crawled"))} for s in ("before", "after")}
    flat = w.groupBy("audit_id").agg(*[e.alias(f"{s}_{k}") for s, by in sides.items() for k, e in by.items()])
    got = {s: {k: c(f"{s}_{k}") for k in sides[s]} for s in sides}
    return flat.select("audit_id", scores.policy_outcome(got["before"], got["after"]).alias("o")).select("audit_id", "o.outcome", "o.delta")


query("s50_policy_outcomes", "audits", "run_stats")(policy_outcomes)
query("a32_dominant_market", "run_stats", "variants", "regions", sql="select strategy, arg_max(country_code, (n, -rank)) as country_code from (select *, rank() over (partition by strategy order by country_code) as rank from (select strategy, country_code, count(*) as n from v_run_stats s join v_variants v using (variant_id) join v_regions r using (region_id) group by all)) group by strategy")(
    lambda s, v, r: ranking.top_per_group(s.join(v.select("variant_id", "strategy"), "variant_id").join(r.select("region_id", "country_code"), "region_id").groupBy("strategy", "country_code").agg(F.count(F.lit(1)).alias("n")), ["strategy"], [F.desc("n"), c("country_code")]).select("strategy", "country_code")
)
query("a35_nearest_rank", "variants", sql="select strategy, list_sort(list(production_score))[cast(round_even((count(*) - 1) * 0.55::double, 0) as int) + 1] as p55, cast(round_even(median(validation_score), 0) as int) as median from v_variants group by strategy")(
    lambda v: v.groupBy("strategy").agg(F.bround(F.percentile("validation_score", F.lit(0.5)), 0).cast("int").alias("median")).join(ranking.nearest_rank_by_counts(v, "strategy", "production_score", 0.55, "p55"), "strategy", "left").select("strategy", "p55", "median")
)
query(
    "a37_scoreboard", "audits",
    sql="select coalesce(change_kind, 'all') as bucket, count(*) as n, count(*) filter (outcome = 'improved') as improved, count(*) filter (outcome = 'degraded') as degraded, count(*) filter (outcome = 'neutral') as neutral, cast(round_even(avg(delta), 0) as int) as delta from v_audits group by rollup (change_kind)",
)(
    lambda a: a.rollup("change_kind").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c("outcome") == o).alias(o) for o in ("improved", "degraded", "neutral")], F.bround(F.avg("delta"), 0).cast("int").alias("delta")).select(F.coalesce("change_kind", F.lit("all")).alias("bucket"), "n", "improved", "degraded", "neutral", "delta")
)
query("t03_top_variants", "variants", sql="select variant_id, label, production_score, validation_score from v_variants order by production_score desc, validation_score desc, priority desc, variant_id limit 8")(
    lambda v: v.orderBy(F.desc("production_score"), F.desc("validation_score"), F.desc("priority"), "variant_id").limit(8).select("variant_id", "label", "production_score", "validation_score")
)
query("w05_topk_per_cluster", "variants", sql="select cluster_slug, variant_id from v_variants qualify row_number() over (partition by cluster_slug order by priority desc, variant_id) <= 6")(lambda v: ranking.top_per_group(v, ["cluster_slug"], [F.desc("priority"), c("variant_id")], 6).select("cluster_slug", "variant_id"))
query("w08_first_seen", "emails", sql="select email, min(seq) as seq from v_emails group by email")(lambda e: e.groupBy("email").agg(F.min("seq").alias("seq")))


def compare_plans(outcomes: DataFrame) -> DataFrame:
    """Full outer comparison of two providers' ranked variants."""
    tally = outcomes.groupBy("provider", "variant_key").agg(F.count_if("selected").alias("score"))
    a, b = (tally.where(c("provider") == p).select("variant_key", c("score").alias(f"{p}_score")) for p in ("openai", "heuristic"))
    both = a.join(b, "variant_key", "full")
    status = F.when(c("heuristic_score").isNull(), "selected_only").when(c("openai_score").isNull(), "heuristic_only").otherwise("shared")
    return both.select("variant_key", status.alias("status"), (F.coalesce("openai_score", F.lit(0)) - F.coalesce("heuristic_score", F.lit(0))).alias("delta"))


query(
    "j14_compare_plans", "outcomes",
    sql="with t as (select provider, variant_key, count(*) filter (selected) as score from v_outcomes group by all) select coalesce(a.variant_key, b.variant_key) as variant_key, case when b.score is null then 'selected_only' when a.score is null then 'heuristic_only' else 'shared' end as status, coalesce(a.score, 0) - coalesce(b.score, 0) as delta from (select * from t where provider = 'openai') a full join (select * from t where provider = 'heuristic') b on a.variant_key = b.variant_key".replace("with t as", ", t as", 1),
)(compare_plans)
query("a12_lease_counts", "requests", sql="select proxy_id, count(*) filter (provider = 'crawler') as crawler, count(*) filter (provider = 'browser') as browser from v_requests where used_proxy group by proxy_id")(
    lambda r: r.where("used_proxy").groupBy("proxy_id").pivot("provider", ["crawler", "browser"]).agg(F.count(F.lit(1))).na.fill(0, ["crawler", "browser"])
)
query(
    "t10_proxy_order", "requests",
    sql="select proxy_id, row_number() over (order by browser = 0 desc, errors, crawler, proxy_id) as rank from (select proxy_id, count(*) filter (provider = 'crawler') as crawler, count(*) filter (provider = 'browser') as browser, count(error) as errors from v_requests where used_proxy group by proxy_id)",
)(
    lambda r: ranking.ranked(r.where("used_proxy").groupBy("proxy_id").agg(F.count_if(c("provider") == "crawler").alias("crawler"), F.count_if(c("provider") == "browser").alias("browser"), F.count("error").alias("errors")), [], [F.desc(c("browser") == 0), c("errors"), c("crawler"), c("proxy_id")]).select("proxy_id", "rank")
)
