"""Registered queries: merges of companies with all child tables, element and crawl writes, recorded outcomes, whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import contacts, crawl, html, outcomes, prompts, scores
from brindle.operators import companies as co
from brindle.operators import merging, runs
from brindle.plans.catalog import _CANON, _website_key, query
from brindle.sources import seeds

c = F.col
_ID = "coalesce(canonical_id, r.company_id)"
_ORDER = f"({_ID} <> r.company_id)::int, r.company_id"
_TO = f"left join ({_CANON}) m on m.company_id = r.company_id"
_PLACEHOLDER = "(trim(name) = '' or lower(trim(name)) like 'place-%' or lower(trim(name)) like 'node/%' or lower(trim(name)) like 'way/%' or lower(trim(name)) like 'relation/%' or lower(trim(name)) = lower(trim(external_ref)))"
_WEAK = "('pending', 'failed', 'no_website')"


def _first(name: str, order: str = _ORDER) -> str:
    return f"arg_min({name}, row({order})) filter ({name} <> '') as {name}"


# --- U-07: companies and their children
_FULL = """(select *, case when company_id % 7 = 2 then name else 'node:' || company_id end as external_ref, case when company_id % 3 = 0 then 'q' || company_id end as source_query, case when company_id % 4 = 1 then '' || company_id % 90 else '' end as latitude,
  case when company_id % 4 = 1 then '' || company_id % 80 else '' end as longitude, company_id % 7 = 0 as has_contact_form from v_companies)"""


def full_companies(k: DataFrame) -> DataFrame:
    text = lambda e: e.cast("string")
    here = c("company_id") % 4 == 1
    return k.select(
        "*", F.when(c("company_id") % 7 == 2, c("name")).otherwise(F.concat(F.lit("node:"), text(c("company_id")))).alias("external_ref"), F.when(c("company_id") % 3 == 0, F.concat(F.lit("q"), text(c("company_id")))).alias("source_query"),
        F.when(here, text(c("company_id") % 90)).otherwise("").alias("latitude"), F.when(here, text(c("company_id") % 80)).otherwise("").alias("longitude"), (c("company_id") % 7 == 0).alias("has_contact_form"),
    )


query(
    "u07_merge_companies", "companies",
    sql=f"""select {_ID} as company_id, arg_min(name, row({_PLACEHOLDER}::int, -length(trim(name)), {_ORDER})) as name, {', '.join(_first(n) for n in ('website_url', 'city', 'source_query', 'latitude', 'longitude'))}, bool_or(has_contact_form) as has_contact_form,
  coalesce(arg_min(crawl_status, row({_ORDER})) filter (crawl_status not in {_WEAK}), arg_min(crawl_status, row({_ORDER}))) as crawl_status, count(*) as merged from {_FULL} r {_TO} group by 1""",
)(lambda k: merging.merge_companies(full_companies(k), co.canonical(k)))
query(
    "u07_merge_sightings", "emails", "companies",
    sql=f"""select {_ID} as company_id, email, {_first('source_page_url', _ORDER + ', email_id')}, {_first('source_type', _ORDER + ', email_id')}, min(seq) as first_seen_at, max(seq + 10) as last_seen_at
  from (select *, case when seq % 3 = 0 then '' else 'p' || seq end as source_page_url, case when source_rank > 0 then 't' || source_rank end as source_type from v_emails) r {_TO} group by 1, 2""",
)(
    lambda e, k: merging.merge_sightings(
        e.select("company_id", "email_id", "email", F.when(c("seq") % 3 == 0, "").otherwise(F.concat(F.lit("p"), c("seq").cast("string"))).alias("source_page_url"), F.when(c("source_rank") > 0, F.concat(F.lit("t"), c("source_rank").cast("string"))).alias("source_type"),
                 c("seq").alias("first_seen_at"), (c("seq") + 10).alias("last_seen_at")), co.canonical(k), ["email"], "email_id")
)
query(
    "u07_merge_maps", "channels", "companies",
    sql=f"""select company_id, channel_type, normalized, string_agg(k || '=' || v, ',' order by k) as metadata from (
  select {_ID} as company_id, channel_type, lower(trim(value)) as normalized, k, arg_max(v, row({_ORDER}, channel_id)) as v from (
    select company_id, channel_id, channel_type, value, 'source' as k, 's' || channel_id % 3 as v from v_channels union all select company_id, channel_id, channel_type, value, 'k' || channel_id % 4, '' || channel_id from v_channels) r {_TO} group by 1, 2, 3, 4) group by 1, 2, 3""",
)(
    lambda ch, k: merging.merge_maps(
        ch.select("company_id", "channel_id", "channel_type", F.lower(F.btrim("value")).alias("normalized"), F.create_map(F.lit("source"), F.concat(F.lit("s"), (c("channel_id") % 3).cast("string")), F.concat(F.lit("k"), (c("channel_id") % 4).cast("string")), c("channel_id").cast("string")).alias("metadata")),
        co.canonical(k), ["channel_type", "normalized"], "channel_id", "metadata",
    ).withColumn("metadata", F.array_join(F.transform(F.map_entries("metadata"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))
)
_PRIORITY = "case status " + " ".join(f"when '{s}' then {n}" for s, n in co.STATUS_PRIORITY.items()) + " else 0 end"
query(
    "u07_merge_run_rows", "run_companies", "companies",
    sql=f"""select {_ID} as company_id, run_id, arg_min(status, row(-({_PRIORITY}), {_ORDER}, line)) as status, min(queued_at) as queued_at, min(started_at) as started_at, max(finished_at) as finished_at, {_first('last_error', _ORDER + ', line')}
  from (select *, case when line % 2 = 0 then queued_at end as started_at, case when line % 3 = 0 then queued_at end as finished_at, case when status = 'failed' then 'e' || line else '' end as last_error from v_run_companies) r {_TO} group by 1, 2""",
)(
    lambda r, k: merging.merge_run_rows(r.select("*", F.when(c("line") % 2 == 0, c("queued_at")).alias("started_at"), F.when(c("line") % 3 == 0, c("queued_at")).alias("finished_at"), F.when(c("status") == "failed", F.concat(F.lit("e"), c("line").cast("string"))).otherwise("").alias("last_error")), co.canonical(k), "line")
)
query("u07_merge_categories", "companies", sql=f"select distinct {_ID} as company_id, r.company_id % 8 as category_id from v_companies r {_TO}")(
    lambda k: merging.merge_categories(k.select("company_id", (c("company_id") % 8).alias("category_id")), co.canonical(k))
)
query(
    "u07_merge_submissions", "requests", "companies",
    sql=f"""with f as (select id, {_ID} as company_id, url, ({_ID} <> r.company_id)::int as m, r.company_id as own from (select *, id % 1500 as company_id from v_requests where provider = 'crawler') r {_TO})
select id + 1 as submission_id, company_id, first_value(id) over (partition by company_id, url order by m, own, id) as form_id from f""".replace("with f as", ", f as", 1),
)(
    lambda r, k: merging.merge_submissions(
        r.where("provider = 'crawler'").select((c("id") + 1).alias("submission_id"), c("id").alias("form_id")), r.where("provider = 'crawler'").select((c("id") % 1500).alias("company_id"), c("id").alias("form_id"), c("url").alias("page_url")), co.canonical(k))
)
query("u07_request_companies", "requests", "companies", sql=f"select id, {_ID} as company_id from (select id, id % 1500 as company_id from v_requests) r {_TO}")(
    lambda r, k: merging.repoint(r.select("id", (c("id") % 1500).alias("company_id")), co.canonical(k))
)

# --- U-01: a scan's elements over the companies
_ELEMENTS = """(select *, case when contains(coalesce(website, ''), 't.me/') then null when website <> '' then case when contains(website, '://') then website else 'https://' || website end end as site from (
  select company_id as seq, region_id, case when company_id % 4 = 0 then 'node:' else 'way:' end || company_id as external_ref, case when company_id % 6 = 0 then '' else 'Longer name of the place ' || company_id % 30 end as title,
    case when company_id % 17 = 0 then 'https://t.me/x' when company_id % 9 = 1 then 'new' || company_id % 20 || '.example.com' else website_url end as website, case when company_id % 3 = 0 then 'town' || company_id % 10 end as town, 'scan ' || company_id % 5 as query from v_companies where company_id % 5 <> 4))"""


def elements(k: DataFrame) -> DataFrame:
    text = lambda e: e.cast("string")
    i = c("company_id")
    return k.where("company_id % 5 <> 4").select(
        i.alias("seq"), "region_id", F.concat(F.when(i % 4 == 0, "node:").otherwise("way:"), text(i)).alias("external_ref"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("Longer name of the place "), text(i % 30))).alias("name"),
        F.when(i % 17 == 0, "https://t.me/x").when(i % 9 == 1, F.concat(F.lit("new"), text(i % 20), F.lit(".example.com"))).otherwise(c("website_url")).alias("website"),
        F.when(i % 3 == 0, F.concat(F.lit("town"), text(i % 10))).alias("city"), F.concat(F.lit("scan "), text(i % 5)).alias("query"),
    )


def stored_companies(k: DataFrame) -> DataFrame:
    return full_companies(k).where("company_id % 2 = 0").withColumn("source", F.when(c("company_id") % 10 == 0, "manual").otherwise("overpass"))


query(
    "u01_elements", "companies",
    sql=f""", k as (select *, {_website_key('website_url')} as key, case when company_id % 10 = 0 then 'manual' else 'overpass' end as source from {_FULL} where company_id % 2 = 0),
e as (select seq, region_id, external_ref, coalesce(nullif(title, ''), external_ref) as name, site, town, query, {_website_key('site')} as key from {_ELEMENTS}),
r as (select region_id, external_ref, min(company_id) as by_ref from k where source = 'overpass' group by 1, 2),
w as (select region_id, key, arg_min(company_id, row({_PLACEHOLDER}::int, (crawl_status in {_WEAK})::int, (coalesce(city, '') = '')::int, -length(trim(name)), company_id)) as by_key from k where key is not null group by 1, 2),
met as (select coalesce(by_ref, by_key) as company_id, e.seq, e.external_ref, e.name, site, town as city, query as source_query, 1 as n, e.region_id || '/' || coalesce(e.key, e.external_ref) as unit from e left join r on r.region_id = e.region_id and r.external_ref = e.external_ref left join w on w.region_id = e.region_id and w.key = e.key),
rows_ as (select company_id, case when company_id is null then unit end as new_key, seq, external_ref, name, site, city, source_query, n from met union all select company_id, null, 0, external_ref, name, website_url, city, source_query, 0 from k where company_id in (select company_id from met))
select company_id, new_key, arg_min(name, row({_PLACEHOLDER}::int, -length(trim(name)), n, seq)) as name, arg_max(site, row(n, seq)) filter (site <> '') as website_url, arg_max(city, row(n, seq)) filter (city <> '') as city,
  arg_min(source_query, row(n, seq)) filter (source_query <> '') as source_query, sum(n)::bigint as elements from rows_ group by 1, 2""",
)(lambda k: merging.upsert_elements(elements(k), stored_companies(k)))

# --- U-06: what a crawl writes
query(
    "u06_crawled_companies", "companies", "crawled",
    sql="""select k.company_id, case when website_url <> '' then st else 'no_website' end as crawl_status, coalesce(website_url <> '' and has_form, false) as has_contact_form
  from v_companies k join (select site_id, min(crawl_status) as st, bool_or(page_id % 13 = 0) as has_form from v_crawled group by 1) s on s.site_id = k.company_id""",
)(
    lambda k, p: merging.crawled_companies(k, p.select(c("site_id").alias("company_id"), (c("page_id") % 13 == 0).alias("has_contact_form")), p.groupBy(c("site_id").alias("company_id")).agg(F.min("crawl_status").alias("crawl_status")))
)


def crawled_pages(p: DataFrame) -> DataFrame:
    url = lambda n: F.concat(F.lit("/p"), (c("page_id") % n).cast("string"))
    new = p.select(c("site_id").alias("company_id"), url(11).alias("url"), c("page_id").alias("seq"), F.when(c("page_id") % 4 != 0, c("title")).alias("title"), "status_code", c("error").alias("crawl_error"))
    old = p.where("page_id % 50 = 0").groupBy(c("site_id").alias("company_id"), url(13).alias("url")).agg(F.lit("old").alias("title"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("crawl_error"))
    return merging.crawled_pages(new, old)


query(
    "u06_crawled_pages", "crawled",
    sql=""", n as (select site_id as company_id, '/p' || page_id % 11 as url, case when page_id % 4 <> 0 then title end as title, status_code, error as crawl_error from v_crawled qualify row_number() over (partition by site_id, page_id % 11 order by page_id desc) = 1),
o as (select distinct site_id as company_id, '/p' || page_id % 13 as url from v_crawled where page_id % 50 = 0)
select * from n union all select company_id, url, 'old', 200, null from o where not exists (select 1 from n where n.company_id = o.company_id and n.url = o.url)""",
)(crawled_pages)


def crawled_forms(p: DataFrame) -> DataFrame:
    form = lambda a, m, h: F.struct(a.alias("action_url"), m.alias("method"), h.alias("has_captcha"))
    action = F.concat(F.lit("/send"), c("page_id").cast("string"))
    both = F.array(form(action, F.when(c("page_id") % 2 == 0, "post").otherwise(""), c("page_id") % 7 == 0), form(F.lit("/other"), F.lit("get"), F.lit(True)))
    pages = p.select(c("site_id").alias("company_id"), F.concat(F.lit("/p"), (c("page_id") % 5).cast("string")).alias("url"), c("page_id").alias("seq"), F.when(c("page_id") % 3 == 0, both).alias("forms"))
    stored = p.where("site_id % 5 = 0").select(c("site_id").alias("company_id"), F.lit("/p0").alias("page_url"))
    return merging.crawled_forms(pages, stored)


query(
    "u06_crawled_forms", "crawled",
    sql="select site_id as company_id, '/p' || page_id % 5 as page_url, '/send' || page_id as action_url, case when page_id % 2 = 0 then 'post' else 'get' end as method, page_id % 7 = 0 as has_captcha from v_crawled where page_id % 3 = 0 and not (site_id % 5 = 0 and page_id % 5 = 0) qualify row_number() over (partition by site_id, page_id % 5 order by page_id) = 1",
)(crawled_forms)


def linked_phones(p: DataFrame) -> DataFrame:
    found = F.transform(contacts.phone_candidates(c("body")), lambda x: F.struct(x.alias("raw"), contacts.normalize_phone(x).alias("normalized")))
    chat = F.when(c("href").contains("wa.me") | c("href").contains("whatsapp"), "whatsapp").otherwise("telegram")
    return p.select("page_id", merging.linked_phone(chat, crawl.messenger_digits(c("href")), found).alias("linked_phone"))


query("u06_linked_phones", "crawled", sql="select page_id, case when page_id % 5 in (0, 1) then '+66 81 234 5678' end as linked_phone from v_crawled")(linked_phones)


# --- S-14: contacts in JSON-LD
def structured(p: DataFrame) -> DataFrame:
    n = lambda k: (c("page_id") % k).cast("string")
    block = F.concat(
        F.lit('{"@type": "Org", "deep": {"Email": "Info'), n(5), F.lit('@Shop.example.com", "telephone": " +66 81 234 56'), F.lpad(n(90), 2, "0"), F.lit(' ", "list": ["write to a@b.example.org now", 7, null, ["test@b.example.org"]]}, "sameAs": ["https://t.me/Shop'), n(7),
        F.lit('", "https://wa.me/66812345'), F.lpad(n(900), 3, "0"), F.lit('", 5]'), F.when(c("page_id") % 10 == 0, "").otherwise("}"),
    )
    page = F.concat(F.lit("<p>x</p><script type=\"application/ld+json\">"), block, F.lit("</script><script type='application/ld+json'>{\"SAMEAS\": \"@Second\"}</script>"))
    found = html.structured_contacts(c("leaves"))
    rows = p.select("page_id", html.json_ld_leaves(html.json_ld_blocks(page)).alias("leaves"))
    return rows.select("page_id", *[F.array_join(v, ",").alias(k) for k, v in found.items()])


query(
    "s14_structured_contacts", "crawled",
    sql="""select page_id, case when ok then 'a@b.example.org,info' || page_id % 5 || '@shop.example.com' else '' end as emails, case when ok then '+66 81 234 56' || lpad('' || page_id % 90, 2, '0') else '' end as phones,
  case when ok then '@second,@shop' || page_id % 7 else '@second' end as telegram, case when ok then '+66812345' || lpad('' || page_id % 900, 3, '0') else '' end as whatsapp from (select *, page_id % 10 <> 0 as ok from v_crawled)""",
)(structured)

# --- recorded outcomes: S-56, S-58, S-59, S-60, PL-02, A-46
_ANSWERS = ("answer", "nxdomain", "no_answer", "timeout", "no_servers", "error")
_PICK = "list_extract(['" + "', '".join(_ANSWERS) + "'], cast({i} % 6 as int) + 1)"


def answers(p: DataFrame) -> DataFrame:
    pick = lambda e: F.element_at(F.array(*[F.lit(x) for x in _ANSWERS]), (e % 6 + 1).cast("int"))
    domain = F.regexp_extract("asset_email", "@(.*)$", 1)
    v = outcomes.domain_verdict(domain, pick(c("page_id")), pick(F.floor(c("page_id") / 6)), c("page_id") % 3, F.when(c("page_id") % 9 == 0, "MX lookup timed out"))
    return p.select("page_id", v.alias("v")).select("page_id", "v.*")


query(
    "s56_domain_answers", "crawled",
    sql=f"""select page_id, found as valid, ex as domain_exists, found as mx_found, case when not ex then 'Domain ''' || d || ''' does not exist' when not found then case when page_id % 9 = 0 then 'MX lookup timed out' else 'No MX records found for ''' || d || '''' end end as error
  from (select *, ex and page_id % 3 > 0 as found from (select page_id, regexp_extract(asset_email, '@(.*)$', 1) as d, {_PICK.format(i='page_id')} in ('answer', 'timeout', 'no_servers') or {_PICK.format(i='(page_id // 6)')} in ('answer', 'timeout', 'no_servers') as ex from v_crawled))""",
)(answers)
query(
    "s58_probe_outcomes", "crawled",
    sql="select page_id, 'unknown' as verdict, page_id % 5 <> 2 as can_retry, list_extract(['Connection failed', 'Server disconnected', 'SMTP error', 'Timeout', 'Network error'], cast(page_id % 5 as int) + 1) || ': ' || message as error from v_crawled",
)(
    lambda p: p.select("page_id", outcomes.probe_error(F.element_at(F.array(*[F.lit(k) for k in outcomes.PROBE_ERRORS]), (c("page_id") % 5 + 1).cast("int")), c("message")).alias("v")).select("page_id", "v.*")
)
query("s59_job_states", "crawled", sql="select page_id, list_extract(['pending', 'processing', 'failed', 'completed', null], cast(page_id % 5 as int) + 1) as status from v_crawled")(
    lambda p: p.select("page_id", outcomes.job_state(F.element_at(F.array(*[F.lit(k) for k in (*outcomes.JOB_STATES, "REVOKED")]), (c("page_id") % 5 + 1).cast("int"))).alias("status"))
)
_SAYS = ("2 Slots available now.", "Rate limited until noon", "The dispatcher is down", "", "rate limited, currently running queries: 1")
query(
    "s60_source_answers", "crawled",
    sql="""select page_id, case when good then case page_id % 5 when 1 then 'rate_limited' when 2 then 'bootstrapping' else 'healthy' end when has_message then 'bootstrapping' else 'unreachable' end as summary,
  case when good then 'ready' when not has_message then 'unknown' when has_contact_ and has_social then 'converting' when has_social then 'importing' else 'downloading' end as stage, good as ready,
  case when contains(message, 'resolution') then 'no_name' when contains(message, 'timed out') then 'timeout' else 'other' end as reason
  from (select page_id, message, coalesce(status_code = 200, false) as good, page_id % 9 <> 0 as has_message, page_id % 8 = 0 as has_contact_, has_social from v_crawled)""",
)(
    lambda p: p.select("page_id", outcomes.source_status(c("status_code"), F.element_at(F.array(*[F.lit(s) for s in _SAYS]), (c("page_id") % 5 + 1).cast("int")), c("page_id") % 9 != 0, c("page_id") % 8 == 0, c("has_social")).alias("v"), outcomes.probe_reason(c("message")).alias("reason")).select("page_id", "v.*", "reason")
)


def outcome_rows(p: DataFrame) -> DataFrame:
    exception = F.when(c("page_id") % 3 == 0, c("message"))
    flag = lambda code: F.coalesce(c("error") == code, F.lit(False))
    v = outcomes.crawl_outcome(exception, scores.dead_host(exception), ~c("has_contact") & (c("page_id") % 2 == 0), flag("anti_bot_challenge"), flag("js_shell"), c("crawl_status"), (c("page_id") % 5).cast("int"))
    return p.select("page_id", v.alias("v")).select("page_id", "v.*")


query(
    "pl02_crawl_writes", "crawled",
    sql="""select page_id, case when x is null then case when esc then 'queued' else 'completed' end when dead then 'failed' when tried < 3 then 'queued' else 'failed' end as run_status, case when x is null then crawl_status when not dead and tried < 3 then 'retrying' else 'failed' end as crawl_status,
  case when x is null then case when esc then case when error = 'anti_bot_challenge' then error when error = 'js_shell' then error when crawl_status in ('blocked_by_robots', 'robots_bypassed') then crawl_status else 'generic' end end when dead then 'Dead host: ' || x when tried < 3 then 'Retry ' || (tried + 1) || '/3 queued: ' || x else x end as reason
  from (select *, case when page_id % 3 = 0 then message end as x, page_id % 3 = 0 and message in ('No route to host', 'getaddrinfo failed') as dead, not has_contact and page_id % 2 = 0 as esc, page_id % 5 as tried from v_crawled)""",
)(outcome_rows)
query(
    "a46_site_flags", "crawled",
    sql="select site_id, has_form, case when not answered then 'failed' when site_id % 6 = 0 then 'robots_bypassed' else 'completed' end as status from (select site_id, bool_or(page_id % 13 = 0) as has_form, bool_or(coalesce(status_code, 0) not in (0, 200)) as answered from v_crawled group by 1)",
)(
    lambda p: p.groupBy("site_id").agg(F.bool_or(c("page_id") % 13 == 0).alias("has_form"), F.bool_or(~F.coalesce("status_code", F.lit(0)).isin(0, 200)).alias("answered")).select("site_id", "has_form", outcomes.site_status(c("answered"), c("site_id") % 6 == 0).alias("status"))
)

# --- S-62, SRC-13
query(
    "src13_clusters", "regions",
    sql=f"select * from (values {', '.join(repr((s, v, l, o, dict((x[0], x[1]) for x in seeds.VERTICALS)[v])) for s, v, l, o in seeds.CLUSTERS)}) t(slug, vertical, label, sort_order, vertical_label)",
)(lambda r: seeds.clusters(r.sparkSession).join(seeds.verticals(r.sparkSession).select(c("slug").alias("vertical"), c("label").alias("vertical_label")), "vertical"))


def taxonomy_drafts(p: DataFrame) -> DataFrame:
    k = seeds.clusters(p.sparkSession).select(c("slug").alias("focus"), c("vertical").alias("k_vertical"), c("label").alias("k_label"))
    rows = p.select("prompt_id", "prompt", F.when(c("prompt_id") % 5 == 0, "vehicle").alias("v"), F.when(c("prompt_id") % 7 == 0, "tour_operators").alias("focus")).join(k, "focus", "left")
    return rows.select("prompt_id", F.inline(prompts.draft_taxonomy(c("prompt"), c("v"), c("focus"), c("k_vertical"), c("k_label"))))


_TITLE = "array_to_string(list_transform(regexp_extract_all(trim(prompt), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_SLUG = lambda t, sep: f"trim(regexp_replace(lower({t}), '[^a-z0-9]+', '{sep}', 'g'), '{sep}')"
query(
    "s62_taxonomy_drafts", "prompts",
    sql=f"""select prompt_id, vertical, cluster, substr({_SLUG("cluster || '-' || w", '-')}, 1, 96) as template_key, substr(label || ' ' || upper(w[1]) || w[2:], 1, 128) as label, w as sub_intent, score as template_score from (
  select prompt_id, case when prompt_id % 7 = 0 then 'tourism' when prompt_id % 5 = 0 then 'vehicle' else substr({_SLUG("string_split(prompt, ' in ')[1]", '_')}, 1, 64) end as vertical, case when prompt_id % 7 = 0 then 'tour_operators' else substr({_SLUG('prompt', '_')}, 1, 64) end as cluster,
    case when prompt_id % 7 = 0 then 'Tour Operators' else substr({_TITLE}, 1, 128) end as label from v_prompts), (values ('core', 65), ('premium', 60), ('specialty', 55)) t(w, score)""",
)(taxonomy_drafts)

# --- PL-01 and PL-05: whole chains
_STATE = """(select run_id, line, 'cat' || line as slug, min(company_id) % 7 = 0 as f, max(quantity) > 20 as due, case when min(status) = 'failed' then 'boom ' || min(company_id) end as error, max(quantity)::bigint as found, run_id % 4 as remaining from v_run_companies group by run_id, line)"""
_STEPS = f"""s as (select *, (f or due) as scan, coalesce(sum(((f or due) and error is null)::int) over w, 0) as used from {_STATE} window w as (partition by run_id order by line rows between unbounded preceding and 1 preceding)),
t as (select *, scan and used >= remaining as over_ from s), u as (select *, coalesce(bool_or(over_) over (partition by run_id order by line rows between unbounded preceding and 1 preceding), false) as ended from t),
x as (select *, case when ended then 'untouched' when over_ then 'rate_limited' when not scan then 'cached' when error is not null then 'failed' when f then 'fresh_forced' else 'fresh' end as st from u)"""


def discovery(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = r.groupBy("run_id", "line").agg(F.min("company_id").alias("company_id"), F.max("quantity").alias("quantity"), F.min("status").alias("status"))
    states = r.select(
        "run_id", c("line").alias("category_id"), F.concat(F.lit("cat"), c("line").cast("string")).alias("slug"), (c("company_id") % 7 == 0).alias("force"), (c("quantity") > 20).alias("due"),
        F.when(c("status") == "failed", F.concat(F.lit("boom "), c("company_id").cast("string"))).alias("error"), c("quantity").cast("long").alias("found"), c("line").cast("long").alias("last_count"), (c("run_id") % 4).alias("remaining"),
    )
    return runs.discovery(states)


query("pl01_categories", "run_companies", sql=f", {_STEPS} select run_id, line as category_id, st as status from x")(lambda r: discovery(r)[0])
query(
    "pl01_discovery", "run_companies",
    sql=f""", {_STEPS}, y as (select run_id, sum(case when st in ('fresh', 'fresh_forced') then found when st = 'cached' then line else 0 end)::bigint as discovered, count(*) filter (st in ('fresh', 'fresh_forced')) as queries_used,
  string_agg(slug || ': ' || error, ' ; ' order by line) filter (st = 'failed') as errors, bool_or(st = 'rate_limited') as limited, bool_or(st in ('fresh', 'fresh_forced', 'cached')) as any_ok, max(remaining) as cap from x group by run_id)
select run_id, discovered, queries_used, case when errors is not null and not any_ok then 'failed' when limited then 'skipped' else 'running' end as status,
  case when errors is not null and not any_ok then errors when errors is not null then 'Discovery completed. Partial category failures: ' || errors when limited then 'Daily cap reached (' || queries_used || '/' || cap || ').' else 'Discovery completed.' end as note from y""",
)(lambda r: discovery(r)[1])
query(
    "pl05_validation", "recipes", "companies",
    sql=""", e as (select company_id % 400 as recipe_id, count(*) as n, count(*) filter (website_url <> '') as w, count(distinct lower(trim(name))) filter (name <> '') as names from v_companies group by 1),
t as (select r.recipe_id, status, coalesce(n, 0) as total_results, coalesce(w, 0) as with_website, coalesce(names, 0) as distinct_names, coalesce(round_even(w / n, 4), 0) as website_rate, coalesce(round_even(names / n, 4), 0) as name_rate from v_recipes r left join e using (recipe_id) where r.recipe_id % 10 <> 0),
s as (select *, case when total_results = 0 then 10 else least(100, cast(round_even(least(total_results, 40) * 1.5::double + website_rate * 35 + name_rate * 25, 0) as int)) end as score from t), v as (select *, case when total_results = 0 then 'candidate' when score >= 70 then 'validated' when score >= 35 then 'candidate' else 'draft' end as version_status from s)
select recipe_id, total_results, with_website, distinct_names, website_rate, name_rate, score, version_status, case when status = 'draft' or version_status = 'validated' then version_status else status end as recipe_status from v""",
)(lambda r, k: runs.validate_recipes(r, r.where("recipe_id % 10 = 0"), k.select((c("company_id") % 400).alias("recipe_id"), "name", c("website_url").alias("website"))))
