"""Lead-data views over the driver's tables, in SQL that Spark and DuckDB read alike. {table} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from brindle.functions.numbering import read_plan

VIEWS = {
    "regions": """
select n_nationkey as region_id, n_name as name, upper(substr(n_name, 1, 2)) as country_code, n_regionkey as parent_id, 4 as level, n_nationkey % 7 <> 0 as is_active from {nation}""",
    "companies": """
select c_custkey as company_id, c_nationkey as region_id, case when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then concat('place-', cast(c_custkey as string)) else c_name end as name,
  case when c_custkey % 3 = 0 then null else concat('https://', case when c_custkey % 2 = 0 then 'WWW.' else '' end, 'Shop', cast(c_custkey % 400 as string), '.example.com/', case when c_custkey % 5 = 0 then 'Home/' else '' end) end as website_url,
  case c_custkey % 5 when 0 then 'pending' when 1 then 'completed' when 2 then 'failed' when 3 then 'completed' else 'no_website' end as crawl_status,
  case when c_custkey % 4 = 0 then null else concat('city', cast(c_nationkey as string)) end as city, c_acctbal as balance from {customer}""",
    "emails": """
select c_custkey as email_id, c_custkey % 600 as company_id, concat(case c_custkey % 9 when 0 then 'info' when 1 then 'sales' when 2 then 'test' else concat('user', cast(c_custkey % 50 as string)) end, '@',
  case c_custkey % 8 when 0 then 'gmail.com' when 1 then 'gmial.com' when 2 then 'mailinator.com' when 3 then 'hotmial.co.uk' when 4 then 'example.org' when 5 then 'yahooo.com' when 6 then 'yopmail.com' else 'shop.example.com' end) as email,
  cast(c_custkey % 4 as int) as source_rank, c_custkey as seq from {customer}""",
    "phones": "select c_custkey as phone_id, c_custkey % 500 as company_id, concat('+66', lpad(cast(c_custkey % 700 as string), 9, '0')) as phone, concat(case when c_custkey % 2 = 0 then '+66 ' else '0066 ' end, lpad(cast(c_custkey % 700 as string), 9, '0')) as raw, c_custkey as seq from {customer} where c_custkey % 3 <> 1",
    "channels": "select c_custkey as channel_id, c_custkey % 450 as company_id, case when c_custkey % 5 = 0 then 'whatsapp' else 'telegram' end as channel_type, concat('@h', cast(c_custkey % 300 as string)) as value from {customer} where c_custkey % 5 = 0 or c_custkey % 7 = 0",
    "runs": "select o_orderkey as run_id, o_custkey % 25 as region_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'running' end as status, o_orderdate as started_at, o_totalprice as cost from {orders}",
    "run_companies": """
select l_orderkey as run_id, l_partkey as company_id, l_linenumber as line, case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'skipped' when l_linestatus = 'O' then 'queued' when l_linenumber % 2 = 0 then 'running' else 'completed' end as status,
  l_shipdate as queued_at, l_quantity as quantity from {lineitem}""",
    "requests": """
select event_id as id, case user_id % 3 when 0 then 'crawler' when 1 then 'browser' else 'maps' end as provider, event_type as request_kind, user_id % 4 = 0 as used_proxy, case when user_id % 4 = 0 then user_id % 10 end as proxy_id,
  concat('https://', case when event_id % 2 = 0 then 'www.' else '' end, 'Host', cast(event_id % 40 as string), '.com', case when event_id % 5 = 0 then ':443' else '' end, '/p/', cast(event_id % 9 as string)) as url,
  cast(floor(value) as int) as duration_ms, case when event_type = 'error' then concat('timed out on step ', cast(user_id % 6 as string)) end as error, ts as created_at from {events}""",
    "variants": """
select p_partkey as variant_id, p_brand as cluster_slug, p_type as label, case p_size % 4 when 0 then 'overpass' when 1 then 'google_maps' when 2 then 'directory' else 'hybrid' end as strategy, p_size as priority,
  cast(p_partkey % 101 as int) as validation_score, cast(p_partkey % 6 as int) as validation_count, cast((p_partkey * 7) % 101 as int) as production_score, cast(p_partkey % 5 as int) as production_runs,
  cast(p_partkey % 3 as int) as planner_selected, cast((p_partkey * 3) % 4 as int) as planner_drafted, cast(case when p_partkey % 9 = 0 then 2 else 0 end as int) as planner_activated,
  cast(p_partkey % 2 as int) as market_selected, cast(p_partkey % 4 as int) as market_drafted, cast(case when p_partkey % 11 = 0 then 1 else 0 end as int) as market_activated,
  0 as prompt_selected, 0 as prompt_drafted, 0 as prompt_activated, cast((p_partkey * 5) % 101 as int) as market_score, cast(p_partkey % 4 as int) as market_runs, cast((p_partkey * 11) % 101 as int) as strategy_score, cast(p_partkey % 7 as int) as strategy_runs from {part}""",
    "run_stats": """
select l_partkey as variant_id, l_orderkey as run_id, l_suppkey % 25 as region_id, cast(10 + sum(l_quantity) as bigint) as discovered, cast(sum(floor(l_quantity / 2)) as bigint) as crawled, cast(sum(floor(l_quantity / 3)) as bigint) as website,
  cast(sum(floor(l_quantity / 4)) as bigint) as contact, cast(sum(floor(l_quantity / 5)) as bigint) as email, cast(sum(floor(l_quantity / 6)) as bigint) as phone, cast(least(100, sum(floor(l_quantity * 2))) as int) as score, max(l_shipdate) as created_at
from {lineitem} group by l_partkey, l_orderkey, l_suppkey % 25""",
    "outcomes": """
select o_custkey as plan_id, o_orderkey % 50 as variant_key, case when o_custkey % 2 = 0 then 'openai' else 'heuristic' end as provider, o_custkey % 25 as region_id, o_orderpriority like '1%' or o_orderpriority like '2%' as selected,
  o_orderpriority like '1%' as drafted, o_orderstatus = 'F' and o_orderpriority like '1%' as activated from {orders}""",
    "evals": "select d.doc_id as eval_id, d.source as provider, d.lang as model, case when l.doc_id is null then null else l.quality * 3 + l.toxic end as judgement, d.n_chars as size from {documents} d left join {labels} l on d.doc_id = l.doc_id",
    "audits": "select o_orderkey as audit_id, o_custkey % 4 as policy, case o_orderstatus when 'F' then 'suggestion' when 'O' then 'manual' else 'rollback' end as change_kind, o_orderdate as changed_at, case when o_orderkey % 3 = 0 then 'improved' when o_orderkey % 3 = 1 then 'degraded' else 'neutral' end as outcome, cast(o_orderkey % 21 - 10 as int) as delta from {orders} where o_orderkey % 37 = 0",
    "places": """
select s_suppkey as seq, concat(' ', case when s_suppkey % 9 = 0 then '' else s_name end) as name, case when s_suppkey % 6 = 0 then null else concat('kw', cast(s_suppkey % 7 as string)) end as keyword,
  case when s_suppkey % 10 = 0 then '' else concat('pid', cast(s_suppkey % 60 as string)) end as place_id, concat('shop', cast((s_suppkey * 4) % 400 as string), '.example.com') as website, concat('1,', lpad(cast(s_suppkey as string), 3, '0'), '.5') as reviews,
  concat('+66', lpad(cast(s_suppkey % 700 as string), 9, '0')) as phone, cast(s_nationkey as bigint) as region_id from {supplier}""",
    "crawled": """
select event_id as page_id, event_id % 97 as site_id, concat('https://site', cast(event_id % 97 as string), '.example.com/p', cast(event_id as string)) as url, case event_id % 97 % 6 when 0 then 'blocked_by_robots' when 1 then 'failed' when 2 then 'robots_bypassed' else 'completed' end as crawl_status,
  cast(case event_id % 23 when 0 then 403 when 1 then 503 when 2 then 404 when 3 then 502 when 4 then null when 5 then 521 when 6 then 401 else 200 end as int) as status_code,
  case when event_id % 97 % 5 = 0 then null when event_id % 31 = 0 then 'anti_bot_challenge' when event_id % 29 = 0 then 'js_shell' when event_id % 19 = 0 then 'cross_domain_redirect_after_ssl_fallback' end as error,
  event_id % 97 % 4 = 1 and event_id % 3 = 0 as has_contact, event_id % 4 = 0 as has_social, cast(event_id % 400 as int) as text_length, event_id % 13 = 0 as tried_headers,
  case event_id % 17 when 0 then 'Attention Required' when 1 then 'Just a moment' else 'Shop' end as title,
  concat('Call us: ', lpad('', cast(event_id % 60 as int), '.'), ' +66 81 234 5678 ', lpad('', cast(event_id % 50 as int), '.'), case event_id % 9 when 0 then ' phone' when 1 then ' captcha' when 2 then ' NO_HOST_CONNECTION' when 3 then ' whatsapp' else ' end' end) as body,
  case event_id % 8 when 0 then 'No_Host Connection' when 1 then 'Bad Gateway' else 'OK' end as reason,
  case event_id % 10 when 0 then 'Tunnel connection failed: 407' when 1 then 'timed out' when 2 then 'cannot reach Relay3.example.net' when 3 then 'No route to host' when 4 then 'getaddrinfo failed' else 'read error' end as message,
  case when event_id % 2 = 0 then 'relay3.example.net' else '' end as relay_host, concat(case event_id % 4 when 0 then 'info@' when 1 then 'me@www.' else 'x@' end, case event_id % 5 when 0 then 'gmail.com' when 1 then 'site1.example.com' when 2 then 'example.com' when 3 then 'other.org' else 'mail.site4.example.com' end) as asset_email,
  concat('site', cast(event_id % 7 as string), '.example.com') as host, case event_id % 5 when 0 then 'https://wa.me/66812345678' when 1 then 'https://api.whatsapp.com/send?phone=+66 81-234-5678&text=hi' when 2 then 'https://t.me/Some_Shop/' when 3 then '@Handle' else 'https://wa.me/message' end as href, ts as crawled_at from {events}""",
    "recipes": "select p_partkey as recipe_id, concat('recipe-', cast(p_partkey % 40 as string)) as slug, p_brand as category, cast(p_partkey % 5 + 1 as int) as version, case p_size % 5 when 0 then 'draft' when 1 then 'candidate' when 2 then 'validated' when 3 then 'active' else 'deprecated' end as status, p_size % 7 <> 0 as lint_passed, p_size % 3 <> 0 as gate_passed, case p_partkey % 4 when 0 then 'active' when 1 then 'candidate' when 2 then 'deleted' else 'deprecated' end as target, p_type as tags, p_partkey % 30 as template_key, p_partkey as seq from {part}",
    "replies": "select event_id as id, cast(case event_id % 11 when 0 then 250 when 1 then 251 when 2 then 550 when 3 then 252 when 4 then 421 when 5 then 499 when 6 then 500 when 7 then 554 when 8 then 450 when 9 then 220 else 451 end as int) as code, case event_id % 7 when 0 then 'Greylisted, try again' when 1 then 'OK' when 2 then null when 3 then 'Temporarily rejected' else 'user unknown' end as message from {events}",
    "prompts": "select p_partkey as prompt_id, concat(case p_partkey % 6 when 0 then 'Rent a car in ' when 1 then 'Best nails & lashes in ' when 2 then 'Complete wellness experience - ' when 3 then 'Lawyers/real estate agencies of ' when 4 then 'ATV tours, scuba courses in ' else 'the local bakeries for ' end, p_type) as prompt from {part}",
}

#: Region codes of the dialled numbers' countries, by nation.
DIALLED = ("DZ", "AR", "BR", "CA", "EG", "ET", "FR", "DE", "IN", "ID", "IR", "IQ", "JP", "JO", "KE", "MA", "MZ", "PE", "CN", "RO", "SA", "VN", "RU", "GB", "US")
_PLAN = {c.region: c for c in read_plan()}
_BY_NATION = lambda f: "case c_nationkey " + " ".join(f"when {n} then '{f(_PLAN[r])}'" for n, r in enumerate(DIALLED)) + " end"
VIEWS |= {
    "dialled": f"""
select number_id, case when number_id % 17 = 0 then null else region end as region, case number_id % 11 when 0 then concat('+', code, ' ', national) when 1 then concat(trunk, substr(national, 1, 3), '-', substr(national, 4))
  when 2 then concat(idd, ' ', code, ' ', national) when 3 then concat('+', code, ' (', trunk, ') ', national) when 4 then national when 5 then concat('Tel: ', trunk, national, ' ext 12') when 6 then concat('www.example.com/', national)
  when 7 then concat('open 10:30 ', national) when 8 then concat(code, national) when 9 then concat('00', code, '.', national) else concat(trunk, '/', substr(national, 1, 2), ' ', substr(national, 3, 3)) end as dialled
from (select c_custkey as number_id, {_BY_NATION(lambda c: c.region)} as region, {_BY_NATION(lambda c: c.code)} as code, {_BY_NATION(lambda c: c.idd)} as idd, {_BY_NATION(lambda c: c.trunk)} as trunk,
  substr(concat(cast(2 + c_custkey % 7 as string), lpad(cast((c_custkey * 104729 + 7) % 10000000000 as string), 10, '3')), 1, cast({_BY_NATION(lambda c: c.most)} as int)) as national from {{customer}})""",
    "company_events": """
select case when l_orderkey % 3 = 0 then 0 else l_orderkey % 200 end as run_id, l_suppkey as company_id, l_orderkey * 8 + l_linenumber as seq, l_shipdate as at,
  case (l_partkey + l_linenumber) % 7 when 0 then 'queue' when 1 then 'start' when 2 then 'finish' when 3 then 'retry' when 4 then 'requeue' when 5 then 'queue' else 'start' end as kind,
  case when (l_partkey + l_linenumber) % 7 = 2 then case l_partkey % 3 when 0 then 'completed' when 1 then 'failed' else 'skipped' end end as status,
  case when (l_partkey + l_linenumber) % 7 in (2, 4) and l_quantity > 25 then concat('error ', cast(l_partkey % 9 as string)) end as error from {lineitem}""",
    "run_events": """
select case when o_orderkey % 3 = 0 then 0 else o_orderkey % 200 end as run_id, o_orderkey * 8 as seq, o_orderdate as at, 'close' as kind, case o_orderstatus when 'F' then 'failed' else 'skipped' end as status,
  'Closed with its run.' as error from {orders} where o_orderkey % 211 = 0""",
    "lookups": """
select event_id as lookup_id, case when event_id % 3 = 0 then 'hot@example.com' when event_id % 29 = 1 then null else concat('user', cast(user_id as string), '@example.com') end as email, ts as at,
  event_type in ('signup', 'purchase') as stores, case event_type when 'signup' then 'valid' else 'risky' end as verdict, cast(floor(value) as int) as score, case when event_id % 2 = 0 then 6 * 3600 else 24 * 3600 end as ttl from {events}""",
    "job_events": """
select case when user_id % 3 = 0 then 'job-hot' else concat('job-', cast(user_id % 40 as string)) end as job_id, event_id as seq, case event_type when 'purchase' then 'start' when 'signup' then 'keyword' else 'result' end as kind,
  case when event_type = 'purchase' then cast(user_id % 50 as bigint) end as n, concat('place ', cast(event_id as string)) as result from {events}""",
}

_BRAND, _LAST = "replace(lower(p_brand), '#', '_')", "split_part(p_name, ' ', 2)"
VIEWS |= {
    "asks": """
select l_orderkey * 8 + l_linenumber as prompt_id, case when l_orderkey % 97 = 0 then null when l_orderkey % 101 = 0 then ' the best, of & in ' else concat(case l_orderkey % 9 when 0 then 'Best ' when 1 then 'luxury ' when 2 then 'Wellness & ' when 3 then 'a full '
  when 4 then 'Rent a car/' when 5 then 'other ' when 6 then 'service for ' else '' end, case when l_orderkey % 13 = 0 then 'zebra' else p_name end, case l_suppkey % 7 when 0 then 's ' else ' ' end, lower(p_type),
  case l_linenumber % 6 when 0 then ' in Chiang Mai' when 1 then ' bangkok studio' when 2 then '-agency berlin' when 3 then ' activity' when 4 then ' platelets' else '' end) end as prompt from {lineitem} join {part} on l_partkey = p_partkey""",
    "hints": f"""
select distinct 'goods' as vertical, {_BRAND} as cluster, case length(p_brand) % 2 when 0 then p_name else concat({_LAST}, 's') end as alias from {{part}} where (length(p_name) * 7 + cast(split_part(p_brand, '#', 2) as int)) % 5 = 0
union all select distinct 'fleet', {_BRAND}, 'car hire' from {{part}} where p_brand like '%4' union all select distinct 'fleet', {_BRAND}, 'rent a car' from {{part}} where p_brand like '%4'""",
    "templates": f"""
select {_BRAND} as cluster, replace(p_name, ' ', '-') as template_key, concat('Shop of ', p_name) as label, 'goods' as vertical, case max(p_size) % 3 when 0 then replace(p_name, ' ', '-') when 1 then {_LAST} else 'other' end as sub_intent,
  case sum(p_partkey) % 4 when 0 then 'browser' when 1 then 'website' when 2 then 'hybrid' else 'map' end as strategy, cast(40 + max(p_size) % 20 as int) as priority,
  split(concat(p_name, ',', {_LAST}, 's,', min(lower(p_type)), ',lat,,', {_LAST}, ' ', split_part(p_name, ' ', 1)), ',') as aliases, split(concat(p_name, ',buy ', p_name, ',', {_LAST}, ',', p_name, ',', min(lower(p_type))), ',') as search_terms,
  split(concat('contact,', {_LAST}, ',contact'), ',') as website_keywords, case when max(p_size) % 5 = 0 then split('en,es,en', ',') end as language_hints from {{part}} where p_brand not like '%5' group by p_brand, p_name""",
}
VIEWS |= {
    "plan_requests": """
select event_id as request_id, timestamp '2024-01-01 00:00:00' + (event_id * 7 % 86400) * interval '1' second as at, case when event_id % 3 = 0 then 'Small ring shop' when event_id % 53 = 1 then null when event_id % 59 = 1 then 'the &' when event_id % 61 = 1 then '  ' else concat(
  case user_id % 5 when 0 then 'Best ' when 1 then 'luxury ' when 2 then 'rent a car ' else '' end, case user_id % 8 when 0 then 'small' when 1 then 'red' when 2 then 'blue' when 3 then 'hot' when 4 then 'old' when 5 then 'large' when 6 then 'cold' else 'new' end, ' ',
  case event_id % 8 when 0 then 'ring' when 1 then 'widget' when 2 then 'bolts' when 3 then 'gear' when 4 then 'gizmo' when 5 then 'plate' when 6 then 'anvil' else 'zebra' end, case when event_id % 4 = 1 then ' in Phuket' else '' end) end as prompt,
  case event_id % 7 when 0 then 'openai' when 1 then ' OpenAI ' when 2 then '' when 3 then null when 4 then 'claude' when 5 then 'heuristic' else 'openai' end as provider,
  case user_id % 10 when 0 then null when 1 then '{{"cluster_choice": ' when 2 then '[1, 2]' when 3 then '{{"cluster_choice": {{"vertical": "goods", "cluster_slug": 7}}, "variants": []}}' when 4 then '{{"cluster_choice": {{"vertical": "goods", "cluster_slug": "brand_2"}}, "variants": [{{"label": "x"}}, {{"variant_key": "k", "source_strategy": "by_foot"}}]}}'
    when 5 then concat('{{"cluster_choice": {{"vertical": "goods", "cluster_slug": " brand_3 "}}, "default_variant_key": "b", "extra": [], "variants": [{{"variant_key": "a", "label": "A", "source_strategy": "WEBSITE_FIRST", "fit_score": ', cast(event_id % 300 - 50 as string), '}}, {{"variant_key": "b", "source_strategy": "hybrid_discovery", "template_score": "41", "prompt_match_score": 12.9}}]}}')
    else '{{"cluster_choice": {{"vertical": "goods", "cluster_slug": "brand_4"}}, "default_variant_key": "gone", "variants": [{{"template_key": "big-shop", "source_strategy": "overpass_discovery_enrich", "fit_score": true}}, {{"variant_key": "big-shop", "source_strategy": "website_first"}}, {{"variant_key": "c", "source_strategy": "directory_expansion", "fit_score": "88"}}]}}' end as answer
from {events}""",
}

#: Pages with what trips up patterns: a ">" in quotes, comments, raw text, entities, unquoted and upper-case names, links up and down.
VIEWS |= {
    "shop_pages": """
select event_id as page_id, concat('https://www.site', cast(event_id % 97 as string), '.example.com/a/b/p', cast(event_id as string), '?ref=1') as url,
  case event_id % 12 when 0 then '../x' when 1 then './y/' when 2 then '../../../z?q=../1' when 3 then 'c/./d/../e' when 4 then '/r/../s/..' when 5 then '//other.example.org/../k' when 6 then '?p=2' when 7 then '#top' when 8 then 'https:deep/../flat' when 9 then 'mailto:a@b.example.org' when 10 then '..' else 'contact/.' end as href,
  concat('<!doctype html><TITLE> Shop &amp; ', cast(event_id % 50 as string), ' </TITLE><!-- <a href="/no">no@no.example.org</a> > --><script src="', case event_id % 5 when 0 then '/static/app.js?v=1' when 1 then 'lib/../main.mjs' when 2 then 'https://cdn.example.net/x.js'
    when 3 then concat('https://Site', cast(event_id % 97 as string), '.example.com/S.JS') else '/favicon.ico' end, '">var t = "<a href=no>";</script><script SRC=/static/b', cast(event_id % 3 as string), '.js></script><link rel="stylesheet" href="/theme.css"><link rel="icon" href="/i.css"><p title="a > b">Caf&eacute; &lt;',
    cast(event_id % 9 as string), '&gt; &#x41;</p><script src="/static/c.js" defer></script><noscript><a href="/hidden">x</a></noscript><a class=go title="3 > 2" href="', case event_id % 12 when 0 then '../x' when 1 then './y/' when 2 then '../../../z?q=../1' when 3 then 'c/./d/../e' when 4 then '/r/../s/..'
    when 5 then '//other.example.org/../k' when 6 then '?p=2' when 7 then '#top' when 8 then 'https:deep/../flat' when 9 then 'mailto:a@b.example.org' when 10 then '..' else 'contact/.' end, '">Go&nbsp;', cast(event_id % 5 as string), '</a><script src="/static/c.js"></script><a href="mailto:Owner', cast(event_id % 11 as string),
    '&#64;shop.example.com">m</a>', case when event_id % 4 = 0 then '<script src="/static/d.js"></script>' else '' end, case when event_id % 6 = 0 then '<a href="/unfinished' else '' end) as html from {events}""",
    "asset_fetches": """
select concat('https://www.site', cast(user_id % 97 as string), '.example.com', case event_id % 7 when 0 then '/static/app.js?v=1' when 1 then '/a/b/main.mjs' when 2 then '/static/b1.js' when 3 then '/static/c.js' when 4 then '/static/d.js' when 5 then '/theme.css' else '/static/b2.js' end) as asset_url,
  timestamp '2024-01-01 00:00:00' + event_id * interval '1' second as fetched_at, cast(case user_id % 9 when 0 then 404 when 1 then null else 200 end as int) as status_code, case event_id % 8 when 0 then 'image/png' when 1 then null when 2 then 'Text/CSS' else 'application/javascript; charset=utf-8' end as content_type,
  concat('var owner="Info', cast(event_id % 20 as string), '&#64;Site', cast(user_id % 97 as string), '.example.com"; // x', cast(event_id % 3 as string), '@gmail.com, other@else.org, test@gmail.com') as body from {events}""",
}

#: Subdivisions in chains of up to 16, with parents that are unknown, themselves, or each other; and addresses with one fault or strange name each.
VIEWS |= {
    "divisions": """
select concat(n_cc, '-', cast(q as string)) as code, concat('Area ', cast(q as string)) as name, n_cc as country_code,
  case when q % 16 = 0 then null when q % 40 = 11 then concat(n_cc, '-lost') when q % 40 = 13 then concat(n_cc, '-', cast(q as string)) when q % 40 = 7 then concat(n_cc, '-', cast(q + 1 as string)) when q % 5 = 2 then '' else concat(n_cc, '-', cast(q - 1 as string)) end as parent_code
from (select o_custkey, upper(substr(n_name, 1, 2)) as n_cc, cast(floor(o_orderkey / 25) as bigint) as q from {orders} join {nation} on o_orderkey % 25 = n_nationkey)""",
    "countries": "select upper(substr(n_name, 1, 2)) as code, n_name as name from {nation} where n_nationkey <> 3",
    "raw_addresses": """
select c_custkey as email_id, case c_custkey % 29 when 0 then null when 1 then '   ' when 2 then 'no-at.example.com' when 3 then 'a@@b.org' when 4 then 'a b@c.org' when 5 then '.a@b.org' when 6 then 'a.@b.org' when 7 then 'a..b@c.org' when 8 then 'a(b@c.org' when 9 then 'a@[127.0.0.1]'
  when 10 then 'a@.b.org' when 11 then 'a@b.org.' when 12 then 'a@b_c.org' when 13 then 'a@-b.org' when 14 then 'a@b-.org' when 15 then 'a@ab--c.org' when 16 then 'a@localhost' when 17 then 'a@b.123' when 18 then 'a@shop.test' when 19 then concat(lpad('', 65, 'a'), '@b.org')
  when 20 then concat('a@', lpad('', 64, 'b'), '.org') when 21 then concat(' Info', cast(c_custkey as string), '@BÜCHER.Example ') when 22 then 'Ünal@xn--bcher-kva.example' when 23 then 'a@例え。テスト' when 24 then 'a@straße.de' when 25 then 'a@b☃.org' when 26 then 'a@xn--zz.org'
  when 27 then concat('User+', cast(c_custkey % 50 as string), '@Mail.Example.CO.UK') else concat('u', cast(c_custkey as string), '@my-company.io') end as email from {customer}""",
}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def ctes(*names: str) -> str:
    """``with`` clause of views for the oracle."""
    return "with recursive " + ", ".join(f"v_{n} as ({VIEWS[n].format(**{t: t for t in tables_of(VIEWS[n])})})" for n in names) + " "
