"""Registered queries over pages read by the tokenizer, international addresses and the region catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import addresses, markup, urls
from brindle.operators import assets, regions
from brindle.plans.catalog import query

c = F.col


@query(
    "s08_page_parts", "shop_pages",
    sql="""select page_id, 'Shop & ' || page_id % 50 as title, 'Shop & ' || page_id % 50 || ' Café <' || page_id % 9 || '> A Go' || chr(160) || page_id % 5 || ' m' as text, '/hidden|' || href || '|mailto:Owner' || page_id % 11 || '@shop.example.com' as hrefs,
  case when page_id % 12 = 9 then 'a@b.example.org,' else '' end || 'owner' || page_id % 11 || '@shop.example.com' as emails from v_shop_pages""",
)
def page_parts(p: DataFrame) -> DataFrame:
    """Title, visible text, link targets and addresses of each page."""
    parts = p.select("page_id", markup.page_parts(c("html")).alias("p"))
    return parts.select("page_id", "p.title", "p.text", F.array_join(F.transform("p.links", lambda a: a["href"]), "|").alias("hrefs"), F.array_join(markup.page_emails(c("p")), ",").alias("emails"))


# A link's path after its page's folder (or from the root), folded over its segments as a list of lists.
_SEGMENTS = "string_split(case when p like '/%' then p else regexp_extract(b, '^(.*/)', 1) || p end, '/')[2:]"
_FOLD = "list_reduce(list_prepend([''], list_transform(segs, lambda s: [s])), lambda acc, x: case when x[1] = '.' then acc when x[1] = '..' then case when len(acc) > 1 then acc[:len(acc) - 1] else acc end else list_concat(acc, x) end)"


@query(
    "s05_link_targets", "shop_pages",
    sql=f"""select page_id, case when href like 'mailto:%' then href when href like '//%' then 'https:' || href when p = '' then root || b || case when href like '?%' then href else '?ref=1' || href end
  else root || coalesce(nullif(array_to_string({_FOLD}, '/') || case when segs[-1] in ('.', '..') then '/' else '' end, ''), '/') || regexp_extract(href, '(\\?.*)$', 1) end as target
  from (select *, {_SEGMENTS} as segs from (select page_id, href, regexp_extract(url, '^https://[^/]*', 0) as root, regexp_extract(url, '^https://[^/]*([^?]*)', 1) as b, regexp_extract(regexp_replace(href, '^https:', ''), '^([^?#]*)', 1) as p from v_shop_pages))""",
)
def link_targets(p: DataFrame) -> DataFrame:
    return p.select("page_id", urls.absolute_url(c("url"), c("href")).alias("target"))


_ROOT = "'https://www.site' || page_id % 97 || '.example.com'"


@query(
    "src09_asset_emails", "shop_pages", "asset_fetches",
    sql=f"""select page_id, max(n) as n_assets, count(emails) as n_read, coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_filter(emails, lambda e: e like '%@gmail.com' or e like '%@site' || page_id % 97 || '.example.com'))))), ','), '') as emails from (select page_id, unnest(ours) as asset_url, len(ours) as n from (select page_id,
  list_concat(case page_id % 5 when 0 then [{_ROOT} || '/static/app.js?v=1'] when 1 then [{_ROOT} || '/a/b/main.mjs'] when 3 then ['https://Site' || page_id % 97 || '.example.com/S.JS'] else [] end, [{_ROOT} || '/static/b' || page_id % 3 || '.js', {_ROOT} || '/static/c.js'],
    case when page_id % 4 = 0 then [{_ROOT} || '/static/d.js'] else [] end, [{_ROOT} || '/theme.css'])[:4] as ours from v_shop_pages)) left join (
  select asset_url, list_filter(regexp_extract_all(replace(lower(body), '&#64;', '@'), '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}'), lambda e: e not like 'test@%') as emails from (select * from v_asset_fetches qualify row_number() over (partition by asset_url order by fetched_at desc) = 1)
  where status_code < 400 and regexp_matches(lower(content_type), 'javascript|json|css|text')) using (asset_url) group by page_id""",
)
def asset_emails(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """Addresses in the first four assets of each page's own host, out of the newest fetch of each."""
    found = assets.asset_emails(pages.select("page_id", "url", F.struct(markup.page_assets(c("html")).alias("assets")).alias("parts")), fetches)
    return found.select("page_id", "n_assets", "n_read", F.array_join("emails", ",").alias("emails"))


# --- S-25: the outcome of each made address
_FAULTS = {
    0: "Email must be a string", 1: "Email is empty", 2: "Invalid email format", 3: "Invalid email format", 4: "Invalid email format", 5: "The address starts with a dot.", 6: "A dot stands right before the @.", 7: "Two dots stand in a row.",
    8: "The part before the @ holds an invalid character.", 9: "A bracketed host is not allowed.", 10: "A dot stands right after the @.", 11: "The address ends with a dot.", 12: "The domain holds a character that names do not allow.",
    13: "A label of the domain starts or ends with a hyphen.", 14: "A label of the domain starts or ends with a hyphen.", 15: "Two hyphens stand third and fourth in a label.", 16: "The domain has no dot.", 17: "The domain ends in no top-level name.",
    18: "The domain is a reserved name.", 19: "Invalid email format", 20: "A label of the domain has over 63 characters.", 25: "The domain holds a character that names do not allow.", 26: "The domain holds a character that names do not allow.",
}
_MADE = """case email_id % 29 when 21 then 'info' || email_id || '@bücher.example' when 22 then 'ünal@bücher.example' when 23 then 'a@例え.テスト' when 24 then 'a@straße.de' when 27 then 'user+' || email_id % 50 || '@mail.example.co.uk' when 28 then 'u' || email_id || '@my-company.io' end"""
_ASCII = "case email_id % 29 when 21 then 'xn--bcher-kva.example' when 22 then 'xn--bcher-kva.example' when 23 then 'xn--r8jz45g.xn--zckzah' when 24 then 'xn--strae-oqa.de' when 27 then 'mail.example.co.uk' when 28 then 'my-company.io' end"


@query(
    "s25_addresses", "raw_addresses",
    sql=f"select email_id, error is null as valid, normalized, split_part(normalized, '@', 1) as local, split_part(normalized, '@', 2) as domain, ascii_domain, error from (select email_id, {_MADE} as normalized, {_ASCII} as ascii_domain, case email_id % 29 "
    + " ".join(f"when {k} then '{v}'" for k, v in _FAULTS.items()) + " end as error from v_raw_addresses)",
)
def read_addresses(emails: DataFrame) -> DataFrame:
    return emails.select("email_id", addresses.read_address(c("email")).alias("a")).select("email_id", "a.*")


# --- SRC-12
_ONE = "one as (select code, min(nullif(parent_code, '')) as parent_code, min(country_code) as country_code, min(name) as name from v_divisions group by code)"


@query(
    "src12_region_catalog", "countries", "divisions",
    sql=f""", {_ONE} select *, country_code <> 'AR' as is_active from (select code, min(name) as name, code as country_code, 2 as level from v_countries group by code union all
  select o.code, o.name || ' [' || o.code || '], ' || k.name, o.country_code, 4 from one o join (select code, min(name) as name from v_countries group by code) k on k.code = o.country_code where parent_code is null)""",
)
def region_catalog(known: DataFrame, divisions: DataFrame) -> DataFrame:
    """Countries and their top-level subdivisions; one country is not active."""
    return regions.region_catalog(known, divisions, c("country_code") != "AR")


@query(
    "src12_region_tree", "divisions",
    sql=f""", {_ONE}, climb as (select code, code as root, 0 as depth, 'ok' as state from one where parent_code is null
  union all select code, code, 0, 'unknown parent' from one where parent_code not in (select code from one) union all select o.code, t.root, t.depth + 1, t.state from climb t join one o on o.parent_code = t.code)
  select o.code, case when state = 'ok' then root end as root, case when state = 'ok' then depth end as depth, coalesce(state, 'cycle') as state from one o left join climb using (code)""",
)
def region_tree(divisions: DataFrame) -> DataFrame:
    """Root and depth of each subdivision, or why it has none."""
    return regions.region_tree(divisions)
