"""Registered queries over numbering plans, written tables, event logs, caches and job progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbering import read_numbers, read_plan
from brindle.operators import ingestion, lookups, states
from brindle.operators.tables import KeyedTable, in_batches
from brindle.plans.catalog import _website_key, query
from brindle.storage import new_folder
from brindle.streaming.progress import job_progress_state

c = F.col

# --- S-19, S-18: numbers by numbering plan
_ROWS = ", ".join(f"('{p.region}', '{p.code}', '{p.idd}', '{p.trunk}', {p.least}, {p.most})" for p in read_plan())


def _nat(n: str, p: str) -> str:
    """National number ``n`` under plan row ``p``, or null."""
    bare = f"substr({n}, length({p}.trunk) + 1)"
    drops = f"{p}.trunk <> '' and starts_with({n}, {p}.trunk) and (starts_with({p}.trunk, '0') or (length({n}) not between {p}.least and {p}.most and length({bare}) between {p}.least and {p}.most))"
    cut = f"case when {drops} then {bare} else {n} end"
    return f"case when length({cut}) between {p}.least and {p}.most then {cut} end"


query(
    "s19_plan_numbers", "dialled",
    sql=rf""", plan as (select * from (values {_ROWS}) t(region, code, idd, trunk, least, most)),
codes as (select distinct on (code) code, trunk, least, most from plan order by code, region),
d as (select number_id, region, t, regexp_replace(t, '\D', '', 'g') as digits, regexp_matches(t, '^[^0-9+]*[+]') as plus,
      contains(lower(t), 'www.') or contains(t, '://') or length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 3 or length(t) > 64 or regexp_matches(t, '\b\d{{1,2}}[.:]\d{{2}}\b') as bad
      from (select number_id, region, trim(regexp_replace(regexp_replace(dialled, '(?i)(ext|extension|x)\s*\d+$', ''), '(?i)[\s,;]*(ext(ension)?[.]?|#)[:=\s]*\d{{1,7}}$', '')) as t from v_dialled)),
full_digits as (select d.*, case when plus then digits when starts_with(digits, own.idd) then substr(digits, length(own.idd) + 1) end as abroad from d left join plan own on own.region = d.region),
tried as (select f.*, '+' || codes.code || {_nat("substr(abroad, length(codes.code) + 1)", "codes")} as by_code, '+' || own.code || {_nat("digits", "own")} as within,
      case when starts_with(digits, own.code) then '+' || own.code || {_nat("substr(digits, length(own.code) + 1)", "own")} end as coded
      from full_digits f left join codes on starts_with(f.abroad, codes.code) left join plan own on own.region = f.region)
select number_id, case when not bad then coalesce(by_code, case when not plus then coalesce(within, coded) end, case when length(digits) between 9 and 15 then '+' || regexp_replace(digits, '^00', '') end) end as phone from tried""",
)(lambda d: read_numbers(d, "dialled", "region").select("number_id", "phone"))

# --- U-10, U-22, SNK-04, SNK-07: written tables
_BATCHES = 3


def _table(df: DataFrame, name: str, schema: str, keys: list[str]) -> KeyedTable:
    return KeyedTable(df.sparkSession, new_folder(df.sparkSession, name), schema, keys)


def source_links(places: DataFrame, companies: DataFrame, phones: DataFrame) -> DataFrame:
    """The place rows as three batches, each given twice; the links that they leave."""
    records = places.select("seq", F.concat(F.lit("pid"), c("seq").cast("string")).alias("external_id"), F.btrim("name").alias("name"), "website", "phone", "region_id")
    keyed = companies.withColumn("company_key", c("company_id").cast("string"))
    links = keyed.where("company_id % 50 = 1").select(F.concat(F.lit("pid"), c("company_key")).alias("external_id"), "company_key")
    numbers = phones.select(c("company_id").cast("string").alias("company_key"), "phone")
    created, linked = _table(places, "created", ingestion.COMPANIES, ["company_key"]), _table(places, "links", ingestion.LINKS, ["source", "external_id"])
    for b, batch in enumerate(in_batches(records, c("seq"), _BATCHES)):
        for _ in range(2):
            ingestion.materialize_sources(batch, "maps", keyed, numbers, links, created, linked, b)
    return linked.read()


_PLACE_KEY = f"concat_ws('/', s.region_id, {_website_key('s.website')})"
query(
    "u10_source_links", "places", "companies", "phones",
    sql=f""", base as (select s.*, seq % {_BATCHES} as batch, {_PLACE_KEY} as gkey, coalesce(l.company_id, w.company_id, p.company_id) as known,
  case when l.company_id is not null then 'link' when w.company_id is not null then 'website' when p.company_id is not null then 'phone' else 'new' end as how from v_places s
  left join (select 'pid' || company_id as external_id, company_id::varchar as company_id from v_companies where company_id % 50 = 1) l on l.external_id = 'pid' || s.seq
  left join (select region_id, {_website_key('website_url')} as key, min(company_id::varchar) as company_id from v_companies group by 1, 2) w on w.key = {_website_key('s.website')} and w.region_id = s.region_id
  left join (select region_id, phone, min(company_id::varchar) as company_id from v_phones join v_companies using (company_id) group by 1, 2) p on p.phone = s.phone and p.region_id = s.region_id),
made as (select gkey, batch as made_in, seq as maker from base where how = 'new' qualify row_number() over (partition by gkey order by batch, seq) = 1),
joined as (select b.*, made_in, maker, how in ('phone', 'new') and made_in < batch as finds, how = 'new' and made_in = batch as same from base b left join made using (gkey))
select 'maps' as source, 'pid' || seq as external_id, case when finds or same then 'maps/pid' || maker else known end as company_key, case when same and maker = seq then 'merged' else 'matched' end as merge_status,
  case when finds or (same and maker <> seq) then 'website' when same then 'new' else how end as matched_by, batch::int as first_batch from joined""",
)(source_links)


def written_runs(runs: DataFrame) -> DataFrame:
    """Runs created, some updated, some cancelled, as four numbered batches of which one is given again."""
    table = _table(runs, "runs", "run_id bigint, region_id bigint, status string, cost double", ["run_id"])
    rows = runs.select("run_id", c("region_id").cast("long").alias("region_id"), F.lit("pending").alias("status"), "cost")
    table.insert(rows, [c("run_id")], writer="api", batch=0)
    changes = runs.where("status <> 'pending'").select("run_id", "status")
    table.upsert(changes, writer="api", batch=1)
    table.insert(rows, [c("run_id")], writer="api", batch=0)  # a repeat after a lost answer
    table.delete(runs.where("run_id % 10 = 0").select("run_id"), writer="api", batch=2)
    table.upsert(rows.where("run_id % 20 = 0").withColumn("status", F.lit("restored")), writer="api", batch=3)
    return table.read()


query("u22_written_runs", "runs", sql="select run_id, region_id::bigint as region_id, case when run_id % 20 = 0 then 'restored' else status end as status, cost from v_runs where run_id % 10 <> 0 or run_id % 20 = 0")(written_runs)


def written_requests(requests: DataFrame) -> DataFrame:
    """The request log as a table by id, with the log's widths; two batches, the second of which overlaps the first."""
    rows = requests.select("id", "provider", F.substring("url", 1, 500).alias("url"), F.substring("error", 1, 2000).alias("error"), "duration_ms")
    table = _table(requests, "requests", rows.schema.simpleString()[7:-1].replace(":", " "), ["id"])
    table.insert(rows.where("id % 3 <> 0"), [c("id")], writer="log", batch=0)
    table.insert(rows.where("id % 3 <> 1").withColumn("duration_ms", c("duration_ms") + 1), [c("id")], writer="log", batch=1)
    return table.read()


query("snk04_written_requests", "requests", sql="select id, provider, url[:500] as url, error[:2000] as error, duration_ms + case when id % 3 = 0 then 1 else 0 end as duration_ms from v_requests")(written_requests)

# --- ST-03, U-21, ST-15: states from an event log
_LOG = """log as (select * from v_company_events union all select r.run_id, company_id, seq, r."at", kind, status, error from (select distinct run_id, company_id from v_company_events) join v_run_events r using (run_id))"""
_FOLD = f""", {_LOG},
e as (select *, row_number() over (partition by run_id, company_id order by "at", seq) as n from log),
f as (select distinct run_id, company_id, 0::bigint as n, 'absent' as status, 0::bigint as retries, null::timestamp as started, null::timestamp as finished, null::varchar as error from log
  union all select run_id, company_id, e.n,
    case when skip then f.status when kind in ('queue', 'requeue') then 'queued' when kind = 'start' then 'running' when kind = 'retry' then case f.status when 'absent' then 'queued' else f.status end else e.status end,
    case when skip then retries when kind = 'queue' then 0 when kind = 'retry' then retries + 1 else retries end,
    case when skip or kind in ('retry', 'finish', 'close') then started when kind = 'start' then "at" end,
    case when skip or kind = 'retry' then finished when kind in ('finish', 'close') then "at" end,
    case when skip or kind = 'retry' then f.error when kind in ('requeue', 'finish', 'close') then e.error end
  from f join e using (run_id, company_id), lateral (select (kind = 'queue' and f.status in ('queued', 'running', 'completed')) or (kind = 'close' and f.status not in ('queued', 'running')) as skip) where e.n = f.n + 1),
final as (select * from f where status <> 'absent' qualify row_number() over (partition by run_id, company_id order by n desc) = 1)"""


def _states(log: DataFrame, run_events: DataFrame) -> DataFrame:
    return states.company_states(states.with_run_events(log, run_events, "run_id", "company_id"), ["run_id", "company_id"], ["at", "seq"])


query("st03_company_states", "company_events", "run_events", sql=_FOLD + "select run_id, company_id, status, retries as retry_count, started as started_at, finished as finished_at, error as last_error from final")(_states)
_AS_OF = "1998-01-01 00:00:00"


def _outcomes(log: DataFrame, run_events: DataFrame) -> DataFrame:
    """Runs begin with their first event; every fifth has ended discovery, every seventh was asked to stop."""
    runs = log.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max("at").alias("last")).select("run_id", "started_at", F.when(c("run_id") % 5 == 0, c("last")).alias("finished_at"), (c("run_id") % 7 == 0).alias("cancel_requested"))
    return states.run_outcomes(_states(log, run_events), runs, "run_id", F.to_timestamp_ntz(F.lit(_AS_OF)))


query(
    "st04_run_outcomes", "company_events", "run_events",
    sql=_FOLD + f""", runs as (select run_id, min("at") as started_at, case when run_id % 5 = 0 then max("at") end as finished_at, run_id % 7 = 0 as cancel_requested from v_company_events group by run_id),
per as (select run_id, count(*) as companies, count(*) filter (status = 'completed') as completed, count(*) filter (status in ('queued', 'running')) as open from final group by run_id)
select run_id, coalesce(companies, 0) as companies, coalesce(completed, 0) as completed, coalesce(open, 0) as open, case when coalesce(open, 0) = 0 and (coalesce(companies, 0) > 0 or finished_at is not null) then case when cancel_requested then 'skipped' else 'completed' end
  when coalesce(open, 0) = 0 and started_at <= timestamp '{_AS_OF}' - interval 10 minute then 'failed' else 'open' end as outcome from runs left join per using (run_id)""",
)(_outcomes)

# --- ST-09, ST-10, P-10: lookups against a cache
query(
    "st09_cached_answers", "lookups",
    sql="""select lookup_id, hit, case when hit then floor(age)::bigint end as age_seconds, case when hit then verdict end as verdict, case when hit then score end as score from (
  select l.lookup_id, r.verdict, r.score, (epoch_us(l."at") - epoch_us(r."at")) / 1000000.0 as age, coalesce(epoch_us(l."at") - epoch_us(r."at") <= l.ttl::bigint * 1000000, false) as hit
  from (select * from v_lookups where not stores) l asof left join (select * from v_lookups where stores) r on l.email = r.email and l."at" >= r."at")""",
)(
    lambda v: lookups.cached_answers(v.where("not stores").select("lookup_id", "email", "at", "ttl"), v.where("stores"), "email", "at", ["lookup_id"], ["verdict", "score"], c("ttl")).select("lookup_id", "hit", "age_seconds", "verdict", "score")
)

# --- SNK-03, ST-12: progress of jobs
query(
    "snk03_job_progress", "job_events",
    sql="""select job_id, 'running' as status, count(*) filter (kind = 'result') as result_count, count(*) filter (kind = 'keyword') as completed, coalesce(max(n), 0) as total,
  coalesce(list_reverse(list(result order by seq desc) filter (kind = 'result'))[-5:], []) as latest from v_job_events group by job_id""",
)(job_progress_state)
