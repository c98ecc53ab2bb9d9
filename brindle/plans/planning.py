"""Registered queries over prompts, drafts and recorded planner answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import answers, prompts
from brindle.operators import drafts, planner
from brindle.operators.tables import KeyedTable
from brindle.plans.catalog import _normal_sql, query
from brindle.plans.extra import _ANY, _HINT, _LANG
from brindle.storage import materialize, new_folder

c = F.col
_ARRAYS = ("search_terms", "website_keywords", "language_hints", "fit_reasons")
_PLAIN = ("template_key", "cluster", "cluster_score", "vertical", "label", "sub_intent", "strategy", "template_score", "match_score", "fit_score", "slug")


def _norm(column: str) -> str:
    return _normal_sql().replace("trim(prompt)", f"trim({column})")


_HOLDS = "a <> '' and (contains(t, a) or len(list_filter(string_split(a, ' '), lambda w: not list_contains(toks, w))) = 0)"
_BONUS = f"case strategy when 'browser' then case when {_ANY(prompts.BROWSER_WORDS)} then 4 else 1 end when 'website' then case when {_ANY(prompts.WEBSITE_WORDS)} then 3 else 1 end when 'hybrid' then 2 else 0 end"
_SLUG = "substr(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 96)"
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_STRATEGY_REASON = f"case when strategy = 'browser' and {_ANY(prompts.BROWSER_WORDS)} then '{prompts.REASONS['browser']}' when strategy = 'website' and {_ANY(prompts.WEBSITE_WORDS)} then '{prompts.REASONS['website']}' when strategy = 'hybrid' then '{prompts.REASONS['hybrid']}' end"
# All pairs of texts and aliases, and of texts and the templates of their cluster.
DRAFTS_SQL = f""", n as (select prompt_id, {_normal_sql()} as t from v_asks), x as (select distinct t, string_split(t, ' ') as toks from n where t <> ''),
h as (select *, {_norm("alias")} as a from v_hints),
ranks as (select t, cluster, min(vertical) as vertical, cast(count(*) * 100 + max(length(alias)) as int) as score from x join h on {_HOLDS} group by t, cluster),
best as (select x.t, toks, coalesce(r.vertical, '{drafts.FALLBACK[0]}') as cluster_vertical, coalesce(cluster, '{drafts.FALLBACK[1]}') as cluster, coalesce(score, 0) as cluster_score from x
  left join (select * from ranks qualify row_number() over (partition by t order by score desc, cluster) = 1) r on r.t = x.t),
al as (select cluster, template_key, pos, alias, {_norm("alias")} as a from (select cluster, template_key, unnest(aliases) as alias, generate_subscripts(aliases, 1) as pos from v_templates)),
held as (select t, template_key, list(alias order by pos) as hits from best join al using (cluster) where {_HOLDS} group by t, template_key),
si as (select cluster, template_key, {_norm("replace(sub_intent, '-', ' ')")} as a from v_templates), named as (select t, template_key from best join si using (cluster) where {_HOLDS}),
s0 as (select b.t, b.cluster, b.cluster_score, v.* exclude (cluster), coalesce(hits, []) as hits, named.t is not null as named, {_HINT.replace("(t,", "(b.t,")} as place from best b join v_templates v on v.cluster = b.cluster
  left join held on held.t = b.t and held.template_key = v.template_key left join named on named.t = b.t and named.template_key = v.template_key),
s1 as (select *, cast(10 * len(hits) + case when named then 6 else 0 end + case when place is not null then 5 else 0 end + {_BONUS} as int) as match_score from s0),
s2 as (select *, priority + match_score as fit_score, row_number() over (partition by t order by priority + match_score desc, sub_intent, label, template_key) as rank from s1 qualify rank <= 6),
s3 as (select *, list_concat(case when place is not null then list_transform(search_terms[:3], lambda q: q || ' ' || place) else [] end, search_terms) as q0 from s2),
s4 as (select *, {_UNIQUE.format("q0")}[:8] as q1 from s3), s5 as (select *, list_concat(website_keywords, q1) as k0 from s4),
d as (select t, rank, template_key, cluster, cluster_score, vertical, label, sub_intent, strategy, priority as template_score, match_score, fit_score, {_SLUG.format("concat_ws(' ', template_key, place)")} as slug, array_to_string(q1, '|') as search_terms,
  array_to_string({_UNIQUE.format("k0")}[:10], '|') as website_keywords, case when len(language_hints) > 0 then array_to_string({_UNIQUE.format("language_hints")}, '|') else replace({_LANG}, ',', '|') end as language_hints,
  concat_ws('|', case when named then 'Prompt directly references the ''' || sub_intent || ''' sub-intent.' end, case when len(hits) > 0 then 'Matches intent terms: ' || array_to_string(hits[:3], ', ') || '.' else 'Added as a closely related variant inside the selected cluster.' end,
    case when place is not null then 'Localized search terms for ' || place || '.' end, {_STRATEGY_REASON}) as fit_reasons from s5
  union all select t, 1, {_SLUG.format("t")}, cluster, cluster_score, cluster_vertical, array_to_string(list_transform(toks[:8], lambda w: upper(w[1]) || w[2:]), ' '), 'broad-intent', 'hybrid', 50, 0, 50, {_SLUG.format("t")}, t, 'contact|about|booking', replace({_LANG}, ',', '|'),
  'Fallback draft generated because no curated variants exist for this cluster yet.' from best where cluster not in (select cluster from v_templates))"""


@query("pl06_recipe_drafts", "asks", "hints", "templates", sql=DRAFTS_SQL + "select prompt_id, cast(rank as int) as rank, " + ", ".join([*_PLAIN, *_ARRAYS]) + " from n join d using (t)")
def recipe_drafts(asks: DataFrame, hints: DataFrame, templates: DataFrame) -> DataFrame:
    """The six best drafts of each prompt, with all that a draft proposes."""
    named = drafts.prompt_texts(asks)
    found = drafts.text_drafts(named, hints, templates).select("text", "rank", *_PLAIN, *[F.array_join(a, "|").alias(a) for a in _ARRAYS])
    return drafts.with_drafts(asks, named, found).select("prompt_id", "rank", *_PLAIN, *_ARRAYS)


# --- M-02: fields of answers
_NUM = "try_cast(case when json_type({0}) not in ('BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') then json_extract_string({0}, '$') end as double)"
_TEXT = "case when json_type({0}) = 'VARCHAR' then nullif(trim(json_extract_string({0}, '$')), '') end"
_SLUG_FIELD = "json_extract(j, '$.cluster_choice.cluster_slug')"


@query(
    "m02_answer_fields", "plan_requests",
    sql=f"""select request_id, {_TEXT.format(_SLUG_FIELD)} as cluster, cast(trunc({_NUM.format("json_extract(j, '$.variants[0].fit_score')")}) as bigint) as first_fit,
  cast(trunc({_NUM.format("json_extract(j, '$.variants[1].template_score')")}) as bigint) as second_template, cast(trunc({_NUM.format(_SLUG_FIELD)}) as bigint) as slug_number from (select request_id, case when json_valid(answer) then answer::json end as j from v_plan_requests)""",
)
def answer_fields(r: DataFrame) -> DataFrame:
    v = F.try_parse_json("answer")
    return r.select(
        "request_id", answers.text_field(v, "$.cluster_choice.cluster_slug").alias("cluster"), answers.metric(c("answer"), "$.variants[0].fit_score").alias("first_fit"),
        answers.metric(c("answer"), "$.variants[1].template_score").alias("second_template"), answers.metric(c("answer"), "$.cluster_choice.cluster_slug").alias("slug_number"),
    )


# --- PL-03: plans over a day, with cache, quota, recorded answers and drafts
_CAP = 40
_STRATEGY = "case lower({0}) " + " ".join(f"when '{a}' then '{b}'" for a, b in answers.STRATEGIES) + " end"
_CLAMP = "cast(least(greatest(coalesce(trunc({0}), {1}), 0), 100) as int)"
_FIELD = lambda name, f: f.format(f"json_extract(v, '$.{name}')")
_FIT = _CLAMP.format(_FIELD("fit_score", _NUM), f"{_CLAMP.format(_FIELD('template_score', _NUM), 50)} + {_CLAMP.format(_FIELD('prompt_match_score', _NUM), 0)}")
_DEFAULT = _TEXT.format("json_extract(j, '$.default_variant_key')")
PLANS_SQL = DRAFTS_SQL.replace("from v_asks", "from (select request_id as prompt_id, trim(prompt) as prompt from v_plan_requests)") + f""",
q as (select request_id, "at", trim(v.prompt) as prompt, coalesce(nullif(lower(trim(provider)), ''), 'heuristic') as requested, case when json_valid(answer) then answer::json end as j, answer, t as text from v_plan_requests v join n on n.prompt_id = request_id),
vs as (select request_id, pos, {_STRATEGY.format(_FIELD("source_strategy", _TEXT))} as strategy, coalesce({_FIELD("variant_key", _TEXT)}, {_FIELD("template_key", _TEXT)}) as key, {_FIT} as fit
  from (select request_id, unnest(json_extract(j, '$.variants[*]')) as v, generate_subscripts(json_extract(j, '$.variants[*]'), 1) as pos from q where requested = 'openai' and json_type(j) = 'OBJECT')),
vu as (select * from vs where strategy is not null and key is not null qualify row_number() over (partition by request_id, key order by pos) = 1),
va as (select request_id, count(*) as n_variants, arg_min(key, pos) as first_key, list(key) as keys from vu group by request_id),
g as (select q.*, {_TEXT.format(_SLUG_FIELD)} as g_cluster, n_variants, case when list_contains(keys, {_DEFAULT}) then {_DEFAULT} else first_key end as g_key,
  case when requested <> 'openai' then 'not asked' when coalesce(trim(answer), '') = '' then 'no answer' when j is null or json_type(j) <> 'OBJECT' then 'not JSON' when g_cluster is null or {_TEXT.format("json_extract(j, '$.cluster_choice.vertical')")} is null then 'no cluster' when n_variants is null then 'no variant' end as err
  from q left join va using (request_id)),
firsts as (select *, row_number() over (partition by requested order by "at", request_id) as n from (select * from g where coalesce(prompt, '') <> '' and not (err is not null and text = '') qualify row_number() over (partition by text, requested order by "at", request_id) = 1)),
dd as (select t, count(*) as n_drafts, min(cluster) as d_cluster, arg_min(template_key, rank) as d_key, arg_min(fit_score, rank) as d_fit from d group by t),
made as (select f.*, case when err is null then 'openai' else 'heuristic' end as m_provider, err is not null and requested <> 'heuristic' as m_fallback,
  case when err is null or requested = 'heuristic' then null when requested = 'openai' then 'OpenAI planner fallback: ' || err else format('Planner provider ''{{}}'' is not configured yet; used heuristic fallback.', requested) end as m_reason,
  case when err is null then g_cluster else d_cluster end as m_cluster, case when err is null then f.n_variants else n_drafts end as m_n, case when err is null then g_key else d_key end as m_key, case when err is null then vu.fit else d_fit end as m_fit
  from firsts f left join dd on dd.t = f.text left join vu on vu.request_id = f.request_id and vu.key = f.g_key where n <= {_CAP}),
over_ as (select requested, "at", request_id from firsts where n = {_CAP}),
st as (select g.request_id, g.prompt, g.text, g.err, case when m.request_id is null or (g."at", g.request_id) < (m."at", m.request_id) then 'failed' when g.request_id = m.request_id then 'planned' else 'hit' end as status,
  o.request_id is not null and (g."at", g.request_id) > (o."at", o.request_id) as late, m_provider, m_fallback, m_reason, m_cluster, m_n, m_key, m_fit
  from g left join made m on m.text = g.text and m.requested = g.requested and coalesce(g.prompt, '') <> '' left join over_ o on o.requested = g.requested)
select request_id, status, case when coalesce(prompt, '') = '' then 'Prompt is required.' when status <> 'failed' then null when err is not null and text = '' and not late then 'Prompt cannot be empty.' else 'Recipe planner daily quota reached.' end as error,
  case when status <> 'failed' then m_provider end as provider, case when status <> 'failed' then m_fallback end as used_fallback, case when status <> 'failed' then m_reason end as fallback_reason, case when status <> 'failed' then m_cluster end as cluster,
  cast(case when status <> 'failed' then m_n end as int) as n_variants, case when status <> 'failed' then m_key end as selected_key, case when status <> 'failed' then m_fit end as selected_fit from st"""


@query("pl03_prompt_plans", "plan_requests", "hints", "templates", sql=PLANS_SQL)
def prompt_plans(requests: DataFrame, hints: DataFrame, templates: DataFrame) -> DataFrame:
    """A day of requests in two batches: the plans of the first are written to a keyed table, which is the cache and the quota of the second."""
    spark = requests.sparkSession
    table = KeyedTable(spark, new_folder(spark, "plans"), planner.PLANS, ["cache_key", "created_at"])
    later = c("request_id") * 7 % 86400 >= 3600
    parts = []
    for b, batch in enumerate((requests.where(~later), requests.where(later))):
        parts.append(materialize(planner.plan_prompts(batch, table.read(), hints, templates, _CAP), "results"))
        table.insert(planner.made_plans(parts[-1]), [c("request_id")], writer="planner", batch=b)
    out = planner.selected(parts[0].unionByName(parts[1]))
    return out.select("request_id", "status", "error", "provider", "used_fallback", "fallback_reason", "cluster", F.when(c("variants").isNotNull(), F.size("variants")).alias("n_variants"), c("selected.variant_key").alias("selected_key"), c("selected.fit_score").alias("selected_fit"))
