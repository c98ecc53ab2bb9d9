"""Drafts and plans of prompts: hand-worked cases, all pairs against the index, a day in batches, and odd rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import answers
from brindle.operators import drafts, planner
from brindle.operators.tables import KeyedTable
from brindle.storage import materialize

TEMPLATES = "template_key string, label string, vertical string, cluster string, sub_intent string, strategy string, aliases array<string>, search_terms array<string>, website_keywords array<string>, language_hints array<string>, priority int"
ROWS = [
    ("nail-salon", "Nail Salon", "beauty", "beauty", "nails", "map", ["nail", "manicure"], ["nail salon", "manicure"], ["nail"], None, 60),
    ("spa", "Spa", "beauty", "beauty", "spa", "browser", ["spa", "massage"], ["spa"], [], ["en", "th", "en"], 62),
    ("clinic", "Clinic", "beauty", "beauty", "skin-clinic", "website", ["skin clinic"], ["a", "b", "c", "d"], ["a"], [], 50),
]
HINTS = [("beauty", "beauty", "nail"), ("beauty", "beauty", "spa"), ("vehicle", "rentals", "car rental"), ("vehicle", "rentals", "car hire"), ("vehicle", "rentals", "rent a car"), (None, "none", None)]


def held(texts, phrases):
    inside = lambda t, p: p in t or set(p.split()) <= set(t.split())
    found = {t: sorted({p for p in phrases if p and inside(t, p)}) for t in texts if t}
    return {t: p for t, p in found.items() if p}


def test_index_equals_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["", None, "hot hot hot"] * 2 + ["spa " * 30_000 + "end"]
    texts = [t.strip() if t else t for t in texts]
    phrases = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(300)] + ["", None, "hot", "hot hot", "end spa", "pa s", "zz"] * 2
    got = drafts.match_phrases(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert {r.text: r.phrases for r in got.collect()} == held(texts, phrases)
    assert drafts.match_phrases(spark.createDataFrame([], "text string"), spark.createDataFrame([("a",)], "phrase string")).count() == 0
    assert drafts.match_phrases(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "phrase string")).count() == 0


def run(spark, asks, k=6, templates=ROWS):
    rows = drafts.draft_variants(spark.createDataFrame(asks, "prompt_id long, prompt string, cluster string"), spark.createDataFrame(HINTS, "vertical string, cluster string, alias string"), spark.createDataFrame(templates, TEMPLATES), k)
    return sorted(rows.collect(), key=lambda r: (r.prompt_id, r.rank))


def test_scores_by_hand(spark):
    rows = run(spark, [(1, "Luxury Wellness & manicures, Phuket", "x"), (2, "Rent a car", None), (3, "zebra", None), (4, "", None), (5, None, None), (6, " of THE best ", None), (7, "zebra", None), (7, "zebra", None)])
    first = [r for r in rows if r.prompt_id == 1]
    # "luxury spa nail phuket": spa 62 + 10 + 6 + 5 + 4; nail salon 60 + 20 (both aliases read "nail") + 6 + 5; clinic 50 + 5 + 1
    assert [(r.template_key, r.template_score, r.match_score, r.fit_score) for r in first] == [("nail-salon", 60, 31, 91), ("spa", 62, 25, 87), ("clinic", 50, 6, 56)]
    assert first[0].cluster_score == 204 and first[0].slug == "nail-salon-phuket" and first[0].language_hints == ["en", "th"] and first[1].language_hints == ["en", "th"]
    assert first[0].search_terms == ["nail salon phuket", "manicure phuket", "nail salon", "manicure"] and first[0].website_keywords == ["nail", "nail salon phuket", "manicure phuket", "nail salon", "manicure"]
    assert first[0].fit_reasons == ["Prompt directly references the 'nails' sub-intent.", "Matches intent terms: nail, manicure.", "Localized search terms for phuket."]
    assert first[1].fit_reasons[-1].startswith("Prompt hints") and first[2].fit_reasons == ["Added as a closely related variant inside the selected cluster.", "Localized search terms for phuket."]
    assert first[2].search_terms == ["a phuket", "b phuket", "c phuket", "a", "b", "c", "d"]
    broad = {r.prompt_id: r for r in rows if r.prompt_id != 1}
    # all three aliases of "rentals" read "car rental": 3 * 100 + 10
    assert set(broad) == {2, 3, 7} and (broad[2].cluster, broad[2].cluster_score, broad[2].label, broad[2].slug, broad[2].fit_score) == ("rentals", 310, "Car Rental", "car-rental", 50)
    assert (broad[3].vertical, broad[3].cluster, broad[3].cluster_score, broad[3].sub_intent) == ("tourism", "tour_operators", 0, "broad-intent")
    assert sum(r.prompt_id == 7 for r in rows) == 2


def test_few_best_of_a_large_cluster(spark):
    many = [(f"t{i:03}", f"T {i % 7}", "beauty", "beauty", f"kind-{i % 5}", ("browser", "website", "hybrid", "map")[i % 4], [f"w{i % 9}x"], [], [], None, 40 + i % 11) for i in range(300)]
    asks = [(i, f"spa w{i % 12}x {w}", None) for i, w in enumerate(["luxury", "studio", "", "luxury studio"] * 6)]
    full = run(spark, asks, 1000, many)
    assert len(full) == 300 * len(asks)
    assert [r for r in run(spark, asks, 3, many)] == [r for r in full if r.rank <= 3]


def test_no_templates(spark):
    assert [r.sub_intent for r in run(spark, [(1, "spa", None)], templates=[])] == ["broad-intent"]
    assert run(spark, []) == []


REQUEST = "request_id long, at timestamp, prompt string, provider string, answer string"
GOOD = '{"cluster_choice": {"vertical": "beauty", "cluster_slug": "beauty"}, "default_variant_key": "b", "variants": [{"variant_key": "a", "source_strategy": "website_first", "fit_score": 70}, {"variant_key": "b", "label": "B", "source_strategy": "hybrid_discovery", "fit_score": "140"}]}'


def plan(spark, rows, plans=None, cap=0, **more):
    asks = spark.createDataFrame([(i, m and datetime(2024, 1, 1, *m), *x) for i, m, *x in rows], REQUEST)
    plans = spark.createDataFrame([], planner.PLANS) if plans is None else plans
    return planner.plan_prompts(asks, plans, spark.createDataFrame(HINTS, "vertical string, cluster string, alias string"), spark.createDataFrame(ROWS, TEMPLATES), cap, **more)


def test_answers_by_field(spark):
    v = '"variants": [%s]}'
    head = '{"cluster_choice": {"vertical": "x", "cluster_slug": "y"}, '
    one = '{"variant_key": "k", "source_strategy": "website_first"}'
    cases = {
        None: "no answer", "  ": "no answer", "{": "not JSON", "[]": "not JSON", '"text"': "not JSON", "null": "not JSON", "{}": "no cluster", '{"cluster_choice": "y", ' + v % one: "no cluster", '{"cluster_choice": {"vertical": "x", "cluster_slug": 5}, ' + v % one: "no cluster",
        head + '"variants": {}}': "no variant", head + v % "": "no variant", head + v % '7, null, [], {"variant_key": "k"}, {"source_strategy": "website_first"}, {"variant_key": "k", "source_strategy": "walk"}': "no variant",
    }
    good = head + '"default_variant_key": " b ", "surplus": {"a": [1]}, ' + v % ", ".join([
        '{"template_key": "first-shop", "source_strategy": "Website_First", "template_score": "41", "prompt_match_score": 12.9}', '{"variant_key": "b", "label": " B ", "source_strategy": "hybrid_discovery", "fit_score": -3}',
        '{"variant_key": "b", "source_strategy": "website_first"}', '{"variant_key": "c", "source_strategy": "directory_expansion", "fit_score": true}', '{"variant_key": "d", "source_strategy": "website_first", "fit_score": 1e9, "other": 1}', '"x"'])
    rows = spark.createDataFrame([(k,) for k in [*cases, good]], "raw string").select("raw", answers.read_answer(F.col("raw")).alias("x")).collect()
    assert {r.raw: r.x.error for r in rows} == {**cases, good: None}
    x = next(r.x for r in rows if r.raw == good)
    assert [tuple(w) for w in x.variants] == [("first-shop", "First Shop", "website", 53), ("b", "B", "hybrid", 0), ("c", "C", "directory", 50), ("d", "D", "website", 100)]
    assert (x.dropped, x.default_key, x.cluster, x.vertical) == (2, "b", "y", "x")


def test_a_day_by_hand(spark):
    rows = [
        (1, (9, 0), "spa", "OpenAI ", GOOD), (2, (9, 1), "The SPA!", "openai", None), (3, (9, 2), "nail", "openai", "broken"), (4, (9, 3), "zebra", "claude", GOOD), (5, (9, 4), "", None, None), (6, (9, 5), "of the", None, None),
        (7, (9, 5), "massage", "openai", GOOD), (8, (9, 6), "of", "openai", None), (9, (9, 7), "nail", "openai", GOOD), (10, None, "spa", "openai", GOOD), (11, (9, 4), None, "openai", GOOD), (12, (8, 0), "spa", "openai", None),
    ]
    got = {r.request_id: r for r in planner.selected(plan(spark, rows, cap=2)).collect()}
    assert len(got) == 12
    # "spa" is first asked at 8:00 without an answer: drafts stand in, and the later answers are not asked for
    assert (got[12].status, got[12].provider, got[12].fallback_reason, got[12].selected.variant_key) == ("planned", "heuristic", "OpenAI planner fallback: no answer", "spa")
    assert [(got[i].status, got[i].provider, got[i].default_key) for i in (1, 2)] == [("hit", "heuristic", "spa")] * 2
    assert (got[3].status, got[3].fallback_reason, got[9].status, got[9].default_key) == ("planned", "OpenAI planner fallback: not JSON", "hit", "nail-salon")
    assert (got[4].status, got[4].used_fallback, got[4].cluster, got[4].model) == ("planned", True, "tour_operators", "heuristic-v1") and "'claude'" in got[4].fallback_reason
    assert [got[i].error for i in (5, 11, 10, 6, 7, 8)] == ["Prompt is required."] * 2 + ["Time is required.", "Prompt cannot be empty."] + ["Recipe planner daily quota reached."] * 2
    # without a cap only the calls that cannot be answered fail
    free = {r.request_id: r for r in planner.selected(plan(spark, rows)).collect()}
    assert (free[7].status, free[7].selected.variant_key, free[7].selected.fit_score, free[8].error) == ("planned", "b", 100, "Prompt cannot be empty.")


def test_batches_equal_the_whole_day(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, (rng.randint(0, 23), rng.randint(0, 59)), rng.choice(["spa", "nail", "of", "", "car hire", "rent a car", f"zebra {rng.randint(0, 9)}"]), rng.choice(["openai", None, "claude"]), rng.choice([None, GOOD, "x"])) for i in range(300)]
    names = ["request_id", "status", "error", "default_key", "fallback_reason"]
    whole = sorted(map(str, plan(spark, rows, cap=5).select(names).collect()))
    table = KeyedTable(spark, f"file://{tmp_path}/plans", planner.PLANS, ["cache_key", "created_at"])
    parts = []
    for b in range(3):
        out = materialize(plan(spark, [r for r in rows if r[1][0] // 8 == b], table.read(), cap=5))
        for _ in range(2):  # a batch that is written twice changes nothing
            table.insert(planner.made_plans(out), [F.col("request_id")], writer="planner", batch=b)
        parts += map(str, out.select(names).collect())
    assert sorted(parts) == whole
    made = table.read()
    assert made.groupBy("requested").count().where("count > 5").count() == 0
    old = made.limit(1).withColumn("created_at", F.lit(datetime(2023, 12, 30))).withColumn("expires_at", F.lit(datetime(2024, 1, 1, 0, 0)))
    assert plan(spark, rows[:40], old, cap=0).where("status = 'hit' and expires_at <= at").count() == 0
    assert plan(spark, [], made).count() == 0
    with pytest.raises(ValueError):
        plan(spark, rows, hours=2)
