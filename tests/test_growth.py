"""Work that must not grow with the square of the input: no operator of a plan makes more rows than a small multiple of it."""

import datetime as dt
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.functions import answers, contacts, html, markup
from brindle.operators import drafts, runs, states
from brindle.plans import extra, more


def most_rows(df) -> int:
    """The most rows that one operator of ``df`` gives while it is collected."""
    df.collect()

    def walk(p):
        n = p.metrics().get("numOutputRows")
        name = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        inner += [p.children().apply(i) for i in range(p.children().size())]
        return max([n.get().value() if n.isDefined() else 0, *[walk(x) for x in inner]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_either_key_with_one_slug(spark):
    rows = spark.range(3000).select("id", F.lit("same").alias("slug"))
    a, b = rows.where("id % 2 = 0"), rows.where("id % 3 = 0")
    out = more.either_key(a, b)
    assert most_rows(out) <= 6000
    assert {r.id: r.other for r in out.collect()} == {i: i if i % 3 == 0 else 0 for i in range(0, 3000, 2)}


def test_prompt_variants_of_alike_labels(spark):
    words = ["red", "ring", "blue", "bolt"]
    pick = lambda k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(F.col("id") / k) % 4 + 1).cast("int"))
    v = spark.range(14000).select(F.col("id").alias("variant_id"), F.concat_ws(" ", pick(3), pick(5)).alias("label"), (F.col("id") % 50).cast("int").alias("priority"))
    p = spark.range(2000).select(F.col("id").alias("prompt_id"), F.when(F.col("id") != 7, F.concat(F.lit("Ring of "), pick(20))).alias("prompt"))
    out = extra.draft_variants(p, v)
    assert most_rows(out) <= 30000
    templates = [(r.variant_id, set(r.label.split(" ")), r.priority) for r in v.where("variant_id % 7 = 0").collect()]
    want = {}
    for r in p.where("prompt_id < 60").collect():
        fits = [(i, None if r.prompt is None else q + 10 * len(w & set(r.prompt.lower().split(" ")))) for i, w, q in templates if i % 20 == r.prompt_id % 20]
        want[r.prompt_id] = sorted(fits, key=lambda f: (-(f[1] or 0), f[0]))[:6]
    got = {i: [] for i in want}
    for r in out.where("prompt_id < 60").orderBy("prompt_id", "rank").collect():
        got[r.prompt_id].append((r.variant_id, r.fit))
    assert got == want


STATS = "created_at timestamp_ntz, score int, discovered long, crawled long, contact long, email long, phone long"


def test_windows_of_many_audits_and_runs(spark):
    start, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    stats = [(start + (i % 480) * hour, i % 9 if i % 5 else None, i % 7 if i % 3 else None, i % 4, i % 3, i % 2, None) for i in range(4000)] + [(None, 1, 1, 1, 1, 1, 1)]
    audits = [(i % 350, start + (i % 240 + 120) * hour if i % 50 else None) for i in range(400)]
    out = runs.before_and_after(spark.createDataFrame(audits, "audit_id long, changed_at timestamp_ntz"), spark.createDataFrame(stats, STATS))
    assert most_rows(out) <= 16000
    got = {(r.audit_id, r.side): (r.runs, r.score, r.crawled, r.phone) for r in out.collect()}
    assert len(got) == len(out.collect())
    for audit in (0, 1, 17, 49, 50, 349):
        for side, low, high in (("before", -168, 0), ("after", 0, 168)):
            rows = [s for i, at in audits if i == audit and at for s in stats if s[0] and at + low * hour <= s[0] < at + high * hour]
            scores, found = [s[1] for s in rows if s[1] is not None], sum(s[2] or 0 for s in rows)
            assert got.get((audit, side)) == ((len(rows), round(sum(scores) / len(scores), 2), round(100.0 * sum(s[3] for s in rows) / max(found, 1), 2), None) if rows else None)


LOG = "run long, company long, seq long, at timestamp_ntz, kind string, status string, error string"


def test_closes_of_a_large_run(spark):
    start = dt.datetime(2024, 1, 1)
    at = lambda n: start + dt.timedelta(hours=n)
    kinds = [("queue", None), ("start", None), ("finish", "failed"), ("retry", None), ("requeue", None), ("close", "skipped"), ("start", None)]
    log = [(i % 2, i * 7 % 101, i, at(i * 13 % 500), *kinds[i * 5 % 7], "e") for i in range(1500)]
    ends = [(i % 3, 10000 + i, at(i * 2), *(("close", "failed") if i % 40 else ("retry", None) if i % 80 else ("close", "running")), f"c{i}") for i in range(200)]
    rows = spark.createDataFrame(log, LOG)
    events = spark.createDataFrame(ends, LOG.replace("company long, ", ""))
    given = states.with_run_events(rows, events, "run", "company")
    named = rows.select("run", "company").distinct()
    whole = rows.unionByName(named.join(events, "run").select(*rows.columns))
    assert whole.count() > 3 * given.count()
    for chunk in (4, 1024):
        fold = lambda df: sorted(map(tuple, states.company_states(df, ["run", "company"], ["at", "seq"], chunk).collect()))
        assert fold(given) == fold(whole)


def test_pages_of_a_batch_are_not_held_as_objects(monkeypatch):
    class Parts(dict):
        pass

    live, most, read = weakref.WeakSet(), [0], markup.read_page

    class Ref:
        pass

    def watched(page):
        parts = Parts(read(page))
        parts["mark"] = mark = Ref()
        live.add(mark)
        most[0] = max(most[0], len(live))
        return parts

    pages = pa.array([f'<a href="/{i}">x</a>' if i % 9 else None if i % 2 else "" for i in range(1000)])
    whole = markup.page_parts.func(pages).to_pylist()
    monkeypatch.setattr(markup, "read_page", lambda page: None if page is None else watched(page))
    assert markup.page_parts.func(pages).to_pylist() == whole
    assert most[0] <= 256
    assert markup.page_parts.func(pages.slice(0, 0)).to_pylist() == []


def test_a_repeated_prompt_is_normalised_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text and text.lower()

    monkeypatch.setattr(drafts.p, "normalize_prompt", counted)
    asks = spark.range(4000).select(F.col("id").alias("prompt_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("Zebra "), F.col("id") % 5)).alias("prompt"))
    hints = spark.createDataFrame([("beauty", "beauty", "spa")], "vertical string, cluster string, alias string")
    templates = spark.createDataFrame([], "template_key string, label string, vertical string, cluster string, sub_intent string, strategy string, aliases array<string>, search_terms array<string>, website_keywords array<string>, language_hints array<string>, priority int")
    got = drafts.draft_variants(asks, hints, templates).groupBy("template_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prompt_id").alias("ids")).collect()
    assert {r.template_key: (r.n, r.ids) for r in got} == {f"zebra-{k}": (n, n) for k in range(5) for n in [sum(i % 11 > 0 and i % 5 == k for i in range(4000))]}
    assert calls.value <= 100


def test_an_answer_is_read_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("raw")).select(answers.read_answer(F.col("raw")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(path) for path in ("$.variants", "$.cluster_choice.vertical", "$.default_variant_key", "$.source_strategy", "$.fit_score")] == [1] * 5


def test_a_number_in_a_leaf_is_normalised_once(spark, monkeypatch):
    made, real = [], contacts.normalize_phone
    monkeypatch.setattr(contacts, "normalize_phone", lambda v: made.append(v) or real(v))
    leaves = F.transform(F.array("v"), lambda v: F.struct(F.lit("text").alias("kind"), v.alias("value")))
    values = ["+66 81 234 5678", "0066812345678 ext 5", "12345678", "000000000", "at 10:30 on 123456789012", "www.a1234567890", "call me 123456789", "x" * 60 + "123456789", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", html.structured_contacts(leaves)["phones"].alias("phones"))
    assert {r.v for r in rows.collect() if r.phones} == set(values[:2])
    assert len(made) == 1
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("extension") == 1


def test_an_asset_is_resolved_once(spark):
    pages = ['<script src=/a.js></script><link rel=preload href="b.css"><link rel=icon href=i.css><script>"<script src=no>"</script><noscript><script src="x/../c.mjs"></noscript><!-- <script src=n> -->', '<script src="/d.js', "<SCRIPT SRC='?q=1'>", "", None]
    assert [markup.read_assets(p) for p in pages] == [p if p is None else markup.read_page(p)["assets"] for p in pages]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", F.concat(F.lit("https://www.A.com/p/q"), "i").alias("u"), F.struct(markup.page_assets(F.col("html")).alias("assets")).alias("parts"))
    rows = rows.select("i", markup.first_assets(F.col("u"), F.col("parts")).alias("a"))
    assert {r.i: r.a for r in rows.collect()} == {0: ["https://www.A.com/a.js", "https://www.A.com/p/x/../c.mjs".replace("x/../", ""), "https://www.A.com/p/b.css"], 1: [], 2: [], 3: [], 4: None}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("]+|[") == 1
