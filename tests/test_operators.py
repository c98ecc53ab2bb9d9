from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import companies, ranking, runs, upserts
from brindle.sources import readers
from brindle.streaming import jobs


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    s = spark.createDataFrame([(2, "B", "y"), (2, "C", None), (3, None, "z")], "k int, v string, w string")
    out = upserts.upsert(t, s, ["k"], [F.col("v")], fill_only=("w",))
    assert sorted(map(tuple, out.collect())) == [(1, "a", None), (2, "B", "x"), (3, None, "z")]
    assert sorted(r.k for r in upserts.insert_absent(t, s, ["k"]).collect()) == [1, 2, 3]
    assert [r.k for r in upserts.remove_keys(t, s, ["k"]).collect()] == [1]
    assert upserts.evolve(t, {"n": ("int", 5), "v": ("string", "")}).first().n == 5


def test_nearest_rank_and_streaks(spark):
    df = spark.createDataFrame([(1, x) for x in (50, 10, 40, 20, 30)], "g int, x int")
    assert df.groupBy("g").agg(ranking.nearest_rank(F.col("x"), 0.55).alias("p")).first().p == 30
    log = spark.createDataFrame([("p", i, f) for i, f in enumerate([True, True, False, True, True, True, True, True])], "k string, i int, f boolean")
    rows = ranking.failure_streaks(log, "k", [F.col("i")], F.col("f")).orderBy("i").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3, 4, 5] and rows[-1].disabled and not rows[4].cooling
    fold = ranking.clamped_fold(log, "k", "i", F.when(F.col("f"), -20).otherwise(5)).first().value
    assert fold == 0
    assert ranking.running_mean(spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("k", 3, 5)], "k string, i int, v int"), "k", "i", "v").first().mean == 3


def test_numbers_of_large_groups_and_early_stop(spark):
    df = spark.createDataFrame([(k, i) for k, m in (("a", 900), (None, 70), ("b", 1)) for i in range(m)], "g string, i int").repartition(5)
    want = {(r.g, r.i, r.i + 1) for r in df.collect()}
    assert {tuple(r) for r in ranking.numbered(df, "g", ["i"]).collect()} == want
    assert ranking.numbered(df.limit(0), "g", ["i"]).count() == 0
    sites = {"u": "xxxxx", "v": "xxxoxx", "w": "oxxxx", None: "xxxx", "z": "xx"}
    pages = spark.createDataFrame([(s, i, x == "x") for s, xs in sites.items() for i, x in enumerate(xs)], "site string, i int, bad boolean")
    seen = {}
    for r in ranking.early_stop(pages, "site", [F.col("i")], F.col("bad")).collect():
        seen[r.site] = seen.get(r.site, 0) + r.visited
    assert seen == {"u": 3, "v": 5, "w": 5, None: 3, "z": 2}


def test_page_flags_more(spark):
    df = spark.range(30).withColumnRenamed("id", "x")
    rows = ranking.page(df, [F.desc("x")], 10, 10).orderBy(F.desc("x")).collect()
    assert [r.x for r in rows] == list(range(19, 9, -1)) and all(r.has_more for r in rows)
    assert not ranking.page(df, [F.desc("x")], 20, 10).first().has_more


def test_contact_companies(spark):
    e, p, ch = (spark.createDataFrame([(x,) for x in xs], "company_id int") for xs in ([], [1, 2], [3]))
    r = companies.contact_companies(e, p, ch, F.lit(0)).first()
    assert (r.contact_companies, r.phone_companies) == (3, 2)


def test_ingest_summary(spark):
    records = spark.createDataFrame([(1, "a.com", 1), (2, "https://www.a.com/", 1), (3, "a.com", 2), (4, None, 1), (5, "k.com", 1), (6, "k.com", 1), (7, "x.com", 1)], "seq int, website string, region_id int")
    matches = spark.createDataFrame([(i, "new", None) for i in (1, 2, 3, 4)] + [(5, "website", 50), (6, "website", 50), (7, "phone", 70)], "seq int, matched_by string, company_id int")
    run = spark.createDataFrame([(50, "failed"), (70, "running")], "company_id int, status string")
    assert companies.ingest_summary(records, matches, run).first().asDict() == {"staged": 7, "created": 3, "matched": 4, "queued": 4}


def test_merges_follow_the_canonical_company(spark):
    ids = spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "company_id int, canonical_id int")
    pages = spark.createDataFrame([(1, 10, "u", "dup", 200, True, None, 9), (2, 11, "u", "", 0, False, "late", 5), (3, 12, "u", "x", 404, False, None, 1)], "company_id int, page_id int, url string, title string, status_code int, has_contact_form boolean, crawl_error string, crawled_at int")
    assert sorted(map(tuple, companies.merge_pages(pages, ids).collect())) == [(2, "u", "dup", 200, True, "late", 9), (3, "u", "x", 404, False, None, 1)]
    channels = spark.createDataFrame([(1, 7, "t", "@AB"), (2, 8, "t", "@ab"), (2, 9, "w", "@ab")], "company_id int, channel_id int, channel_type string, value string")
    assert sorted(map(tuple, companies.merge_channels(channels, ids).collect())) == [(2, "t", "@ab", "@ab", 7, 8), (2, "w", "@ab", "@ab", 9, 9)]
    forms = spark.createDataFrame([(1, 4, "p", "a1", True, False, 3), (2, 5, "p", None, False, False, 2)], "company_id int, form_id int, page_url string, action_url string, has_captcha boolean, is_js_challenge boolean, last_checked_at int")
    assert [tuple(r) for r in companies.merge_forms(forms, ids).collect()] == [(2, "p", "a1", True, False, 3)]


def test_draft_counts_keep_childless_generations(spark):
    g, a, b = (spark.createDataFrame([(x,) for x in xs], "generation_id int") for xs in ([1, 2], [1, 1], [1]))
    assert sorted(map(tuple, runs.draft_counts(g, verticals=a, clusters=b, templates=b).collect())) == [(1, 2, 1, 1), (2, 0, 0, 0)]


def test_names(spark):
    rows = [(None, "Shop", True), ("place-1", "Shop", True), ("Shop", "place-9", False), ("Shop", "Shops", True), ("Shops", "Shop", False), ("a", None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", companies.replace_name(F.col("a"), F.col("b"))).collect())


def test_ambiguous_margin(spark):
    df = spark.createDataFrame([(1, "a", 310), (1, "b", 285), (2, "a", 310), (2, "b", 284), (3, "a", 5)], "k int, c string, s int")
    assert {r.k: r.ambiguous for r in ranking.ambiguous(df, "k", "s", "c").collect()} == {1: True, 2: False, 3: False}


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 0.0, "lon": 2.0, "center": {"lat": 5.0, "lon": 6.0}, "tags": {"phone": "1;2", "contact:email": "a@b.c", "shop": "car"}}]}')
    e = readers.map_elements(spark, str(tmp_path / "e.json"))
    assert tuple(e.select("external_ref", "lat", "lon").first()) == ("node/1", 5.0, 2.0)
    assert {(r.kind, r.value) for r in readers.tag_contacts(e).collect()} == {("phone", "1"), ("phone", "2"), ("email", "a@b.c")}
    assert e.where(readers.matches_tags(F.col("tags"), [("shop", "car"), ("x", "y")])).count() == 1 and e.where(readers.matches_tags(F.col("tags"), [("shop", "car")], [("phone", "1;2")])).count() == 0
    (tmp_path / "p.csv").write_text('﻿Phone,name\n"+90 1",x\n,\n\'5\',y\n', encoding="utf-8")
    assert [r.original for r in readers.phone_csv(spark, str(tmp_path / "p.csv")).collect()] == ["+90 1", "5"]
    (tmp_path / "b.txt").write_text("# c\n\nA.com\nb.org\n")
    assert {r.domain for r in readers.blocklist(spark, str(tmp_path / "b.txt"), least=2).collect()} == {"a.com", "b.org"}
    assert "mailinator.com" in {r.domain for r in readers.blocklist(spark, str(tmp_path / "b.txt")).collect()}
    readers.export_csv(spark.createDataFrame([(1, "x,y")], "a int, b string"), str(tmp_path / "out"), ("b",))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().b == "x,y"
    readers.append_requests(spark.createDataFrame([("u" * 900, "e")], "url string, error string"), str(tmp_path / "log"))
    assert len(spark.read.parquet(str(tmp_path / "log")).first().url) == 500


@pytest.fixture
def events(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(130):
        rows.append((i, f"https://www.host{i % 4}.com/x", "crawler" if i % 2 else "maps", t0 + timedelta(minutes=17 * i), "boom" if i % 4 < 2 and i % 9 else None))
    rows.append((500, "http://late.org", "maps", t0 + timedelta(days=9), None))
    df = spark.createDataFrame(rows, "id long, url string, provider string, created_at timestamp, error string").repartition(1).sortWithinPartitions("id")
    df.write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events")), str(tmp_path)


def collect_stream(stream, folder, mode, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_windows_equal_batch(spark, events):
    batch, folder = events
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    got = {(r.window_start, r.provider): (r.n, r.errors) for r in collect_stream(jobs.request_windows(stream, late="60 days"), folder, "update", "windows", spark).collect()}
    want = {(r.window_start, r.provider): (r.n, r.errors) for r in jobs.request_windows(batch).collect()}
    assert got == want
    assert jobs.request_sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_stream_suppression_equals_batch(spark, events):
    batch, folder = events
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/events")
    rows = collect_stream(jobs.stream_suppressed_hosts(stream), folder, "update", "suppressed", spark).collect()
    want = {r.host: (r.failures, r.blocked) for r in jobs.suppressed_hosts(batch).collect()}
    assert {r.host: (r.failures, r.blocked) for r in rows} == want and any(b for _, b in want.values())


def test_stream_dedupe_and_merge(spark, events):
    batch, folder = events
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/events")
    got = collect_stream(jobs.first_seen(stream, ["url"], "created_at", "30 days"), folder, "append", "seen", spark)
    assert sorted(r.url for r in got.collect()) == sorted(r.url for r in jobs.first_seen(batch, ["url"], "created_at").collect())
    seen = []
    jobs.each_batch(stream, lambda df, n: seen.append((n, df.count())), f"{folder}/ck-each").awaitTermination(60)
    assert sum(n for _, n in seen) == batch.count()


def test_due_dates(spark):
    rows = [(None, "completed", "2024-01-01", False), ("u", "pending", "2024-01-09", True), ("u", "completed", None, True), ("u", "completed", "2024-01-01", True), ("u", "completed", "2024-01-09", False)]
    df = spark.createDataFrame(rows, "w string, s string, l string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", runs.recrawl_due(F.col("w"), F.col("s"), F.col("l"), F.lit("2024-01-10"), 72)).collect())


def test_folds_gather_no_group(spark):
    import random

    rng = random.Random(6)
    log = [(rng.choice("aab"), i, rng.choice([-20, -7, 5, 5, 5, 9])) for i in range(900)]
    want = {k: 100 for k in "ab"}
    for k, _, s in log:
        want[k] = max(0, min(100, want[k] + s))
    df = spark.createDataFrame(rng.sample(log, len(log)), "k string, i int, s int").repartition(4)
    for chunk in (1, 7, 4096):
        assert {r.k: r.value for r in ranking.clamped_fold(df, "k", "i", F.col("s"), chunk=chunk).collect()} == want
    for p in (0.0, 0.5, 0.55, 1.0):
        got = {r.k: r.x for r in ranking.nearest_rank_by_counts(df, "k", "s", p, "x").collect()}
        for k in "ab":
            v = sorted(s for key, _, s in log if key == k)
            assert got[k] == v[round((len(v) - 1) * p)]
    few = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("k", 3, 5)], "k string, i int, v int")
    assert ranking.running_mean(few, "k", "i", "v", limit=3).first().mean == 3
    with pytest.raises(Exception, match="more than 2 values"):
        ranking.running_mean(few, "k", "i", "v", limit=2).collect()
