"""Hand-worked cases of numbering plans, written tables, event logs, cache lookups and progress streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions.numbering import read_numbers, read_plan
from brindle.operators import ingestion, lookups, states
from brindle.operators.tables import Conflict, KeyedTable
from brindle.streaming import progress

NUMBERS = [
    # ten countries' national forms, then international ones, then guards and fallbacks
    ("081 234 5678", "TH", "+66812345678"), ("020 7946 0958", "GB", "+442079460958"), ("(650) 253-0000", "US", "+16502530000"), ("1-650-253-0000", "US", "+16502530000"), ("030 123456", "DE", "+4930123456"),
    ("01 42 68 53 00", "FR", "+33142685300"), ("06 6982 0000", "IT", "+390669820000"), ("8 (495) 123-45-67", "RU", "+74951234567"), ("912 345 678", "ES", "+34912345678"), ("03-3224-9999", "JP", "+81332249999"), ("098765 43210", "IN", "+919876543210"),
    ("06 1 234 5678", "HU", "+3612345678"), ("+44 (0)20 7946 0958", "TH", "+442079460958"), ("001 44 20 7946 0958", "TH", "+442079460958"), ("011 81 3 3224 9999", "US", "+81332249999"), ("66 81 234 5678", "TH", "+66812345678"), ("+66812345678", None, "+66812345678"),
    ("8001234567", "RU", "+78001234567"), ("081 234 5678 ext. 12", "TH", "+66812345678"), ("Tel 081-234-5678", "TH", "+66812345678"), ("081-234-5678 x9", "th", "+66812345678"), ("+999 123 4567", "TH", "+9991234567"), ("0812345678", None, "+0812345678"), ("0812345678", "ZZ", "+0812345678"),
    ("https://x.example/0812345678", "TH", None), ("www.x.example 0812345678", "TH", None), ("call 0812345678", "TH", None), ("open 10:30 0812345678", "TH", None), ("12345", "TH", None), ("", "TH", None), (None, "TH", None), ("0" * 70, "TH", None), ("1234567890123456", "TH", None),
]


def test_numbering_plan(spark):
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(NUMBERS)], "i int, value string, region string, want string")
    got = read_numbers(df, "value", "region", "got").orderBy("i").collect()
    assert [(r.value, r.region, r.got) for r in got] == [(r.value, r.region, r.want) for r in got]


def test_plan_is_sound():
    """Codes are prefix-free, so a number has one reading; regions are told once."""
    plan = read_plan()
    codes = {c.code for c in plan}
    assert len({c.region for c in plan}) == len(plan) < 200 and all(0 < c.least <= c.most <= 15 - len(c.code) + 1 for c in plan)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string, n long", ["k"], buckets=4)


def content(table, version=None):
    return {r.k: (r.v, r.n) for r in table.read(version).collect()}


def rows(spark, *found):
    return spark.createDataFrame(list(found), "k long, v string, n long")


def test_table_merges_once_for_each_batch(spark, table):
    assert content(table) == {}
    assert table.upsert(rows(spark, (1, "a", 1), (2, "b", 1), (None, "z", 1)), writer="w", batch=0)
    assert not table.upsert(rows(spark, (1, "other", 9)), writer="w", batch=0)
    assert table.upsert(rows(spark, (1, None, 2), (3, "c", 2)), writer="w", batch=1)
    assert not table.upsert(rows(spark, (1, "late", 0)), writer="w", batch=0)
    assert table.upsert(rows(spark, (3, "d", 3)), writer="other", batch=0)
    assert {k: v for k, v in content(table).items() if k} == {1: ("a", 2), 2: ("b", 1), 3: ("d", 3)}
    assert content(table, 0)[1] == ("a", 1) and 3 not in content(table, 0)
    assert table.delete(spark.createDataFrame([(2,), (77,)], "k long")) and 2 not in content(table)
    assert table.insert(rows(spark, (1, "x", 5), (4, "second", 2), (4, "first", 1)), [F.col("n")]) and content(table)[4] == ("first", 1) and content(table)[1] == ("a", 2)
    before = table.manifest()["buckets"]
    assert table.upsert(rows(spark)) and table.manifest()["buckets"] == before


def test_untouched_buckets_are_not_rewritten(spark, table):
    table.upsert(rows(spark, *[(k, "v", k) for k in range(40)]))
    before = table.manifest()["buckets"]
    table.upsert(rows(spark, (7, "w", 7)))
    after = table.manifest()["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1 and content(table)[7] == ("w", 7) and len(content(table)) == 40


def test_failed_writer_leaves_the_old_snapshot(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, "a", 1)), writer="w", batch=0)
    with pytest.raises(Exception, match="broken row"):
        table.upsert(rows(spark, (1, "b", 2)).withColumn("v", F.raise_error(F.lit("broken row"))), writer="w", batch=1)
    monkeypatch.setattr(table, "_commit", lambda m: (_ for _ in ()).throw(OSError("died before the manifest")))
    with pytest.raises(OSError):
        table.upsert(rows(spark, (1, "c", 3)), writer="w", batch=1)
    monkeypatch.undo()
    assert content(table) == {1: ("a", 1)}
    assert table.upsert(rows(spark, (1, "d", 4)), writer="w", batch=1) and content(table) == {1: ("d", 4)}


def test_two_writers_of_one_version(spark, table):
    table.upsert(rows(spark, (1, "a", 1)))
    mine = {**table.manifest(), "version": 1}
    table.upsert(rows(spark, (2, "b", 1)))
    with pytest.raises(Conflict):
        table._commit(mine)
    assert set(content(table)) == {1, 2}


def test_table_under_repeated_stream_batches(spark, table, tmp_path):
    """A stream that is run again from an old checkpoint gives its batches the same numbers: the table does not change."""
    source = f"{tmp_path}/in"
    rows(spark, (1, "a", 1), (2, "b", 1)).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("k long, v string, n long").parquet(source)
    add = lambda df, i: table.merge(df, lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"), F.sum("n").alias("n")), writer="s", batch=i)
    for checkpoint in ("one", "two"):
        stream().writeStream.foreachBatch(add).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert content(table) == {1: ("a", 1), 2: ("b", 1)}


def test_sources_after_a_writer_that_died_between_its_tables(spark, tmp_path, monkeypatch):
    made, links = KeyedTable(spark, f"file://{tmp_path}/c", ingestion.COMPANIES, ["company_key"]), KeyedTable(spark, f"file://{tmp_path}/l", ingestion.LINKS, ["source", "external_id"])
    records = spark.createDataFrame([(1, "x1", "Shop", "new.example.com", None, 1), (2, "x2", "Shop 2", "www.new.example.com/", None, 1), (3, "x3", "No site", None, "+661", 1), (4, "x4", "Other", None, "+669", 1), (5, "", "No id", None, None, 1), (6, "x6", "Old", "old.example.com", None, 1), (7, "x1", "again", None, None, 1)], "seq long, external_id string, name string, website string, phone string, region_id long")
    companies = spark.createDataFrame([("c1", 1, "https://old.example.com"), ("c2", 1, None)], "company_key string, region_id long, website_url string")
    phones, stored = spark.createDataFrame([("c2", "+661")], "company_key string, phone string"), spark.createDataFrame([], "external_id string, company_key string")
    run = lambda batch, r=records: ingestion.materialize_sources(r, "maps", companies, phones, stored, made, links, batch)
    monkeypatch.setattr(links, "insert", lambda *a, **k: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        run(0)
    monkeypatch.undo()
    assert made.read().count() == 2 and links.read().count() == 0
    assert run(0) and not run(0)
    want = {"x1": ("maps/x1", "merged", "new"), "x2": ("maps/x1", "matched", "website"), "x3": ("c2", "matched", "phone"), "x4": ("maps/x4", "merged", "new"), "x6": ("c1", "matched", "website")}
    assert {r.external_id: (r.company_key, r.merge_status, r.matched_by) for r in links.read().collect()} == want
    later = spark.createDataFrame([(9, "x9", "Third", "https://new.example.com", None, 1), (10, "x4", "Other", None, None, 1)], records.schema)
    assert run(1, later) and {r.external_id: r.company_key for r in links.read().where("first_batch = 1").collect()} == {"x9": "maps/x1"}


def brute_states(log):
    """The six events as they are told, one company at a time."""
    out = {}
    for key, _, kind, at, status, error in sorted(log, key=lambda e: (e[0], e[1])):
        s = out.setdefault(key, {"status": "absent", "retry": 0, "started": None, "finished": None, "error": None})
        if kind == "queue" and s["status"] not in ("queued", "running", "completed"):
            s.update(status="queued", retry=0, started=None, finished=None, error=None)
        elif kind == "requeue":
            s.update(status="queued", started=None, finished=None, error=error[:2000] if error else None)
        elif kind == "retry":
            s.update(status="queued" if s["status"] == "absent" else s["status"], retry=s["retry"] + 1)
        elif kind == "start":
            s.update(status="running", started=at, finished=None, error=None)
        elif kind == "finish" or (kind == "close" and s["status"] in ("queued", "running")):
            s.update(status=status, finished=at, error=error[:2000] if error else None)
    return {k: tuple(s.values()) for k, s in out.items() if s["status"] != "absent"}


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_states_by_ranges(spark, chunk):
    """A hot company's log of thousands of events, cut anywhere, ends as it does when read in order."""
    rng, log = random.Random(5), []
    for i in range(3000):
        kind = rng.choice(states.EVENTS)
        at = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i // 2)
        log.append((rng.choice([1, 1, 1, *range(2, 60)]), i, kind, at.to_pydatetime(), rng.choice(["completed", "failed", "skipped"]) if kind in ("finish", "close") else None, rng.choice([None, "e" * 3000, "x"])))
    df = spark.createDataFrame(log, "company long, seq long, kind string, at timestamp, status string, error string")
    got = {r.company: (r.status, r.retry_count, r.started_at, r.finished_at, r.last_error) for r in states.company_states(df, ["company"], ["at", "seq"], chunk).collect()}
    assert got == brute_states(log)
    with pytest.raises(Exception, match="no such event"):
        states.company_states(df.withColumn("kind", F.lit("jump")), ["company"], ["at", "seq"]).collect()
    assert states.company_states(df.limit(0), ["company"], ["at", "seq"]).count() == 0


def test_thresholds_by_hand(spark):
    """Eleven scores: nearest ranks 6, 8 and 2 of (n - 1) * p = 5.5, 8 and 2, half to even; then blended by half (75 + 2.5 and 35 - 7.5, to even) and clamped."""
    from brindle.plans.decisions import thresholds

    rows = [("s", 10 * i, 1, 9 * i, 1, i % 3, 1) for i in range(11)] + [("s", 99, 0, 99, 0, 0, 0), ("none", 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "strategy string, validation_score int, validation_count int, production_score int, production_runs int, planner_activated int, prompt_activated int")
    got = {r.strategy: r for r in thresholds(df).collect()}
    # seen: validation 60, 80, 20; production 54, 72, 18; activations 0 and eleven of 1 to 3: median 2, place 8 of the third quarter 2, at least 3 there; 1 + 0.5 and 2 + 0.5 to even
    s = got["s"]
    assert (s.new_rec_val, s.new_trust_val, s.new_sup_val) == (60, 77, 27) and (s.new_rec_prod, s.new_trust_prod, s.new_sup_prod) == (37, 56, 14)
    assert (s.new_rec_act, s.new_trust_act) == (1, 2)
    assert (got["none"].new_rec_val, got["none"].new_sup_val) == (60, 35)


def test_activation_floors(spark):
    from brindle.functions import scores

    df = spark.createDataFrame([("website_first",), ("hybrid_discovery",), ("unknown",)], "s string").select("s", scores.activation_floors(F.col("s")).alias("f"))
    assert {r.s: [x.floor for x in r.f] for r in df.collect()} == {"website_first": [55, 1, 10, 1], "hybrid_discovery": [58, 1, 5, 1], "unknown": [55, 1, 0, 0]}


def test_cache_lookups(spark):
    stored = [("a", 100, 1, "old"), ("a", 200, 2, "new"), ("a", 200, 3, "newer"), ("b", 50, 4, None), (None, 10, 5, "null key"), ("c", 300, 6, "later")]
    asked = [(1, "a", 99), (2, "a", 100), (3, "a", 199), (4, "a", 200), (5, "a", 200 + 3600), (6, "a", 200 + 3601), (7, "b", 60), (8, "c", 299), (9, "d", 1), (10, None, 20), (11, "a", None)]
    stamp = lambda df: df.withColumn("at", F.timestamp_seconds("s"))
    right = stamp(spark.createDataFrame(stored, "key string, s long, n long, verdict string"))
    left = stamp(spark.createDataFrame(asked, "id long, key string, s long"))
    got = {r.id: (r.hit, r.age_seconds, r.verdict) for r in lookups.cached_answers(left, right, "key", "at", ["n"], ["verdict"], F.lit(3600)).collect()}
    miss = (False, None, None)
    assert got == {1: miss, 2: (True, 0, "old"), 3: (True, 99, "old"), 4: (True, 0, "newer"), 5: (True, 3600, "newer"), 6: miss, 7: (True, 10, None), 8: miss, 9: miss, 10: miss, 11: miss}


EVENTS = [("j1", 1, "start", 3, None), ("j1", 2, "result", None, "r2"), ("j1", 3, "keyword", None, None), *[("j1", 4 + i, "result", None, f"r{4 + i}") for i in range(6)], ("j2", 1, "start", 9, None), ("j3", 1, "result", None, "only"), ("j1", 20, "done", None, None)]


def test_progress_stream_equals_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "job_id string, seq long, kind string, n long, result string"
    for i, part in enumerate((EVENTS[:4], EVENTS[4:7], EVENTS[9:11], EVENTS[7:9], EVENTS[11:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    reports = []
    stream = progress.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*"))
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, i: reports.extend(df.collect()) and None).start().awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {r.job_id: r for r in reports}
    want = {r.job_id: r for r in progress.job_progress_state(spark.createDataFrame(EVENTS, schema)).collect()}
    assert set(last) == {"j1", "j3"} and want["j2"].result_count == 0 and want["j2"].total == 9
    for job in last:
        assert (last[job].status, last[job].result_count, last[job].completed, last[job].total, last[job].latest) == tuple(want[job][c] for c in ("status", "result_count", "completed", "total", "latest"))
    assert want["j1"].latest == ["r5", "r6", "r7", "r8", "r9"] and [r.status for r in reports if r.job_id == "j1"].count("done") == 1


def test_suppressed_hosts_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.STORE)
    schema = "id long, url string, created_at timestamp, error string"
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    parts = [[(i, "https://a.example/x", at(i), "e") for i in range(3)], [(10, "https://b.example", at(500), None)], [(11, "https://b.example", at(501), "e")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    reports = []
    stream = progress.forgetting_suppressed_hosts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, i: reports.extend((r.host, r.failures, r.blocked) for r in df.collect()) and None).start().awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert reports[0] == ("a.example", 3, True) and ("a.example", 0, False) in reports and ("b.example", 1, False) in reports
