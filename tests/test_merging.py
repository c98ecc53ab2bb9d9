"""Hand-worked cases of merges, scans, crawls, JSON-LD and the discovery chain."""

import json

from pyspark.sql import functions as F

from brindle.functions import html, outcomes, prompts
from brindle.operators import merging, runs
from brindle.sources import readers, seeds

COMPANY = "company_id long, external_ref string, name string, website_url string, city string, source_query string, latitude string, longitude string, has_contact_form boolean, crawl_status string"


def test_company_takes_what_it_lacks(spark):
    rows = [
        (5, "node:5", "node:5", "a.com", None, "", "", None, False, "failed"), (1, "node:1", "Bakery", "b.com", "x", "q1", "1", "2", None, "pending"),
        (3, "node:3", "Long Bakery", None, "y", "q3", "3", "", True, "completed"), (9, None, "Alone", None, None, None, None, None, None, "pending"),
    ]
    ids = spark.createDataFrame([(1, 5), (3, 5), (5, 5)], "company_id long, canonical_id long")
    got = {r.company_id: r for r in merging.merge_companies(spark.createDataFrame(rows, COMPANY), ids).collect()}
    five = got[5]
    assert (five.name, five.website_url, five.city, five.source_query, five.latitude, five.longitude) == ("Long Bakery", "a.com", "x", "q1", "1", "2")
    assert five.has_contact_form and five.crawl_status == "completed" and five.merged == 3
    assert (got[9].name, got[9].crawl_status, got[9].has_contact_form) == ("Alone", "pending", False)


def test_maps_later_entries_win(spark):
    rows = spark.createDataFrame([(1, "a", 1, {"x": "own", "y": "1"}), (2, "a", 2, {"x": "merged", "z": None}), (2, "b", 3, {})], "company_id long, k string, seq int, m map<string,string>")
    ids = spark.createDataFrame([(2, 1)], "company_id long, canonical_id long")
    assert [(r.company_id, r.k, r.m) for r in merging.merge_maps(rows, ids, ["k"], "seq", "m").collect()] == [(1, "a", {"x": "merged", "y": "1", "z": None})]


def test_scan_meets_ref_then_website_and_makes_new_ones_once(spark):
    stored = spark.createDataFrame(
        [(1, 7, "overpass", "node:1", "node:1", "https://old.com", None, "first", "pending"), (2, 7, "overpass", "node:2", "Shop", "https://www.shop.com/", "c", None, "completed"), (3, 7, "overpass", "node:3", "Other Shop", "shop.com", None, None, "pending")],
        "company_id long, region_id long, source string, external_ref string, name string, website_url string, city string, source_query string, crawl_status string",
    )
    elements = spark.createDataFrame(
        [(1, 7, "node:1", "Real", "new.com", None, "q"), (2, 7, "way:9", None, "shop.com/", "town", "q"), (3, 7, "way:8", "A", "fresh.com", None, "q"), (4, 7, "way:7", "Longer", "www.fresh.com", "t", "q2"),
         (5, 8, "way:6", None, None, None, None), (6, 8, "way:5", "B", "https://t.me/b", None, "q")],
        "seq long, region_id long, external_ref string, name string, website string, city string, query string",
    )
    got = {(r.company_id, r.new_key): (r.name, r.website_url, r.city, r.source_query, r.elements) for r in merging.upsert_elements(elements, stored).collect()}
    assert got == {
        (1, None): ("Real", "https://new.com", None, "first", 1), (2, None): ("Shop", "https://shop.com/", "town", "q", 1), (None, "7/fresh.com"): ("Longer", "https://www.fresh.com", "t", "q", 2),
        (None, "8/way:6"): ("way:6", None, None, None, 1), (None, "8/way:5"): ("B", None, None, "q", 1),
    }


def test_json_ld_is_walked_to_its_leaves(spark):
    good = json.dumps({"a": [{"EMAIL": "X@Shop.example.com"}, {"email": {"deep": "y@shop.example.com"}}], "telephone": "+66 81 234 5678", "n": 5, "sameAs": "https://t.me/Shop", "t": "call 02"})
    deep = "[" * 100_000 + "]" * 100_000
    rows = spark.createDataFrame([(1, [good, "{broken", None]), (2, None), (3, []), (4, [deep])], "id int, blocks array<string>")
    got = {r.id: r for r in rows.select("id", html.json_ld_leaves("blocks").alias("l")).select("id", *[v.alias(k) for k, v in html.structured_contacts(F.col("l")).items()]).collect()}
    assert (got[1].emails, got[1].phones, got[1].telegram, got[1].whatsapp) == (["x@shop.example.com", "y@shop.example.com"], ["+66 81 234 5678"], ["@shop"], [])
    assert all(got[i].emails == [] and got[i].phones == [] for i in (2, 3, 4))


def test_discovery_stops_at_the_cap(spark):
    rows = [(1, 1, "a", False, True, None, 10, 0, 2), (1, 2, "b", False, True, "boom", 0, 0, 2), (1, 3, "c", True, False, None, 5, 0, 2), (1, 4, "d", False, False, None, 0, 7, 2), (1, 5, "e", False, True, None, 9, 0, 2), (1, 6, "f", False, False, None, 0, 8, 2),
            (2, 1, "a", False, True, "down", 0, 0, 9)]
    states = spark.createDataFrame(rows, "run_id int, category_id int, slug string, force boolean, due boolean, error string, found long, last_count long, remaining int")
    categories, result = runs.discovery(states)
    assert [r.status for r in categories.where("run_id = 1").orderBy("category_id").collect()] == ["fresh", "failed", "fresh_forced", "cached", "rate_limited", "untouched"]
    got = {r.run_id: tuple(r)[1:] for r in result.collect()}
    assert got == {1: (22, 2, "skipped", "Discovery completed. Partial category failures: b: boom"), 2: (0, 0, "failed", "a: down")}


def test_lists_seeds_and_unknown_classes(spark, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps({"job_id": "j", "phone_numbers": [" 1 ", "", "2", "  "]}))
    assert [(r.position, r.phone, r.total_numbers) for r in readers.number_list(spark, str(tmp_path / "job.json")).orderBy("position").collect()] == [(0, "1", 4), (2, "2", 4)]
    assert seeds.verticals(spark).count() == 11 and seeds.clusters(spark).count() == 14
    row = spark.range(1).select(outcomes.job_state(F.lit("REVOKED")).alias("a"), outcomes.probe_error(F.lit("other"), F.lit("m")).alias("b"), prompts.title_case(F.lit("ATV tours/o'neil 2nd")).alias("c")).first()
    assert row.a is None and row.b is None and row.c == "Atv Tours/O'Neil 2Nd"
