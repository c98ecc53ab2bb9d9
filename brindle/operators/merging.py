"""Companies merged into their canonical record with all their child tables, crawls and map elements written to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.operators.companies import STATUS_PRIORITY, is_placeholder
from brindle.operators.ranking import top_per_group

WEAK = ("pending", "failed", "no_website")


def moved(rows: DataFrame, ids: DataFrame, seq: str) -> DataFrame:
    """Rows under their canonical company with ``_order``, the order of a merge: its own first, then by company and ``seq``."""
    to = F.coalesce("canonical_id", "company_id")
    rows = rows.join(ids.select("company_id", "canonical_id"), "company_id", "left")
    order = F.struct((to != F.col("company_id")).cast("int").alias("m"), F.col("company_id").alias("c"), F.col(seq).alias("s"))
    return rows.withColumn("_order", order).withColumn("company_id", to).drop("canonical_id")


def first(name: str, order: str | Column = "_order") -> Column:
    """The first value in order that is neither null nor empty."""
    o = F.col(order) if isinstance(order, str) else order
    return F.min_by(name, F.when(F.col(name).isNotNull() & (F.col(name).cast("string") != ""), o)).alias(name)


def _any(name: str) -> Column:
    return F.coalesce(F.bool_or(name), F.lit(False)).alias(name)


def best_name(name: Column, placeholder: Column, order: Column) -> Column:
    """What is left of names offered in turn, where a real name replaces a placeholder and a longer one its equal."""
    return F.min_by(name, F.struct(placeholder.cast("int").alias("p"), (-F.length(F.btrim(F.coalesce(name, F.lit(""))))).alias("n"), order.alias("o")))


def named_by_ref(name: Column, ref: Column) -> Column:
    """A placeholder name, among them the record's own reference."""
    return is_placeholder(name) | F.coalesce((ref != "") & (F.lower(F.btrim(name)) == F.lower(F.btrim(ref))), F.lit(False))


def merge_companies(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each canonical company: the best name, the first website, city, query and position, whether any has a form,
    and the first crawl status that says more than pending, failed or no website (its own if none does)."""
    rows = moved(companies, ids, "company_id")
    order = F.col("_order")
    strong = F.when(~F.col("crawl_status").isin(*WEAK), order)
    return rows.groupBy("company_id").agg(
        best_name(F.col("name"), named_by_ref(F.col("name"), F.col("external_ref")), order).alias("name"), *[first(n) for n in ("website_url", "city", "source_query", "latitude", "longitude")],
        _any("has_contact_form"), F.coalesce(F.min_by("crawl_status", strong), F.min_by("crawl_status", order)).alias("crawl_status"), F.count(F.lit(1)).alias("merged"),
    )


def merge_sightings(rows: DataFrame, ids: DataFrame, keys: list[str], seq: str, value: str | None = None) -> DataFrame:
    """Contacts (company_id, keys, source_page_url, source_type, first_seen_at, last_seen_at), one row for each key of a canonical
    company: the first source, the earliest and latest sighting and, with ``value``, its longest form (the first of equals)."""
    longest = [F.min_by(value, F.struct((-F.length(F.btrim(value))).alias("n"), "_order")).alias(value)] if value else []
    return moved(rows, ids, seq).groupBy("company_id", *keys).agg(
        first("source_page_url"), first("source_type"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), *longest,
    )


def merge_maps(rows: DataFrame, ids: DataFrame, keys: list[str], seq: str, column: str) -> DataFrame:
    """(company_id, keys, column): maps of equal keys put together, where a later row's entry replaces an earlier one's. Entries are
    reduced one by one before they are put into a map, so a map is as large as its distinct entries; empty maps give no row."""
    entries = moved(rows, ids, seq).select("company_id", *keys, "_order", F.explode(column).alias("_k", "_v"))
    last = entries.groupBy("company_id", *keys, "_k").agg(F.max_by(F.struct("_v"), "_order").alias("_s"))
    return last.groupBy("company_id", *keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", F.col("_s._v").alias("_v"))))).alias(column))


def merge_run_rows(rows: DataFrame, ids: DataFrame, seq: str) -> DataFrame:
    """Rows of runs, one for each run of a canonical company: the state of highest priority, the earliest queueing and start, the
    latest end, the first error."""
    priority = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STATUS_PRIORITY.items()], F.lit(0))
    return moved(rows, ids, seq).groupBy("company_id", "run_id").agg(
        F.min_by("status", F.struct((-priority).alias("p"), "_order")).alias("status"), F.min("queued_at").alias("queued_at"), F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"), first("last_error"),
    )


def merge_categories(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (company_id, category_id) under canonical companies."""
    return moved(rows, ids, "category_id").select("company_id", "category_id").distinct()


def merge_submissions(submissions: DataFrame, forms: DataFrame, ids: DataFrame) -> DataFrame:
    """Submissions (submission_id, form_id) with the form that stays of their form's page and its canonical company."""
    f = moved(forms, ids, "form_id")
    kept = f.groupBy("company_id", "page_url").agg(F.min_by("form_id", "_order").alias("kept_form_id"))
    old = f.select(F.col("form_id"), "company_id", "page_url").join(kept, ["company_id", "page_url"]).select("form_id", "company_id", "kept_form_id")
    return submissions.select("submission_id", "form_id").join(old, "form_id").select("submission_id", "company_id", F.col("kept_form_id").alias("form_id"))


def repoint(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that only change their company, such as request metrics."""
    return moved(rows, ids, "company_id").drop("_order").select(*rows.columns)


def upsert_elements(elements: DataFrame, companies: DataFrame, source: str = "overpass") -> DataFrame:
    """Companies after a scan: every company an element met, and the new ones.

    elements: seq, region_id, external_ref, name, website, city, query; companies: company_id, region_id, source, external_ref, name,
    website_url, city, source_query, crawl_status. An element meets the company of its reference in its region, else the
    best-named one of its website key there; other elements of one region and website key (without one: of one reference) make one
    new company, whose ``company_id`` is null and ``new_key`` names it. Elements count in order of ``seq``: a better name replaces, the
    last website and city count, a query stays. A website that the scan itself changes is not matched by later elements.
    Social and chat addresses are no websites.
    """
    site = urls.company_website(F.col("website"))
    e = elements.select("seq", "region_id", "external_ref", F.coalesce(F.when(F.col("name") != "", F.col("name")), "external_ref").alias("name"), site.alias("site"), "city", F.substring("query", 1, 255).alias("source_query"))
    e = e.withColumn("key", urls.website_key(F.col("site")))
    by_ref = companies.where(F.col("source") == source).groupBy("region_id", "external_ref").agg(F.min("company_id").alias("by_ref"))
    rank = [named_by_ref(F.col("name"), F.col("external_ref")), F.col("crawl_status").isin(*WEAK), F.coalesce(F.col("city") == "", F.lit(True)), -F.length(F.btrim(F.coalesce("name", F.lit("")))), F.col("company_id")]
    keyed = companies.where(F.col("website_url").isNotNull()).withColumn("key", urls.website_key(F.col("website_url"))).where("key is not null")
    by_key = keyed.groupBy("region_id", "key").agg(F.min_by("company_id", F.struct(*[x.alias(f"r{i}") for i, x in enumerate(rank)])).alias("by_key"))
    e = e.join(by_ref, ["region_id", "external_ref"], "left").join(by_key, ["region_id", "key"], "left").withColumn("company_id", F.coalesce("by_ref", "by_key"))
    unit = F.when(F.col("company_id").isNull(), F.concat_ws("/", F.col("region_id").cast("string"), F.coalesce("key", "external_ref")))
    met = e.select("company_id", unit.alias("new_key"), F.col("seq"), "external_ref", "name", "site", "city", "source_query", F.lit(1).alias("n"))
    touched = met.where("company_id is not null").select("company_id").distinct()
    old = companies.join(touched, "company_id", "left_semi").select("company_id", F.lit(None).cast("string").alias("new_key"), F.lit(None).cast("long").alias("seq"), "external_ref", "name", F.col("website_url").alias("site"), "city", "source_query", F.lit(0).alias("n"))
    order = F.struct("n", F.coalesce("seq", F.lit(0)).alias("s"))
    last = lambda n: F.max_by(n, F.when(F.col(n) != "", order))
    rows = old.unionByName(met).groupBy("company_id", "new_key")
    return rows.agg(best_name(F.col("name"), named_by_ref(F.col("name"), F.col("external_ref")), order).alias("name"), last("site").alias("website_url"), last("city").alias("city"), first("source_query", order), F.sum("n").alias("elements"))


def crawled_companies(companies: DataFrame, pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """(company_id, crawl_status, has_contact_form) after a crawl: no_website without a website, else the crawl's status and
    whether any page has a form. Companies that were not crawled (no row in ``statuses``) are left out."""
    forms = pages.groupBy("company_id").agg(_any("has_contact_form"))
    rows = companies.select("company_id", "website_url").join(statuses.select("company_id", "crawl_status"), "company_id").join(forms, "company_id", "left")
    site = F.coalesce(F.col("website_url") != "", F.lit(False))
    return rows.select("company_id", F.when(site, F.col("crawl_status")).otherwise("no_website").alias("crawl_status"), F.coalesce(site & F.col("has_contact_form"), F.lit(False)).alias("has_contact_form"))


def crawled_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages (company_id, url, seq, ...) of crawls over those stored: the last visit's values count as they are, nulls too."""
    last = top_per_group(pages, ["company_id", "url"], [F.desc("seq")]).drop("seq")
    kept = stored.join(last.select("company_id", "url"), ["company_id", "url"], "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def crawled_forms(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """New forms: the first of a page's list, on its first visit that has any, if no form of that page is stored."""
    rows = pages.where(F.size("forms") > 0).select("company_id", F.col("url").alias("page_url"), "seq", F.element_at("forms", 1).alias("form"))
    rows = rows.join(stored.select("company_id", "page_url").distinct(), ["company_id", "page_url"], "left_anti")
    one = top_per_group(rows, ["company_id", "page_url"], [F.col("seq")])
    return one.select("company_id", "page_url", "form.action_url", F.coalesce(F.when(F.col("form.method") != "", F.col("form.method")), F.lit("get")).alias("method"), F.coalesce("form.has_captcha", F.lit(False)).alias("has_captcha"))


def linked_phone(channel_type: Column, normalized: Column, phones: Column) -> Column:
    """The number as the page writes it (its last form), if a chat link of the page names one of its numbers. phones: array of (raw, normalized)."""
    same = F.filter(phones, lambda p: p["normalized"] == normalized)
    return F.when((channel_type == "whatsapp") & (F.size(same) > 0), F.element_at(same, -1)["raw"])
