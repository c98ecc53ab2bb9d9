"""Company resolution: contact summaries, canonical records, merges and the match cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import prompts, urls
from brindle.operators.ranking import top_per_group

PLACEHOLDERS = ("place-", "node/", "way/", "relation/")
# Priority of run states in a merge.
STATUS_PRIORITY = {"completed": 5, "running": 4, "queued": 3, "skipped": 2, "failed": 1}


def is_placeholder(name: Column) -> Column:
    low = F.lower(F.btrim(F.coalesce(name, F.lit(""))))
    out = low == ""
    for p in PLACEHOLDERS:
        out = out | low.startswith(p)
    return out


def contact_summaries(phones: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per company: phones (count and greatest), and chat channels by type."""
    p = phones.groupBy("company_id").agg(F.countDistinct("phone_id").alias("phone_count"), F.max("phone").alias("top_phone"))
    is_ = lambda t: F.col("channel_type") == t
    c = channels.groupBy("company_id").agg(
        F.countDistinct(F.when(is_("whatsapp"), F.col("channel_id"))).alias("whatsapp_count"), F.max(F.when(is_("whatsapp"), F.col("value"))).alias("whatsapp"),
        F.countDistinct(F.when(is_("telegram"), F.col("channel_id"))).alias("telegram_count"), F.max(F.when(is_("telegram"), F.col("value"))).alias("telegram"),
    )
    return p, c


def email_rows(emails: DataFrame, companies: DataFrame, regions: DataFrame, phones: DataFrame, channels: DataFrame) -> DataFrame:
    """A row per address with its company, region and contact counts. Summaries are joined after they are reduced."""
    p, c = contact_summaries(phones, channels)
    rows = emails.join(companies.select("company_id", "name", "region_id"), "company_id").join(regions.select("region_id", F.col("name").alias("region_name"), "country_code"), "region_id")
    rows = rows.join(p, "company_id", "left").join(c, "company_id", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("phone_count", "whatsapp_count", "telegram_count")]
    return rows.select("email_id", "email", "company_id", "name", "region_name", "country_code", *zero, "top_phone", "whatsapp", "telegram")


def company_audit(companies: DataFrame, emails: DataFrame, phones: DataFrame, channels: DataFrame) -> DataFrame:
    """Contacts of each company; children are reduced first, so no join fans out."""
    e = emails.groupBy("company_id").agg(F.countDistinct("email_id").alias("email_count"), F.max("email").alias("top_email"))
    p, c = contact_summaries(phones, channels)
    rows = companies.join(e, "company_id", "left").join(p, "company_id", "left").join(c, "company_id", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("email_count", "phone_count", "whatsapp_count", "telegram_count")]
    return rows.select("company_id", "region_id", "name", *zero, "top_email", "top_phone", "whatsapp", "telegram")


def contact_companies(emails: DataFrame, phones: DataFrame, channels: DataFrame, group: Column) -> DataFrame:
    """Companies with any contact (a union of sets), and the phone figure: the larger of phone and channel companies."""
    tag = lambda df, kind: df.select("company_id", F.lit(kind).alias("kind"))
    all_ = tag(emails, "email").unionAll(tag(phones, "phone")).unionAll(tag(channels, "channel")).distinct().withColumn("bucket", group)
    n = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("company_id")))
    return all_.groupBy("bucket").agg(F.countDistinct("company_id").alias("contact_companies"), n("email").alias("email_companies"), F.greatest(n("phone"), n("channel")).alias("phone_companies"))


def canonical(companies: DataFrame) -> DataFrame:
    """(company_id, canonical_id): the best record of each (region, website key): a real name, then crawled, then a
    city, then the longer name, then the lowest id. Records without a key stand for themselves."""
    keyed = companies.withColumn("key", urls.website_key(F.col("website_url")))
    name = F.length(F.btrim(F.coalesce("name", F.lit(""))))
    best = F.struct(
        (~is_placeholder(F.col("name"))).cast("int").alias("a"), (~F.col("crawl_status").isin("pending", "failed", "no_website")).cast("int").alias("b"),
        F.col("city").isNotNull().cast("int").alias("c"), name.alias("d"), (-F.col("company_id")).alias("e"),
    )
    heads = keyed.where("key is not null").groupBy("region_id", "key").agg(F.max_by("company_id", best).alias("canonical_id"))
    return keyed.join(heads, ["region_id", "key"], "left").select("company_id", F.coalesce("canonical_id", "company_id").alias("canonical_id"))


def merge_emails(emails: DataFrame, ids: DataFrame) -> DataFrame:
    """Addresses under their canonical company, one row each: the first source stays, the last sighting counts."""
    moved = emails.join(ids, "company_id", "left").withColumn("company_id", F.coalesce("canonical_id", "company_id"))
    return moved.groupBy("company_id", "email").agg(F.min_by("source_rank", "seq").alias("first_source"), F.max("seq").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))


def merge_phones(phones: DataFrame, ids: DataFrame) -> DataFrame:
    """Phones under their canonical company, one row each, with the longest raw form (the earlier one of equals)."""
    moved = phones.join(ids, "company_id", "left").withColumn("company_id", F.coalesce("canonical_id", "company_id"))
    return moved.groupBy("company_id", "phone").agg(F.max_by("raw", F.struct(F.length("raw"), -F.col("seq"))).alias("raw"), F.max("seq").alias("last_seen"))


def _moved(rows: DataFrame, ids: DataFrame, seq: str) -> DataFrame:
    """Rows under their canonical company, with the order of a merge: the company's own first, then by company and ``seq``."""
    moved = rows.join(ids, "company_id", "left").withColumn("_to", F.coalesce("canonical_id", "company_id"))
    return moved.withColumn("_order", F.struct((F.col("_to") != F.col("company_id")).cast("int").alias("m"), F.col("company_id").alias("c"), F.col(seq).alias("s"))).drop("company_id", "canonical_id").withColumnRenamed("_to", "company_id")


def _first(name: str, empty) -> Column:
    """The first value in merge order that is neither null nor empty."""
    return F.min_by(name, F.when(F.col(name) != F.lit(empty), F.col("_order"))).alias(name)


def merge_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages (company_id, page_id, url, title, status_code, has_contact_form, crawl_error, crawled_at), one row for each url of a
    canonical company: the first title, status and error, whether any has a form, the last crawl."""
    return _moved(pages, ids, "page_id").groupBy("company_id", "url").agg(
        _first("title", ""), _first("status_code", 0), F.coalesce(F.bool_or("has_contact_form"), F.lit(False)).alias("has_contact_form"), _first("crawl_error", ""), F.max("crawled_at").alias("crawled_at"),
    )


def merge_channels(channels: DataFrame, ids: DataFrame) -> DataFrame:
    """Channels (company_id, channel_id, channel_type, value), one row for each type and lower-case value: the longest form, the
    first of equals in merge order; first and last sighting by channel_id."""
    rows = _moved(channels, ids, "channel_id").withColumn("normalized", F.lower(F.btrim("value")))
    return rows.groupBy("company_id", "channel_type", "normalized").agg(
        F.min_by("value", F.struct((-F.length(F.btrim("value"))).alias("n"), "_order")).alias("value"), F.min("channel_id").alias("first_seen"), F.max("channel_id").alias("last_seen"),
    )


def merge_forms(forms: DataFrame, ids: DataFrame) -> DataFrame:
    """Forms (company_id, form_id, page_url, action_url, has_captcha, is_js_challenge, last_checked_at), one row for each page:
    the first action, whether any has a captcha or a challenge, the last check."""
    any_ = lambda n: F.coalesce(F.bool_or(n), F.lit(False)).alias(n)
    return _moved(forms, ids, "form_id").groupBy("company_id", "page_url").agg(_first("action_url", ""), any_("has_captcha"), any_("is_js_challenge"), F.max("last_checked_at").alias("last_checked_at"))


def merge_run_companies(rows: DataFrame) -> DataFrame:
    """One row per (run, company): the state of highest priority, the earliest queueing."""
    prio = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STATUS_PRIORITY.items()], F.lit(0))
    return rows.groupBy("run_id", "company_id").agg(F.max_by("status", prio).alias("status"), F.min("queued_at").alias("queued_at"), F.count(F.lit(1)).alias("merged"))


def match_cascade(records: DataFrame, links: DataFrame, companies: DataFrame, phones: DataFrame) -> DataFrame:
    """Company of each staged record: by an existing link, else by website key in its region, else by phone there, else new.

    records: seq, source_id, website, phone, region_id. Each lookup is reduced to its least company first, so records never multiply.
    """
    by_key = companies.withColumn("key", urls.website_key(F.col("website_url"))).where("key is not null").groupBy("region_id", "key").agg(F.min("company_id").alias("by_website"))
    by_phone = phones.join(companies.select("company_id", "region_id"), "company_id").groupBy("region_id", "phone").agg(F.min("company_id").alias("by_phone"))
    by_link = links.groupBy("source_id").agg(F.min("company_id").alias("by_link"))
    rows = records.withColumn("key", urls.website_key(F.col("website"))).join(by_link, "source_id", "left").join(by_key, ["region_id", "key"], "left").join(by_phone, ["region_id", "phone"], "left")
    how = F.when(F.col("by_link").isNotNull(), "link").when(F.col("by_website").isNotNull(), "website").when(F.col("by_phone").isNotNull(), "phone").otherwise("new")
    return rows.select("seq", how.alias("matched_by"), F.coalesce("by_link", "by_website", "by_phone").alias("company_id"))


def ingest_summary(records: DataFrame, matches: DataFrame, run_rows: DataFrame) -> DataFrame:
    """One row of counts of an ingest: staged records, created and matched companies' records, companies queued for the run.

    records: seq, website, region_id; matches: the cascade's rows; run_rows: company_id, status of the run. New records of one
    region and website key create one company, the others match it. A company is queued once, and not while its row in the
    run is queued, running or completed. A website that a match by phone would add to its company is not followed.
    """
    key = F.concat(F.col("region_id").cast("string"), F.lit("/"), urls.website_key(F.col("website")))
    rows = matches.join(records.select("seq", F.coalesce(key, F.concat(F.lit("seq "), F.col("seq").cast("string"))).alias("key")), "seq")
    counts = rows.agg(F.count(F.lit(1)).alias("staged"), F.countDistinct(F.when(F.col("matched_by") == "new", F.col("key"))).alias("created"))
    busy = run_rows.where(F.col("status").isin("queued", "running", "completed")).select("company_id")
    known = matches.where("company_id is not null").select("company_id").distinct().join(busy, "company_id", "left_anti").agg(F.count(F.lit(1)).alias("known"))
    return counts.crossJoin(known).select("staged", "created", (F.col("staged") - F.col("created")).alias("matched"), (F.col("created") + F.col("known")).alias("queued"))


def stage_places(places: DataFrame, default: str = "google_maps") -> DataFrame:
    """Raw place rows with trimmed names, tolerant numbers and a query text; a place id counts once (the first), empty ids stay."""
    rows = places.select(
        "seq", F.nullif(F.btrim("name"), F.lit("")).alias("name"), F.coalesce(F.nullif(F.btrim("keyword"), F.lit("")), F.lit(default)).alias("query_text"), F.nullif("place_id", F.lit("")).alias("place_id"),
        prompts.to_number(F.col("reviews"), "int").alias("reviews"), "website", "phone", "region_id",
    )
    with_id = top_per_group(rows.where("place_id is not null"), ["place_id"], [F.col("seq")])
    return with_id.unionByName(rows.where("place_id is null"))


def replace_name(current: Column, incoming: Column) -> Column:
    """Whether an incoming name replaces the current one: a real one a placeholder, a longer one its equal."""
    mine, new = is_placeholder(current), is_placeholder(incoming)
    longer = F.length(F.btrim(incoming)) > F.length(F.btrim(F.coalesce(current, F.lit(""))))
    return F.coalesce((incoming != "") & F.when(mine & ~new, True).when(mine == new, longer).otherwise(False), F.lit(False))


def in_scope(rows: DataFrame, regions: DataFrame, region_id: int | None = None, country_code: str | None = None) -> DataFrame:
    """Rows of one region, else of one country's regions, else all: the filter is chosen when the plan is made."""
    if region_id is not None:
        return rows.where(F.col("region_id") == region_id)
    if country_code is not None:
        return rows.join(regions.where(F.col("country_code") == country_code).select("region_id"), "region_id", "left_semi")
    return rows
