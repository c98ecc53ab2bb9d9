"""Addresses in a page's own scripts and styles, out of recorded fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import contacts, markup, urls

c = F.col


def readable_assets(fetches: DataFrame) -> DataFrame:
    """(asset_url, emails) of the newest fetch of each URL, if it succeeded and is text; ties go to the larger status, then type and body.
    Bodies are reduced to their addresses before rows move."""
    text_type = F.coalesce(F.lower("content_type"), F.lit("")).rlike("javascript|json|css|text")
    usable = F.coalesce(c("status_code") < 400, F.lit(False)) & text_type
    rows = fetches.select("asset_url", "fetched_at", "status_code", "content_type", F.xxhash64("body").alias("h"), F.when(usable, contacts.extract_emails(markup.unescape_all(F.coalesce("body", F.lit(""))))).alias("emails"))
    newest = rows.where(c("asset_url").isNotNull()).groupBy("asset_url").agg(F.max_by(F.struct("emails"), F.struct("fetched_at", "status_code", "content_type", "h")).alias("b"))
    return newest.select("asset_url", c("b.emails").alias("emails")).where(c("emails").isNotNull())


def asset_emails(pages: DataFrame, fetches: DataFrame, most: int = 4) -> DataFrame:
    """(page_id, n_assets, n_read, emails) for each page of (page_id, url, parts), of whose parts only ``assets`` is read: of its first ``most`` assets, those with a readable fetch, and the
    addresses in them that belong to the page's host or are common mailboxes, sorted. A page without any has an empty list; repeated page ids are one page.

    Assets are unique before the join, so a file that a third of the pages loads meets each page once; a hot one is split by Spark.
    """
    wanted = pages.select("page_id", F.regexp_replace(urls.netloc(c("url")), r"^www\.", "").alias("_host"), F.explode_outer(markup.first_assets(c("url"), c("parts"), most)).alias("asset_url"))
    met = wanted.join(readable_assets(fetches), "asset_url", "left")
    good = F.filter("emails", lambda e: contacts.is_asset_candidate(e, c("_host")) & ~contacts.is_noise_email(e))
    rows = met.select("page_id", "asset_url", F.when(c("emails").isNotNull(), c("asset_url")).alias("read"), F.coalesce(good, F.array().cast("array<string>")).alias("good"))
    out = rows.groupBy("page_id").agg(*[F.size(F.collect_set(x)).alias(n) for x, n in (("asset_url", "n_assets"), ("read", "n_read"))], F.collect_set("good").alias("g"))
    return out.select("page_id", "n_assets", "n_read", F.array_sort(F.array_distinct(F.flatten("g"))).alias("emails"))
