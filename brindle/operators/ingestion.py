"""Source records made into companies and links, written as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.operators.companies import match_cascade
from brindle.operators.ranking import top_per_group
from brindle.operators.tables import KeyedTable
from brindle.storage import materialize

COMPANIES = "company_key string, region_id bigint, name string, website_url string, source string, external_ref string"
LINKS = "source string, external_id string, company_key string, merge_status string, matched_by string, first_batch int"
REF_WIDTH = 128


def materialize_sources(records: DataFrame, source: str, companies: DataFrame, phones: DataFrame, stored_links: DataFrame, created: KeyedTable, links: KeyedTable, batch: int) -> bool:
    """Match a batch of source records to companies, create those that are missing, and link each record; False for a batch that is there already.

    records: seq, external_id, name, website, phone, region_id. companies (company_key, region_id, website_url), phones (company_key, phone) and
    stored_links (external_id, company_key) are what there was before any batch; ``created`` and ``links`` hold what batches add. A record follows its link,
    else a company of its website in its region, else one of its phone there; records of a batch that no company fits share one if they share a website and region.
    A record without an external id cannot be linked and is left out. Companies are written before links, each safe under a repeat, so a
    writer that dies between the two is mended by giving its batch again.
    """
    if links.manifest()["batches"].get(source, -1) >= batch:
        return False
    records = top_per_group(records.where("external_id <> ''"), ["external_id"], [F.col("seq")])
    # a company that this batch made before it died is not one that the batch finds
    earlier = created.read().where(F.col("source") == source).join(links.read().select("company_key").distinct(), "company_key", "left_semi")
    known = companies.select("company_key", "region_id", "website_url").unionByName(earlier.select("company_key", "region_id", "website_url"))
    linked = stored_links.select("external_id", "company_key").unionByName(links.read().where(F.col("source") == source).select("external_id", "company_key"))
    staged = records.withColumnRenamed("external_id", "source_id")
    as_id = lambda df: df.withColumnRenamed("company_key", "company_id")
    found = match_cascade(staged, as_id(linked).withColumnRenamed("external_id", "source_id"), as_id(known), as_id(phones))
    rows = materialize(records.join(found.withColumnRenamed("company_id", "company_key"), "seq"), "matched")
    group = F.coalesce(F.concat_ws("/", F.col("region_id").cast("string"), urls.website_key(F.col("website"))), F.col("external_id"))
    group = F.when(urls.website_key(F.col("website")).isNotNull(), group).otherwise(F.concat(F.lit("id/"), F.col("external_id")))
    new = rows.where("matched_by = 'new'").withColumn("_group", group)
    first = new.groupBy("_group").agg(F.min_by("external_id", F.struct("seq", "external_id")).alias("_first"))
    new = new.join(first, "_group").withColumn("company_key", F.concat(F.lit(f"{source}/"), F.col("_first")))
    makes = F.col("_first") == F.col("external_id")
    made = new.where(makes).select("company_key", F.col("region_id").cast("long").alias("region_id"), "name", F.col("website").alias("website_url"), F.lit(source).alias("source"), F.substring("external_id", 1, REF_WIDTH).alias("external_ref"))
    created.insert(made, [F.col("company_key")], writer=source, batch=batch)
    link = lambda df, status, how: df.select(F.lit(source).alias("source"), "external_id", "company_key", status.alias("merge_status"), how.alias("matched_by"), F.lit(batch).alias("first_batch"))
    added = link(rows.where("matched_by <> 'new'"), F.lit("matched"), F.col("matched_by")).unionByName(link(new, F.when(makes, "merged").otherwise("matched"), F.when(makes, "new").otherwise("website")))
    return links.insert(added, [F.col("external_id")], writer=source, batch=batch)
