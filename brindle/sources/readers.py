"""Readers of recorded inputs, with declared schemas, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import contacts

ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
PLACES = "name string, keyword string, address string, phone string, website string, rating string, reviews string, place_id string, latitude string, longitude string, external_id string"
PLACE_EXPORT = ("name", "address", "phone", "website", "rating", "reviews", "latitude", "longitude")
REQUESTS = "id long, provider string, request_kind string, url string, used_proxy boolean, status_code int, duration_ms int, error string, created_at timestamp"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per map element of recorded JSON answers. A position comes from the element, else from its centre; a
    coordinate of 0 counts as missing."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    position = lambda k: F.coalesce(F.nullif(F.col(f"e.{k}"), F.lit(0.0)), F.col(f"e.center.{k}"))
    return e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("external_ref"), position("lat").alias("lat"), position("lon").alias("lon"), F.col("e.tags").alias("tags"))


def matches_tags(tags, include: list[tuple[str, str]], exclude: list[tuple[str, str]] | None = None):
    """Any of ``include`` holds; ``exclude`` is applied only if given."""
    one = lambda pairs: F.array_contains(F.array(*[F.coalesce(tags[k] == v, F.lit(False)) for k, v in pairs]), True) if pairs else F.lit(False)
    return one(include) & ~one(exclude or [])


TAG_CONTACTS = (
    ("email", "email"), ("contact:email", "email"), ("phone", "phone"), ("contact:phone", "phone"), ("mobile", "phone"), ("contact:mobile", "phone"),
    ("whatsapp", "whatsapp"), ("contact:whatsapp", "whatsapp"), ("telegram", "telegram"), ("contact:telegram", "telegram"),
)


def tag_contacts(elements: DataFrame) -> DataFrame:
    """(external_ref, tag, kind, value) of the contact tags of each element; a tag may hold several values."""
    one = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(k).alias("kind"), F.col("tags")[t].alias("raw")) for t, k in TAG_CONTACTS])
    rows = elements.select("external_ref", F.explode(one).alias("x")).where("x.raw is not null")
    return rows.select("external_ref", "x.tag", "x.kind", F.explode(contacts.tag_values(F.col("x.raw"))).alias("value"))


def place_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACES).json(path)


def phone_csv(spark: SparkSession, path: str) -> DataFrame:
    """First column of an uploaded list: mark of encoding and quotes stripped, headings and blanks skipped."""
    first = F.btrim(F.regexp_replace(F.regexp_replace(F.col("_c0"), "^﻿", ""), "^[\"']+|[\"']+$", ""))
    rows = spark.read.option("header", False).option("encoding", "UTF-8").csv(path)
    return rows.select(first.alias("original")).where((F.col("original") != "") & ~F.lower("original").startswith("phone"))


def number_list(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of recorded list jobs (JSON objects with ``job_id`` and ``phone_numbers``): trimmed, blanks dropped. ``position`` counts
    from 0 over the whole list and ``total_numbers`` counts the blanks too."""
    jobs = spark.read.schema("job_id string, phone_numbers array<string>").option("multiLine", True).json(path)
    rows = jobs.select("job_id", F.size("phone_numbers").alias("total_numbers"), F.posexplode("phone_numbers").alias("position", "raw"))
    return rows.select("job_id", "total_numbers", "position", F.btrim("raw").alias("phone")).where("phone <> ''")


def blocklist(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """Throwaway domains: lower case, no blanks or comments. A list of fewer than ``least`` is taken for broken: the seed list stands in."""
    d = F.lower(F.btrim("value"))
    found = spark.read.text(path).select(d.alias("domain")).where((d != "") & ~d.startswith("#")).distinct()
    if found.limit(least).count() < least:
        return spark.createDataFrame([(x,) for x in contacts.DISPOSABLE_SEED], "domain string")
    return found


def export_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """CSV with a heading, written in parallel."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def append_requests(df: DataFrame, path: str) -> None:
    """Appends request rows with the log's widths."""
    cut = lambda name, n: F.substring(name, 1, n).alias(name)
    kept = [cut("url", 500) if f == "url" else cut("error", 500) if f == "error" else F.col(f) for f in df.columns]
    df.select(*kept).write.mode("append").parquet(path)
