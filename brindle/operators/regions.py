"""Countries and their subdivisions: the catalogue of regions, and hierarchies by parent links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.storage import materialize

c = F.col
COUNTRY_LEVEL, SUBDIVISION_LEVEL = 2, 4


def countries(spark: SparkSession) -> DataFrame:
    """(code, name) of the two-letter country codes that the JVM knows, with its English names."""
    locale = spark._jvm.java.util.Locale
    rows = [(str(code), str(locale("", code).getDisplayCountry(locale.ENGLISH))) for code in locale.getISOCountries()]
    return spark.createDataFrame(rows, "code string, name string").coalesce(1)


def one_per_code(divisions: DataFrame) -> DataFrame:
    """(code, name, country_code, parent_code), codes in upper case; of repeated codes the row of the least parent (none first), country and name. Null codes go."""
    rows = divisions.select(F.upper(F.btrim("code")).alias("code"), F.struct(F.upper(F.btrim(F.nullif("parent_code", F.lit("")))).alias("parent_code"), F.upper("country_code").alias("country_code"), "name").alias("r"))
    return rows.where(c("code").isNotNull()).groupBy("code").agg(F.min("r").alias("r")).select("code", "r.name", "r.country_code", "r.parent_code")


def region_catalog(known: DataFrame, divisions: DataFrame, is_active: Column) -> DataFrame:
    """(code, name, country_code, level, is_active): countries, and their subdivisions without a parent under ``name [code], country``. Nested
    ones and those of unknown countries are left out. ``is_active`` reads country_code.

    Countries are few, so Spark broadcasts them by its size threshold.
    """
    known = known.select(F.upper("code").alias("country_code"), c("name").alias("country")).where(c("country_code").isNotNull()).groupBy("country_code").agg(F.min("country").alias("country"))
    top = one_per_code(divisions).where(c("parent_code").isNull()).join(known, "country_code")
    below = top.select("code", F.concat("name", F.lit(" ["), "code", F.lit("], "), "country").alias("name"), "country_code", F.lit(SUBDIVISION_LEVEL).alias("level"))
    above = known.select(c("country_code").alias("code"), c("country").alias("name"), "country_code", F.lit(COUNTRY_LEVEL).alias("level"))
    return above.unionByName(below).withColumn("is_active", F.coalesce(is_active, F.lit(False)))


def region_tree(divisions: DataFrame, max_depth: int = 64) -> DataFrame:
    """(code, root, depth, state) of each code. state is ``ok``, or why there is no root: ``unknown parent`` (here or above), ``cycle`` (on it, below it, or
    deeper than ``max_depth``); root and depth are then null. A root has depth 0.

    Every round doubles the links a row has climbed, so the rounds are log2(max_depth), not the depth; only rows still climbing are joined.
    A parent of very many rows is a hot key of the larger side only, which Spark splits.
    """
    rows = one_per_code(divisions).select("code", F.coalesce("parent_code", "code").alias("up"), F.when(c("parent_code").isNull(), 0).otherwise(1).alias("steps"), c("parent_code").isNull().alias("done"))
    at = materialize(rows.withColumn("lost", F.lit(False)), "tree")
    reach = 1
    while reach < max_depth * 2 and not at.where("not done").isEmpty():
        to = at.select(c("code").alias("up"), c("up").alias("next"), c("steps").alias("more"), c("done").alias("rooted"), c("lost").alias("gone"))
        climbing = at.where("not done").join(to, "up", "left")
        missing = c("next").isNull() | c("gone")
        moved = climbing.select("code", F.when(~missing, c("next")).otherwise(c("up")).alias("up"), (c("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (missing | c("rooted")).alias("done"), missing.alias("lost"))
        at = materialize(at.where("done").unionByName(moved), "tree")
        reach *= 2
    ended = c("done") & (c("steps") <= max_depth)
    ok = ended & ~c("lost")
    state = F.when(ok, "ok").when(ended, "unknown parent").otherwise("cycle")
    return at.select("code", F.when(ok, c("up")).alias("root"), F.when(ok, c("steps")).alias("depth"), state.alias("state"))
