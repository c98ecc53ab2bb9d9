"""Recorded lookups against a cache of earlier results: an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import materialize


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows of ``left`` with ``values`` and time (``found_at``) of the latest row of ``right`` of the same key at or before ``at``.

    Of rows of one key and time the last by ``order`` counts. Both sides are put together, dealt by ranges of key and time, and the
    last result is carried forward within each range; what a range ends with is carried on to the key's later ranges, so a key of any number of rows
    is no single task. A null key or time finds nothing.
    """
    kept = F.max_by(F.struct(*values, F.col(at).alias("found_at")), F.struct(*order)).alias("_found")
    stored = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(kept).withColumn("_row", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType))
    asked = left.select(key, at, F.lit(None).cast(stored.schema["_found"].dataType).alias("_found"), F.struct(*left.columns).alias("_row"))
    both = stored.select(key, at, "_found", "_row").unionAll(asked).withColumn("_asks", F.col("_row").isNotNull().cast("int"))
    both = materialize(both.repartitionByRange(key, at, "_asks").withColumn("_part", F.spark_partition_id()), "lookups")
    ends = both.where("_found is not null").groupBy(key, "_part").agg(F.max_by("_found", at).alias("_end"))
    before = F.last("_end", True).over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = both.select(key, "_part").distinct().join(ends, [key, "_part"], "left").withColumn("_before", before)
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_range"), "_before")
    within = Window.partitionBy(key, "_part").orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_found", True).over(within)).where("_row is not null")
    out = carried.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")), "left").withColumn("_last", F.coalesce("_last", "_before"))
    out = out.withColumn("_last", F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("_last")))
    return out.select("_row.*", "_last.*")


def cached_answers(lookups: DataFrame, results: DataFrame, key: str, at: str, order: list[str], values: list[str], ttl: Column) -> DataFrame:
    """Lookups with whether the cache answered (``hit``), the result's age in seconds, and its ``values``, null on a miss. A result is
    good for ``ttl`` seconds of the lookup's own, its last second included."""
    out = latest_before(lookups, results, key, at, order, values)
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("found_at").cast("timestamp"))
    hit = F.coalesce(age <= ttl.cast("long") * 1_000_000, F.lit(False))
    return out.select(*lookups.columns, hit.alias("hit"), F.when(hit, F.floor(age / 1_000_000).cast("long")).alias("age_seconds"), *[F.when(hit, F.col(v)).alias(v) for v in values])
