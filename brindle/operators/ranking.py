"""Window-shaped operators: latest, first, top-k, pages, percentiles and ordered folds. Every order ends in a key, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import materialize


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group. Spark limits each group before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def numbered(df: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Number of each row in its group, as :func:`ranked` gives, for groups too large for one task: rows are dealt by ranges of
    key and order, numbered within a range, and moved on by the counts of the group's earlier ranges. ``order`` tells rows of a group apart."""
    rows = materialize(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_part")) - F.col("_rows")
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_range"), before.alias("_before"))
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    both = within.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")))
    return both.select(*df.columns, (F.col("_in") + F.col("_before")).cast("int").alias(name))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page by ``TakeOrdered``, with ``has_more``: whether a row follows."""
    rows = df.orderBy(*order).limit(offset + limit + 1)
    n = Window.orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(n)).where(F.col("_n") > offset).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > offset + limit).where(F.col("_n") <= offset + limit).drop("_n")


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of a group: place round((n - 1) * p), half to even, of the sorted values. Gathers the
    group, so only for small ones; ``nearest_rank_by_counts`` is for any."""
    a = F.array_sort(F.collect_list(values))
    return F.element_at(a, F.bround((F.size(a) - 1) * p, 0).cast("int") + 1)


def nearest_rank_by_counts(df: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """The same percentile from counts per (group, value) and their running sum, without gathering a group."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_upto", F.sum("_n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    totals = n.groupBy(key).agg(F.sum("_n").alias("_all"))
    return n.join(totals, key).where(F.col("_upto") > F.bround((F.col("_all") - 1) * p, 0)).groupBy(key).agg(F.min(value).alias(name))


def failure_streaks(df: DataFrame, key: str, order: list[Column], failed: Column, cooldown: int = 3, disable: int = 5) -> DataFrame:
    """Running streak of failures per key, reset by a success, with the flags at ``cooldown`` and ``disable``."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(~failed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.when(F.col("_failed"), 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).withColumn("cooling", F.col("streak") >= cooldown).withColumn("disabled", F.col("streak") >= disable).drop("_failed", "_island")


def clamped_fold(df: DataFrame, key: str, order: str, step: Column, start: int = 100, low: int = 0, high: int = 100, chunk: int = 4096) -> DataFrame:
    """Running value per key that is held within bounds after each step.

    Clamped steps compose: any run of them is a shift, then a low and a high bound. Rows are range-partitioned by key and
    order, so a key of many rows spreads; every ``chunk`` rows become one such triple, and a key's triples are combined.
    """
    wide = 1 << 60
    clamp = lambda x: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x))
    rows = df.select(F.col(key), F.col(order).alias("o"), step.cast("long").alias("s")).repartitionByRange(key, "o", "s").withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(key, "_part").orderBy("o", "s")) - 1) / chunk))
    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(-wide).cast("long").alias("low"), F.lit(wide).cast("long").alias("high"))
    add = lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), clamp(acc["low"] + x["s"]).alias("low"), clamp(acc["high"] + x["s"]).alias("high"))
    steps = F.array_sort(F.collect_list(F.struct("o", "s")))
    triples = rows.groupBy(key, "_part", "_chunk").agg(F.aggregate(steps, none, add).alias("t"))
    at = lambda acc, x: F.greatest(x["t"]["low"], F.least(x["t"]["high"], acc + x["t"]["s"]))
    last = F.aggregate(F.array_sort(F.collect_list(F.struct("_part", "_chunk", "t"))), F.lit(start).cast("long"), at)
    return triples.groupBy(key).agg(last.cast("int").alias("value"))


def running_mean(df: DataFrame, key: str, order: str, value: str, limit: int = 100_000) -> DataFrame:
    """Mean updated one value at a time and rounded (half to even) at each step. Rounded steps do not compose, so a key's
    values are gathered; a key of more than ``limit`` values is an error, and no more than one above it are gathered."""
    rows = top_per_group(df.select(key, F.col(order).alias("o"), F.col(value).alias("v")), [key], [F.col("o"), F.col("v")], limit + 1)
    a = F.array_sort(F.collect_list(F.struct("o", "v")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("m"))
    step = lambda acc, x: F.struct((acc["n"] + 1).alias("n"), F.bround((acc["m"] * acc["n"] + x["v"]) / (acc["n"] + 1), 0).cast("int").alias("m"))
    over = F.raise_error(F.lit(f"running_mean: a key has more than {limit} values")).cast("int")
    return rows.groupBy(key).agg(a.alias("a")).select(key, F.when(F.size("a") > limit, over).otherwise(F.aggregate("a", start, step, lambda acc: acc["m"])).alias("mean"))


def early_stop(df: DataFrame, site: str, order: list[Column], useless: Column, limit: int = 3) -> DataFrame:
    """Pages a crawl would still read: those before ``limit`` useless pages in a row from the site's start.

    A page is left if it comes after the site's ``limit``-th useless page and no useful page comes before it. Both places are
    found by aggregates, so no task holds a site; a page without a verdict counts as neither.
    """
    rows = df.withColumn("_at", F.struct(*order)).withColumn("_useless", useless)
    third = top_per_group(rows.where("_useless"), [site], [F.col("_at")], limit).groupBy(F.col(site).alias("_site")).agg(F.max("_at").alias("_third"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
    useful = rows.where("not _useless").groupBy(F.col(site).alias("_where")).agg(F.min("_at").alias("_useful"))
    places = third.join(useful, F.col("_site").eqNullSafe(F.col("_where")), "left")
    left = (F.col("_at") > F.col("_third")) & (F.col("_useful").isNull() | (F.col("_at") <= F.col("_useful")))
    rows = rows.join(places, F.col(site).eqNullSafe(F.col("_site")), "left")
    return rows.select(*df.columns, (~F.coalesce(left, F.lit(False))).alias("visited"))


def ambiguous(df: DataFrame, key: str, score: str, tie: str, margin: int = 25) -> DataFrame:
    """Best of each key, and whether the next one is too near to tell."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("next_score", F.lead(score).over(w)).where("_n = 1").drop("_n")
    return rows.withColumn("ambiguous", F.coalesce(F.col("next_score") >= F.greatest(F.col(score) - margin, F.lit(1)), F.lit(False)))
