"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, most: int, seed: int, by: str | None = None) -> list[Row]:
    """At most ``most`` different rows, or so many of each value of ``by``, on the driver: those of least hash of all columns.

    Rows that repeat count once, and null or repeated ids are told apart by their other columns. A first cut by
    the counts keeps about twice as many, so no more than these are ever moved. Null values of ``by`` are left out.
    """
    columns = rows.columns
    rows = rows.withColumn("_by", F.col(by).cast("string") if by else F.lit("")).where("_by is not null").withColumn("_draw", F.xxhash64(*columns, F.lit(seed)))
    counts = [(r["_by"], r["n"]) for r in rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts:
        return []
    # values of ``by`` are classes of a model, so few; a map of their counts needs no join, and no shuffle of texts
    total = F.create_map(*[F.lit(x) for pair in counts for x in pair])[F.col("_by")]
    place = F.pmod(F.col("_draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(place < 2.0 * most / total).dropDuplicates(["_by", "_draw"])
    least = Window.partitionBy("_by").orderBy("_draw")
    return picked.withColumn("_rank", F.row_number().over(least)).where(F.col("_rank") <= most).select(*columns).collect()
