"""Which row is which, where ids are null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def id_key(doc_id: str = "doc_id") -> Column:
    """A document's id, NO_ID for null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_key(text: str = "text") -> Column:
    """With the id, what tells texts apart that share an id; rows equal in both are copies of one document."""
    return F.xxhash64(text)


def one_of_copies(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row of each group of ``keys``, that of the least hash of all columns, so reruns agree. Each task gives a
    group's best row only once."""
    best = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_brindle_row")
    return rows.groupBy(*keys).agg(best).select("_brindle_row.*")
