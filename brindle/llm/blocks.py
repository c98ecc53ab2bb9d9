"""A stated set of queries against all rows, in blocks: rows stay where they are, one bounded block of queries goes to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import materialize, new_folder

#: Bytes of one block of queries, at most.
BLOCK_BYTES = 1 << 25


def _dealt(queries: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The queries with a block number of hash of ``row``; blocks are doubled until the largest has at most ``most`` rows."""
    n = queries.count()
    blocks = max(1, -(-n // most))
    while True:
        out = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        largest = out.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return out, blocks
        blocks *= 2


def against_all(rows: DataFrame, queries: DataFrame, run: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, query_bytes: int, name: str, most: int = 8192) -> DataFrame:
    """What ``run(block, batches)`` gives for each block of queries and each task's stream of ``rows``, as one table.

    A block has at most ``most`` queries and ``BLOCK_BYTES`` bytes (``query_bytes`` bounds one query); it is counted before it
    is taken to the driver and broadcast, and dropped after its pass. Queries carry a number ``row`` of their own. Without
    queries the table is empty.
    """
    spark = rows.sparkSession
    queries, blocks = _dealt(queries, max(1, min(most, BLOCK_BYTES // max(1, query_bytes))))
    if blocks > 1:
        queries = materialize(queries, f"{name}-queries")
    folder = new_folder(spark, name)
    rows.sparkSession.createDataFrame([], schema).write.parquet(folder)
    for b in range(blocks):
        block = queries.where(F.col("block") == b).drop("block").toArrow()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast(block)
        rows.mapInArrow(lambda batches, sent=sent: run(sent.value, batches), schema).write.mode("append").parquet(folder)
        sent.destroy()
    return spark.read.schema(schema).parquet(folder)
