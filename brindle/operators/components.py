"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import materialize

#: Edges that a task's union-find holds at once; a few MB.
CHUNK = 1 << 18


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """The edges of each task as stars: a union-find over ``chunk`` of them at a time, its least node the centre."""
    kind = edges.schema["hi"].dataType.simpleString()

    def stars(pairs: list[tuple], types: pa.DataType) -> pa.RecordBatch:
        parent: dict = {}

        def find(v):
            top = v
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[v] != top:
                parent[v], v = top, parent[v]
            return top

        for hi, lo in pairs:
            hi, lo = find(hi), find(lo)
            if hi != lo:
                parent[max(hi, lo)] = min(hi, lo)
        nodes = [v for v in parent if find(v) != v]
        return pa.RecordBatch.from_arrays([pa.array(nodes, types), pa.array([find(v) for v in nodes], types)], names=["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = [], None
        for batch in batches:
            types = batch.schema.field(0).type
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= chunk:
                yield stars(held[:chunk], types)
                held = held[chunk:]
        if held:
            yield stars(held, types)

    return edges.mapInArrow(run, f"hi {kind}, lo {kind}")


def _dealt(edges: DataFrame, chunk: int) -> DataFrame:
    """The edges contracted where they are, then by their larger end. A task gives a node only one smaller end, so no node brings
    more rows to its place than there were tasks, and all smaller ends of a node are joined there."""
    return _contracted(_contracted(edges, chunk).repartition("hi"), chunk)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs under one node only, and none of these hangs itself."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Distributed union-find: contraction within tasks, between alternating large-star and small-star steps.

    Each task first contracts its own edges to stars, ``chunk`` edges at a time, and these are dealt by their larger ends and
    contracted again, which leaves few rounds or none. Each round hangs every node under the smallest neighbour known so far; a hub's edges are only ever
    reduced with ``min`` (map-side combined) and joined back, so no node's neighbours meet in one task. Rounds end when
    the edges are a forest of stars. Null ends and self-loops are ignored; edges that are none after ``max_rounds`` are an
    error. Returns (node, root): every node of a non-loop edge, with root the smallest node of its component.
    """
    cur = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    cur = materialize(_dealt(cur, chunk), "edges")
    rounds = 0
    while not _is_forest_of_stars(cur):
        if rounds == max_rounds:
            raise RuntimeError(f"connected_components: no fixed point after {max_rounds} rounds")
        rounds += 1
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes under u's smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.unionAll(least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo"), "edges")
        # small star: every smaller neighbour of u, and u, go under u's smallest neighbour
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = small.select(F.col("lo").alias("x"), "m").unionAll(low.select(F.col("hi").alias("x"), "m"))
        cur = materialize(_dealt(small.where("x <> m").select(F.col("x").alias("hi"), F.col("m").alias("lo")), chunk), "edges")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
