"""Components of items that share a key, without ever gathering a key's items in one place."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.storage import materialize

BLOCK = 256


class Compare(Protocol):
    """Which pairs of items are alike. ``prepare`` reads the items of one place, an Arrow array, once. A pair that meets on several paths,
    named by ``path`` for each pair, need be found on one of them only. A compare that also has ``tokens``, as many different numbers
    for each item, and ``spare``, so many of which two alike items may lack of each other's, names its own paths, see :func:`rare_tokens`."""

    def prepare(self, data: pa.Array) -> Any: ...

    def pairs(self, items: Any, i: np.ndarray, j: np.ndarray, path: np.ndarray | None = None) -> np.ndarray: ...


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over ``n`` local nodes: the least member of each node's set."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.asarray([find(v) for v in range(n)])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of each run of equal keys, from batches sorted by them."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and rows:
                yield rows
                rows = []
            last = key
            rows.append(row)
    if rows:
        yield rows


def batched(groups: Iterator[list[dict]], rows: int = 2048, size: int = 1 << 22, data: str = "data") -> Iterator[list[list[dict]]]:
    """Groups put together until they have so many rows or bytes of data."""
    held, n, total = [], 0, 0
    for g in groups:
        held.append(g)
        n, total = n + len(g), total + sum(len(r[data]) for r in g)
        if n >= rows or total >= size:
            yield held
            held, n, total = [], 0, 0
    if held:
        yield held


def block_pairs(rows: DataFrame, size: str, blocks: str, by: str) -> DataFrame:
    """Deal the rows of a group into ``blocks`` blocks by a hash of ``by``; each row goes to the pairs of blocks (bi, bj)
    with its own, so every two rows of a group meet in exactly one place, and no place holds more than two blocks."""
    b = F.pmod(F.xxhash64(by), F.col(blocks)).cast("int")
    return rows.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", size, blocks)


def cross_pairs(rows: DataFrame, group: str, kind: str, by: str) -> DataFrame:
    """Like :func:`block_pairs`, for pairs of different ``kind`` only: rows of a group's most frequent kind never meet each
    other, and a group of one kind has no rows here, so a group of one large kind and few other rows costs in proportion to its rows times these few."""
    kinds = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    large = kinds.groupBy(group).agg(F.max(F.struct("n", kind)).alias("top"), F.sum("n").alias("all"))
    ceil = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    large = large.select(group, F.col(f"top.{kind}").alias("major"), ceil(F.col("all") - F.col("top.n")).alias("few"), ceil(F.col("top.n")).alias("many")).where("few > 0")
    own = F.xxhash64(by)
    is_major = F.col(kind) == F.col("major")
    dealt = rows.join(large, group).withColumn("b", F.when(is_major, F.col("few") + F.pmod(own, F.col("many"))).otherwise(F.pmod(own, F.col("few"))).cast("int"))
    met = F.when(is_major, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0), met))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", "major", "few", "many")


class Roots:
    """Union-find over the distinct roots that one task meets; each joined pair of roots leaves the task once."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, v: int) -> int:
        top = v
        while (up := self.parent.get(top, top)) != top:
            top = up
        while v != top:
            self.parent[v], v = top, self.parent.get(v, v)
        return top

    def tops(self, roots: np.ndarray) -> np.ndarray:
        each, at = np.unique(roots, return_inverse=True)
        return np.asarray([self.find(v) for v in each.tolist()], np.int64)[at]

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in set(zip(left.tolist(), right.tolist())):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        below = [v for v in self.parent if self.find(v) != v]
        return below, [self.find(v) for v in below]


def held_columns(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 2048, size: int = 1 << 22, data: str = "data") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches sorted by ``keys``, cut and joined at ends of groups so that each has so many rows or bytes of data, or is one
    group; with each group's first and end row."""

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    def give(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        off = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(data)).to_numpy())])
        a = 0
        while a < len(ends) - 1:
            most = min(np.searchsorted(ends, ends[a] + rows), np.searchsorted(off[ends], off[ends[a]] + size))
            b = max(a + 1, min(int(most), len(ends) - 1))
            yield batch.slice(ends[a], ends[b] - ends[a]), ends[a:b] - ends[a], ends[a + 1 : b + 1] - ends[a]
            a = b

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            batch, held = whole([*held, batch]), []
        at = cut(batch)
        if not held and len(at):
            yield from give(batch.slice(0, at[-1]), np.concatenate([[0], at]))
            batch = batch.slice(at[-1])
        elif held and len(at):
            first = whole([*held, batch.slice(0, at[0])])
            yield from give(first, np.asarray([0, first.num_rows]))
            yield from give(batch.slice(at[0], at[-1] - at[0]), at - at[0])
            batch, held = batch.slice(at[-1]), []
        held.append(batch)
    if held:
        last = whole(held)
        yield from give(last, np.asarray([0, last.num_rows]))


def pairs_of(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of the same group, for groups of rows [first, end)."""
    n = np.repeat(end, end - first) - np.arange(first[0], end[-1]) - 1
    i = np.repeat(np.arange(first[0], end[-1]), n)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def in_play(bi: int, bj: int, b: np.ndarray) -> np.ndarray:
    """Pairs of rows that are this place's to compare: across its two blocks, or within its only one."""
    pairs = np.triu(np.ones((len(b), len(b)), bool), 1)
    return pairs if bi == bj else pairs & (b[:, None] != b[None, :])


def rare_tokens(items: DataFrame, compare: Any) -> DataFrame:
    """(path, alias): paths on which all alike items of different components meet. items: alias, root, data.

    An item lists its tokens in one order for all, and keeps the first ``spare`` + 1: alike items then have one in common.
    Tokens that stand in one component only come first and join nothing, so they are no paths; the rest are ordered
    by how many items have them. Items that share less than alike ones do, such as a common passage, keep none or few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = compare.tokens(batch.column("data"))
                rows = [np.repeat(batch.column(c).to_numpy(), tokens.shape[1]) for c in ("alias", "root")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, tokens.ravel())], names=["alias", "root", "token"])

    every = materialize(items.select("alias", "root", "data").mapInArrow(run, "alias long, root long, token long"), "tokens")
    several = every.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "n")
    listed = every.join(several, "token").groupBy("alias").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    first = F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - (compare.size - compare.spare - 1)))
    return listed.select("alias", F.explode(first).alias("x")).select(F.col("x.token").alias("path"), "alias")


def components_of_shared(paths: DataFrame, payload: DataFrame, compare: Compare) -> DataFrame:
    """(node, root): components of items that share a path and are alike. paths: path, alias; payload: alias, data.

    First each path's items are compared with its least one only, which links groups of copies at a cost in
    proportion to their rows. Only paths whose items then lie in several components are compared in full, across
    components: at once where they are few, in pairs of blocks where they are many. If the compare has tokens, the items of
    such paths meet by their rare tokens instead, so that a path of many items that are not alike makes no pairs of blocks. A task
    joins components as it finds them, compares no pair it has joined already, and gives each component it has hung under another once.
    """
    shared = paths.groupBy("path").agg(F.min("alias").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("path", "pivot")
    members = materialize(paths.join(shared, "path"), "members")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                items = compare.prepare(pa.concat_arrays([batch.column("data"), batch.column("pivot_data")]))
                yield batch.select(["alias", "pivot"]).filter(pa.array(compare.pairs(items, np.arange(n), np.arange(n) + n)))

    # dealt by alias first, distinct pairs need no exchange beside that of the join
    stars = members.where("alias <> pivot").select("alias", "pivot").repartition("alias").distinct().join(payload, "alias").join(payload.select(F.col("alias").alias("pivot"), F.col("data").alias("pivot_data")), "pivot")
    stars = stars.select("alias", "pivot", "data", "pivot_data").mapInArrow(near, "alias long, pivot long")
    first = materialize(connected_components(stars, "alias", "pivot"), "first")

    def placed(members: DataFrame) -> DataFrame:
        at = members.join(first.withColumnRenamed("node", "alias"), "alias", "left").select("path", "alias", F.coalesce("root", "alias").alias("root"))
        return materialize(at, "placed")

    left_over = placed(members)
    if hasattr(compare, "tokens"):
        several = left_over.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("path")
        left_over = placed(rare_tokens(left_over.join(several, "path").select("alias", "root").distinct().join(payload, "alias"), compare))
    rows = cross_pairs(left_over, "path", "root", "alias").join(payload, "alias")
    rows = rows.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Roots()
        for held, start, end in held_columns(batches, ["path", "bi", "bj"]):
            path, bi, bj, block, roots = (held.column(c).to_numpy() for c in ("path", "bi", "bj", "b", "root"))
            tops = known.tops(roots)
            i, j = pairs_of(start, end)
            ok = (tops[i] != tops[j]) & ((bi[i] == bj[i]) | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            if len(i):
                ok = compare.pairs(compare.prepare(held.column("data")), i, j, path[i])
                known.join(tops[i[ok]], tops[j[ok]])
        a, b = known.edges()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = rows.select("path", "bi", "bj", "b", "alias", "root", "data").mapInArrow(link, "a long, b long")
    joined = materialize(connected_components(more, "a", "b"), "second").select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = first.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionAll(joined.select(F.col("root").alias("node"), F.col("top").alias("root")))
    return materialize(out.distinct(), "components")
