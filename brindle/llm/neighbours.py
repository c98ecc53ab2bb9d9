"""Nearest neighbours by cosine with randomly rotated one-bit codes and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.blocks import against_all
from brindle.storage import materialize

CODES = "vec_id long, vec binary, code binary, fit float"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in column.to_pylist():
        x = np.asarray([np.nan if c is None else c for c in v], np.float64) if v else None
        out.append(x if x is not None and np.isfinite(x).all() and (x != 0).any() else None)
    return out


def build_index(vectors: DataFrame, **options) -> DataFrame:
    """:func:`encode` with a number for each row, written once, so a search and the choice of its queries read the same
    codes and numbers."""
    return materialize(encode(vectors, **options).withColumn("row", F.monotonically_increasing_id()), "codes")


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """The index: each usable vector, the packed signs of its rotated unit vector, and ``fit``, the inner product of
    that unit vector with its code. Rows whose vector or id is null, or whose vector is empty, zero or not finite, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vecs, codes, fits = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), _usable(batch.column(1))):
                if x is None or i is None:
                    continue
                turn = turns.setdefault(len(x), rotation(len(x), seed)) if len(x) not in turns else turns[len(x)]
                scaled = scaled_rows(x[None, :])[0]
                y = turn @ (scaled / np.linalg.norm(scaled))
                ids.append(i)
                vecs.append(x.tobytes())
                codes.append(np.packbits(y > 0).tobytes())
                fits.append(np.float32(np.abs(y).sum() / np.sqrt(len(y))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(codes, pa.binary()), pa.array(fits, pa.float32())], names=["vec_id", "vec", "code", "fit"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).mapInArrow(run, CODES)


def scaled_rows(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to 0.5 up to 1: no square over- or underflows, and no digit
    of a cosine changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def _cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of scaled vectors, in double precision and one fixed order of additions, so equal vectors have equal scores."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


class _Queries:
    """Queries of one dimension of a block, and the k best of the rows each has met."""

    def __init__(self, block: pa.Table, at: np.ndarray, dim: int, seed: int, k: int, eps: float):
        own = block.take(pa.array(at))
        self.ids, self.rows = own.column("vec_id").to_numpy(), own.column("row").to_numpy()
        self.vecs = scaled_rows(np.frombuffer(b"".join(own.column("vec").to_pylist()), np.float64).reshape(-1, dim))
        unit = self.vecs / np.linalg.norm(self.vecs, axis=1, keepdims=True)
        self.unit, self.dim, self.k, self.eps = (unit @ rotation(dim, seed).T).astype(np.float32), dim, k, eps
        self.found, self.score = np.zeros((len(at), k), np.int64), np.full((len(at), k), -np.inf)

    def meet(self, table: pa.Table, part: int = 256) -> None:
        """A code estimates <q, x> as <q', sign> / (sqrt(D) fit), off by more than eps * sqrt((1 - fit^2) / (D - 1)) / fit with
        vanishing probability. The rows of best estimates are scored exactly; of the others only those whose upper bound
        reaches the k-th best of all scores so far are."""
        ids, own, fit = table.column("vec_id").to_numpy(), table.column("row").to_numpy(), table.column("fit").to_numpy()
        vecs = scaled_rows(np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, self.dim))
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        sign, k = np.unpackbits(codes, axis=1, count=self.dim).astype(np.float32) * 2 - 1, self.k
        err = self.eps * np.sqrt(np.maximum(0, 1 - fit * fit) / max(1, self.dim - 1)) / fit + 1e-5
        where = {r: n for n, r in enumerate(own.tolist())}
        for c in range(0, len(self.ids), part):
            est = (self.unit[c : c + part] @ sign.T) / (np.sqrt(self.dim) * fit)
            high = est + err
            for q in range(c, min(c + part, len(self.ids))):
                if (self_row := where.get(int(self.rows[q]))) is not None:
                    high[q - c, self_row] = -np.inf
                    est[q - c, self_row] = -np.inf
                least = self.score[q, -1]
                if len(ids) > 8 * k:
                    first = np.argpartition(-est[q - c], 4 * k)[: 4 * k]
                    first = first[est[q - c][first] > -np.inf]
                    least = np.sort(np.concatenate([self.score[q], _cosines(vecs[first], self.vecs[q])]))[-k]
                cand = np.flatnonzero((high[q - c] >= least - 1e-9) & (high[q - c] > -np.inf))
                if len(cand):
                    score = np.concatenate([self.score[q], _cosines(vecs[cand], self.vecs[q])])
                    found = np.concatenate([self.found[q], ids[cand]])
                    best = np.lexsort((found, -score))[:k]
                    self.found[q], self.score[q] = found[best], score[best]

    def best(self) -> pa.RecordBatch:
        q, r = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.rows[q]), pa.array(self.found[q, r]), pa.array(self.score[q, r])], names=["query_id", "query_row", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, eps: float = 4.0, rows_per_block: int = 4096, queries_per_block: int = 8192, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of the whole index for each query, in blocks.

    Rows and queries are both as from :func:`build_index`. Rows stay where they are: each task reads its own once for each block of queries
    (``queries_per_block`` at most, and a bounded number of bytes), ``rows_per_block`` at a time, and gives at most k rows a query, which are
    ranked after one shuffle by query. Nearest first, ties to the smaller vec_id; a query's own row, not another of its vec_id,
    is no candidate, and rows that repeat a query are queries of their own. Only vectors of the query's dimension are compared; their
    length does not matter, from the least double to the largest. Fewer rows than k give fewer ranks; equal vectors are all reranked, so copies
    never hide one another.
    """

    def run(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = np.asarray([len(v) // 8 for v in block.column("vec").to_pylist()])
        met = {d: _Queries(block, np.flatnonzero(dims == d), d, seed, k, eps) for d in np.unique(dims).tolist()}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = np.asarray([len(v) // 8 for v in table.column("vec").to_pylist()])
            for d in np.unique(own).tolist():
                rows = table.filter(pa.array(own == d)) if d in met else table.slice(0, 0)
                for c in range(0, rows.num_rows, rows_per_block):
                    met[d].meet(rows.slice(c, rows_per_block))
        for q in met.values():
            yield q.best()

    queries = queries.select("row", "vec_id", "vec")
    size = queries.agg(F.max(F.length("vec"))).first()[0] or 1
    found = against_all(index, queries, run, "query_id long, query_row long, vec_id long, score double", query_bytes=4 * size, name="nearest", most=queries_per_block)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
