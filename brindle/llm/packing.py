"""Packing documents into fixed windows with lexically related neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import mix, runs
from brindle.llm.tokens import encoder
from brindle.storage import materialize

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of ids that one task packs, about.
TASK = 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _places(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A locality key for each text: the least hash of its runs of three ids, or of single ids where it has fewer."""
    out = np.zeros(len(off) - 1, np.uint64)
    n = np.diff(off)
    v = ids.astype(np.uint64)
    if len(v) > 2:
        three = (v[:-2] * np.uint64(1 << 40) + v[1:-1] * np.uint64(1 << 20) + v[2:]) * _SPREAD
        last = np.zeros(len(v) + 1, bool)  # runs that would cross into the next text
        for back in (1, 2):
            last[np.maximum(off[1:] - back, 0)] = True
        three[last[: len(three)]] = np.iinfo(np.uint64).max
        some = np.flatnonzero(n > 2)
        out[some] = np.minimum.reduceat(three, off[some]) if len(some) else 0
    for k in np.flatnonzero((n > 0) & (n < 3)).tolist():
        out[k] = (v[off[k] : off[k + 1]] * _SPREAD).min()
    # long texts have smaller minima: mixed again, so that they lie among all others
    return (mix(out) >> np.uint64(1)).astype(np.int64)


def _tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, place): ids as bytes of 16 or 32 bits, and a locality key, the least hash of a three-id run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for i, j, ids, off in encode.blocks(batch.column("text")):
                places = _places(ids, off)
                whole = np.insert(ids, off[1:], end_id)
                at = off + np.arange(len(off))
                if not len(whole) or whole.max() < 1 << 16:
                    raw = whole.astype("<u2")
                    rows = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                else:
                    rows = pa.array([b"\0" + whole[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), rows, pa.array(places)], names=["doc_id", "ids", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, place long")


def _unpack(data: bytes) -> np.ndarray:
    """Narrow ids have an even number of bytes, wide ones are marked by a leading byte."""
    return np.frombuffer(data, "<u2").astype("<u4") if len(data) % 2 == 0 else np.frombuffer(data, "<u4", offset=1)


def document_frequencies(tokens: DataFrame, vocabulary: int) -> tuple[int, float, np.ndarray]:
    """Documents, mean length, and in how many documents each id stands, over all documents.

    Tasks count into one array of the vocabulary's size; the sum of these is at most one row per id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(vocabulary + 1, np.int64), 0, 0
        last = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v = _unpack(data)
                at = np.arange(len(v))
                last[v] = at  # of an id's places one stays, and only that one counts
                df[v[last[v] == at]] += 1
                n, total = n + 1, total + len(v)
        df[vocabulary] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64()), pa.array(np.where(at == vocabulary, total, 0), pa.int64())], names=["id", "n", "total"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long, total long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    df = np.zeros(vocabulary, np.int64)
    n = total = 0
    for r in rows:
        if r.id == vocabulary:
            n, total = r["n"], r.total
        else:
            df[r.id] = r["n"]
    return n, total / max(1, n), df


class Index:
    """A BM25 inverted index over one shard of documents: postings by id, weighted once.

    Ids in half of all documents or more have no positive weight (the usual log odds) and no postings.
    """

    def __init__(self, docs: list[np.ndarray], n: int, mean: float, df: np.ndarray, k1: float = 1.2, b: float = 0.75):
        self.size = len(docs)
        self.idf = np.log(np.maximum(1.0, (n - df + 0.5) / (df + 0.5)))
        doc, term, count = [], [], []
        self.terms = []
        for i, d in enumerate(docs):
            t = np.sort(d[:-1].astype(np.uint16) if len(self.idf) <= 1 << 16 else d[:-1], kind="stable")  # a radix sort
            first, stop = runs(t)
            t, c = t[first].astype(np.int64), stop - first
            keep = self.idf[np.minimum(t, len(self.idf) - 1)] > 0
            t, c = t[keep], c[keep]
            self.terms.append(t)
            doc.append(np.full(len(t), i, np.int32))
            term.append(t)
            count.append(c * (k1 + 1) / (c + k1 * (1 - b + b * len(d) / mean)))
        doc, term, weight = np.concatenate(doc), np.concatenate(term), np.concatenate(count)
        order = np.argsort(term, kind="stable")
        self.doc, term = doc[order], term[order]
        self.weight = (weight[order] * self.idf[np.minimum(term, len(self.idf) - 1)]).astype(np.float32)
        self.start = np.searchsorted(term, np.arange(len(self.idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        a, b = self.start[t], self.start[t + 1]
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(t) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], self.weight[at], self.size)

    def drop(self, gone: np.ndarray) -> None:
        """Takes documents out of the postings; the scores of all others stay as they are."""
        keep = ~gone[self.doc]
        self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
        self.doc, self.weight = self.doc[keep], self.weight[keep]


def _best_first(free: np.ndarray, score: np.ndarray, head: int = 16) -> Iterator[int]:
    """Documents by descending score, ties to the earlier one; the few first ones, mostly all that are needed, without a whole sort."""
    if len(free) > 4 * head:
        least = np.partition(score, len(score) - head)[-head]
        at = np.flatnonzero(score > least)
        yield from free[at[np.argsort(-score[at], kind="stable")]].tolist()
        free, score = (x[score <= least] for x in (free, score))
    yield from free[np.argsort(-score, kind="stable")].tolist()


def _pack(lengths: list[int], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): a seed starts each window, its best unused neighbours fill it, and
    what is cut off the last one seeds the next window. Only the last window can be short."""
    used = np.zeros(len(lengths), bool)
    following, listed = 0, len(lengths)
    seed = rest = None
    seq = room = 0
    while True:
        if seed is None:
            while following < len(lengths) and used[following]:
                following += 1
            if following == len(lengths):
                return
            seed, rest = following, 0
            used[seed] = True
        room = window
        neighbours: Iterator[int] | None = None
        doc, at, seed = seed, rest, None
        first = doc
        while doc is not None:
            n = min(room, lengths[doc] - at)
            yield doc, at, n, seq, window - room
            room -= n
            if at + n < lengths[doc]:
                seed, rest = doc, at + n
            if not room:
                break
            if neighbours is None:
                free = np.flatnonzero(~used)
                if len(free) < 0.8 * listed:
                    index.drop(used)
                    listed = len(free)
                neighbours = _best_first(free, index.scores(first)[free])
            doc, at = next((d for d in neighbours if not used[d]), None), 0
            if doc is not None:
                used[doc] = True
        seq += 1


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, window: int = 2048, shard_docs: int = 2048) -> DataFrame:
    """Cut all documents into pieces and lay them into sequences of ``window`` ids.

    docs: doc_id, text; other columns are ignored. Documents are tokenised once (a null text is only the end id), then
    range-partitioned by a locality key, so that copies and near copies meet; ties are split by doc_id and then by row, so a
    hot key or id spreads; the number of partitions follows the number of ids. Runs of ``shard_docs`` documents are the shards of the index, weighted by the document frequencies of all
    documents (an array of the vocabulary's size, the only thing sent to all). Neighbours in other shards are not found;
    the README lists the share that is. A shard fills every sequence but its last.
    Repeated rows are packed one by one; an empty table gives no piece. Returns PIECES; sequence_id is unique over shards.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    tokens = materialize(_tokenise(docs, tokenizer, end_id), "tokens")
    n, mean, df = document_frequencies(tokens, vocabulary)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((n, mean, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        shard, held_ids, held = 0, [], []

        def flush() -> pa.RecordBatch:
            docs = [_unpack(d) for d in held]
            out = [[] for _ in range(7)]
            for d, start, length, seq, offset in _pack([len(x) for x in docs], Index(docs, *shared.value), window):
                crc = zlib.crc32(docs[d][start : start + length].tobytes())
                for column, x in zip(out, (held_ids[d], start, length, crc, len(docs[d]), base + (shard << 24) + seq, offset)):
                    column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in PIECES.split(", ")])

        tokens_held = 0
        for batch in batches:
            for i, d in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held_ids.append(i)
                held.append(d)
                tokens_held += len(d) // 2
                if len(held) == shard_docs or tokens_held > shard_docs * 4096:
                    yield flush()
                    shard, held_ids, held, tokens_held = shard + 1, [], [], 0
        if held:
            yield flush()

    tasks = max(1, -(-int(n * mean) * 2 // TASK))
    order = ["place", "doc_id", "row"]
    rows = tokens.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return rows.select("doc_id", "ids").mapInArrow(run, PIECES)
