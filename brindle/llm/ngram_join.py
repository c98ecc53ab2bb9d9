"""Jaccard self-join of documents on word n-grams by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import NO_ID, id_key, one_of_copies, text_key
from brindle.llm.text import binary_parts, mix, text_blocks, word_shingles
from brindle.llm.linking import block_pairs, components_of_shared, forest, grouped, in_play
from brindle.operators.components import connected_components
from brindle.storage import materialize

DEPTH = 3
SKETCH = 64
#: Sets, and shingles, of one block in verification; a place holds two blocks.
SETS, WEIGHT = 1024, 1 << 20
_SKETCH = np.random.default_rng(31).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has shared a path with probability ``recall``.

    At the threshold a shared path has on average one shared child (Poisson), so it lives DEPTH levels with
    probability p_d, where p_0 = 1 and p_d = 1 - exp(-p_(d-1)).
    """
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def chosen_paths(x: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    """Ends of all paths of DEPTH tokens that set ``x`` chooses: each level keeps a token with probability
    1 / (threshold * size), by a hash of path and token, so similar sets choose alike."""
    paths = mix(np.arange(1, runs + 1, dtype=np.uint64))
    if not len(x):
        return paths[:0]
    bound = np.uint64(min(2**64 - 1, int(2.0**64 / (threshold * len(x)))))
    for _ in range(DEPTH):
        ends = []
        step = max(1, (1 << 20) // len(x))
        for k in range(0, len(paths), step):
            p = paths[k : k + step]
            row, col = np.nonzero(x[None, :] * (p | np.uint64(1))[:, None] <= bound)
            ends.append(mix(p[row] * np.uint64(0x9E3779B97F4A7C15) + x[col]))
        paths = np.concatenate(ends) if ends else paths[:0]
    return np.unique(paths)


def sketch(x: np.ndarray) -> bytes:
    """SKETCH 32-bit minima of a set; the share of equal ones estimates Jaccard."""
    out = np.zeros(SKETCH, np.uint64)
    step = max(1, (1 << 20) // max(1, len(x)))
    for k in range(0, SKETCH, step):
        out[k : k + step] = (x[None, :] * _SKETCH[k : k + step, None]).min(1)
    return (out >> np.uint64(24)).astype("<u4").tobytes()


class Sketches:
    """Compares sets by their sketches: alike if ``least`` of the places or more agree. Tokens are the places with their minima."""

    def __init__(self, least: float):
        self.least = least
        self.size, self.spare = SKETCH, SKETCH - math.ceil(least * SKETCH)

    def prepare(self, data: pa.Array) -> np.ndarray:
        return np.frombuffer(binary_parts(data)[0], "<u4").reshape(-1, SKETCH)

    def tokens(self, data: pa.Array) -> np.ndarray:
        return mix(self.prepare(data).astype(np.uint64) | np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)).view(np.int64)

    def pairs(self, sketches: np.ndarray, i: np.ndarray, j: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            out[k : k + 65536] = (sketches[i[k : k + 65536]] == sketches[j[k : k + 65536]]).sum(1) >= self.least * SKETCH
        return out


def _signatures(docs: DataFrame, k: int, runs: int, threshold: float) -> DataFrame:
    schema = "doc_id long, text_id long, set_id binary, alias long, n long, paths array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_ids = batch.column("doc_id").to_pylist(), batch.column("text_id").to_pylist()
            for i, j, data, off in text_blocks(batch):
                cols = [[] for _ in range(7)]
                for row, x in enumerate(word_shingles(data, off, k)):
                    one, two = mix(x).sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    one = mix(np.asarray([one + np.uint64(len(x))]))[0]
                    values = (ids[i + row], text_ids[i + row], one.tobytes() + two.tobytes(), int(one.astype(np.int64)), len(x), chosen_paths(x, runs, threshold).astype(np.int64), sketch(x) if len(x) else b"")
                    for c, v in zip(cols, values):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of blocks of the incidence matrix of shared elements."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.asarray([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((m, m), np.float64)
    for c in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Exact links within candidate components: per set and place, (set_id, linked, near): the documents it is linked
    to and the least set_id it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["root", "bi", "bj"]):
            g = list({r["set_id"]: r for r in g}.values())  # a repeated row gives its text twice
            table = pa.table({"text": pa.array([r["text"] for r in g], pa.large_string())}).to_batches()[0]
            sets = [x for _, _, data, off in text_blocks(table) for x in word_shingles(data, off, k)]
            n = np.asarray([len(s) for s in sets])
            both = overlaps(sets)
            linked = in_play(g[0]["bi"], g[0]["bj"], np.asarray([r["b"] for r in g])) & (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            copies = np.asarray([r["copies"] for r in g])
            total = (linked * copies[None, :]).sum(1) + (linked * copies[:, None]).sum(0)
            near = forest(len(g), i, j)
            at = np.flatnonzero(total)
            names = [r["set_id"] for r in g]
            yield pa.RecordBatch.from_arrays([pa.array([names[v] for v in at], pa.binary()), pa.array(total[at], pa.int64()), pa.array([names[near[v]] for v in at], pa.binary())], names=["set_id", "linked", "near"])

    rows = block_pairs(texts, "sets", "blocks", "set_id").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    return rows.select("root", "bi", "bj", "b", "set_id", "copies", "text").mapInArrow(run, "set_id binary, linked long, near binary")


def ngram_join(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, recall: float = 0.999, sketch_least: float = 0.6) -> DataFrame:
    """All documents, with their links: (doc_id, class_id, copy_id, n_links, n_shingles).

    docs: doc_id, text; other columns are ignored. A text's set is its distinct runs of ``k`` words
    (``[^\\x20\\x09-\\x0D]+``), or its only run if it has fewer; two documents are linked if the Jaccard similarity of
    their sets is ``threshold`` or more. ``n_links`` counts the other documents a document is linked to, copies included;
    ``class_id`` is the least doc_id of all it is connected with, ``copy_id`` that of the documents with the same set.

    Sets are collapsed first, so copies are never paired. Chosen paths of ``recall`` propose, sketches thin the
    proposals out, and every pair within a proposed component is verified on whole texts; a large component is verified
    in pairs of blocks, of at most 2 * SETS sets. Groups are only ever reduced by count and least, or dealt into blocks.

    Null and empty texts have no set: no links, a class of their own row's doc_id. A null doc_id takes part and stays null.
    Repeated rows are copies. An empty table gives an empty result.
    """
    out = _classes(docs, k, threshold, recall, sketch_least)
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), real(F.col("class.doc_id")).alias("class_id"), real(F.col("copy.doc_id")).alias("copy_id"), "n_links", F.col("n").alias("n_shingles"))


def _classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, sketch_least: float = 0.6) -> DataFrame:
    """(doc_id, text_id, n, n_links, copy, class) of each row; ``copy`` and ``class`` are the least (doc_id, text_id) of its copies and of
    its class, so documents of no id or one that others share are told apart by their texts."""
    docs = docs.select(id_key().alias("doc_id"), "text", text_key().alias("text_id"))
    signed = materialize(_signatures(docs, k, runs_for(recall), threshold), "signatures")
    some = signed.where("n > 0")
    sets = materialize(some.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_id")).alias("one"), F.count(F.lit(1)).alias("copies"), F.min("alias").alias("alias"), F.min("n").alias("n"), F.min("paths").alias("paths"), F.min("sketch").alias("sketch")), "sets")
    paths = sets.select(F.explode("paths").alias("path"), "alias")
    comps = components_of_shared(paths, sets.select("alias", F.col("sketch").alias("data")), Sketches(sketch_least))
    cand = sets.select("set_id", "alias", "copies", "one.*", "n").join(comps.withColumnRenamed("node", "alias"), "alias").select("set_id", "copies", "doc_id", "text_id", "n", "root")
    sizes = cand.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("sets") / SETS), F.least(F.col("sets"), F.ceil(F.col("weight") / F.lit(WEIGHT))))).drop("weight")
    texts = cand.join(sizes, "root").join(docs, ["doc_id", "text_id"]).select("root", "sets", "blocks", "set_id", "copies", "text")
    links = materialize(_verify(texts, k, threshold), "links")
    top = connected_components(links.select("set_id", "near"), "set_id", "near").withColumnRenamed("node", "set_id")
    linked = links.groupBy("set_id").agg(F.sum("linked").alias("linked"))
    per_set = sets.select("set_id", F.col("one").alias("copy"), "copies").join(linked, "set_id", "left").join(top, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = per_set.groupBy("root").agg(F.min("copy").alias("class"))
    per_set = per_set.join(least, "root").select("set_id", "class", "copy", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    own = F.struct("doc_id", "text_id")
    out = signed.select("doc_id", "text_id", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"), "n").join(per_set, "set_id", "left")
    return out.select("doc_id", "text_id", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy", own).alias("copy"), F.coalesce("class", own).alias("class"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns, one row of each class: that of the least doc_id (null first), then the least hash of its text.
    Rows without words are classes of their own and stay; rows that repeat an id are judged by their own texts, and of rows equal
    in id and text one stays."""
    own = (F.col("class.doc_id") == F.col("doc_id")) & (F.col("class.text_id") == F.col("text_id"))
    kept = _classes(docs, **options).where(own).groupBy(F.col("doc_id").alias("_brindle_doc"), F.col("text_id").alias("_brindle_text")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("_brindle_copies"))
    kept = materialize(kept, "kept")
    keyed = docs.withColumn("_brindle_id", id_key()).withColumn("_brindle_key", text_key())
    same = (F.col("_brindle_id") == F.col("_brindle_doc")) & (F.col("_brindle_key") == F.col("_brindle_text"))
    rows, several = keyed.join(kept.where("_brindle_copies <= 1"), same).select(*docs.columns), kept.where("_brindle_copies > 1")
    return rows if several.isEmpty() else rows.unionAll(one_of_copies(keyed.join(several, same), ["_brindle_id", "_brindle_key"], docs.columns))
