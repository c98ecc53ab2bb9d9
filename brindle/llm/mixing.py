"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Target words of each source (sizes: source, size, n rows of it): ``share`` of all words dealt by weight, at most ``max_repeat`` times its size.

    The table has a row per source (a mix names its sources, so it is small); the windows over it are global.
    Filling to a common level: with sources in order of (cap / weight), those before the first one that the level
    does not fill are capped, the rest get weight * level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    level = Window.orderBy("ratio", "source_idx").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = (
        sizes.groupBy("source")
        .agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("source_idx", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, F.col("source_idx") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(level), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("level", F.when(F.col("ratio") * F.col("open_weight") > F.col("rest"), F.col("rest") / F.col("open_weight")))
        .withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("ratio", "source_idx"))).over(everything))
    )
    return t.select("source", "source_idx", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _fly(pi: np.ndarray, size: np.ndarray, draw) -> np.ndarray:
    """Flight phase over one chunk: three open units at a time move along the null vector of (count, words)
    until one of them reaches 0 or 1. At most two stay open. ``draw`` yields uniform numbers."""
    pi = pi.astype(float).tolist()
    size = size.astype(float).tolist()
    held: list[int] = []
    for k in range(len(pi)):
        held.append(k)
        while len(held) == 3:
            i, j, l = held
            si, sj, sl = size[i], size[j], size[l]
            u = (sl - sj, si - sl, sj - si) if not si == sj == sl else (1.0, -1.0, 0.0)
            up = down = float("inf")
            for x, d in zip(held, u):
                if d > 0:
                    up, down = min(up, (1 - pi[x]) / d), min(down, pi[x] / d)
                elif d < 0:
                    up, down = min(up, pi[x] / -d), min(down, (1 - pi[x]) / -d)
            step = up if next(draw) * (up + down) < down else -down
            left = []
            for x, d in zip(held, u):
                p = pi[x] + step * d
                p = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
                pi[x] = p
                if 0.0 < p < 1.0:
                    left.append(x)
            held = left
    return np.asarray(pi)


def _land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing: of all 0/1 ends of the few open units, the one whose words, then count, are nearest to expectation."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_)),
        key=lambda e: (abs(float(np.dot(np.asarray(e) - pi[open_], size[open_]))), abs(float(np.sum(np.asarray(e) - pi[open_]))), e),
    )
    out = pi.copy()
    out[open_] = best
    return out


def _flier(seed: int, level: int, last: bool, names: list[str]):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["source_idx"].iloc[0]), int(pdf["chunk"].iloc[0])])
        pdf = pdf.iloc[rng.permutation(len(pdf))]
        draw = iter(lambda: rng.random(), None)
        pi = pdf["pi"].to_numpy(dtype=float).copy()
        size = pdf["size"].to_numpy(dtype=float)
        open_ = np.flatnonzero((pi > 0) & (pi < 1))
        pi[open_] = _fly(pi[open_], size[open_], draw)
        return pdf.assign(pi=_land(pi, size) if last else pi)[names]

    return fly


def _drawn(docs: DataFrame, key: Column, weights, share: float, max_repeat: float, chunk: int, seed: int) -> DataFrame:
    """One row per different row of ``docs``: key, doc_id, size, source, source_size, target, n (so many rows are
    equal), base (copies that each gets), more (copies that they get together besides)."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    sizes = materialize(sizes.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = materialize(source_targets(sizes, tuple(weights), share, max_repeat).coalesce(1), "targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    clean = lambda c: F.when(c < _EPS, 0.0).otherwise(c)
    each = sizes.select("key", "doc_id", "size", "n", F.col("source").alias("s")).join(targets, F.col("s").eqNullSafe(F.col("source"))).withColumn("base", F.floor(q + _EPS))
    each = each.withColumn("part", clean(F.greatest(F.lit(0.0), q - F.col("base"))) * F.col("n")).withColumn("sure", F.floor(F.col("part") + _EPS)).withColumn("pi", clean(F.greatest(F.lit(0.0), F.col("part") - F.col("sure"))))
    rows = each.select("key", "size", "source_idx", "n_docs", "pi")
    names = rows.columns
    done, level, n = [], 0, most
    while True:
        last = n <= chunk
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(float(chunk)))) if not last else F.lit(1)
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(seed + level)), chunks.cast("long")))
        out = materialize(rows.groupBy("source_idx", "chunk").applyInPandas(_flier(seed, level, last, names), rows.select(*names).schema), f"flight{level}")
        if last:
            done.append(out)
            break
        done.append(out.where("pi = 0 or pi = 1"))
        # every chunk leaves at most two rows open
        rows = out.where("pi > 0 and pi < 1").withColumn("n_docs", 2 * F.ceil(F.col("n_docs") / F.lit(float(chunk))).cast("long"))
        n, level = 2 * -(-n // chunk), level + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    # equal rows have one key, and so one unit and one draw
    result = result.select("key", F.col("source_idx").alias("drawn_source"), F.col("pi").alias("drawn"))
    met = each.join(result, "key").where("source_idx = drawn_source")
    return met.select("key", "doc_id", "size", "source", "source_size", "target", "n", F.col("base").cast("long").alias("base"), (F.col("sure") + F.col("drawn")).cast("long").alias("more"))


def mix_sources(docs: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_repeat: float = 2.0, chunk: int = 1024, seed: int = 7) -> DataFrame:
    """Draw a mix in which each source has its target of words.

    docs: doc_id, text, source; other columns are ignored. Sources in code-point order (null last) take ``weights``
    in turn. A document of a source with target/size = q is taken floor(q) times and once more with probability
    q - floor(q); the cube method draws those so that every source's words and documents match their expectation
    but for a landing of at most two documents.

    Chunks of about ``chunk`` rows of one source fly independently, a hot source simply has more chunks; the at most
    two open units of each chunk fly again in the next, far smaller level, until a source fits one chunk. Only
    keys and sizes are shuffled. Draws depend on the seed and on the rows alone, so reruns agree.

    Null or empty texts have size 0 and may be taken or not, at no words. A null source is a source. Rows that repeat doc_id, text
    and source are one unit of the draw that stands for them all: they share its copies evenly, but for the rest. Rows of one null or
    repeated doc_id and different texts are different units. An empty table gives an empty result. Returns one row per
    input row: doc_id, size, source, source_size, target, copies, taken (= copies * size).
    """
    units = _drawn(docs, F.xxhash64("doc_id", "text", "source"), weights, share, max_repeat, chunk, seed)
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    copies = F.col("base") + F.when(F.col("row") <= F.col("more"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, max_repeat: float = 2.0, chunk: int = 1024, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it: like :func:`mix_sources`, but only rows
    that are equal in all columns are one unit, so the targets hold for null and repeated ids as well."""
    key = F.xxhash64(*docs.columns)
    units = materialize(_drawn(docs, key, weights, share, max_repeat, chunk, seed).select(F.col("key").alias("mix_key"), "n", (F.col("n") * F.col("base") + F.col("more")).alias("copies")).where("copies > 0"), "mix")
    rows = docs.withColumn("mix_key", key)
    taken = rows.join(units.where("n = 1"), "mix_key")
    if units.where("n > 1").limit(1).count():
        # of equal rows one stands for all
        taken = taken.unionAll(rows.join(units.where("n > 1"), "mix_key").dropDuplicates(["mix_key"]))
    return taken.withColumn("mix_time", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)
