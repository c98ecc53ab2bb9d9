"""Hard negatives by integer inner products over bit-planes, most significant first.

A component is an integer in two's complement; plane j of a row holds bit j of all its components. After the planes down to j
the score of a row with an anchor a lies in [s + m * N, s + m * P], where s is the sum over the planes read, m = 2^j - 1, and
N and P are the sums of the negative and positive components of a. A row leaves as soon as this interval cannot qualify.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.blocks import against_all
from brindle.storage import materialize

INDEX = "vec_id long, label long, dim int, bits int, planes binary"
FOUND = "anchor_row long, pair int, row long, vec_id long, score decimal(38,0)"
LONG = (-(1 << 63), (1 << 63) - 1)
#: Components beyond this are held as Python integers.
WIDE = 1 << 52
PART = 256
ROWS = 4096


def relabelled(vec_id: Column, label: Column) -> Column:
    """Labels with known noise: where vec_id is divisible by 7, the next label of ten."""
    label = label.cast("long")
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def integers(x: np.ndarray, scale: int = 256) -> list[int]:
    """floor(scale * x) of each component, exact for any finite double."""
    return [int(np.floor(scale * c)) if abs(c) < WIDE else int(c) * scale for c in x.tolist()]


def _planes(values: list[int]) -> tuple[int, bytes]:
    bits = 1 + max([0, *(v.bit_length() if v >= 0 else (-v - 1).bit_length() for v in values)])
    return bits, b"".join(np.packbits([(v >> j) & 1 for v in values]).tobytes() for j in range(bits - 1, -1, -1)) if values else b""


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """The bit-planes of floor(``scale`` * x) of each usable vector, packed, with its label and a row number; written once.

    Rows with a null label or vector, or a null, infinite or NaN component are left out; an empty vector stays and has score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2).cast(pa.large_list(pa.float64()))
            off = vec.offsets.to_numpy()
            x, dims = vec.values.to_numpy(zero_copy_only=False), np.diff(off)
            bits, planes = [0] * len(dims), [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                m = np.floor(scale * x[off[at][:, None] + np.arange(dim)]) if dim else np.zeros((len(at), 0))
                narrow = np.abs(m).max(1, initial=0) < WIDE
                few = at[narrow]
                if len(few):
                    v = m[narrow].astype(np.int64)
                    top = int(max(v.max(initial=0), -v.min(initial=0) - 1)).bit_length() + 1
                    packed = np.packbits((v[:, None, :] >> np.arange(top - 1, -1, -1)[:, None]) & 1, axis=2).reshape(len(few), -1)
                    for i, p in zip(few.tolist(), packed):
                        bits[i], planes[i] = top, p.tobytes()
                for i in at[~narrow].tolist():
                    bits[i], planes[i] = _planes(integers(x[off[i] : off[i + 1]], scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(bits, pa.int32()), pa.array(planes, pa.binary())], names=["vec_id", "label", "dim", "bits", "planes"])

    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vec"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    return materialize(rows.mapInArrow(run, INDEX).withColumn("row", F.monotonically_increasing_id()), "planes")


class _Rows:
    """Rows of one dimension and number of planes, whose planes are unpacked one by one."""

    def __init__(self, table: pa.Table, dim: int, bits: int):
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.ids = np.asarray([LONG[1] if v is None else v for v in table.column("vec_id").to_pylist()], np.int64)
        self.named = ~np.asarray(table.column("vec_id").is_null())
        self.dim, self.bits = dim, bits
        self.packed = np.frombuffer(b"".join(table.column("planes").to_pylist()), np.uint8).reshape(len(self.row), bits, -1)

    def plane(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Plane ``bits - 1 - k`` of these rows as 0 and 1."""
        return np.unpackbits(self.packed[at, k], axis=1, count=self.dim).astype(np.float64)

    def values(self) -> np.ndarray:
        """All components; Python integers where an int64 is too short."""
        kind = object if self.bits > 53 else np.int64
        out = np.zeros((len(self.row), self.dim), kind)
        for k in range(self.bits):
            weight = (1 << (self.bits - 1 - k)) * (-1 if k == 0 else 1)
            out += self.plane(k).astype(np.int64).astype(kind) * weight
        return out


def _groups(table: pa.Table) -> Iterator[_Rows]:
    dims, bits = table.column("dim").to_numpy(), table.column("bits").to_numpy()
    for dim, b in sorted(set(zip(dims.tolist(), bits.tolist()))):
        found = table.filter(pa.array((dims == dim) & (bits == b)))
        for k in range(0, found.num_rows, ROWS):
            yield _Rows(found.slice(k, ROWS), dim, b)


def _narrowed(anchors: np.ndarray, rows: _Rows, alive: np.ndarray, qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that remain after all planes, with their scores. ``qualify(low, high, at)`` says which may still qualify,
    over the whole matrix (``at`` None) or over pairs ``at``. Sums stay under 2^53, so they are exact in double precision."""
    s = np.zeros(alive.shape)
    neg, pos = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    q = r = None
    for k in range(rows.bits):
        j = rows.bits - 1 - k
        weight = float(1 << j) * (-1 if k == 0 else 1)
        rest = float((1 << j) - 1)
        if q is None:
            s += weight * (anchors @ rows.plane(k).T)
            alive &= qualify(s + rest * neg[:, None], s + rest * pos[:, None], None)
            if np.count_nonzero(alive) * 8 < alive.size:
                q, r = np.nonzero(alive)
                s = s[q, r]
        else:
            got, bits = np.empty(len(q)), rows.plane(k)
            for c in range(0, len(q), 1 << 14):
                got[c : c + (1 << 14)] = (anchors[q[c : c + (1 << 14)]] * bits[r[c : c + (1 << 14)]]).sum(1)
            s += weight * got
            keep = qualify(s + rest * neg[q], s + rest * pos[q], (q, r))
            q, r, s = q[keep], r[keep], s[keep]
    if q is None:
        q, r = np.nonzero(alive)
        s = s[q, r]
    return q, r, s


def _fits(anchor_bits: int, rows: _Rows) -> bool:
    return anchor_bits + rows.bits + max(1, rows.dim).bit_length() <= 52


class _Best:
    """The k best rows for each key so far: highest score, then least vec_id (null last)."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, key: np.ndarray, rows: _Rows, r: np.ndarray, score) -> None:
        for q, i, s in zip(key.tolist(), r.tolist(), score.tolist() if isinstance(score, np.ndarray) else score):
            self.kept[q].append((-int(s), not rows.named[i], int(rows.ids[i]), int(rows.row[i])))
        for q in np.unique(key).tolist():
            self.kept[q] = sorted(self.kept[q])[: self.k]
            if len(self.kept[q]) == self.k:
                self.least[q] = float(-self.kept[q][-1][0])


def _best_lower(low: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each anchor the k-th largest lower bound of the rows that surely count; -inf if fewer do."""
    if low.shape[1] <= k:
        return np.full(len(low), -np.inf)
    return -np.partition(np.where(sure, -low, np.inf), k - 1, axis=1)[:, k - 1]


def _decode(block: pa.Table) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Anchors of a block by dimension: (place in the block, components)."""
    out: dict[int, list] = {}
    dims, bits = block.column("dim").to_numpy(), block.column("bits").to_numpy()
    for dim, b in sorted(set(zip(dims.tolist(), bits.tolist()))):
        at = np.flatnonzero((dims == dim) & (bits == b))
        out.setdefault(dim, []).append((b, at, _Rows(block.take(pa.array(at)), dim, b).values()))
    return out


def _emit(anchor_rows: list[int], pairs: list[int], best: _Best) -> pa.RecordBatch:
    out = [(a, p, row, ident if not unnamed else None, -s) for a, p, kept in zip(anchor_rows, pairs, best.kept) for s, unnamed, ident, row in kept]
    cols = list(zip(*out)) if out else [[], [], [], [], []]
    scores = [Decimal(max(-(10**38) + 1, min(10**38 - 1, s))) for s in cols[4]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(scores, pa.decimal128(38, 0))], names=["anchor_row", "pair", "row", "vec_id", "score"])


def _positives(block: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best other rows of each anchor's label among one task's rows."""
    anchors, own, label = _decode(block), block.column("row").to_numpy(), block.column("label").to_numpy()
    best = _Best(len(own), k)
    for batch in batches:
        for rows in _groups(pa.Table.from_batches([batch])):
            for bits, places, values in anchors.get(rows.dim, []):
                for c in range(0, len(places), PART):
                    at = places[c : c + PART]
                    counts = (label[at][:, None] == rows.label) & (own[at][:, None] != rows.row)
                    if not _fits(bits, rows):
                        for q, i in zip(*np.nonzero(counts)):
                            best.add(at[[q]], rows, np.asarray([i]), [_dot(values[c + q], rows, i)])
                        continue

                    def qualify(low, high, pair, at=at, counts=counts):
                        if pair is not None:
                            return high >= best.least[at[pair[0]]]
                        return counts & (high >= np.maximum(best.least[at], _best_lower(low, counts, k))[:, None])

                    q, r, s = _narrowed(values[c : c + PART].astype(np.float64), rows, counts.copy(), qualify)
                    best.add(at[q], rows, r, s)
    yield _emit(own.tolist(), [0] * len(own), best)


def _dot(anchor: np.ndarray, rows: _Rows, i: int) -> int:
    one = _Rows.__new__(_Rows)
    one.row, one.dim, one.bits, one.packed = rows.row[i : i + 1], rows.dim, rows.bits, rows.packed[i : i + 1]
    return sum(int(a) * int(b) for a, b in zip(anchor.tolist(), one.values()[0].tolist()))


def _negatives(block: pa.Table, batches: Iterator[pa.RecordBatch], k: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """For each anchor and each of its positives' scores p, the k best rows of other labels with least * p <= 100 * score <= most * p."""
    anchors, label = _decode(block), block.column("label").to_numpy()
    scores = [[int(s) for s in x] for x in block.column("positive_scores").to_pylist()]
    width = max(map(len, scores), default=0)
    floor, ceil = np.full((len(scores), width), np.inf), np.full((len(scores), width), -np.inf)
    bounds = {}
    for a, own in enumerate(scores):
        for p, s in enumerate(own):
            lo, hi = -((-least * s) // 100), (most * s) // 100
            bounds[a, p] = (lo, hi)
            # scores told by planes lie within 2^53, so bounds beyond it are as good as infinite
            floor[a, p], ceil[a, p] = (float(x) if abs(x) < 1 << 53 else np.inf if x > 0 else -np.inf for x in (lo, hi))
    best = [_Best(len(scores), k) for _ in range(width)]
    for batch in batches:
        for rows in _groups(pa.Table.from_batches([batch])):
            for bits, places, values in anchors.get(rows.dim, []):
                for c in range(0, len(places), PART):
                    at = places[c : c + PART]
                    counts = label[at][:, None] != rows.label
                    if not _fits(bits, rows):
                        for q, i in zip(*np.nonzero(counts)):
                            s = _dot(values[c + q], rows, i)
                            for p in range(len(scores[at[q]])):
                                if bounds[at[q], p][0] <= s <= bounds[at[q], p][1]:
                                    best[p].add(at[[q]], rows, np.asarray([i]), [s])
                        continue

                    def qualify(low, high, pair, at=at, counts=counts):
                        q = at if pair is None else at[pair[0]]
                        of = (lambda x: x[:, None]) if pair is None else (lambda x: x)
                        out = np.zeros(low.shape, bool)
                        for p in range(width):
                            lo, hi = of(floor[q, p]), of(ceil[q, p])
                            far = best[p].least[q]
                            if pair is None:
                                far = np.maximum(far, _best_lower(low, counts & (low >= lo) & (high <= hi), k))
                            out |= (high >= lo) & (low <= hi) & (np.minimum(high, hi) >= of(far))
                        return out & counts if pair is None else out

                    q, r, s = _narrowed(values[c : c + PART].astype(np.float64), rows, counts.copy(), qualify)
                    for p in range(width):
                        ok = (s >= floor[at[q], p]) & (s <= ceil[at[q], p])
                        best[p].add(at[q[ok]], rows, r[ok], s[ok])
    own = block.column("row").to_pylist()
    for p in range(width):
        yield _emit(own, [p] * len(own), best[p])


def mine_negatives(index: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    ``index`` and ``anchors`` (rows of it) come from :func:`build_index`. An anchor's positives are the first ``positives`` other rows
    of its label by score, ties to the smaller vec_id (null last); a positive's negatives are the first ``negatives`` rows of other labels
    whose score is ``least`` to ``most`` hundredths of the positive's. Only vectors of one dimension are compared; a row is told from others by its
    number, so rows that repeat an id are rows of their own. An anchor without positives, and a positive without such negatives, give
    no row. Order is by exact integers; a score that does not fit a long is given as the nearest long, and one beyond 38 digits is ordered as 38 nines.

    No row moves: each task reads its rows once for each bounded block of anchors and keeps the best of each.
    """
    anchors = anchors.select("row", "vec_id", "label", "dim", "bits", "planes")
    size = anchors.agg(F.max(F.length("planes") + 8 * F.col("dim"))).first()[0] or 1
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    pos = against_all(index, anchors, lambda block, batches: _positives(block, batches, positives), FOUND, query_bytes=64 + size, name="positives")
    pos = materialize(pos.withColumn("pair", rank("anchor_row") - 1).where(F.col("pair") < positives), "positives")
    of = pos.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "score"))), lambda x: x["score"]).alias("positive_scores"))
    with_scores = materialize(anchors.join(of, anchors["row"] == of["anchor_row"]).drop("anchor_row"), "anchors")
    neg = against_all(index, with_scores, lambda block, batches: _negatives(block, batches, negatives, least, most), FOUND, query_bytes=64 + size + 32 * positives, name="negatives")
    neg = neg.withColumn("rank", rank("anchor_row", "pair")).where(F.col("rank") <= negatives)
    p = pos.select("anchor_row", "pair", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive"))
    a = with_scores.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    as_long = lambda c: F.greatest(F.least(F.col(c), F.lit(LONG[1]).cast("decimal(38,0)")), F.lit(LONG[0]).cast("decimal(38,0)")).cast("long")
    out = neg.join(p, ["anchor_row", "pair"]).join(a, "anchor_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), as_long("positive").alias("positive_score"), as_long("score").alias("negative_score"))
