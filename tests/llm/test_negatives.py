import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import blocks, negatives, queries


def brute(rows, k=5):
    """rows: (vec_id, vector, label). The contract in exact integers, rows told apart by their place."""
    ok = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        ok.append((i, [math.floor(256 * c) if abs(c) < 2**52 else int(c) * 256 for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    least = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (a, x, label) in enumerate(ok):
        if a is None or a % 100:
            continue
        scored = sorted((*least(sum(p * q for p, q in zip(x, y)), i), i, other) for m, (i, y, other) in enumerate(ok) if m != n and len(y) == len(x))
        for s, _, _, p, _ in [r for r in scored if r[4] == label][:k]:
            hits = [r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, p, rank, r[3], -s, -r[0]) for rank, r in enumerate(hits, 1)]
    return sorted(out, key=str)


def mined(df):
    index = negatives.build_index(df, label=negatives.relabelled(F.col("vec_id"), F.col("label")))
    return sorted([tuple(r) for r in negatives.mine_negatives(index, index.where("vec_id % 100 = 0")).collect()], key=str)


def test_query_against_brute_force_and_sql(spark, sf):
    got = sorted([tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect()], key=str)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows) and got
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op11_hard_negatives"]).fetchall(), key=str) == got


@pytest.mark.parametrize("most", [1, 8192])
def test_odd_rows(spark, monkeypatch, most):
    """Nulls, not finite, other dimensions, empty, huge and tiny vectors, ties, repeated anchors, clashing extra columns."""
    monkeypatch.setattr(blocks.against_all, "__kwdefaults__", {**blocks.against_all.__kwdefaults__, "most": most})
    monkeypatch.setattr(negatives, "ROWS", 16)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=6) + (i % 3 == 0)).tolist(), int(i % 3)) for i in range(1, 120)]
    rows += [(0, [1.0] * 6, 1), (100, [1.5] * 6, 1), (100, [1.5] * 6, 1), (200, [2.0, 1.0], 0), (201, [1.0, 1.0], 0), (203, [1.0, 1.0], 4), (300, [], 2), (301, [], 2), (302, [], 5)]
    rows += [(400, None, 1), (401, [None] * 6, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (404, [1.0] * 6, None), (None, [1.2] * 6, 2), (None, [1.2] * 6, 1)]
    rows += [(500 + i, [1.5] * 6, i % 2) for i in range(9)] + [(600, [-1.0] * 6, 1), (700, [0.0] * 6, 3), (701, [1e-9, -1e-9] * 3, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, bits int")
    got = mined(df)
    assert got == brute(rows) and len(got) > 50
    assert mined(df.limit(0)) == []


def test_wide_components(spark):
    """Components of up to 1e15, whose products need more than a double, and scores beyond a long."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * (1e15 if i % 4 == 0 else 1e6 if i % 4 == 1 else 1.0)).tolist(), int(i % 2)) for i in range(1, 60)]
    rows += [(100, [1e6, 2e6, 0.5, -1.0], 0), (200, [1e15, 1.0, 1.0, 1.0], 1), (300, [3.0, 1.0, 2.0, -1.0], 1)]
    top = (1 << 63) - 1
    clip = lambda s: max(-top - 1, min(top, s))
    want = sorted([(*r[:4], clip(r[4]), clip(r[5])) for r in brute(rows)], key=str)
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == want and want


def test_planes_drop_rows_early():
    """Few pairs are left when the lowest plane is read, and those are the right ones."""
    rng = np.random.default_rng(9)
    import pyarrow as pa

    v = np.floor(256 * rng.normal(0, 0.125, (2000, 64))).astype(int)
    packed = [negatives._planes(x)[1] if negatives._planes(x)[0] == 8 else None for x in v.tolist()]
    at = [i for i, p in enumerate(packed) if p]
    table = pa.table({"row": at, "label": [0] * len(at), "vec_id": at, "planes": pa.array([packed[i] for i in at], pa.binary())})
    rows, anchors = negatives._Rows(table, 64, 8), v[at[:20]].astype(float)
    assert (rows.values() == v[at]).all()
    left = []

    def qualify(low, high, pair):
        keep = high >= negatives._best_lower(low, np.ones_like(low, bool), 5)[:, None] if pair is None else np.ones(len(low), bool)
        left.append(np.count_nonzero(keep))
        return keep

    q, r, s = negatives._narrowed(anchors, rows, np.ones((20, len(at)), bool), qualify)
    exact = anchors @ v[at].T
    assert left[-1] < 0.2 * exact.size and (s == exact[q, r]).all()
    for i in range(20):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(r[q == i])
