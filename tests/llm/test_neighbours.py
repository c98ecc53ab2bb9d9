import numpy as np

from brindle.llm import neighbours, queries


def brute(rows, k=5, every=50):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            s = sorted((-float(np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y))), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in queries.op10_nearest_vectors(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    exact = {i: np.asarray(v, float) for i, v in rows}
    for q, by in got.items():
        for i, s in by.values():
            assert abs(s - exact[q] @ exact[i] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[i])) < 1e-12


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 40)]
    rows += [(0, [1.0] * 8), (50, [2.0] * 8), (100, [0.0] * 8), (101, None), (102, []), (103, [1.0, None] * 4), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (None, [1.0] * 8), (106, [1.0, 2.0])]
    rows += [(200 + i, [3.0] * 8) for i in range(7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    index = neighbours.build_index(df)
    got = neighbours.search(index, index.where("vec_id % 50 = 0"), rows_per_block=10, queries_per_block=1).collect()
    want = brute(rows)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k + 1): i for q, best in want.items() for k, (i, _) in enumerate(best)}
    assert neighbours.search(index.limit(0), index.limit(0)).count() == 0


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 30)] + [(50, [1.0] * 6), (50, [1.0] * 6), (50, [-1.0, 1.0] * 3)]
    index = neighbours.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.search(index, index.where("vec_id = 50")).collect())
    assert len(got) == 15 and [g[0] for g in got] == [r for r in range(1, 6) for _ in range(3)]
    assert got.count((1, 50, 1.0)) == 2


def test_components_from_least_to_largest(spark):
    """Lengths from 1e-200 to 1e200 change neither neighbours nor scores, and subnormal vectors take part."""
    rng = np.random.default_rng(6)
    base = [(i, rng.normal(size=16)) for i in range(300)]
    scales = [1e200, 1e-200, 1.0, 1e308 / 4, 1e-300]
    rows = [(i, (x * scales[i % 5]).tolist()) for i, x in base] + [(1000, (base[50][1] * 1e200).tolist()), (1001, [5e-324] * 16)]
    plain = {i: x for i, x in base} | {1000: base[50][1], 1001: np.ones(16)}
    index = neighbours.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(index, index.where("vec_id % 50 = 0"), queries_per_block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {0, 50, 100, 150, 200, 250, 1000} and got[50][1][0] == 1000 and got[50][1][1] > 1 - 1e-12
    for q, by in got.items():
        cos = {i: float(plain[q] @ x / np.linalg.norm(plain[q]) / np.linalg.norm(x)) for i, x in plain.items() if i != q}
        want = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        assert [by[r][0] for r in range(1, 6)] == want and all(abs(by[r][1] - cos[by[r][0]]) < 1e-9 for r in by)


def test_rows_are_not_moved(spark, sf):
    """The plan's only exchange is by query, of the k best of each task."""
    index = neighbours.build_index(spark.read.parquet(f"{sf}/embeddings.parquet"))
    plan = neighbours.search(index, index.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" not in plan
