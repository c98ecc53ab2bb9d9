from collections import defaultdict

from llm import brute
from brindle.llm.mixing import apply_mix, mix_sources


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2.0 * sizes[s] for s in full), open_ - full
    return out


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_sources(docs, chunk=32).collect()
    raw = docs.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in raw)
    size = {r.doc_id: len(brute.words(r.text)) for r in raw}
    by = defaultdict(int)
    for r in raw:
        by[r.source] += size[r.doc_id]
    want = targets(by)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in by:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mix_sources(docs.repartition(3), chunk=32).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "q " * 50, "a"), (5, "one", "b")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, source string, size int, target string")
    out = mix_sources(docs).collect()
    assert len(out) == 6 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
    assert mix_sources(docs.limit(0)).collect() == []


def test_thousands_of_null_and_repeated_ids(spark):
    rows = [(None, f"w{i} " * (1 + i % 7), "ab"[i % 2], i) for i in range(4000)] + [(7, f"x{i}", "c", i) for i in range(3000)] + [(9, "same words here", "d", 0)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = mix_sources(docs, chunk=64).collect()
    assert len(out) == len(rows) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
    want = {r.source: r.target for r in out}
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)
    kept, applied = apply_mix(docs, chunk=64), defaultdict(int)
    assert kept.columns == docs.columns
    for r in kept.collect():
        applied[r.source] += len(brute.words(r.text))
    assert all(abs(applied[s] - want[s]) <= 8 for s in want)


def test_production_parameters(spark, sf):
    from brindle.llm import queries

    rows = queries.op2_source_mix(spark, sf).collect()
    by, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        by[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    want = targets(by)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
