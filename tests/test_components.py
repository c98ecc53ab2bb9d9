import random

import pytest

from brindle.operators import components
from brindle.operators.components import connected_components


def truth(edges):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    for chunk in (1, 50, 1 << 18):
        rows = connected_components(df, chunk=chunk).collect()
        assert {r.node: r.root for r in rows} == truth(edges) and len(rows) == len({r.node for r in rows})
    assert connected_components(df.limit(0)).count() == 0


def test_string_nodes(spark):
    df = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "p string, q string")
    for chunk in (1, 100):
        assert {(r.node, r.root) for r in connected_components(df, "p", "q", chunk=chunk).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_unfinished_labels_are_an_error(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="no fixed point"):
        connected_components(df, chunk=1, max_rounds=1)


def test_stars_of_many_tasks_need_few_rounds(spark, monkeypatch):
    """300 hubs whose members each hang under up to three of them, dealt over 64 tasks that Spark does not put together."""
    rng = random.Random(4)
    edges = [(1000 + k, rng.randrange(300)) for k in range(4000) for _ in range(3 if k % 40 == 0 else 1)]
    written, keep = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: (written.append(name), keep(df, name))[1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(64)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in rows} == truth(edges) and len(written) <= 7
