import random

from llm import brute
from brindle.llm import linking, ngram_join


def truth(rows):
    sets = [brute.shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    by = {}
    for v, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(v)
    for v, s in enumerate(sets):
        for u in {u for x in s for u in by[x] if u < v}:
            if brute.jaccard(s, sets[u]) >= 0.8:
                links[u] += 1
                links[v] += 1
                root[max(find(u), find(v))] = min(find(u), find(v))
    least = {}
    for v in range(n):
        i = rows[v][0]
        r = find(v)
        least[r] = min(least.get(r, i), i, key=lambda x: (x is not None, x))
    return sorted(((rows[v][0], least[find(v)], links[v]) for v in range(n)), key=str)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n int, set_id binary")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs, **kw).collect()), key=str)


def test_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == truth(rows)


def test_edited_copies_and_odd_texts(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "one"), (9005, "ab " * 5000), (9006, "ab " * 6000), (None, rows[0][1]), (3, rows[9][1]), (3, rows[9][1])]
    monkeypatch.setattr(ngram_join, "SETS", 8)
    monkeypatch.setattr(linking, "BLOCK", 4)
    have, want = got(spark, rows), truth(rows)
    assert [h[0] for h in have] == [w[0] for w in want]
    assert sum(w[2] for w in want) - sum(h[2] for h in have) <= 0.002 * sum(w[2] for w in want)
    assert all(h[2] <= w[2] for h, w in zip(have, want))
    assert sum(h != w for h, w in zip(have, want)) <= 2
    assert got(spark, []) == []


def test_one_of_each_class_stays(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(100)]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (8, " ".join(base[:-1] + ["x"])), (9, "quite another text"), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 9, 10]


def test_recall_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(6)
    hit = 0
    for _ in range(400):
        x = rng.integers(1, 1 << 62, 220, dtype=np.uint64)
        a, b = x[:200], np.concatenate([x[:178], x[200:]])
        hit += len(np.intersect1d(ngram_join.chosen_paths(np.sort(a), ngram_join.runs_for(0.999), 0.8), ngram_join.chosen_paths(np.sort(b), ngram_join.runs_for(0.999), 0.8))) > 0
    assert hit >= 398


def test_a_common_passage_makes_no_pairs_of_blocks(spark, monkeypatch):
    """Rows follow the documents, not their square, where many share a passage and few are alike."""
    monkeypatch.setattr(linking, "BLOCK", 8)
    made, dealt = [], linking.cross_pairs

    def counted(*args):
        out = dealt(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(linking, "cross_pairs", counted)
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = word(44), []
    for k in range(320):
        t = word(20) + passage + word(20)
        texts += [t] if k % 10 else [t, ["x"] + t[1:], t[:-1] + ["y"]]
    for n in (192, 384):
        rows = [(k, " ".join(t)) for k, t in enumerate(texts[:n])]
        assert got(spark, rows) == truth(rows)
    assert made[1] <= 3 * made[0] + 384


def test_alike_items_share_a_rare_token(spark):
    """Items alike in just enough places meet, however common or rare the tokens are in which they agree."""
    rng = random.Random(8)
    compare, size = ngram_join.Sketches(0.6), ngram_join.SKETCH
    common = [rng.randrange(1 << 32) for _ in range(size)]
    sets = []
    for _ in range(60):
        a = [c if rng.random() < 0.55 else rng.randrange(1 << 32) for c in common]
        differ = set(rng.sample(range(size), compare.spare))
        sets += [a, [rng.randrange(1 << 32) if p in differ else v for p, v in enumerate(a)]]
    data = [b"".join(v.to_bytes(4, "little") for v in s) for s in sets]
    pairs = {(i, j) for i in range(120) for j in range(i) if sum(x == y for x, y in zip(sets[i], sets[j])) >= 0.6 * size}
    assert len(pairs) >= 60
    items = spark.createDataFrame([(k, k, d) for k, d in enumerate(data)], "alias long, root long, data binary")
    by = {}
    for r in linking.rare_tokens(items, compare).collect():
        by.setdefault(r.path, []).append(r.alias)
    met = {(max(i, j), min(i, j)) for v in by.values() for i in v for j in v if i != j}
    assert pairs <= met and len(met) < 0.5 * 120 * 119 / 2
