import hashlib
import random

import numpy as np

from brindle.llm import repeats


def truth(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 399):
            seen.setdefault(t[i : i + 400], []).append((d, i))
    mark = [np.zeros(len(t) + 1, bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                mark[d][i : i + 400] = True
    out = []
    for (i, _), t, m in zip(rows, texts, mark):
        kept = bytes(np.frombuffer(t, np.uint8)[~m[:-1]])
        out.append((i, len(t), int(m.sum()), int((np.diff(m.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, spans string")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, **kw).collect()), key=str)


def test_cover_has_every_difference():
    assert {int((a - b) % repeats.PERIOD) for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == truth(rows)


def made():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (395, 399, 400, 401, 450, 700, 1500, 3000)]
    rows = []
    for k in range(120):
        parts = [word(rng.randint(0, 300)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "#"
            parts.insert(rng.randrange(len(parts)), "".join(p))
        rows.append((k, "".join(parts)))
    rows += [(500 + k, passages[4] + word(50)) for k in range(40)] + [(600 + k, word(rng.randint(1, 40)) + passages[2] + word(5)) for k in range(40)]
    rows += [(900, None), (901, ""), (902, "z" * 900), (903, "ab" * 1000), (904, "q" * 400), (905, "w" * 401), (None, passages[7]), (7, rows[7][1]), (7, rows[7][1]), (906, "y" * 399)]
    return rows


def test_planted_passages_and_odd_texts(spark):
    rows = made()
    assert got(spark, rows) == truth(rows)
    assert got(spark, []) == []


def test_large_buckets_give_the_same(spark):
    rows = made()
    assert got(spark, rows, small=3) == truth(rows)
