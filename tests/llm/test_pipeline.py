import random
from collections import Counter

import corpus_pipeline
from brindle.storage import materialize
from llm import brute
from llm.test_lines import truth as line_truth
from llm.test_ngram_join import truth as join_truth
from llm.test_tokens import check_packing


def test_stages_as_brute_force(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "src1", 7)], docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), name))
    assert all(d.columns == docs.columns for d in out[:-1])
    raw, lang, line, near, mix = ([(r.doc_id, r.text) for r in d.collect()] for d in out[:5])
    # language: rows without letters go, clean documents stay
    assert {i for i, _ in raw} - {i for i, _ in lang} == {10**6, 10**6 + 1}
    # lines: one of each class stays, in place
    gone = line_truth(lang)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, (0, []))[1])) for i, t in lang}
    want = {i: t for i, t in want.items() if not (i in gone and gone[i][0] == len(gone[i][1]))}
    assert len(set(dict(line).items()) ^ set(want.items())) <= 2
    # near duplicates: the least document of each class stays
    assert {i for i, _ in near} == {i for i, least, _ in join_truth(line) if i == least}
    # mix: each document at most twice, with its whole text
    assert max(Counter(i for i, _ in mix).values()) <= 2 and set(mix) <= set(near)
    assert abs(sum(len(brute.words(t)) for _, t in mix) / sum(len(brute.words(t)) for _, t in near) - 1.5) < 0.05
    assert check_packing(out[5].collect(), dict(mix), len(mix)) > 0.9


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "empty")
    assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    """Thousands of rows without an id or with one that others share: no unique line or text is lost, every copy goes."""
    from brindle.llm import lines, ngram_join

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    unique = lambda n=12: " ".join(word() for _ in range(n))
    header = "a shared header line that stands in very many texts"
    rows = [(1, header + "\nfirst body of the first text"), (5, header + "\nquite another body here"), (5, "only here is this sentence to be found\nand this other one as well")]
    rows += [(None, header + "\n" + unique()) for _ in range(1500)] + [(7, header + "\n" + unique() + "\n" + unique()) for _ in range(1500)]
    again = [(None, unique(30)), (9, unique(30)), (9, unique(30))]
    rows += again * 200 + [(11, again[1][1]), (2, again[0][1])] + [(None, None), (None, None), (3, " "), (3, " ")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, n_chars long, removed string").repartition(7)
    out = [(r.doc_id, r.text) for r in lines.dedup_lines(df).collect()]
    left = Counter(x.strip() for _, t in out for x in (t or "").split("\n") if x.strip())
    assert set(left) == {x.strip() for _, t in rows for x in (t or "").split("\n") if x.strip()} and set(left.values()) == {1}
    assert sum(t is None for _, t in out) == 2 and out.count((3, " ")) == 2
    assert len(out) == len({r for r in rows if r[1] and r[1].strip()}) - 2 + 4
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect())
    want = {}
    for i, t in rows:
        if t and t.strip():
            want[t] = min(want.get(t, (i is not None, i or 0)), (i is not None, i or 0))
    assert kept == Counter({(i if has else None, t): 1 for t, (has, i) in want.items()}) + Counter({(None, None): 2, (3, " "): 2})
