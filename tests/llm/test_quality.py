import random

import duckdb

from llm import brute
from brindle.llm import queries
from brindle.llm.quality import quality_rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def same(spark, pairs):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None, 1.0) for i, t in pairs], "doc_id long, text string, source string, n_words double")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in quality_rules(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in pairs}


def test_rules_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    same(spark, [(r.doc_id, r.text) for r in docs])


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "\n\n a\n a\n", "# $ % é ü\x1f x", "a b c d e f g h " * 6, "x" * 5000, " ".join("ab"[rng.random() < 0.5] for _ in range(4000))]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    same(spark, list(enumerate(texts)))
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_bad_host_goes_and_good_hosts_stay(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = [(i, good if i % 10 else "short", f"good{i % 4}") for i in range(200)] + [(1000 + i, "short" if i % 8 else good, "bad") for i in range(200)]
    rows = quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert all(not r.kept for r in rows if r.source == "bad")
    assert all(r.kept == (not r.base_failed) for r in rows if r.source != "bad")


def test_failing_hosts_as_the_oracle(spark, tmp_path):
    """Hosts whose share of bad documents lies around the bound, one of them null: the registered SQL gives the same verdicts."""
    good = " ".join(f"word{i}" for i in range(40))
    shares = {"a": 0, "b": 3, "c": 7, "d": 8, "e": 9, "f": 10, None: 9}
    docs = [(k * 1000 + i, "short" if i % 10 < bad else good, host) for k, (host, bad) in enumerate(shares.items()) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_words", "base_failed", "kept"]
    got = sorted(tuple(r) for r in queries.op6_quality_rules(spark, str(tmp_path)).select(*names).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op6_quality_rules']})").fetchall())
    kept, base = {r[0] for r in got if r[3]}, {r[0] for r in got if not r[2]}
    assert kept < base and {i // 1000 for i in kept} == {0, 1, 2, 3} and {i // 1000 for i in base - kept} == {4, 6}
