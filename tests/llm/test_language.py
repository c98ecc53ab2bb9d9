import zlib
from dataclasses import replace

from brindle.llm import language, queries


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_odd_rows(spark, sf):
    model = language.train_language_model(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 $ \n", "k"), (None, "the of and that", "k"), (4, "le la " * 50000, None), (4, "der die und", "k")], "doc_id long, text string, score string")
    rows = {(r.doc_id, r.lang_pred): r for r in language.predict_languages(docs, model).collect()}
    assert len(rows) == 6 and all((i, "und") in rows for i in (1, 2, 3))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {None, 4}
    assert language.predict_languages(docs.limit(0), model).count() == 0
    empty = language.train_language_model(docs.limit(0).selectExpr("*", "'' as lang"))
    assert language.predict_languages(docs, empty).count() == 6


def test_like_text_is_told_unlike_rejected(spark):
    en = ["the thing and that other with heath", "then they were here and there with the rest", "this is the one that rather mattered"]
    fr = ["le les une eau des aux beaux", "elle est la reine des eaux", "une autre que les vieux cadeaux"]
    docs = spark.createDataFrame([(k, f"{en[k % 3]} {en[(k // 3) % 3]}" if k % 2 else f"{fr[k % 3]} {fr[(k // 3) % 3]}", "en" if k % 2 else "fr") for k in range(120)], "doc_id long, text string, lang string")
    model = language.train_language_model(docs)
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, model).collect()}
    assert all(got[k] == ("en" if k % 2 else "fr") for k in got)
    assert not any(r.rejected for r in language.predict_languages(docs, model).collect())
    mixed = spark.createDataFrame([(k, f"{en[k % 3]} {fr[k % 3]}", None) for k in range(3)] + [(9, "qx zv wk jj", None)], docs.schema)
    strict = replace(model, reject_below=0.999)
    rows = {r.doc_id: r for r in language.predict_languages(mixed, strict).collect()}
    assert all(r.rejected == (r.score < 0.999) and r.lang_pred in ("en", "fr") for r in rows.values()) and any(r.rejected for r in rows.values())
    kept = {r.doc_id for r in language.keep_identified(mixed, strict).collect()}
    assert kept == {k for k, r in rows.items() if not r.rejected}
