import numpy as np
import pytest

from brindle.llm import licences

PLANTED = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}


@pytest.fixture(scope="module")
def model(spark, sf):
    return licences.train_licence_model(spark.read.parquet(f"{sf}/documents.parquet"))


def test_notices_in_documents(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r.doc_id, n, PLANTED[x.strip()]) for r in docs.collect() for n, x in enumerate(r.text.split("\n")) if x.strip() in PLANTED}
    got = {(r.doc_id, m.line_no, m.family) for r in licences.scan_licences(docs, model).collect() for m in r.matches}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)


def test_edited_notices_and_lookalikes(spark, model):
    rng = np.random.default_rng(99)
    texts, labels = licences._examples(rng, 3)
    pick = [k for k in range(len(texts)) if labels[k] and len(texts[k].split()) > 6]
    docs = spark.createDataFrame([(k, f"Some heading\n{texts[k]}\nand text") for k in pick], "doc_id long, text string")
    hits = sum(any(m.family == licences.FAMILIES[labels[r.doc_id]] and m.line_no == 1 for m in r.matches) for r in licences.scan_licences(docs, model).collect())
    assert hits >= 0.9 * len(pick)
    clean = ["the software of the public library is in general use", "we granted the city a permission", "terms and conditions apply", "apache helicopters over the desert"]
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), model).collect()
    assert not any(r.matches for r in rows)


def _wrap(text, width):
    out = [""]
    for w in text.split():
        if out[-1] and len(out[-1]) + 1 + len(w) > width:
            out.append("")
        out[-1] = f"{out[-1]} {w}".strip()
    return out


@pytest.mark.parametrize("width", [24, 40, 60])
def test_wrapped_notices(spark, model, width):
    notices = [(f, t) for f, texts in licences.TEMPLATES.items() for t in texts if len(t) > width]
    docs = spark.createDataFrame([(k, "\n".join(["a walk to the old river", "and back", "", *_wrap(t, width), "", "the rest of the day"])) for k, (f, t) in enumerate(notices)], "doc_id long, text string")
    rows = {r.doc_id: r.matches for r in licences.scan_licences(docs, model).collect()}
    found = [any(m.family == f and m.line_no >= 3 and m.end_line < 3 + len(_wrap(t, width)) for m in rows[k]) for k, (f, t) in enumerate(notices)]
    lines = {r.doc_id: r.matches for r in licences.scan_licences(docs, model, wrap=1).collect()}
    single = [any(m.family == f for m in lines[k]) for k, (f, t) in enumerate(notices)]
    assert np.mean(found) >= max(0.9, np.mean(single)) and (width > 24 or np.mean(found) > np.mean(single))
    for matches in rows.values():
        assert all(a.end_line < b.line_no for a, b in zip(matches, matches[1:]))


def test_runs_of_lines():
    p = licences.paragraphs(np.frombuffer(b"a b\nc\n\nd\ne f\nghi\nj", np.uint8), np.asarray([0, 13, 18]))
    q = licences.wrapped(p, 3)
    words = lambda x: sorted(zip(x.doc.tolist(), x.line_no.tolist(), x.end_line.tolist(), (x.end - x.first).tolist()))
    assert words(p) == [(0, 0, 0, 2), (0, 1, 1, 1), (0, 3, 3, 1), (0, 4, 4, 2), (1, 0, 0, 1), (1, 1, 1, 1)]
    assert words(q) == [(0, 0, 1, 3), (0, 3, 4, 3), (1, 0, 1, 2)]


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "\n \n", 1), (3, "...", 1), (4, "x " * 100000 + "\nReleased under the MIT License.", 1), (4, "Released under the MIT License.", 1)], "doc_id long, text string, matches int")
    rows = sorted(licences.scan_licences(docs, model).collect(), key=lambda r: (r.doc_id or 0, r.n_paragraphs))
    assert [(r.doc_id, r.n_paragraphs, [m.family for m in r.matches]) for r in rows] == [(None, 0, []), (1, 0, []), (2, 0, []), (3, 0, []), (4, 1, ["MIT"]), (4, 2, ["MIT"])]
    assert licences.scan_licences(docs.limit(0), model).count() == 0
    assert licences.train_licence_model(docs.limit(0)).least >= 0.5


def test_logits_as_plain_sums():
    rng = np.random.default_rng(3)
    w, bias = rng.normal(size=(64, 4)), rng.normal(size=4)
    texts = ["one", "One two!", "a b c d e"]
    p = licences._block(texts)
    got = licences.logits(p, w, bias)
    for k in range(3):
        g = np.concatenate([p.grams[o][p.first[k] : max(p.first[k], p.end[k] - o)] for o in range(3)])
        assert np.allclose(got[k], w[(g % np.uint64(64)).astype(int)].sum(0) / np.sqrt(len(g)) + bias)
