import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from brindle.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "\n", "hello world", " leading", "trailing  ", "two  spaces\n\nand lines\n end", "it's we'll I'M 's", "x<|endoftext|>y </s> <s>", "a▁b", "▁", "tab\there\r\nthere", "日本語 の 文 　 全角",
    "naïve Straße İß Ünï", "nbsp here em space", "\u0000zero\u0001", "😀 😀😀 é", "word," * 50, "no" * 3000, "(word)... \"quoted\" [1] 2,000.50 -- end", "a \n b\n  c\n\n  d", "​ zero ﻿ width", "Привет, мир\nкак дела", "ŉ ǆ ɐ ʰ", "١٢٣ ①②", "x\u0085y   z", "'s 't\n's", "end.\n",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Aligner(A, B)


def whole(text, a, b, tables):
    """Groups and links of a whole text, token by token."""
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xa, xb = [tables.bytes_a[i] for i in ia], [tables.bytes_b[i] for i in ib]
    if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
        return None
    ends = lambda xs: [sum(map(len, xs[: i + 1])) for i in range(len(xs))] if len(xs) < 300 else __import__("itertools").accumulate(map(len, xs))
    ea, eb = list(ends(xa)), list(ends(xb))
    both, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
    for e in both:
        ni, nj = ea.index(e, i) + 1, eb.index(e, j) + 1
        groups.append((ia[i:ni], ib[j:nj]))
        i, j = ni, nj
    at = dict(zip(eb, ib))
    return ia, ib, groups, [(x, at[e]) for x, e in zip(ia, ea) if e in at]


def brute(rows, libraries):
    found = [(i, whole(t, *libraries)) for i, t in rows]
    counts = Counter(p for _, f in found if f for p in f[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for i, f in found:
        if f:
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in f[2])
            out.append((i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()))
        else:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


def test_odd_texts(spark, libraries):
    """Nulls, empty, odd spaces, special strings, scripts, copies, null ids and columns of clashing names."""
    rows = [*enumerate(ODD), (None, ODD[5]), (5, ODD[5]), (7, "another row")]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, keys string, block int").repartition(3)
    got = sorted([tuple(r) for r in alignment.align(df, A, B).collect()], key=str)
    assert got == brute(rows, libraries)
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_chunks_give_the_groups_of_whole_texts(libraries, monkeypatch):
    rng = random.Random(4)
    parts = ["a", "Word", " ", "  ", "\n", ".", ",", "'s", "'", "é", "Я", "日", " ", " ", "\t", "12", "😀", "<|endoftext|>", "▁", "-", "_", "\r", "ſ", "ǅ", "́"]
    texts = [" " + "".join(rng.choices(parts, weights=[4, 4, 6, 2, 3] + [1] * (len(parts) - 5), k=rng.randrange(1, 40))) for _ in range(3000)]
    work = libraries[2]
    rows, keys, uses, docs = work.block(pa.array(texts, pa.large_string()), True)
    for t, (n_a, n_b, n_groups, digest, _) in zip(texts, rows):
        f = whole(t[1:], *libraries)
        want = (len(f[0]), len(f[1]), len(f[2])) if f else (0, 0, 0)
        assert (n_a, n_b, n_groups) == want, repr(t)
    assert sum(uses) == sum(r[2] for r in rows) and (docs <= uses).all() and (docs > 0).all()
    monkeypatch.setattr(alignment.Aligner, "LARGEST", 10)
    small = alignment.Aligner(A, B)
    small.block(pa.array(texts[:100], pa.large_string()))
    assert small.block(pa.array(texts[100:400], pa.large_string()))[0][7][:4] == rows[107][:4]


def test_query(spark, sf, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.op12_token_alignment(spark, sf).collect()], key=str)
    assert got == brute(rows, libraries)


def test_small_blocks_and_other_rules(spark, sf, libraries):
    """Many blocks give what one gives; links by overlap, and weights by documents, by hand."""
    df = spark.createDataFrame([(1, "ab ab"), (2, "ab"), (3, None)], "doc_id long, text string")
    ids = whole("ab", *libraries)
    n = len(ids[3])
    by_doc = {r.doc_id: r for r in alignment.align(df, A, B, weight="documents").collect()}
    assert by_doc[1].count_sum == 2 * by_doc[2].count_sum == 2 * 2 * n
    assert alignment.link_pairs([1, 2], [3, 4, 5], {1: 2, 2: 3}, {3: 1, 4: 3, 5: 1}, "overlap") == {(1, 3): 1, (1, 4): 1, (2, 4): 1, (2, 5): 1}
    assert alignment.link_pairs([1, 2], [3, 4, 5], {1: 2, 2: 3}, {3: 1, 4: 3, 5: 1}, "ends") == {(2, 5): 1}
    overlap = {r.doc_id: r for r in alignment.align(df, A, B, rule="overlap").collect()}
    assert overlap[2].n_links >= by_doc[2].n_links and overlap[3].n_links == 0
