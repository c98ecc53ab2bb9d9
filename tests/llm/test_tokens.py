import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing, queries, tokens
from brindle.storage import materialize, new_folder

PATH = queries.tokenizer_path()
ODD = [(4, None), (2, ""), (None, "hello  World"), (7, "a b\x1cc é İx <|endoftext|>y don't 12,3 z"), (7, "a b\x1cc é İx <|endoftext|>y don't 12,3 z"), (9, "word " * 90000), (-3, "x" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0, "s") for i, t in ODD], "doc_id long, text string, ids int, place string")


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_shards(rows, texts, key=lambda r: (r.start,)):
    at = 0
    for r in sorted(rows, key=key):
        ids = whole(texts[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_shards_as_whole_texts(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = tokens.write_and_read(docs, PATH).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(r.doc_id for r in docs.collect())
    check_shards(rows, {r.doc_id: r.text for r in docs.collect()})
    rows = tokens.write_and_read(odd, PATH).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, -3, 2, 4, 7, 7, 9]
    check_shards(rows, dict(ODD))
    assert tokens.write_and_read(odd.limit(0), PATH).count() == 0


def test_reader_takes_only_needed_frames_and_checks_them(spark, odd):
    folder = new_folder(spark, "shards")
    manifest = materialize(tokens.write_shards(odd.coalesce(1), folder, PATH), "m").collect()
    fs, top = pafs.FileSystem.from_uri(folder)
    for m in manifest:
        with fs.open_input_file(f"{top}/{m.path}") as f:
            data = f.read()
        with fs.open_input_file(f"{top}/{m.path}") as f:
            reader = tokens.ShardReader(f)
            taken = []
            reader.frame = lambda k, get=reader.frame: taken.append(k) or get(k)
            for row in range(len(reader.doc_ids)):
                ids = np.frombuffer(b"".join(reader.pieces(row)), "<u4")
                assert ids[-1] == 2
            bad = bytearray(data)
            bad[10] ^= 1
            with fs.open_output_stream(f"{top}/bad") as out:
                out.write(bytes(bad))
            with fs.open_input_file(f"{top}/bad") as g, pytest.raises(Exception):
                tokens.ShardReader(g).frame(0)
        # any zstandard reader sees the plain ids: skippable frames are skipped
        import io

        import zstandard

        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == 4 * m.n_tokens


def check_packing(rows, texts, n_docs):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    for i, parts in pieces.items():
        ids = whole(texts[i]) + [1]
        copies = sum(p.start == 0 for p in parts)
        assert sum(p.length for p in parts) == copies * len(ids)
        for p in parts:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    assert sum(r.start == 0 for r in rows) == n_docs
    return sum(r.length for r in rows) / (2048 * len(seqs))


def test_packing(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packing(packing.pack(docs, PATH).collect(), texts, len(texts)) > 0.95
    check_packing(packing.pack(odd, PATH).collect(), dict(ODD), len(ODD))
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_index_scores_are_bm25():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(5, 40, rng.integers(3, 30)), 1).astype("<u4") for _ in range(40)]
    df = np.zeros(50, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, len(docs), mean, df)
    for q in (0, 7):
        want = []
        for d in docs:
            s = 0.0
            for t in set(docs[q][:-1].tolist()):
                c, idf = int((d[:-1] == t).sum()), np.log(max(1.0, (len(docs) - df[t] + 0.5) / (df[t] + 0.5)))
                s += idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(s)
        assert np.allclose(index.scores(q), want, rtol=1e-4)


def test_seed_gets_its_own_neighbours():
    a, b = np.arange(10, 400), np.arange(1000, 1400)
    docs = [np.append(x, 1).astype("<u4") for x in (a, b, a[::-1], b[::-1])]
    df = np.zeros(2000, np.int64)
    for d in docs:
        df[d] += 1
    pieces = list(packing._pack([len(d) for d in docs], packing.Index(docs, 100, 390, df), 800))
    assert [p[0] for p in pieces[:2]] == [0, 2]


def test_dropped_documents_change_no_score():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(5, 90, rng.integers(3, 60)), 1).astype("<u4") for _ in range(80)]
    df = np.zeros(100, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    index, less = (packing.Index(docs, len(docs), 30.0, df) for _ in range(2))
    gone = rng.random(80) < 0.5
    less.drop(gone)
    for q in (0, 11, 50):
        assert np.array_equal(less.scores(q), np.where(gone, 0, index.scores(q)))


def test_neighbours_without_a_common_run_meet_in_1500_documents(spark):
    rng = np.random.default_rng(4)
    words = [a + b + d for a in "bcdfghjk" for b in "aeiou" for d in ("lt", "rm", "nd", "sk", "mp")]
    rows = [(i, " ".join(rng.choice(words, 300))) for i in range(1500)]
    for i in range(0, 40, 2):
        mine = [f"{rng.integers(10**5, 10**6)}" for _ in range(90)]
        rows[i], rows[i + 1] = (i, " ".join(mine)), (i + 1, " ".join(rng.permutation(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seqs = {}
    for r in packing.pack(docs, PATH).where("doc_id < 40").collect():
        seqs.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert sum(bool(seqs[i] & seqs[i + 1]) for i in range(0, 40, 2)) >= 18
