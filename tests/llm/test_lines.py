import random
import re

import numpy as np
import pyarrow as pa

from brindle.llm import linking, lines

SP = " \t\n\x0b\x0c\r"


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)} or {line}


def truth(rows):
    at = [(i, n, x.strip(SP)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    at.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    texts = list(dict.fromkeys(x for _, _, x in at))
    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    by = {}
    for v, s in enumerate(sets):
        for u in {u for x in s for u in by.get(x, ())}:
            both = len(s & sets[u])
            if both >= 0.8 * (len(s) + len(sets[u]) - both):
                root[max(find(u), find(v))] = min(find(u), find(v))
        for x in s:
            by.setdefault(x, []).append(v)
    place = {x: v for v, x in enumerate(texts)}
    seen, out = set(), {}
    for i, n, x in at:
        r = find(place[x])
        out.setdefault(i, [0, []])[0] += 1
        if r in seen:
            out[i][1].append(n)
        seen.add(r)
    return {i: (n, gone) for i, (n, gone) in out.items()}


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, line_no int, removed string")
    return {r.doc_id: (r.n_lines, r.removed) for r in lines.removed_lines(docs).collect()}


def misses(have, want):
    assert have.keys() == want.keys() and all(have[i][0] == want[i][0] for i in want)
    return sum(len(set(have[i][1]) ^ set(want[i][1])) for i in want), sum(len(want[i][1]) for i in want)


def test_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wrong, total = misses(got(spark, rows), truth(rows))
    assert total > 50 and wrong <= 0.005 * total


def test_edited_lines_and_odd_texts(spark, monkeypatch):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    made = []
    for _ in range(60):
        base = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 30, 120])))
        for _ in range(rng.choice([1, 2, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            made.append("".join(t))
    rng.shuffle(made)
    rows = [(k, "\n".join(made[4 * k : 4 * k + 4])) for k in range(len(made) // 4)]
    rows += [(9000, None), (9001, ""), (9002, "\n \n\t"), (9003, " one \n\none"), (None, "one\nother here"), (9004, "z" * 60000), (9005, "z" * 70000 + "\n" + "ab\n" * 3000)]
    monkeypatch.setattr(linking, "BLOCK", 8)
    wrong, total = misses(got(spark, rows), truth(rows))
    assert total > 500 and wrong <= 0.004 * total
    assert got(spark, []) == {}


def test_texts_are_rebuilt(spark):
    rows = [(1, "keep me here\nand this line too"), (2, "keep me here\n\nnew line of two"), (3, "and this line too"), (4, None), (5, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], 30), 2: ("\nnew line of two", 16), 4: (None, 9), 5: (" ", 1)}


def test_lines_hash_as_in_the_line_table(spark):
    text = "a b\n  é\x0b \n\n" + "x" * 50
    t = {r.line for r in lines.line_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    import xxhash

    data = np.frombuffer(text.encode(), np.uint8)
    s, e = lines.find_lines(data, np.asarray([0, len(data)]))
    h = {int(np.uint64(xxhash.xxh64_intdigest(data.tobytes()[a:b], 42)).astype(np.int64)) for a, b in zip(s, e)}
    assert t == h and len(t) == 3


def test_recall_by_length_with_and_without_the_signature_bound():
    """Pairs at similarities 0.80 to 0.83: how many share a band, and how many of these the bound on agreeing minima lets through."""
    rng = np.random.default_rng(12)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    for low, high in ((11, 17), (18, 60), (61, 250), (251, 900)):
        pairs = []
        while len(pairs) < 1500:
            n = int(rng.integers(low - 7, high - 6))
            more = next((t for t in range(1, n) if 0.80 <= n / (n + t) <= 0.83), 0)
            if more:
                a = rng.choice(letters, n + 7)
                pairs.append((a.tobytes(), a.tobytes() + rng.choice(letters, more).tobytes()))
        flat = [x for p in pairs for x in p]
        off = np.cumsum([0, *map(len, flat)])
        h, char = lines.char_shingles(np.frombuffer(b"".join(flat), np.uint8))
        signature = lines.signatures(h, char[off[:-1]], char[off[1:]] - lines.SHINGLE + 1, np.zeros(len(flat), np.uint64))
        keys, sketch = lines.band_keys(signature), (signature >> np.uint32(12)).astype(np.uint8)
        banded = (keys[::2] == keys[1::2]).any(1)
        passed = (sketch[::2] == sketch[1::2]).sum(1) >= lines.LEAST_AGREEING * lines.SLOTS
        print(low, high, banded.mean(), (banded & passed).mean())
        assert banded.mean() > 0.99 and (banded & passed).mean() > 0.985


def test_many_lines_nearly_alike_are_seldom_compared_in_full(monkeypatch):
    """A base text of 500 characters in 120 edits of some 4 to 8 places: each pair meets, few are alike at 0.8."""
    rng = random.Random(21)
    base, made = [rng.choice("abcdefghij é") for _ in range(500)], []
    for k in range(120):
        t = list(base)
        for at in rng.sample(range(500), rng.randint(4, 8)):
            t[at] = rng.choice("xyz")
        made.append("".join(t).strip().encode())
    made += [b"one", b"one", "é".encode() * 5000, "é".encode() * 5000]
    data = pa.array([bytes(lines.HEAD) + x for x in made], pa.binary())  # without signatures no pair is ruled out by them
    i, j = (x.ravel() for x in np.triu_indices(len(made), 1))
    want = lines.alike_lines(made, i, j, 0.8)
    full, compare = [], lines.alike_lines
    monkeypatch.setattr(lines, "alike_lines", lambda texts, a, b, t: (full.append(len(a)), compare(texts, a, b, t))[1])
    got = lines.Lines(0.8)
    assert (got.pairs(got.prepare(data), i, j) == want).all()
    assert want.sum() > 20 and sum(full) < want.sum() + 0.2 * (~want).sum()


def test_groups_are_cut_at_their_ends_only():
    rng = np.random.default_rng(5)
    path = np.sort(rng.integers(0, 60, 900))
    table = pa.table({"path": path, "bi": np.zeros(900, int), "data": pa.array([bytes(int(k)) for k in rng.integers(0, 30, 900)], pa.binary())})
    for rows, step in ((1, 7), (50, 64), (2000, 900), (40, 1)):
        parts = list(linking.held_columns(iter(table.to_batches(max_chunksize=step)), ["path", "bi"], rows, 1 << 22))
        assert np.concatenate([p.column("path").to_numpy() for p, _, _ in parts]).tolist() == path.tolist()
        groups = [p.column("path").to_numpy()[a:b].tolist() for p, start, end in parts for a, b in zip(start, end)]
        assert [g[0] for g in groups] == sorted(set(path.tolist())) and all(len(set(g)) == 1 for g in groups)
        for p, start, end in parts:
            v, (i, j) = p.column("path").to_numpy(), linking.pairs_of(start, end)
            assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(v)) for y in range(x + 1, len(v)) if v[x] == v[y]}


def test_copies_of_a_row_count_its_lines_once(spark):
    text = " \n\t\n first\n\nfirst\n second \n"
    docs = spark.createDataFrame([(1, text)] * 3 + [(1, "other\nthird one"), (2, "\n\x0b\n"), (None, "first")], "doc_id long, text string")
    rows = {(r.doc_id, r.n_lines, r.copies) for r in lines.removed_lines(docs).collect()}
    assert rows == {(1, 3, 3), (1, 2, 1), (None, 1, 1)}
