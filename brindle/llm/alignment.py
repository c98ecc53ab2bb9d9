"""Links between the tokens of two tokenizers, by a dictionary of groups.

Places where tokens of both end cut a text into groups. A group is the ids of its A tokens and of its B tokens; distinct groups are
interned, their links expanded once, weighted by how often the group occurs, and the results joined back by group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.tokens import _AS_CHARACTER, binary_list, spread
from brindle.storage import materialize

BLOCK = 1 << 23
ENCODED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, used binary, keys array<binary>, uses array<long>, docs array<long>"
LINKS = "key binary, n long, a int, b int, times long"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: The byte of each character of a byte-level vocabulary.
_TO_BYTE = {**{chr(b): b for b in range(256) if b not in _AS_CHARACTER}, **{chr(c): b for b, c in _AS_CHARACTER.items()}}


def _safe(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a character that is surely no white space ends at each byte, and whether one begins there: printable ASCII, two-byte
    characters from U+00C0 on, three-byte ones from U+4000 on."""
    plain = (data > 32) & (data < 127)
    two, three = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xEF)
    ends = plain.copy()
    ends[1:] |= two[:-1]
    ends[2:] |= three[:-2]
    return ends, plain | two | three


class Aligner:
    """Groups of texts, each distinct chunk aligned once.

    A chunk ends before a space or line feed that follows a character which is no white space, and after a single line
    feed between two such characters. The first tokenizer's pattern always cuts there, and no piece of the second holds a space or
    line feed behind another character (checked on loading; else a whole text is one chunk). So neither joins tokens across chunks, and the groups of a text
    are those of its chunks; tests compare whole texts. The store of known chunks starts again when it is large; that bounds memory, not results.
    """

    LARGEST = 400_000

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a, self.bytes_b = [b""] * n, []
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(_TO_BYTE[c] for c in token)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            m = _BYTE.fullmatch(piece)
            self.bytes_b.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())
        self.lengths_a, self.lengths_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.cuts = not any(b" " in x.lstrip(b" ") or (b"\n" in x and x != b"\n") for x in self.bytes_b)
        self._start()

    def _start(self) -> None:
        self.chunks: dict[bytes, int] = {}
        self.numbers: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.written: list[str] = []
        self.first, self.of = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.n_a, self.n_b, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _ids_a(self, chunks: list[bytes]) -> list[list[int]]:
        """A space and Latin letters are one word to the model, and a run of symbols behind them another."""
        out: list = [None] * len(chunks)
        rest, tails = [], {}
        for k, c in enumerate(chunks):
            t = c.decode()
            body = t[1:] if t[:1] == " " else t
            word = body.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
            if word.isalpha() and max(word) <= "ɏ":
                tail = body[len(word) :]
                head = c[: len(c) - len(tail)].decode("latin-1").translate(_AS_CHARACTER)
                ids = [x.id for x in self.a.model.tokenize(head)]
                if tail:
                    if tail not in tails:
                        tails[tail] = [x.id for x in self.a.model.tokenize(tail)]
                    ids += tails[tail]
                out[k] = ids
            else:
                rest.append(k)
        for k, found in zip(rest, self.a.encode_batch([chunks[k].decode() for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def _ids_b(self, chunks: list[bytes]) -> list[list[int]]:
        """The tokenizer puts a space before a text, but for an empty one; a chunk without one, or of one space only, goes behind a
        line feed, and the two tokens of space and line feed are dropped."""
        texts = [c.decode() for c in chunks]
        spaced = [len(t) > 1 and t[0] == " " for t in texts]
        got = self.b.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced)], num_threads=1)
        return [g if s else g[2:] for s, g in zip(spaced, got)]

    def _learn(self, new: list[bytes]) -> None:
        first, of, n_a, n_b, good = [], [], [], [], []
        for c, a, b in zip(new, self._ids_a(new), self._ids_b(new)):
            ok = b"".join([self.bytes_a[i] for i in a]) == c and b"".join([self.bytes_b[i] for i in b]) == c
            self.chunks[c] = len(self.chunks)
            good.append(ok)
            n_a.append(len(a))
            n_b.append(len(b))
            written, before = [], len(of)
            if ok:
                i = j = i0 = j0 = x = y = 0
                while i < len(a):
                    if x <= y:
                        x += self.lengths_a[a[i]]
                        i += 1
                    while y < x:
                        y += self.lengths_b[b[j]]
                        j += 1
                    if x == y:
                        ga, gb = a[i0:i], b[j0:j]
                        key = np.asarray([len(ga), *ga, *gb], "<u4").tobytes()
                        if key not in self.numbers:
                            self.numbers[key] = len(self.keys)
                            self.keys.append(key)
                        of.append(self.numbers[key])
                        written.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                        i0, j0 = i, j
            self.written.append(";".join(written))
            first.append(len(of) - before)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(first, dtype=np.int64)])
        self.of = np.concatenate([self.of, np.asarray(of, np.int64)])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]).astype(np.int64), np.concatenate([self.n_b, n_b]).astype(np.int64)
        self.good = np.concatenate([self.good, np.asarray(good, bool)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, starts of chunks with the end, and each text's first chunk with the end."""
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        begins = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data):
            ends, starts = _safe(data)
            gap, line = (data == 32) | (data == 10), data == 10
            begins[1:-1] = ends[:-1] & gap[1:]
            begins[2:-1] |= ends[:-2] & line[1:-1] & starts[2:]
        begins[off] = True
        at = np.flatnonzero(begins)
        return data, at, np.searchsorted(at, off)

    def block(self, texts: pa.Array, count_docs: bool = False):
        """Of texts that begin with a space: for each (n_a, n_b, good, n_groups, its groups' numbers, digest); then the keys those
        numbers mean, how often each occurs, and in how many texts (0 unless counted)."""
        data, at, doc = self._cut(texts)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        each = chunks.dictionary_encode()
        known = binary_list(each.dictionary)
        if len(self.chunks) > self.LARGEST:
            self._start()
        new = [c for c in known if c not in self.chunks]
        for k in range(0, len(new), 8192):
            self._learn(new[k : k + 8192])
        place = np.fromiter(map(self.chunks.__getitem__, known), np.int64, len(known))
        place = place[each.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[doc])
        good = (total(~self.good[place]) == 0) & (np.diff(doc) > 0)
        size = np.where(np.repeat(good, np.diff(doc)), self.first[place + 1] - self.first[place], 0)
        groups = self.of[spread(self.first[place], self.first[place] + size)]
        uses = np.bincount(groups, minlength=len(self.keys))
        kept = np.flatnonzero(uses)
        number = np.zeros(len(self.keys), np.int64)
        number[kept] = np.arange(len(kept))
        groups = number[groups].astype("<u4")
        cut = np.concatenate([[0], np.cumsum(total(size))])
        docs = np.zeros(len(kept), np.int64)
        if count_docs and len(groups):
            pairs = np.unique(np.repeat(np.arange(len(good)), np.diff(cut)) * len(kept) + groups)
            docs = np.bincount(pairs % len(kept), minlength=len(kept))
        rows = []
        n_a, n_b = total(self.n_a[place]), total(self.n_b[place])
        for i, ok in enumerate(good.tolist()):
            if ok:
                written = ";".join(map(self.written.__getitem__, place[doc[i] : doc[i + 1]].tolist()))
                rows.append((int(n_a[i]), int(n_b[i]), int(cut[i + 1] - cut[i]), hashlib.sha256(written.encode()).hexdigest(), groups[cut[i] : cut[i + 1]].tobytes()))
            else:
                rows.append((0, 0, 0, "", b""))
        return rows, [self.keys[k] for k in kept.tolist()], uses[kept], docs


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker and pair of files; threads of the libraries are off, Spark runs the tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _table(block: int, ids: list, rows: list, keys: list | None = None, uses: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    n = len(rows) + (keys is not None)
    last = [None] * (keys is not None)
    data = [[block] * n, [*ids, *last], *[[*c, *last] for c in columns]]
    arrays = [pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
    listed = lambda x, t: pa.array([None] * len(rows) + ([x] if keys is not None else []), pa.list_(t))
    arrays += [listed(keys, pa.binary()), listed(None if uses is None else uses.tolist(), pa.int64()), listed(None if docs is None else docs.tolist(), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "used", "keys", "uses", "docs"])


def encode_groups(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", count_docs: bool = False) -> DataFrame:
    """A row for each document, with its groups as numbers, and a row for each block of documents with the groups these numbers mean.

    A block is about 8 MB of texts, one whole text at least. Written once, so that block numbers hold when a task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[pa.Array] = []
        held = 0

        def done() -> pa.RecordBatch:
            return _table(block, ids, *work.block(pa.concat_arrays(texts), count_docs))

        for batch in batches:
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False)
            text = pc.if_else(pc.greater(pc.binary_length(text), 0), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())), text)
            id_list, a = batch.column(0).to_pylist(), 0
            while a < len(text):
                b = a + max(1, int(np.searchsorted(np.cumsum(size[a:]), BLOCK - held, side="right")))
                ids += id_list[a:b]
                texts.append(text.slice(a, b - a))
                held += int(size[a:b].sum())
                a = b
                if held >= BLOCK or a < len(text):
                    yield done()
                    block, held = block + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield done()

    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED), "groups")


def link_pairs(a: list[int], b: list[int], lengths_a: list[int], lengths_b: list[int], rule: str) -> dict[tuple[int, int], int]:
    """How often each pair of ids is linked in a group: tokens whose bytes end together, or by ``rule`` "overlap" share a byte."""
    out: dict[tuple[int, int], int] = {}
    ends_a, ends_b = np.cumsum([lengths_a[i] for i in a]).tolist(), np.cumsum([lengths_b[i] for i in b]).tolist()
    if rule == "ends":
        at = dict(zip(ends_b, b))
        pairs = [(i, at[e]) for i, e in zip(a, ends_a) if e in at]
    else:
        pairs, j = [], 0
        for i, e in zip(a, ends_a):
            start = e - lengths_a[i]
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - lengths_b[b[k]] < e:
                pairs.append((i, b[k]))
                k += 1
    for p in pairs:
        out[p] = out.get(p, 0) + 1
    return out


def expand_links(groups: DataFrame, path_a: str, path_b: str, rule: str = "ends") -> DataFrame:
    """(key, n, a, b, times): the linked pairs of each distinct group (key, n), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for batch in batches:
            keys, n, a, b, times = [], [], [], [], []
            for key, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(key, "<u4").tolist()
                for (i, j), t in link_pairs(x[1 : 1 + x[0]], x[1 + x[0] :], work.lengths_a, work.lengths_b, rule).items():
                    keys.append(key)
                    n.append(count)
                    a.append(i)
                    b.append(j)
                    times.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(times, pa.int64())], names=["key", "n", "a", "b", "times"])

    return groups.mapInArrow(run, LINKS)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): an id pair's links over the corpus, and whether no pair of that b has more."""
    counts = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("times")).alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, *, rule: str = "ends", weight: str = "links", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: token counts, groups, links, links whose pair is its b id's most frequent, and the sum of the links' counts.

    ``weight`` "links" counts each occurrence of a group, "documents" each document that holds it. Null and empty texts, and texts
    that either tokenizer does not give back byte for byte, have zeros and an empty digest. Repeated rows and null ids each have
    their row and count each time. Groups never reach the driver; a frequent group is one row of each block of documents before it is
    moved. An empty table gives none.
    """
    encoded = encode_groups(docs, path_a, path_b, id_col=id_col, text_col=text_col, count_docs=weight == "documents")
    use = "uses" if weight == "links" else "docs"
    local = encoded.where("keys is not null").select("block", F.posexplode(F.arrays_zip("keys", F.col(use).alias("n"))).alias("number", "g")).select("block", "number", F.col("g.keys").alias("key"), F.col("g.n").alias("n"))
    groups = local.groupBy("key").agg(F.sum("n").alias("n"))
    links = materialize(expand_links(groups, path_a, path_b, rule), "links")
    scored = links.join(pair_counts(links), ["a", "b"]).groupBy("key").agg(
        F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("count")).alias("total"),
    )
    values = local.select("block", "number", "key").join(scored, "key").select(F.col("block").alias("of_block"), "number", "links", "best", "total")
    rows = encoded.where("keys is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "used")

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        used = left.column("used").to_pylist()
        cut = np.cumsum([0, *(len(u) // 4 for u in used)])
        at = np.frombuffer(b"".join(used), "<u4")
        number = right.column("number").to_numpy()
        out = []
        for name in ("links", "best", "total"):
            value = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
            value[number] = right.column(name).to_numpy()
            out.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(value[at], dtype=np.int64)])[cut])))
        return pa.table([left.column("doc_id"), left.column("n_a"), left.column("n_b"), left.column("n_groups"), *out, left.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(put_together, ALIGNED)
