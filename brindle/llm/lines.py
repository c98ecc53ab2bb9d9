"""Fuzzy line deduplication over a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.linking import components_of_shared
from brindle.llm.rows import NO_ID, id_key, one_of_copies
from brindle.llm.text import binary_parts, mix, powers, runs, text_blocks, words
from brindle.storage import materialize

SHINGLE = 8
ROWS, BANDS = 5, 16
PASSES = 2
#: Lines whose signatures agree in fewer places are not compared in full. Of 30,000 made pairs at similarities 0.80 to 0.83
#: (lines of 18 to 250 characters) none agreed in fewer than 0.62 of the places, and the bands missed 0 to 1.5 in a thousand.
LEAST_AGREEING = 0.62
SLOTS = ROWS * BANDS
#: Buckets of the bound on what two lines share, and bytes of the longest line that it judges.
BUCKETS, FOLDED = 512, 4096
#: Bytes before a line in its payload: one of each minimum, four of each band key.
HEAD = SLOTS + 4 * BANDS
_EMPTY = np.iinfo(np.uint32).max
_SPACES = " \t\n\x0b\x0c\r"
_CODE = np.random.default_rng(40).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
_ODD = np.random.default_rng(41).integers(1, 1 << 62, PASSES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_id(doc: str) -> Column:
    """One number for an id (as from ``id_key``) and a text."""
    return F.xxhash64(doc, "text")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, text_id, leads): every line with a word, by place; ``line`` is a 64-bit hash of it, trimmed,
    ``text_id`` one of its document, and ``leads`` tells the first line with a word of a row."""
    start = F.size(F.split(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0), "\n")) - 1
    # beside a generator these would be read again for every line
    rows = docs.select("doc_id", text_id("doc_id").alias("text_id"), start.alias("start"), "text")
    at = rows.select("doc_id", "text_id", "start", F.posexplode(F.split("text", "\n")).alias("line_no", "t")).where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    return at.select("doc_id", "line_no", F.xxhash64(F.btrim("t", F.lit(_SPACES))).alias("line"), "text_id", (F.col("line_no") == F.col("start")).alias("leads"))


def find_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines with a word, trimmed."""
    s, e, _ = words(data, off)
    if not len(s):
        return s, e
    newline = np.flatnonzero(data == 10)
    place = (np.searchsorted(off, s, side="right") - 1) * (len(newline) + 1) + np.searchsorted(newline, s)
    a, b = runs(place)
    return s[a], e[b - 1]


def char_shingles(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all SHINGLE-character runs of the bytes, by first character, and each byte's character."""
    head = (data & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(head)])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) != char[-1]:  # not UTF-8: bytes stand for characters
        codes, char = data, np.arange(len(data) + 1)
    s = np.zeros(len(codes) + 1, np.uint64)
    value = _CODE[codes & 0xFFFF]
    if len(codes) and codes.max() > 0xFFFF:
        value = value + (codes >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    value *= powers(len(codes))[: len(codes)]
    np.cumsum(value, out=s[1:])
    n = max(0, len(codes) - SHINGLE + 1)
    return (s[SHINGLE:] - s[:n]) * powers(len(s), True)[:n] if n else np.zeros(0, np.uint64), char


def signatures(shingles: np.ndarray, start: np.ndarray, end: np.ndarray, short: np.ndarray) -> np.ndarray:
    """SLOTS minima for each line: in each of PASSES passes a shingle falls into one of SLOTS / PASSES bins; an empty
    bin takes the minimum of another by a fixed random probing, the same for every line. ``short`` stands for the only shingle of
    lines of fewer characters."""
    bins = SLOTS // PASSES
    out = np.full(len(start) * SLOTS, _EMPTY, np.uint32)
    n = np.maximum(end - start, 0)
    only = np.flatnonzero(n == 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(start - first[:-1], n)
    h = np.concatenate([shingles[at], short[only]])
    line = np.concatenate([np.repeat(np.arange(len(start)), n), only])
    base = line * SLOTS
    for q in range(PASSES):
        v = h * _ODD[q]
        v >>= np.uint64(32)
        v *= np.uint64(bins)
        # the whole part is the bin, the fraction the value in it; as a multiple of ``bins`` it is never _EMPTY
        value = v.astype(np.uint32)
        v >>= np.uint64(32)
        slot = v.view(np.int64)
        slot += base
        np.minimum.at(out, slot, value)
        base += bins
    out = out.reshape(-1, SLOTS)
    empty = out == _EMPTY
    row, col = np.nonzero(empty)
    probe = 1
    while len(row):
        source = (mix(col.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(probe)) % np.uint64(SLOTS)).astype(np.int64)
        ok = ~empty[row, source]
        out[row[ok], col[ok]] = out[row[ok], source[ok]]
        row, col, probe = row[~ok], col[~ok], probe + 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS minima each, for each line."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mix(acc * np.uint64(0x100000001B3) + signature[:, b + r * BANDS].astype(np.uint64))
        out[:, b] = acc
    return out


def _band_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, data): packed (band key, line) pairs. Lines that meet in a band within one block of texts are
    handed on at once (kind 1, dealt at random); of each band key only the least line of a block goes to the key's bucket."""

    def pack(key: np.ndarray, line: np.ndarray) -> bytes:
        return np.stack([key.view(np.int64), line]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_blocks(batch):
                s, e = find_lines(data, off)
                if not len(s):
                    continue
                raw = memoryview(data.tobytes())
                line = np.asarray([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(s.tolist(), e.tolist())], np.uint64).view(np.int64)
                line, first = np.unique(line, return_index=True)
                s, e = s[first], e[first]
                h, char = char_shingles(data)
                short = np.asarray([xxhash.xxh64_intdigest(raw[a:b], 3) if char[b] - char[a] < SHINGLE else 0 for a, b in zip(s.tolist(), e.tolist())], np.uint64)
                key = band_keys(signatures(h, char[s], char[e] - SHINGLE + 1, short)).ravel()
                line = np.repeat(line, BANDS)
                order = np.lexsort((line, key))
                key, line = key[order], line[order]
                a, b = runs(key)
                many = np.repeat(b - a > 1, b - a)
                key_one, line_one = key[a], line[a]
                bucket = (key_one >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, key_one, line_one = bucket[order], key_one[order], line_one[order]
                out = [(int(bucket[x]), 0, pack(key_one[x:y], line_one[x:y])) for x, y in zip(*runs(bucket))]
                if many.any():
                    out.append((int(line[0] % buckets), 1, pack(key[many], line[many])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])

    return docs.select("text").mapInArrow(run, "bucket int, kind int, data binary")


def _shared_bands(blobs: DataFrame) -> DataFrame:
    """(path, alias): the lines of every band key that two different lines have."""

    def rows(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(line, pa.int64())], names=["path", "alias"])

    def meet(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, line = np.concatenate(parts, axis=1)
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line = key[new], line[new]
        a, b = runs(key)
        many = np.repeat(b - a > 1, b - a)
        return rows(key[many], line[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                part = np.frombuffer(data, np.int64).reshape(2, -1)
                if kind:
                    yield rows(*part)
                    continue
                if bucket != last and held:
                    yield meet(held)
                    held = []
                last = bucket
                held.append(part)
        if held:
            yield meet(held)

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "path long, alias long").distinct()


class _Items:
    def __init__(self, data: pa.Array):
        self.bytes, self.off = binary_parts(data)
        head = self.bytes[self.off[:-1, None] + np.arange(HEAD)] if len(data) else np.zeros((0, HEAD), np.uint8)
        self.sketches = head[:, :SLOTS]
        self.bands = np.ascontiguousarray(head[:, SLOTS:]).view("<u4")
        self.size = np.diff(self.off)

    def lines(self, rows: np.ndarray) -> list[bytes]:
        return [self.bytes[a + HEAD : b].tobytes() for a, b in zip(self.off[rows].tolist(), self.off[rows + 1].tolist())]


def alike_lines(lines: list[bytes], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether lines ``i`` and ``j`` have an exact Jaccard similarity of ``threshold`` or more, for all pairs at once."""
    off = np.cumsum([0, *map(len, lines)])
    h, char = char_shingles(np.frombuffer(b"".join(lines), np.uint8))
    start = char[off[:-1]]
    n = np.maximum(char[off[1:]] - SHINGLE + 1 - start, 0)
    only = np.flatnonzero(n == 0)
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    value = np.concatenate([h[at], np.asarray([xxhash.xxh64_intdigest(lines[k], 3) for k in only], np.uint64)])
    line = np.concatenate([np.repeat(np.arange(len(n)), n), only])
    names, value = np.unique(value, return_inverse=True)
    member = np.sort(line * len(names) + value)
    member = member[np.concatenate([[True], member[1:] != member[:-1]])]
    size = np.bincount(member // len(names), minlength=len(n))
    first = np.cumsum(size) - size
    # members of the smaller set are looked up in the larger one
    few, many = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    out = size[few] >= threshold * size[many] - 1e-9
    few, many = few[out], many[out]
    pair = np.repeat(np.arange(len(few)), size[few])
    at = np.arange(len(pair)) + np.repeat(first[few] - (np.cumsum(size[few]) - size[few]), size[few])
    want = member[at] % len(names) + many[pair] * len(names)
    hit = member[np.minimum(np.searchsorted(member, want), len(member) - 1)] == want
    both = np.bincount(pair[hit], minlength=len(few))
    out[out] = both >= threshold * (size[few] + size[many] - both) - 1e-9
    return out


def may_be_alike(lines: list[bytes], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether :func:`alike_lines` can hold of ``i`` and ``j``: the smaller counts of shingles in each of BUCKETS buckets add up to
    at least what two lines share. Shingles of a line are told apart by 40 bits of their hashes. Lines of under SHINGLE characters
    and long ones are not judged and may be."""
    far = np.asarray([len(x) > FOLDED for x in lines])
    h, char = char_shingles(np.frombuffer(b"".join(b"" if f else x for x, f in zip(lines, far.tolist())), np.uint8))
    start = char[np.cumsum([0, *(0 if f else len(x) for x, f in zip(lines, far.tolist()))])]
    n = np.maximum(start[1:] - SHINGLE + 1 - start[:-1], 0)
    at = np.arange(n.sum()) + np.repeat(start[:-1] - (np.cumsum(n) - n), n)
    line = np.repeat(np.arange(len(n)), n)
    member = np.sort(line.astype(np.uint64) << np.uint64(40) | (h[at] * _ODD[0]) >> np.uint64(24))
    if len(member):
        member = member[np.concatenate([[True], member[1:] != member[:-1]])]
    line = (member >> np.uint64(40)).astype(np.int64)
    size = np.bincount(line, minlength=len(n))
    count = np.bincount(line * BUCKETS + (member >> np.uint64(31) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=len(n) * BUCKETS).reshape(-1, BUCKETS)
    free = (n == 0) | (count.max(1) > 255)
    count = np.minimum(count, 255).astype(np.uint8)
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        most = np.minimum(count[a], count[b]).sum(1, dtype=np.uint32).astype(np.int64)
        out[k : k + 4096] = (most >= threshold * (size[a] + size[b] - most) - 1e-9) | free[a] | free[b]
    return out


class Lines:
    """Exact Jaccard of character shingles, for pairs whose signatures do not rule it out. A pair that meets in several
    bands is compared in the first of them."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def prepare(self, data: pa.Array) -> _Items:
        return _Items(data)

    def pairs(self, items: _Items, i: np.ndarray, j: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            ok = (items.sketches[a] == items.sketches[b]).sum(1) >= LEAST_AGREEING * SLOTS
            if path is not None:
                band = path[k : k + 65536].astype(np.uint32)
                shared = items.bands[a] == items.bands[b]
                here = shared & (items.bands[a] == band[:, None])
                # a band that these keys do not show as shared is compared as well
                ok &= here[np.arange(len(a)), shared.argmax(1)] | ~here.any(1)
            out[k : k + 65536] = ok
        at = np.flatnonzero(out)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        if len(at) > len(used):  # many pairs a line: reading each line once costs less than comparing its pairs in full
            ok = may_be_alike(items.lines(used), place[: len(at)], place[len(at) :], self.threshold)
            out[at] = ok
            at = at[ok]
        part = np.cumsum(items.size[i[at]] + items.size[j[at]]) >> 20
        for a, b in zip(*runs(part)):
            here = at[a:b]
            used, place = np.unique(np.concatenate([i[here], j[here]]), return_inverse=True)
            out[here] = alike_lines(items.lines(used), place[: len(here)], place[len(here) :], self.threshold)
        return out


def _with_signatures(texts: DataFrame) -> DataFrame:
    """(alias, data): a byte of each minimum of the line's signature, four of each band key, then the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_blocks(batch, "data"):
                h, char = char_shingles(data)
                raw = memoryview(data.tobytes())
                a, b = char[off[:-1]], char[off[1:]] - SHINGLE + 1
                short = np.asarray([xxhash.xxh64_intdigest(raw[x:y], 3) if n <= 0 else 0 for x, y, n in zip(off[:-1].tolist(), off[1:].tolist(), (b - a).tolist())], np.uint64)
                signature = signatures(h, a, b, short)
                sketch, bands = (signature >> np.uint32(12)).astype(np.uint8), band_keys(signature).astype("<u4")
                rows = [sketch[k].tobytes() + bands[k].tobytes() + bytes(raw[off[k] : off[k + 1]]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("alias").slice(i, j - i), pa.array(rows, pa.binary())], names=["alias", "data"])

    return texts.mapInArrow(run, "alias long, data binary")


def _candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(alias, data): the trimmed text of each wanted line (alias, text_id, line_no), taken from a document it first stands in.
    Rows that share a null or repeated doc_id have text_ids of their own; only copies of a row take its lines again."""
    per_doc = wanted.groupBy("text_id").agg(F.collect_list(F.struct("line_no", "alias")).alias("take"))
    got = docs.withColumn("text_id", text_id("doc_id")).join(per_doc, "text_id").select(F.split("text", "\n").alias("lines"), F.explode("take").alias("x"))
    return got.select(F.col("x.alias").alias("alias"), F.btrim(F.get("lines", F.col("x.line_no")), F.lit(_SPACES)).alias("data"))


def line_classes(docs: DataFrame, *, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The line table, and (line, keep_doc, keep_line, keep_text) of every line that is not alone in its class."""
    spark = docs.sparkSession
    docs = docs.select(id_key().alias("doc_id"), "text")
    lines = materialize(line_table(docs), "lines")
    each = lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no", "text_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    each = materialize(each, "distinct-lines")
    # a bucket is read by one task: about two million (key, line) pairs at most
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-each.count() * BANDS // (1 << 21)))
    shared = materialize(_shared_bands(_band_blobs(docs, buckets)), "bands")
    wanted = shared.select("alias").distinct().join(each.select(F.col("line").alias("alias"), "first.line_no", "first.text_id"), "alias")
    texts = materialize(_with_signatures(_candidate_texts(docs, wanted).dropDuplicates(["alias"])), "line-texts")
    comps = components_of_shared(shared, texts, Lines(threshold)).withColumnRenamed("node", "line")
    placed = each.join(comps, "line", "left").withColumn("root", F.coalesce("root", "line")).where("n > 1 or root <> line or first is not null")
    keep = placed.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("size")).where("size > 1")
    kept = placed.join(keep, "root").select("line", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line"), F.col("keep.text_id").alias("keep_text"))
    return lines, kept


def removed_lines(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, copies): per document with a word, the numbers (from 0) of the lines to remove.

    docs: doc_id, text; other columns are ignored. Lines are trimmed of ASCII white space; blank ones are left alone. Two lines
    are alike if the Jaccard similarity of their sets of SHINGLE-character runs is ``threshold`` or more (a shorter line
    is one run). Of each component of alike lines the one of the least (doc_id, line_no) stays in the whole corpus.

    Exact copies are collapsed by hash first. Banding keeps a pair at the threshold with probability
    1 - (1 - 0.8^5)^16 = 0.998; every proposal is verified on the lines themselves. A null doc_id comes first in order.
    Rows that share an id, or have none, are documents of their own if their texts differ (the order goes on by line number and a hash of the text).
    Rows equal in both are ``copies`` of one document: it has one row, and all lines of the others go. Null, blank and empty texts have no row.
    """
    out = _removals(docs, threshold)
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_lines", "n_removed", "removed", "copies")


def _removals(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_id, n_lines, n_removed, removed, copies) of each document: an id, NO_ID for null, and a text with a word."""
    lines, kept = line_classes(docs, threshold=threshold)
    gone = lines.join(kept, "line").where("doc_id <> keep_doc or line_no <> keep_line or text_id <> keep_text").groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    # every copy of a document has one leading line, so its lines need not be told apart to be counted
    each = lines.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("leads").alias("copies")).withColumn("n_lines", F.expr("n div copies"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = each.join(gone, ["doc_id", "text_id"], "left").withColumn("removed", removed)
    return out.select("doc_id", "text_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "copies")


def dedup_lines(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without the lines that :func:`removed_lines` names; n_chars, where it is there, follows.

    A document that loses its last line with a word goes, and so do all copies of one but one; a text that had no word stays as it is.
    """
    drop = _removals(docs, threshold).where("n_removed > 0 or copies > 1")
    drop = materialize(drop.select(F.col("doc_id").alias("_brindle_doc"), F.col("text_id").alias("_brindle_text"), F.col("removed").alias("_brindle_removed"), (F.col("n_removed") == F.col("n_lines")).alias("_brindle_gone"), F.col("copies").alias("_brindle_copies")), "removals")
    at, schema = docs.columns.index("text"), docs.schema
    keyed = docs.withColumn("_brindle_id", id_key()).withColumn("_brindle_key", text_id("_brindle_id"))
    same, columns = (F.col("_brindle_id") == F.col("_brindle_doc")) & (F.col("_brindle_key") == F.col("_brindle_text")), [*docs.columns, "_brindle_removed"]
    rows = keyed.join(drop, same, "left").where("(_brindle_gone is null or not _brindle_gone) and coalesce(_brindle_copies, 1) = 1").select(*columns)
    several = drop.where("_brindle_copies > 1 and not _brindle_gone")
    if not several.isEmpty():
        rows = rows.unionAll(one_of_copies(keyed.join(several, same), ["_brindle_id", "_brindle_key"], columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = rows.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
