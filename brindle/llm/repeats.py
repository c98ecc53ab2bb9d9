"""Removal of long repeated byte strings by blockwise suffix sorting.

A 400-byte string that starts twice has the same anchor at the same distance in both places: the gram of least hash
among its grams. So suffixes fall into buckets by anchor, and only suffixes at one distance from it can share 400 bytes.
Buckets are sorted in byte order, a bounded number of texts at a time. The ranks of a difference-cover sample, by their next
388 bytes, are found first by doubling; a suffix is then ordered by the few bytes up to its next sampled position, the
rank there, and the few bytes that the rank leaves over. Long ties are thus settled by one rank, whatever their length. A bucket
of too many texts is split by the bytes next to its anchor, as often as need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.linking import batched, grouped
from brindle.llm.text import mix, powers, prefix, runs, span_hash, text_blocks
from brindle.storage import materialize

LENGTH = 400
GRAM = 128
PERIOD = 31
#: A perfect difference set of PERIOD: every residue is a difference of two members (Singer, order 5).
COVER = np.asarray([1, 5, 11, 24, 25, 27])
#: Texts of a bucket that one task sorts at once, and bytes of the buckets sorted together.
SMALL, BATCH = 2048, 1 << 20
_POS = np.uint64((1 << 31) - 1)
_NEXT = np.asarray([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
#: Bytes that a sampled rank stands for: with the bytes before the sample it ends at or before LENGTH.
RANKED = LENGTH - int(_NEXT.max())


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: its document, position, the first and last start of a LENGTH-byte string it stands for, the hash
    of its gram and that of all bytes of those strings. Every string within one document has exactly one anchor."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    s = prefix(data)
    m = len(data) - GRAM + 1
    h = mix((s[GRAM:] - s[:m]) * powers(len(s), True)[:m])
    least = sliding_min((h & ~_POS) | np.arange(m, dtype=np.uint64), LENGTH - GRAM + 1)
    ends = np.repeat(off[1:], np.diff(off))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends)
    pos = (least[at] & _POS).astype(np.int64)
    a, b = runs(pos)
    p, lo, hi = pos[a], at[a], at[b - 1]
    doc = np.searchsorted(off, p, side="right") - 1
    whole = mix(span_hash(s, lo, hi + LENGTH) + (p - lo).astype(np.uint64))
    return doc, p, lo, hi, h[p], whole


def _anchor_table(docs: DataFrame) -> DataFrame:
    """(gram, whole, key, loc): loc packs position, bytes before and bytes after, see :func:`_unloc`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, j, data, off in text_blocks(batch):
                doc, p, lo, hi, gram, whole = anchors(data, off)
                loc = ((p - off[doc]) << 20) | ((p - lo) << 10) | (hi + LENGTH - p)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(keys[i + doc]), pa.array(loc)], names=["gram", "whole", "key", "loc"])

    return docs.mapInArrow(run, "gram long, whole long, key long, loc long")


def _bytes_as_keys(data: np.ndarray, at: np.ndarray, n: np.ndarray | int, words: int) -> list[np.ndarray]:
    """The ``n`` bytes from each position as big-endian words, which order as the bytes do; ``data`` is padded at its end."""
    raw = data[at[:, None] + np.arange(8 * words)]
    raw[np.arange(8 * words) >= np.reshape(n, (-1, 1)) + np.zeros((len(at), 1), int)] = 0
    return list(raw.view(">u8").astype(np.uint64).T)


def _ordered(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their keys, the first one first, and where in it a row differs from the one before."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    order, new = _ordered(keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(data: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Ranks of the sampled positions by their next RANKED bytes, in byte order, by doubling: with a position p, p + PERIOD
    is sampled too as long as these bytes reach. ``data`` is padded at its end."""
    place = np.zeros(len(data) + LENGTH, np.int64)
    place[sample] = np.arange(len(sample))
    rank = _ranks(_bytes_as_keys(data, sample, PERIOD, 4))
    known, half = 1, rank
    while 2 * known * PERIOD <= RANKED:
        rank, half = _ranks([rank, rank[place[sample + known * PERIOD]]]), rank
        known *= 2
    # the rest: the rank of half as many bytes once, then single bytes
    reach = known * PERIOD
    keys = [rank]
    if reach + known // 2 * PERIOD <= RANKED:
        keys.append(half[place[sample + reach]])
        reach += known // 2 * PERIOD
    return _ranks(keys + _bytes_as_keys(data, np.minimum(sample + reach, len(data) - 64), RANKED - reach, 8))


def repeated_starts(texts: list[bytes], before: np.ndarray, bucket: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text, whose anchor stands after ``before`` bytes, which of its starts 0 .. len - LENGTH begin a string that
    another text of its bucket has at the same distance to the anchor: the suffix sort of one bucket, or of several."""
    length = np.asarray([len(t) for t in texts])
    n = length - LENGTH + 1
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    base = np.cumsum(length) - length
    anchor = base + before
    every = np.arange(len(data) - LENGTH)
    sample = every[np.isin((every - np.repeat(anchor, length)) % PERIOD, COVER)]
    rank = np.zeros(len(data), np.int64)
    rank[sample] = sample_ranks(data, sample)
    owner = np.repeat(np.arange(len(texts)), n)
    i = np.arange(n.sum()) + np.repeat(base - (np.cumsum(n) - n), n)
    distance = anchor[owner] - i
    skip = _NEXT[(-distance) % PERIOD]
    keys = [distance if bucket is None else bucket[owner] * (LENGTH + 1) + distance, *_bytes_as_keys(data, i, skip, 2), rank[i + skip]]
    order, new = _ordered(keys + _bytes_as_keys(data, i + skip + RANKED, LENGTH - RANKED - skip, 2))
    hit = np.zeros(len(order), bool)
    hit[order[1:][~new[1:]]] = True
    hit[order[:-1][~new[1:]]] = True
    return np.split(hit, np.cumsum(n)[:-1])


def _covered(hit: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Intervals of bytes of the strings that start where ``hit`` holds; start 0 is byte ``first``."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH) + 1
    return [(first + int(g[0]), first + int(g[-1]) + LENGTH) for g in np.split(at, cut)]


SPANS = "key long, a long, b long"
BUCKETS = "gram long, low int, high int, key long, pos long, before long, text binary"


def _sorted_buckets(rows: DataFrame) -> DataFrame:
    """Covered byte intervals from BUCKETS; ``pos`` is the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in batched(grouped(batches, ["gram"]), SMALL, BATCH, "text"):
            groups = [list({(r["key"], r["pos"]): r for r in g}.values()) for g in groups]
            rows = [r for g in groups for r in g if len(g) > 1]
            if not rows:
                continue
            hits = repeated_starts([r["text"] for r in rows], np.asarray([r["before"] for r in rows]), np.repeat(np.arange(len(groups)), [len(g) if len(g) > 1 else 0 for g in groups]))
            spans = [(r["key"], a, b) for r, hit in zip(rows, hits) for a, b in _covered(hit, r["pos"] - r["before"])]
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], names=["key", "a", "b"])

    return rows.repartition("gram").sortWithinPartitions("gram").select("gram", "key", "pos", "before", "text").mapInArrow(run, SPANS)


def _halves(rows: DataFrame) -> DataFrame:
    """BUCKETS and ``whole`` of buckets of half the distances ``low`` to ``high``. All strings at these distances share a
    longer run of bytes around the anchor, and its hash with the old name is the new bucket's name; ``whole`` is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle, text, before = (r["low"] + r["high"]) // 2, r["text"], r["before"]
                least = before - (len(text) - LENGTH)
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    near, far = max(low, least), min(high, before)
                    if near <= far:
                        core = text[before - low : before + LENGTH - high]
                        name = xxhash.xxh64_intdigest(core, (r["gram"] + 1000 * low + high) & 0xFFFFFFFFFFFFFFFF)
                        part = text[before - far : before - near + LENGTH]
                        out.append((name - (1 << 63), low, high, r["key"], r["pos"], far, part, xxhash.xxh64_intdigest(part, far) - (1 << 63)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in BUCKETS.split(", ")] + ["whole"])

    return rows.select(*[c.split()[0] for c in BUCKETS.split(", ")]).mapInArrow(run, f"{BUCKETS}, whole long")


def _split_until_small(rows: DataFrame, small: int) -> DataFrame:
    """Covered byte intervals of buckets with more than ``small`` different texts: they are halved, texts that have become
    equal are told by hash and collapse, until all buckets are small. At one distance all texts of a bucket are equal, so
    nine rounds are the most."""
    spans = None
    while True:
        parts = materialize(_halves(rows), "halves")
        each = parts.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("low", "high", "key", "pos", "before", "text")).alias("one"))
        each = materialize(each, "texts-of-halves")
        again = parts.join(each.where("copies > 1").select("gram", "whole"), ["gram", "whole"])
        found = again.select("key", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") - F.col("before") + F.length("text")).alias("b"))
        sizes = each.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        rows = materialize(each.join(sizes, "gram").select("gram", "one.*", "m"), "split-buckets")
        found = found.unionAll(_sorted_buckets(rows.where(F.col("m") <= small)))
        spans = found if spans is None else spans.unionAll(found)
        rows = rows.where(F.col("m") > small)
        if not rows.limit(1).count():
            return spans


def repeated_spans(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, a, b): byte intervals of texts covered by LENGTH-byte strings that start elsewhere too; they may overlap.

    docs: key, text. Buckets whose texts are all the same need no sorting: all they hold is covered. Only anchors of
    buckets with several different texts fetch these, one text for each; larger buckets than ``small`` are split.
    """
    table = materialize(_anchor_table(docs), "anchors")
    each = table.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "loc")).alias("one"))
    each = materialize(each, "texts-of-grams")
    same = each.where("n > 1").select("gram", "whole")
    pos, before, after = F.shiftright("loc", 20), F.shiftright("loc", 10).bitwiseAND(1023), F.col("loc").bitwiseAND(1023)
    spans = table.join(same, ["gram", "whole"]).select("key", (pos - before).alias("a"), (pos + after).alias("b"))
    mixed = each.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("gram", "m")
    wanted = each.join(mixed, "gram").select("gram", "m", "one.*").select("gram", "m", "key", pos.alias("pos"), before.alias("before"), after.alias("after"))
    per_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "m", "pos", "before", "after")).alias("take"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = (r["text"] or "").encode("utf-8")
                rows = [(t["gram"], t["m"], r["key"], t["pos"], t["before"], data[t["pos"] - t["before"] : t["pos"] + t["after"]]) for t in r["take"]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096]), kinds)], names=["gram", "m", "key", "pos", "before", "text"])

    # equal rows have one key and one text: the join gives their text once each, a bucket takes it once
    buckets = docs.join(per_doc, "key").select("key", "text", "take").mapInArrow(run, "gram long, m long, key long, pos long, before long, text binary")
    buckets = materialize(buckets, "buckets")
    spans = spans.unionAll(_sorted_buckets(buckets.where(F.col("m") <= small)))
    large = buckets.where(F.col("m") > small)
    if large.limit(1).count():
        spans = spans.unionAll(_split_until_small(large.withColumn("low", F.lit(0)).withColumn("high", F.lit(LENGTH - GRAM)), small))
    return spans


def remove_repeats(docs: DataFrame, *, small: int = SMALL) -> DataFrame:
    """What is left of each text without the bytes covered by a LENGTH-byte string that also starts anywhere else.

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes; a null one is empty. Strings are judged on the
    input, within one document or across documents, overlaps included; they do not span documents. Returns one row per
    document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (those runs). Repeated rows
    are documents of their own, so each makes the other's text of LENGTH bytes or more a repeat. Anchors, and texts and
    names that are told to be equal without sorting, are 64-bit hashes of the bytes; shuffles carry hashes and places, whole texts only to the rows that need them.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    spans = materialize(repeated_spans(docs.select("key", "text"), small), "spans")
    gone = spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data, merged = (text or "").encode("utf-8"), []
                for x in sorted((x["a"], x["b"]) for x in spans or ()):
                    if merged and x[0] <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], x[1])
                    else:
                        merged.append({"a": x[0], "b": x[1]})
                digest, at = hashlib.sha256(), 0
                for x in merged:
                    digest.update(data[at : x["a"]])
                    at = x["b"]
                digest.update(data[at:])
                for c, v in zip(out, (doc_id, len(data), sum(x["b"] - x["a"] for x in merged), len(merged), digest.hexdigest(), merged)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = docs.join(gone, "key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, schema)
