"""Token ids of texts, and a binary format for them: independent zstandard frames with a seek table.

A shard file holds the ids of its documents, in order, as little-endian unsigned 32-bit integers, cut into frames of
``FRAME`` ids. After the frames follow two skippable frames, so any zstandard reader can decompress a whole shard:
the document index (doc ids and starts) and the public seekable-format table (sizes and a checksum of each frame).
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import materialize, new_folder

FRAME = 1 << 16
# fixed values of the public zstandard frame and seekable formats
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
SEEK_CHECKSUMS = 0x80


#: Symbols at a chunk's end, but for the apostrophe, which can begin a contraction.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~]+$")
#: Bytes as the characters that stand for them in byte-level vocabularies: printable ones themselves, the others from 256 on.
_UNPRINTED = [*range(33), *range(127, 161), 173]
_AS_CHARACTER = {b: 256 + k for k, b in enumerate(_UNPRINTED)}


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open spans, one after another."""
    n = end - start
    stop = np.cumsum(n)
    if not len(stop):
        return stop
    kind = np.int32 if max(stop[-1], end.max()) < 1 << 31 else np.int64
    out = np.repeat((start - (stop - n)).astype(kind), n)
    out += np.arange(stop[-1], dtype=kind)
    return out


def binary_list(column: pa.Array) -> list[bytes]:
    """The values of a large string array without nulls, as bytes."""
    if not len(column):
        return []
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8).tolist()
    data = column.buffers()[2].to_pybytes() if column.buffers()[2] else b""
    return [data[a:b] for a, b in zip(off, off[1:])]


class Encoder:
    """Ids of texts by the tokenizers library, each distinct chunk between ASCII white space encoded once.

    For a tokenizer that lower-cases, drops white space and never joins across it, the ids of a text are those of its
    chunks; this is tested against whole texts. Blocks of texts are split and their distinct chunks found by Arrow; only
    these are looked up, and ids are put together by one gather. A chunk of ASCII letters is one word to the library's
    model. A point or comma that ends a chunk after an ASCII letter is a token of its own, so such chunks are put together.
    Other unseen chunks go to the library many at a time, joined by spaces, and their ids are told apart by offsets. The
    store of known chunks falls back to those just met when it is large; that bounds memory, not results.
    """

    LARGEST = 700_000
    BLOCK = 1 << 23

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _store(self, words: list[bytes], ids: np.ndarray, lengths: list[int] | np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def _spans(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.ends[at], self.ends[at + 1]

    def _learn(self, new: list[bytes]) -> None:
        cut, plain = [], {}
        for w in new:
            m = _TAIL.search(w)
            last = w[: m.start()].decode()[-1:] if m and b"<|" not in w else ""
            if last.isalpha() and last <= "\u017f" and last != "\u0130":
                cut.append((w, w[: m.start()], m.group()))
                plain[cut[-1][1]] = plain[cut[-1][2]] = None
            else:
                plain[w] = None
        words, others, ids, lengths = [], [], [], []
        for w in plain:
            if w in self.place:
                continue
            t = w.decode()
            if not t.isascii():
                t = t.lower() if max(t) <= "\u017f" and "\u0130" not in t else ""
            if t.isalpha() and t == t.lower():
                found = self.model.tokenize(t if t.isascii() else t.encode().decode("latin-1").translate(_AS_CHARACTER))
                words.append(w)
                ids += [x.id for x in found]
                lengths.append(len(found))
            else:
                others.append(w)
        self._store(words, np.asarray(ids, "<u4"), lengths)
        for k in range(0, len(others), 512):
            texts = [w.decode() for w in others[k : k + 512]]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ends = np.searchsorted([a for a, _ in got.offsets], np.cumsum([0, *(len(t) + 1 for t in texts)]))
            ends[-1] = len(got.ids)
            self._store(others[k : k + 512], np.asarray(got.ids, "<u4"), np.diff(ends).tolist())
        if cut:
            both = [x for _, head, tail in cut for x in (head, tail)]
            a, b = self._spans(both)
            self._store([w for w, _, _ in cut], self.ids[spread(a, b)], (b - a).reshape(-1, 2).sum(1))

    def _forget(self, met: list[bytes]) -> None:
        kept = [w for w in met if w in self.place]
        a, b = self._spans(kept)
        ids = self.ids[spread(a, b)]
        self.place, self.ids, self.ends = {}, np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self._store(kept, ids, b - a)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")  # a special token is matched in its own case
        if pc.any(special).as_py():
            low = pc.if_else(special, texts, low)
        chunks = pc.ascii_split_whitespace(low)
        each = chunks.flatten().dictionary_encode()
        words = binary_list(each.dictionary)
        if len(self.place) > self.LARGEST:
            self._forget(words)
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([words[k] for k in new])
            at[new] = [self.place[words[k]] for k in new]
        at = at[each.indices.to_numpy()]
        start, end = self.ends[at], self.ends[at + 1]
        docs = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return self.ids[spread(start, end)], np.concatenate([[0], np.cumsum(end - start)])[docs]

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Parts (first row, end row, ids, offsets) of an Arrow array of texts; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, size[i] + self.BLOCK, side="right")) - 1)
            yield i, j, *self._block(texts.slice(i, j - i))
            i = j

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for i, j, ids, off in self.blocks(texts):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                yield ids[a:b].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; threads of the library are off, Spark runs the tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents into one shard file; holds one frame and the index."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.buffer, self.held = [], 0
        self.ids, self.starts, self.frames, self.total = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.total)
        self.total += len(ids) // 4
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME:
            data = b"".join(self.buffer)
            whole = len(data) // (4 * FRAME) * (4 * FRAME)
            for k in range(0, whole, 4 * FRAME):
                self._frame(data[k : k + 4 * FRAME])
            self.buffer, self.held = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=self.level).compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.buffer))
        nulls = np.asarray([i is None for i in self.ids], np.uint8)
        index = struct.pack("<Q", len(self.ids)) + nulls.tobytes() + np.asarray([i or 0 for i in self.ids], "<i8").tobytes() + np.asarray([*self.starts, self.total], "<u8").tobytes()
        index = zstandard.ZstdCompressor(level=self.level).compress(index)
        index += struct.pack("<Q", len(index))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), SEEK_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Random access to a shard: reads the tail once, then only the frames that hold a requested document."""

    def __init__(self, file):
        self.file = file
        n = file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(n - 9, 9))
        if magic != SEEK_MAGIC or not flags & SEEK_CHECKSUMS:
            raise ValueError("not a shard with a seek table and checksums")
        seek = n - 9 - 12 * count - 8
        self.frames = list(struct.iter_unpack("<III", self._at(seek + 8, 12 * count)))
        size = struct.unpack("<Q", self._at(seek - 8, 8))[0]
        index = zstandard.ZstdDecompressor().decompress(self._at(seek - 8 - size, size))
        docs = struct.unpack_from("<Q", index)[0]
        nulls = np.frombuffer(index, np.uint8, docs, 8)
        self.doc_ids = [None if z else i for i, z in zip(np.frombuffer(index, "<i8", docs, 8 + docs).tolist(), nulls.tolist())]
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 + 9 * docs).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)])
        self.last = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, size, check = self.frames[k]
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, data)
        return self.last[1]

    def pieces(self, row: int) -> Iterator[bytes]:
        """The ids of the document at this place of the shard, frame by frame."""
        a, b = 4 * int(self.starts[row]), 4 * int(self.starts[row + 1])
        while a < b:
            k = a // (4 * FRAME)
            data = self.frame(k)[a - 4 * FRAME * k : b - 4 * FRAME * k]
            yield data
            a += len(data)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, level: int = 3) -> DataFrame:
    """Tokenise every whole text, append ``end_id``, and write shards in ascending doc_id order.

    docs: doc_id, text; other columns are ignored. Texts are range-partitioned by doc_id and sorted within a partition
    (null ids first; repeated ids by text hash, repeated rows by a row number, so many rows of one id spread over
    shards); each partition streams into one shard. Null texts have only the end id.
    A retried task writes the same bytes under a name of its own and renames. Returns the manifest (shard, path, n_docs,
    n_tokens): one row per shard, in order of shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        fs, top = open_folder(folder)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}.zst"
        temp = f"{top}/.{name}.{task.taskAttemptId()}"
        writer = out = None
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(temp)
                writer = ShardWriter(out, level)
            for i, data in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                writer.add(i, data + end)
        if writer is None:
            return
        writer.close()
        out.close()
        fs.move(temp, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.total], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    order = ["doc_id", "text_hash", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return rows.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards, each frame checked.

    ``start`` counts the ids of all documents before it: shards' totals are summed over the manifest, which has one row
    per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{top}/{row['path']}") as file:
                    reader = ShardReader(file)
                    n = len(reader.doc_ids)
                    for k in range(0, n, 8192):
                        crcs = []
                        for at in range(k, min(n, k + 8192)):
                            crc = 0
                            for piece in reader.pieces(at):
                                crc = zlib.crc32(piece, crc)
                            crcs.append(crc)
                        starts = reader.starts[k : k + len(crcs) + 1]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[k : k + len(crcs)], pa.int64()), pa.array(starts[:-1] + row["base"], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition("shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as shards and read them back. An empty table writes no shard."""
    folder = folder or new_folder(docs.sparkSession, "shards")
    return read_shards(materialize(write_shards(docs, folder, tokenizer, end_id), "manifest"), folder)
