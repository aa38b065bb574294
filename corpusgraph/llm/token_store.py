"""Token-id shards: independent zstandard frames, a trailing seek table, per-frame checksums.

A shard is a sequence of zstandard frames, one a document, in ascending doc_id order, then two skippable frames:

* an index frame: a zstandard-compressed array of doc_ids (int64) with a null flag (uint8) each,
* the seek table of the published seekable format: for each frame compressed size, decompressed size and the low
  32 bits of the XXH64 of the decompressed bytes, then frame count, descriptor and magic number. The index frame has
  an entry of decompressed size 0, so any reader of that format can open a shard.

Ids are little-endian uint16 if the vocabulary fits, else uint32; the descriptor's index frame holds the width.

Edge cases. A null text is an empty one: its frame holds the end id alone. A null doc_id sorts before all others.
Repeated doc_ids each keep their own frame, ordered by their ids' bytes. An empty table gives an empty store.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bounded, durable, shared_folder, texts

SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
LEVEL = 3
#: Cached pieces of a worker; beyond it those go that weren't used for longest.
CACHE_ENTRIES = 1_000_000


# ---------------------------------------------------------------- encoding

#: One run of Latin letters that no normalisation step of the tokenizer joins with a neighbour, maybe marks after it, which are
#: a token's run of their own; an apostrophe begins other tokens.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: A stop that belongs to a run of marks.
MARKED = re.compile(r"[.,](?<=[^\w ][.,]|_[.,]) ")


def _byte_chars() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(spare)) for b in range(256)}


class Remembered(dict):
    """What `make` gives for each key, in two generations: a key that is asked for is in the younger one. If that has half of
    `limit` entries, it becomes the older one, and the older one goes."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class CachedEncoder:
    """Whole texts to ids with the tokenizers library, each distinct space-separated piece once.

    No token of a word vocabulary spans white space, so a text's ids are those of its pieces in order. A piece that is
    a plain Latin word goes straight to the model's merges; every other one through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.chars = str.maketrans({chr(b): c for b, c in _byte_chars().items() if chr(b) != c})
        if hasattr(self.model, "_resize_cache"):  # a word comes once, so the library needn't remember it too
            self.model._resize_cache(0)
        self.pieces, self.marks = Remembered(self.piece, limit), Remembered(self.whole, limit)

    def whole(self, piece: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes() if piece else b""

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)
        return array(self.kind, [x.id for x in self.model.tokenize(shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if m := PLAIN.fullmatch(piece):
            word, marks = m.groups()
            if marks or not word.islower():
                return self.pieces[word.lower()] + self.marks[marks]
            return self.word(word)
        return self.whole(piece)

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian bytes."""
        for text in batch:
            yield b"".join(map(self.pieces.__getitem__, self.plainer(text.replace("\n", " ")).split(" ")))

    def plainer(self, text: str) -> str:
        """A text of the same ids with fewer distinct pieces: lower case, stops apart from words. Only of Latin-1 characters,
        which normalisation leaves alone but for their case, and without what may be a special token."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        if "<|" in text:
            return text
        text = text.lower()
        return text if MARKED.search(text) else text.replace(". ", " . ").replace(", ", " , ")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> CachedEncoder:
    """One encoder a worker: tasks that follow find its cache filled."""
    return CachedEncoder(path)


FRAME_SCHEMA = "doc_id long, n_ids long, width int, size long, checksum long, frame binary"


def frames(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row a document: its compressed frame and what the seek table says of it."""

    def encode(batches):
        encoder, press = encoder_of(tokenizer), zstandard.ZstdCompressor(level=LEVEL)
        end = array(encoder.kind, [end_id]).tobytes()
        width = len(end)
        for ids, bodies in arrow_rows(batches, "doc_id", "text"):
            for k in range(0, len(ids), 1000):
                raw = [x + end for x in encoder.encode(bodies[k : k + 1000])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[k : k + 1000], pa.int64()),
                        pa.array([len(x) // width for x in raw], pa.int64()),
                        pa.array([width] * len(raw), pa.int32()),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                        pa.array([press.compress(x) for x in raw], pa.binary()),
                    ],
                    names=["doc_id", "n_ids", "width", "size", "checksum", "frame"],
                )

    return docs.mapInArrow(bounded(encode), FRAME_SCHEMA)


# ---------------------------------------------------------------- shards


def open_store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class ShardWriter:
    """Appends frames; finish() writes index and seek table. Memory: the entries, 24 bytes a document."""

    def __init__(self, out):
        self.out, self.entries, self.ids, self.nulls, self.n_ids, self.width = out, [], array("q"), bytearray(), 0, 2

    def add(self, doc_id: int | None, frame: bytes, size: int, checksum: int, n_ids: int, width: int) -> None:
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), size, checksum))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n_ids += n_ids
        self.width = width

    def finish(self) -> None:
        body = struct.pack("<I", self.width) + zstandard.ZstdCompressor(level=LEVEL).compress(self.ids.tobytes() + bytes(self.nulls))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.entries.append(struct.pack("<III", len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Random access to one shard: reads the tail once, then only the frames asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size() if hasattr(file, "size") else len(file.getbuffer())
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of this file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        body = self._at(int(self.starts[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        (self.width,) = struct.unpack("<I", body[:4])
        raw = zstandard.ZstdDecompressor().decompress(body[4:], max_output_size=9 * n) if n > 1 else b""
        self.doc_ids, self.nulls = np.frombuffer(raw[: 8 * (n - 1)], "<i8"), np.frombuffer(raw[8 * (n - 1) :], np.uint8)
        self._unpress = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.table) - 1

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, as uint32; a wrong checksum raises ValueError."""
        raw = self._unpress.decompress(self._at(int(self.starts[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document that has this doc_id."""
        live = len(self) and int(self.nulls.sum())
        lo, hi = np.searchsorted(self.doc_ids[live:], [doc_id, doc_id + 1]) + live if len(self) else (0, 0)
        return [self.ids(k) for k in range(lo, hi)]


MANIFEST_SCHEMA = "shard int, path string, n_docs long, n_ids long"


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, rows_per_shard: int = 32_768) -> str:
    """Encode documents and write shards in ascending doc_id order; returns the store's folder.

    Encoded frames are written once as Parquet, so neither range sampling nor a lost executor encodes a text again.
    Each attempt of a task writes a file of its own; the manifest names those of the attempts that counted.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token_store")
    encoded = durable(frames(texts(docs), tokenizer, end_id), "frames")
    shards = max(1, -(-encoded.count() // rows_per_shard))

    def write(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        path, writer, out = f"{base}/shard-{shard:07d}-{uuid.uuid4().hex}.zst", None, None
        for rows in arrow_rows(batches, "doc_id", "frame", "size", "checksum", "n_ids", "width"):
            if writer is None:
                writer = ShardWriter(out := store.open_output_stream(path, compression=None))
            for row in zip(*rows, strict=True):
                writer.add(*row)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    placed = encoded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "frame")
    placed.mapInArrow(bounded(write), MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    return folder


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (uint32 bytes).

    One manifest row a shard gives each shard its first position; shards are read apart from each other, a frame at a time.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", before.alias("base"))

    def read(batches):
        store, _ = open_store(folder)
        for paths, bases in arrow_rows(batches, "path", "base"):
            for path, at in zip(paths, bases, strict=True):
                with store.open_input_file(path) as file:
                    shard = ShardReader(file)
                    for k in range(0, len(shard), 500):
                        some = range(k, min(k + 500, len(shard)))
                        found = [shard.ids(i) for i in some]
                        counts = np.array([len(x) for x in found], dtype=np.int64)
                        starts = at + np.cumsum(counts) - counts
                        at += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[k : k + len(some)], mask=shard.nulls[k : k + len(some)].astype(bool)), pa.array(starts), pa.array(counts), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").mapInArrow(bounded(read), READ_SCHEMA)


def shard_bytes(documents: Iterable[tuple[int | None, np.ndarray]], width: int = 2) -> bytes:
    """A whole shard in memory, for tests and small uses."""
    writer, press = ShardWriter(out := io.BytesIO()), zstandard.ZstdCompressor(level=LEVEL)
    for doc_id, ids in documents:
        raw = np.asarray(ids).astype(f"<u{width}").tobytes()
        writer.add(doc_id, press.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, len(ids), width)
    writer.finish()
    return out.getvalue()
