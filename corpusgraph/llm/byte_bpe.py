"""Byte-level BPE by a sentencepiece BPE model made directly from a rank vocabulary.

Every byte is shown as one visible character, every token as the string of its bytes' characters; a piece's score is
its negative rank and its place in the model is its rank, so the model's ids are the ranks. The normaliser is the
identity. sentencepiece then merges, in each pre-token, the adjacent pair whose union has the best score, leftmost
first, which is what rank-based byte-pair merging does. Decoding maps each id back to its token's bytes.

Edge cases: a null text is an empty one; an empty text has no ids; repeated rows each get a row of their own; a null
doc_id is kept; an id outside the vocabulary can't be decoded (KeyError or IndexError).
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, arrow_rows, bounded, prepare, texts

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 200_000
#: Longer pre-tokens are encoded each time they occur.
CACHE_CHARS = 64
#: Documents handed on at a time.
ROWS = 250


def byte_chars() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


# ---------------------------------------------------------------- the model file


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: integers as varints (negative ones in 64 bits), floats in 4 bytes, the rest with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    body = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(body)) + body


#: Field numbers and values of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE = 3, 2, 4
UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 40, 41, 42, 43, 45
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; ranks without a token become pieces that no text holds."""
    chars = byte_chars()
    tokens = {rank: token for token, rank in ranks.items()}
    size = max(tokens, default=-1) + 1
    out = bytearray()
    for rank in range(size):
        shown = "".join(chars[b] for b in tokens[rank]) if rank in tokens else f"{rank}"
        out += _field(PIECES, _field(PIECE, shown) + _field(SCORE, float(-rank)) + _field(TYPE, NORMAL))
    out += _field(PIECES, _field(PIECE, "") + _field(SCORE, float(-size - 1)) + _field(TYPE, UNKNOWN))
    out += _field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, size + 1) + _field(UNK_ID, size) + _field(BOS_ID, -1) + _field(EOS_ID, -1) + _field(PAD_ID, -1) + _field(UNK_PIECE, ""))
    out += _field(NORMALIZER, _field(NAME, "identity") + _field(DUMMY_PREFIX, 0) + _field(EXTRA_SPACES, 0) + _field(ESCAPE_SPACES, 0))
    return bytes(out)


class _Known(dict):
    """Pre-token to ids as 4-byte integers; learns what is missing."""

    def __init__(self, codec: ByteBpe):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.codec.piece(piece)).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """encode() and decode() of one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        chars = byte_chars()
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(chars) if chr(b) != c})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.known = _Known(self)

    def piece(self, piece: str) -> list[int]:
        """The ids of one pre-token; one that is itself a token is that token."""
        raw = piece.encode()
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        return self.model.encode(raw.decode("latin-1").translate(self.shown))

    def packed(self, text: str) -> bytes:
        """The ids of a text as 4-byte integers."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(vocabulary: str, pattern: str) -> ByteBpe:
    """One model a worker: tasks that follow find it built and its memory filled."""
    return ByteBpe(read_ranks(vocabulary), pattern)


# ---------------------------------------------------------------- DataFrames


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: whole texts encoded, a worker's model built once a task from the vocabulary file."""
    prepare(docs.sparkSession)

    def encode(batches):
        bpe = codec(vocabulary, pattern)
        for ids, bodies in arrow_rows(batches, "doc_id", "text"):
            for k in range(0, len(ids), ROWS):
                packed = [bpe.packed(x) for x in bodies[k : k + ROWS]]
                ends = np.cumsum([0] + [len(x) // 4 for x in packed], dtype=np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + ROWS], pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(bounded(encode), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of encode_documents with the bytes that their ids stand for: doc_id, ids, decoded binary."""
    prepare(encoded.sparkSession)

    def decode(batches):
        bytes_of = {rank: token for token, rank in read_ranks(vocabulary).items()}
        table = pa.array([bytes_of.get(i) for i in range(max(bytes_of, default=-1) + 1)], pa.large_binary())
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids = batch.column(batch.schema.get_field_index("ids"))
                pieces = table.take(ids.flatten())
                if pieces.null_count:
                    raise KeyError("an id that stands for no token")
                ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
                starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset :][ends] if len(pieces) else ends
                raw = pieces.buffers()[2] or pa.py_buffer(b"")
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(np.ascontiguousarray(starts)), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), ids, out], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(bounded(decode), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256; other columns on request."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


FORGET.append(codec.cache_clear)
