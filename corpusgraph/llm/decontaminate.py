"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is `n` consecutive words of an
item; an item of fewer, but not none, is one window. A shard is a bounded run of a partition's documents. Its symbols
are the benchmark's words; any other word can't be in a window and becomes a separator, and so does a run of
benchmark words shorter than the shortest window. Suffixes are sorted by prefix doubling, the Burrows-Wheeler
transform is held in a wavelet matrix with sampled ranks, occurrences are found from sampled suffix positions, and
the words they cover are merged into spans.

Windows are read from the shared folder in blocks of bounded size, so a worker holds one block whatever the
benchmark's size.

Edge cases: a null or wordless text has no words, hits or spans; an item without words or with a null item_id takes
no part; repeated items count once by item_id; repeated documents each get a row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, bounded, shared_folder
from .token_store import open_store

WINDOW = 10
#: Windows in a block, characters in a shard (a longer document is a shard of its own), suffix sampling distance.
BLOCK_WINDOWS, SHARD_CHARS, SAMPLE = 100_000, 6_000_000, 16
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


# ---------------------------------------------------------------- the index


class BitRank:
    """A bit vector with ranks sampled every 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """rank() and access() over a sequence of symbols, a level a bit, all queries of a call at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for shift in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, int(len(bits) - bits.sum()), BitRank(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        first = np.zeros_like(at)
        for shift, zeros, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.ones(first), bits.ones(at)
            first, at = np.where(one, zeros + a, first - a), np.where(one, zeros + b, at - b)
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for shift, zeros, bits in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(at.dtype) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks by the first 1, 2, 4, ... symbols until all differ. The last symbol must be the least."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank, width, n = rank.astype(np.int64), 1, len(symbols)
    while True:
        after = np.zeros(n, np.int64)
        after[:-width or None] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class FmIndex:
    """Backward search over one sequence; symbols are 1 and more, 0 is the end mark that this class adds."""

    def __init__(self, symbols: np.ndarray, size: int):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size), dtype=np.int64)])
        sampled = order % SAMPLE == 0
        self.marks, self.samples = BitRank(sampled), order[sampled]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the half-open range of suffixes that begin with it."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        table = np.zeros((len(patterns), lengths.max(initial=0)), np.int64)
        for k, p in enumerate(patterns):
            table[k, : len(p)] = p
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, table.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            symbol = table[live, lengths[live] - back]
            lo[live] = self.less[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.less[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one is met."""
        out, steps, at, open_ = np.zeros(len(rows), np.int64), 0, rows.astype(np.int64), np.arange(len(rows))
        while len(open_):
            known = self.marks.get(at)
            out[open_[known]] = self.samples[self.marks.ones(at[known])] + steps
            open_, at = open_[~known], at[~known]
            symbol = self.wavelet.access(at)
            at = self.less[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


# ---------------------------------------------------------------- windows and shards


class Windows:
    """A block of distinct windows: their words as symbols from 2 on (1 separates), and the items of each."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.items = [np.unique(x) for x in windows.values()]
        self.symbol: dict[bytes, int] = {}
        self.patterns = [np.array([self.symbol.setdefault(w, len(self.symbol) + 2) for w in x], np.int64) for x in windows]
        self.lengths = np.array([len(x) for x in self.patterns], np.int64)
        self.shortest = int(self.lengths.min(initial=WINDOW))


def item_windows(text: str | None, n: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def write_windows(benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> list[str]:
    """Write the benchmark's windows in blocks into the shared folder; the driver streams items, holding one block."""
    folder = shared_folder(benchmark.sparkSession, "windows")
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    paths: list[str] = []
    held: dict[tuple[bytes, ...], list[int]] = {}

    def flush() -> None:
        if held:
            paths.append(f"{folder}/{len(paths):06d}")
            with store.open_output_stream(f"{base}/{len(paths) - 1:06d}", compression=None) as out:
                out.write(pickle.dumps(dict(held)))
            held.clear()

    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").toLocalIterator():
        for w in item_windows(text, n):
            held.setdefault(w, []).append(item_id)
        if len(held) >= block:
            flush()
    flush()
    return paths


@lru_cache(maxsize=1)
def windows_at(path: str) -> Windows:
    store, at = open_store(path)
    with store.open_input_stream(at, compression=None) as file:
        return Windows(pickle.loads(file.read()))


def search_shard(found: list[list[bytes]], windows: Windows) -> tuple[np.ndarray, list[tuple[int, int]], dict[int, set[int]]]:
    """Which words of the shard are hit, where its documents begin, and the items found in each document."""
    counts = np.array([len(x) for x in found], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    hit, items = np.zeros(total, bool), {}
    symbols = np.fromiter((s for x in found for s in map(windows.symbol.get, x, repeat(1))), np.int64, total)
    at = np.flatnonzero(symbols > 1)
    doc = np.repeat(np.arange(len(found)), counts)[at]
    if not len(at):
        return hit, bounds, items
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] >= windows.shortest
    at, run = at[keep], np.cumsum(new & keep)[keep] - 1
    if not len(at):
        return hit, bounds, items
    place = np.arange(len(at)) + run
    text, origin = np.ones(len(at) + int(run[-1]), np.int64), np.zeros(len(at) + int(run[-1]), np.int64)
    text[place], origin[place] = symbols[at], at
    index = FmIndex(text, len(windows.symbol) + 2)
    lo, hi = index.search(windows.patterns)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(which))
    start = origin[index.locate(rows)]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows.lengths[which], -1)
    hit = np.cumsum(edge)[:-1] > 0
    owner = np.searchsorted(bounds, start, side="right") - 1
    for d, w in np.unique(np.stack([owner, which], 1), axis=0).tolist():
        items.setdefault(d, set()).update(windows.items[w].tolist())
    return hit, bounds, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as half-open ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def shards(bodies: list[str | None]):
    """Ranges of texts of bounded size together."""
    begin, size = 0, 0
    for k, x in enumerate(bodies):
        if size and size + len(x or "") > SHARD_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(x or "")
    yield begin, len(bodies)


def find(bodies: list[str | None], paths: list[str]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, spans of hit words, ids of the items found."""
    out = []
    for begin, end in shards(bodies):
        found = [words_of(x) for x in bodies[begin:end]]
        hit, items = np.zeros(sum(map(len, found)), bool), {}
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        for path in paths:
            more, bounds, named = search_shard(found, windows_at(path))
            hit |= more
            for d, x in named.items():
                items.setdefault(d, set()).update(x)
        for d, words in enumerate(found):
            spans = spans_of(hit[bounds[d] : bounds[d + 1]]) if d in items else []
            out.append((len(words), spans, sorted(items.get(d, ()))))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans; a line break stays where one was cut."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out += [text[at : places[a][0]].rstrip(" "), "\n"]
        at = places[b - 1][1]
    return "".join([*out, text[at:].lstrip(" ")]).strip()


# ---------------------------------------------------------------- DataFrames

FOUND = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: int, end: int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row a document: n_words, n_hit, items found, spans of hit words (half-open, in words)."""
    paths = write_windows(benchmark, n)

    def run(batches):
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1).to_pylist()
            found = find(bodies, paths)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([sum(b - a for a, b in x[1]) for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.list_(pa.int64())),
                    pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(bounded(run), FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The same columns with hit spans cut out of text, until no window is left: a cut can bring the ends of another one
    together. A document of which no word is left goes, if words were cut."""
    paths, place = write_windows(benchmark, n), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            bodies = batch.column(place).to_pylist()
            new, stays, open_ = list(bodies), [True] * len(bodies), list(range(len(bodies)))
            while open_:
                found = find([new[k] for k in open_], paths)
                for k, (words, spans, _) in zip(open_, found, strict=True):
                    stays[k] = not spans or sum(b - a for a, b in spans) < words
                    new[k] = cut(new[k], spans) if spans else new[k]
                open_ = [k for k, f in zip(open_, found, strict=True) if f[1] and stays[k]]
            field = batch.schema.field(place)
            yield batch.set_column(place, field, pa.array(new, field.type)).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(bounded(run), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


FORGET.append(windows_at.cache_clear)
