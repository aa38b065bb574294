"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find.

A line is what line breaks separate, without white space at its ends; blank lines take no part. Its shingles are all
runs of `SHINGLE` characters (the whole line if shorter). A line has 14 bands of 4 minima; a band is a key. Lines of at least
`LONG` distinct shingles take their minima from one permutation, in bins. Shorter lines, whose bins would stay empty, take
them from as many hash functions; lines in between do both, so two lines of similarity 0.8 always share a scheme. A pair
of similarity 0.8 shares a key with a chance of over 0.999.
Lines that share a key and whose signatures, 56 bits of minima, agree enough are a family; in a family lines are compared
exactly, and links of Jaccard similarity 0.8 or more are united. Of each component the first line stays, by doc_id, row
and place. Only `\n` ends a line.

Lines repeated in a batch are one item with a list of places, so a line in a third of all documents is an item a batch.
Texts aren't shuffled: passes over the table read it again, and what a pass needs of another lies in the shared folder by
scan partition. The table must be one that reads alike each time, such as files.

Edge cases: null and empty texts stay as they are; a document of which no line is left gets an empty text; repeated
rows are copies, the later in the table loses its lines; a null doc_id comes after all others; an empty table stays
empty; very long lines are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, prepare
from .lsh import KEY_BYTES, Sets, exact_links, jaccard, link, pack
from .order_minhash import mix
from .passes import by_partition, numbered, of_partition

SHINGLE, SIMILARITY = 8, 0.8
LONG, OVERLAP = 96, 1.25
BANDS, BAND_ROWS = 14, 4
BINS = BANDS * BAND_ROWS
#: Characters of lines that are hashed at a time: their arrays stay in a core's cache. Places of a table that counts a line's
#: distinct shingles from below.
CHUNK_CHARS, SLOTS = 50_000, 512
#: Characters of lines whose items leave at a time.
RECORD_CHARS = 400_000
#: Bytes of a family's lines that are a block: each character has a hash of eight bytes.
BLOCK_BYTES = 250_000
#: How many bits of a signature, each of a minimum, may differ: 0.1 of them do at a similarity of 0.8, and more than this
#: with a chance of 0.0002.
DIFFER = 15
#: Characters up to which two lines are compared as sets of strings.
PAIR_CHARS = 600
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EMPTY = np.uint32(0xFFFFFFFF)
LAST = (1 << 63) - 1  # stands for a null doc_id


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of some lines, and how many each line has."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE) for x in lines]
    sizes = np.array([len(x) for x in padded], np.int64)
    text = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    two = text[:-1] * _A + text[1:]
    four = two[:-2] * _B + two[2:]
    eight = four[:-4] * _C + four[4:]
    within = np.ones(len(text), bool)
    within[np.cumsum(sizes)[:, None] - np.arange(1, SHINGLE)] = False
    out, counts = mix(eight[within[: len(eight)]]), sizes - SHINGLE + 1
    first = np.cumsum(counts) - counts
    for k, x in enumerate(lines):
        if len(x) < SHINGLE:
            out[first[k]] = xxhash.xxh64_intdigest(x)
    return out, counts


def distinct_shingles(upper: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many distinct hashes each line has, as far as schemes are chosen by it: a line of fewer than `LONG` shingles has
    them all counted, repeats too, and of one that has `LONG * OVERLAP` or more, no fewer than that may be told."""
    begins, distinct = np.cumsum(counts) - counts, counts.copy()
    filled = np.zeros(len(counts) * SLOTS, np.uint8)
    filled[np.repeat(np.arange(0, len(filled), SLOTS), counts) + (upper & np.uint32(SLOTS - 1))] = 1
    slots = np.bitwise_count(filled.view(np.uint64).reshape(-1, SLOTS // 8)).sum(axis=1, dtype=np.uint16).astype(np.int64)
    sure = slots >= LONG * OVERLAP
    distinct[sure] = slots[sure]
    for k in np.flatnonzero(~sure & (counts >= LONG)).tolist():
        mine = upper[begins[k] : begins[k] + counts[k]].copy()
        mine.sort()
        distinct[k] = 1 + np.count_nonzero(mine[1:] != mine[:-1])
    return distinct


FACTORS = np.array([xxhash.xxh32_intdigest(b"minimum", seed=k) | 1 for k in range(BINS)], np.uint32)


def joined(minima: np.ndarray, salt: int) -> np.ndarray:
    """Keys of bands: minima (line, band, place) mixed to one number a band."""
    keys = (np.arange(minima.shape[1], dtype=np.uint64) + np.uint64(salt))[None, :] * _B
    for r in range(minima.shape[2]):
        keys = mix(keys * _A + minima[:, :, r])
    return keys


def signs(minima: np.ndarray, bit: int) -> np.ndarray:
    """A bit of each minimum of a line (line, place), packed to a number."""
    bits = np.zeros((len(minima), 64), np.uint8)
    bits[:, :BINS] = (minima >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(bits, axis=1).view("<u8").ravel()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether signatures agree in enough bits."""
    return np.bitwise_count(a[:, 0] ^ b[:, 0]) <= DIFFER


def long_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One permutation: the least hash of each bin; an empty bin takes that of the next full one. Bands take bins far
    apart. Keys and signatures."""
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).view(np.int64)
    bins += np.repeat(np.arange(0, len(counts) * BINS, BINS), counts)
    least = np.full(len(counts) * BINS, _EMPTY, np.uint32)
    np.minimum.at(least, bins, hashes.astype(np.uint32))
    least = least.reshape(-1, BINS)
    filled = least.astype(np.uint64)
    for step in range(1, BINS):
        empty = filled == _EMPTY
        if not empty.any():
            break
        near = np.roll(least, -step, axis=1)
        filled = np.where(empty & (near != _EMPTY), near + np.uint64(step << 32), filled)
    return joined(filled.reshape(-1, BAND_ROWS, BANDS).transpose(0, 2, 1), 1000), signs(filled, 3)


def short_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash function for each minimum. Keys and signatures."""
    begins = np.cumsum(counts) - counts
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.stack([np.minimum.reduceat(upper * f, begins) for f in FACTORS], axis=1).astype(np.uint64)
    return joined(minima.reshape(-1, BANDS, BAND_ROWS), 0), signs(minima, 10)


def parts(lines: list[str], chars: int) -> Iterator[list[str]]:
    """The lines in runs of about so many characters."""
    begin = 0
    while begin < len(lines):
        end, size = begin, 0
        while end < len(lines) and size < chars:
            size += len(lines[end])
            end += 1
        yield lines[begin:end]
        begin = end


Sketch = tuple[list[bytes | None], list[bytes | None], list[bytes | None], list[bytes | None]]


def band_keys(lines: list[str]) -> Sketch:
    """The packed keys and the signature of each line in the scheme of short lines, then in that of long ones."""
    out: Sketch = ([None] * len(lines), [None] * len(lines), [None] * len(lines), [None] * len(lines))
    begin = 0
    for part in parts(lines, CHUNK_CHARS):
        hashes, counts = shingle_hashes(part)
        distinct = distinct_shingles((hashes >> np.uint64(32)).astype(np.uint32), counts)
        for some, scheme, at in ((distinct < LONG * OVERLAP, short_keys, 0), (distinct >= LONG, long_keys, 2)):
            if some.any():
                keys, sign = scheme(hashes[np.repeat(some, counts)], counts[some])
                packed, signs_, width = pack(keys.ravel()), sign.tobytes(), KEY_BYTES * BANDS
                for n, k in enumerate((begin + np.flatnonzero(some)).tolist()):
                    out[at][k], out[at + 1][k] = packed[width * n : width * (n + 1)], signs_[8 * n : 8 * n + 8]
        begin += len(part)
    return out


def shingle_set(line: bytes) -> np.ndarray:
    """The set of shingles of a line."""
    return np.unique(shingle_hashes([line.decode()])[0])


def compare(contents: list[bytes], left: int):
    """Index pairs of similar lines, one of them among the first `left`: equal ones, then exact Jaccard of the distinct
    ones' sets of shingles."""
    first: dict[bytes, int] = {}
    for k, x in enumerate(contents):
        if (f := first.setdefault(x, k)) != k:
            yield f, k
    at = list(first.values())
    if len(at) == 2 and max(map(len, first)) <= PAIR_CHARS:
        a, b = ({x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in (y.decode() for y in first))
        both = len(a & b)
        if left and both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9:
            yield at[0], at[1]
    elif len(at) > 1:
        lines, sets = [x.decode() for x in first], []
        for k in range(0, len(lines), 500):
            hashes, counts = shingle_hashes(lines[k : k + 500])
            sets += [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield from ((at[i], at[j]) for i, j in exact_links(sets, jaccard(SIMILARITY), left=sum(k < left for k in at)))


# ---------------------------------------------------------------- passes over the table

PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("line", "<i4")])
ITEMS = "doc long, row long, line int, n int, places binary, keys binary, sign binary, long_keys binary, long_sign binary"


def items(docs: DataFrame) -> DataFrame:
    """A row for each distinct line of a batch: its first place, all places if there are more, its keys."""

    def run(batches):
        for batch in batches:
            rows, ids, bodies = (batch.column(c).to_pylist() for c in range(3))
            found: dict[str, list[tuple[int, int, int]]] = {}
            for row, doc, text in zip(rows, ids, bodies, strict=True):
                if text:
                    doc = LAST if doc is None else doc
                    for k, x in enumerate(text.split("\n")):
                        if x := x.strip():
                            found.setdefault(x, []).append((doc, row, k))
            for part in parts(list(found), RECORD_CHARS):
                places = [sorted(found[x]) if len(found[x]) > 1 else found[x] for x in part]
                sketch = band_keys(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0][0] for p in places], pa.int64()),
                        pa.array([p[0][1] for p in places], pa.int64()),
                        pa.array([p[0][2] for p in places], pa.int32()),
                        pa.array([len(p) for p in places], pa.int32()),
                        pa.array([np.array(p, PLACE).tobytes() if len(p) > 1 else None for p in places], pa.binary()),
                        *(pa.array(x, pa.binary()) for x in sketch),
                    ],
                    names=["doc", "row", "line", "n", "places", "keys", "sign", "long_keys", "long_sign"],
                )

    return numbered(docs, F.col("doc_id").cast("long"), "text").mapInArrow(bounded(run), ITEMS)


def fetch_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, id, data): the lines at (family, id, row, line), from another pass over the table."""
    folder = by_partition(wanted.select("family", "id", "row", "line"), "row", "wanted")

    def run(batches):
        places: dict[int, list[tuple[int, int, int]]] | None = None
        for batch in batches:
            rows, bodies = (batch.column(c).to_pylist() for c in range(2))
            if places is None and rows:
                places = {}
                for f, i, r, k in zip(*of_partition(folder, rows[0], ["family", "id", "row", "line"]), strict=True):
                    places.setdefault(r, []).append((f, i, k))
            families, ids, data = [], [], []
            for row, text in zip(rows, bodies, strict=True):
                if row in places:
                    lines = text.split("\n")
                    for f, i, k in places[row]:
                        families.append(f)
                        ids.append(i)
                        data.append(lines[k].strip().encode())
            yield pa.RecordBatch.from_arrays([pa.array(families, pa.int64()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["family", "id", "data"])

    return numbered(docs, "text").mapInArrow(bounded(run), "family long, id long, data binary")


def removals(docs: DataFrame) -> DataFrame:
    """(row, line): every line but the first of each component, by row number of the table and line number."""
    prepare(docs.sparkSession)
    found = durable(items(docs).withColumn("id", F.monotonically_increasing_id()), "items")
    sketched = found.where("keys is not null").select("id", "keys", "sign").union(found.where("long_keys is not null").select("id", "long_keys", "long_sign"))
    comps = durable(link(sketched, alike, 1, lambda ids: fetch_lines(docs, found.select("id", "row", "line").join(ids, "id")), compare, Sets(shingle_set, jaccard(SIMILARITY)), BLOCK_BYTES), "components")
    joined = found.select("id", "doc", "row", "line", "n", "places").join(comps, "id", "left").where("comp is not null or n > 1")
    members = durable(joined, "members")
    first = members.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "row", "line", "id")).alias("first"))
    whole = F.coalesce(F.col("id") != F.col("first.id"), F.lit(False))
    lost = members.join(first, "comp", "left").select("row", "line", "places", "n", whole.alias("all")).where("all or n > 1").drop("n")

    def run(batches):
        for batch in batches:
            rows, lines = [], []
            for row, line, places, whole in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if places is None:
                    rows.append(row)
                    lines.append(line)
                else:
                    p = np.frombuffer(places, PLACE)[0 if whole else 1 :]
                    rows += p["row"].tolist()
                    lines += p["line"].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lines, pa.int32())], names=["row", "line"])

    return lost.mapInArrow(bounded(run), "row long, line int")


def _without(text: str, gone: set[int]) -> str:
    return "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])


def _rewritten(docs: DataFrame, schema, out) -> DataFrame:
    """A last pass: `out(batch, gone)` makes the result of each batch; gone[i] are the line numbers that row i loses."""
    folder = by_partition(removals(docs), "row", "removals")

    def run(batches):
        lost: dict[int, set[int]] | None = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if lost is None and rows:
                lost = {}
                for r, k in zip(*of_partition(folder, rows[0], ["row", "line"]), strict=True):
                    lost.setdefault(r, set()).add(k)
            if rows:
                yield out(batch, [lost.get(r, ()) for r in rows])

    return numbered(docs, *(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(bounded(run), schema)


def dedup(docs: DataFrame, drop_empty: bool = False) -> DataFrame:
    """The same columns, text without the lines that lose; on request without documents that lost their last line."""
    place = docs.columns.index("text") + 1

    def out(batch, gone):
        bodies = batch.column(place).to_pylist()
        new = [_without(x, g) if g else x for x, g in zip(bodies, gone, strict=True)]
        new = [x if not g or x.strip() else "" for x, g in zip(new, gone, strict=True)]
        stays = pa.array([not (drop_empty and g and not x) for x, g in zip(new, gone, strict=True)], pa.bool_())
        field = batch.schema.field(place)
        batch = batch.set_column(place, field, pa.array(new, field.type)).filter(stays)
        return pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:]))

    return _rewritten(docs, docs.schema, out)


def report(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_lines (not blank), n_removed, text_sha256 of what is left."""

    def out(batch, gone):
        import hashlib

        ids, bodies = batch.column(1), batch.column(2).to_pylist()
        left = [_without(x, g) if g else (x or "") for x, g in zip(bodies, gone, strict=True)]
        left = [x if not g or x.strip() else "" for x, g in zip(left, gone, strict=True)]
        lines = [sum(1 for y in (x or "").split("\n") if y.strip()) for x in bodies]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(lines, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in left])], names=["doc_id", "n_lines", "n_removed", "text_sha256"])

    return _rewritten(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_lines long, n_removed long, text_sha256 string", out)
