"""Buckets of equal sketch keys, families of alike items of a bucket, exact links in families, and components.

Items are (id, keys, sign): a unique long id (on several rows if it has keys of several schemes), packed sketch keys of
48 bits, and a signature by which two items of a bucket are told to be alike or not before their contents are needed.
Keys travel as arrays, a few rows a batch, not as a row a key. Alike items of a bucket, directly or through others, are
a family; an item's content is sent once, to its family, whatever the number of its buckets. There sets are compared
exactly, and only links that join two components are given on: n - 1 at most for n items, never all pairs.

Chance links grow families, so a family beyond `block_bytes` of content is parted first by an exact prefix filter over
the members of its sets, rarest first: passages that many share come last, and sets that may be near share a member
before them. Sets that share one must leave room for as many members as near sets share: all that two sets share come,
in either, from the first shared one on. A copy with many members of its own, which come first, so meets hardly any other,
even where signatures leave a link possible. Sets must also agree in size and in a signature of `SIGN_WORDS` words, else
clusters that a short signature takes for alike hang together, and the more rows there are, the more. What is still large
is cut into blocks by hash. Each block meets the family's pivots, a few members drawn
by hash; what is linked to them directly or through others settles there, in one copy of each content. Then only members
outside the largest component meet all blocks. A pair of different components has a member outside the largest, so no
pair that could join components is left out, and near copies of one text cost in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded, durable

BLOCK_BYTES = 4_000_000
#: Bytes of pivots, expected, that each block of a large family meets.
PIVOT_BYTES = 100_000
#: Counters of members, by hash, that order them for the prefix filter: the driver holds so many numbers.
COUNTERS = 1 << 20
#: Sets compared with each other at a time; pivots of a bucket before it goes on to its family whole.
ROWS, BUCKET_PIVOTS = 512, 512
#: 64-bit words of a set's signature; by how many standard deviations more than expected its bits may differ, which a pair
#: that is near exceeds with a chance of under 0.000001; sets of a group from which on it is parted by them.
SIGN_WORDS, BEYOND, SIGNED = 8, 5.0, 512
#: Pairs of signatures compared at a time.
PAIRS = 100_000

KEY_BYTES = 6


def pack(keys: np.ndarray) -> bytes:
    """Keys as 6 bytes each, the low ones."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


#: Signatures (n, words) of two lists of items, compared row by row.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def alike_pairs(bucket: np.ndarray, sign: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that make the components of alike entries of each bucket; `bucket` has the first place of each.

    All buckets take a pivot at a time: their first entry, then each that isn't yet in the component of the first. Of two
    alike entries in different components one is outside the first's, and so is a pivot. A bucket that isn't through
    after `BUCKET_PIVOTS` pivots links what is left to its first entry: contents decide.
    """
    ends = np.append(bucket[1:], len(sign))
    joined, open_ = np.zeros(len(sign), bool), np.ones(len(sign), bool)
    us, vs = [], []
    pivots, rounds = bucket.copy(), 0
    while len(pivots):
        sizes = ends - bucket
        at = np.repeat(bucket - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        pivot = np.repeat(pivots, sizes)
        begins = np.cumsum(sizes) - sizes
        if rounds < BUCKET_PIVOTS:
            same = np.concatenate([alike(sign[at[k : k + PAIRS]], sign[pivot[k : k + PAIRS]]) for k in range(0, len(at), PAIRS)]) & (at != pivot)
        else:
            same = (at != pivot) & open_[at] & ~joined[at]
        us.append(at[same])
        vs.append(pivot[same])
        open_[pivots] = False
        reached = np.logical_or.reduceat(same & joined[at], begins) | (pivots == bucket)
        into = np.repeat(reached, sizes) & (same | (at == pivot))
        joined[at[into]] = True
        if rounds >= BUCKET_PIVOTS:
            break
        left = np.where(open_[at] & ~joined[at], at, len(sign))
        following = np.minimum.reduceat(left, begins)
        more = following < len(sign)
        bucket, ends, pivots = bucket[more], ends[more], following[more]
        rounds += 1
        if rounds == BUCKET_PIVOTS:
            pivots = bucket.copy()
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


ENTRY = "part int, base long, keys binary, signs binary, marks binary, places binary"
PACKED = "part int, data binary, moved long"
#: Edges that a task unites, about.
EDGES = 500_000


def packed_edges(u: np.ndarray, v: np.ndarray, parts: int, moved: int = 0) -> pa.RecordBatch:
    """Edges from `u` to `v` as arrays, a row for each partition that `u` is dealt to."""
    part = ((u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    both, part = np.stack([u, v], axis=1)[order].astype("<i8"), part[order]
    begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    data = [both[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(part)], strict=True)] if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a in begins], pa.int32()), pa.array(data, pa.binary()), pa.array([moved] * len(begins), pa.int64())], names=["part", "data", "moved"])


def unpacked_edges(batches) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, "<i8").reshape(-1, 2) for batch in batches for x in batch.column(1).to_pylist()]
    both = np.concatenate(both) if both else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def bucket_edges(items: DataFrame, alike: Alike, words: int = 1, overlap: Overlap | None = None) -> DataFrame:
    """Packed edges that make families of alike items of a bucket. A task holds 14 bytes and the signature of `words`
    64-bit words for each key of its partition.

    Items of the same keys and signature (by a digest of 32 bits, within a bucket and signature) are a class, led by its
    least id. Leaders meet in each bucket; the rest of a class meets its leader, the same in each of their buckets, only in
    the first. The lowest bit of a key that travels marks an item's first; it takes no part in comparisons.

    With `overlap`, keys are members of sets in their order, the last of them `least` members from a set's end, and a signature
    begins with the set's size: a key then travels with the number of members from it on, and pairs must have room.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scatter(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            packed, sign = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = np.array([len(x) // KEY_BYTES for x in packed], np.int64)
            if not counts.sum():
                continue
            first = np.zeros(int(counts.sum()), np.uint64)
            first[(np.cumsum(counts) - counts)[counts > 0]] = 1
            keys, base = unpack(b"".join(packed)) & ~np.uint64(1) | first, int(ids.min())
            signs = np.repeat(np.frombuffer(b"".join(sign), "<u8").reshape(-1, words), counts, axis=0)
            if overlap:
                ends, least = np.cumsum(counts), overlap.least(signs[np.cumsum(counts)[counts > 0] - 1, 0].astype(np.int64))
                signs[:, 0] |= (np.repeat(ends[counts > 0] - 1 + least, counts[counts > 0]) - np.arange(len(signs))).astype(np.uint64) << np.uint64(32)
            marks = np.repeat(np.array([xxhash.xxh32_intdigest(x + s) for x, s in zip(packed, sign, strict=True)], "<u4"), counts)
            places = np.repeat(ids - base, counts)
            places = places.astype("<u4" if int(ids.max()) - base < 1 << 32 else "<u8")
            part = ((keys >> np.uint64(1)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, signs, marks, places, part = keys[order], signs[order], marks[order], places[order], part[order]
            begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            spans = list(zip(begins, [*begins[1:], len(part)], strict=True))
            columns = [pa.array([f(x[a:b]) for a, b in spans], pa.binary()) for x, f in ((keys, pack), (signs, np.ndarray.tobytes), (marks, np.ndarray.tobytes), (places, np.ndarray.tobytes))]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([base] * len(spans), pa.int64()), *columns], names=["part", "base", "keys", "signs", "marks", "places"])

    def gather(batches):
        keys, signs, marks, ids = [], [], [], []
        for batch in batches:
            for base, k, s, m, p in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True):
                keys.append(unpack(k))
                signs.append(np.frombuffer(s, "<u8").reshape(-1, words))
                marks.append(np.frombuffer(m, "<u4"))
                ids.append(base + np.frombuffer(p, f"<u{len(p) // len(keys[-1])}").astype(np.int64))
        if not keys:
            return
        key, sign, mark, id_ = np.concatenate(keys), np.concatenate(signs), np.concatenate(marks), np.concatenate(ids)
        del keys, signs, marks, ids
        first, key = (key & np.uint64(1)) == 1, key >> np.uint64(1)
        order = np.argsort(key)
        ordered = key[order]
        many = np.zeros(len(key), bool)
        many[1:] = ordered[1:] == ordered[:-1]
        many[:-1] |= many[1:]
        order = order[many]
        if not len(order):
            return
        order = order[np.lexsort((id_[order], *sign[order, :2].T, mark[order], key[order]))]
        key, sign, mark, id_, first = key[order], sign[order], mark[order], id_[order], first[order]
        bucket = np.concatenate([[True], key[1:] != key[:-1]])
        leads = bucket | np.concatenate([[True], (mark[1:] != mark[:-1]) | (sign[1:] != sign[:-1]).any(axis=1)])
        leader, rest = np.flatnonzero(leads), np.flatnonzero(first & ~leads)
        led = id_[leader[np.cumsum(leads)[rest] - 1]]
        if overlap:
            signed = sign[leader]
            left = (signed[:, 0] >> np.uint64(32)).astype(np.int64)
            signed[:, 0] &= np.uint64(0xFFFFFFFF)
            u, v = roomy_pairs(np.cumsum(bucket[leader]), left, signed, alike, overlap)
        else:
            u, v = alike_pairs(np.flatnonzero(bucket[leader]), sign[leader], alike)
        u, v = np.concatenate([id_[leader[u]], id_[rest]]), np.concatenate([id_[leader[v]], led])
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = settle(len(nodes), place[: len(u)], place[len(u) :])
        u = np.flatnonzero(label != np.arange(len(nodes)))
        yield packed_edges(nodes[u], nodes[label[u]], parts)

    spread = items.select("id", "keys", "sign").mapInArrow(bounded(scatter), ENTRY)
    return spread.repartitionById(parts, F.col("part")).mapInArrow(bounded(gather), PACKED)


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component, of edges a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Union:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[max(i, j)] = min(i, j)

    def roots(self, some: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in some.tolist()])


# ---------------------------------------------------------------- links of sets


@dataclass(frozen=True)
class Overlap:
    """How many members two sets must share. `near` takes the number shared and both sizes; of a set of n members, any
    that is near shares one of the first n - least(n) + 1 members, in whatever order all sets have them; two sets of n and m
    members that are near share fewest(n, m) at least."""

    near: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    least: Callable[[np.ndarray], np.ndarray]
    fewest: Callable[[np.ndarray, np.ndarray], np.ndarray]


def jaccard(similarity: float) -> Overlap:
    return Overlap(lambda both, a, b: both >= similarity * (a + b - both) - 1e-9, lambda n: np.ceil(similarity * n - 1e-9).astype(np.int64), lambda a, b: np.ceil(similarity * (a + b) / (1 + similarity) - 1e-6).astype(np.int64))


FACTORS = np.array([xxhash.xxh32_intdigest(b"signature", seed=k) | 1 for k in range(64 * SIGN_WORDS)], np.uint32)


def signature(members: np.ndarray) -> np.ndarray:
    """The size of a set, then a bit of the least member by each of 64 * `SIGN_WORDS` hash functions."""
    upper = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(upper), 200):
        np.minimum(least, (FACTORS[:, None] * upper[None, k : k + 200]).min(axis=1), out=least)
    bits = np.packbits(((least >> np.uint32(10)) & np.uint32(1)).astype(np.uint8))
    return np.concatenate([np.array([len(members)], np.uint64), bits.view(np.uint64)])


def agreeing(overlap: Overlap) -> Alike:
    """Whether sizes and signatures of two sets leave it possible that they share as many members as near ones do."""

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sizes = [x[:, 0].astype(np.int64) for x in (a, b)]
        shared = overlap.fewest(*sizes)
        chance = (1 - np.minimum(1, shared / np.maximum(1, sizes[0] + sizes[1] - shared))) / 2
        most = len(FACTORS) * chance + BEYOND * np.sqrt(len(FACTORS) * chance * (1 - chance))
        differ = np.bitwise_count(a[:, 1:] ^ b[:, 1:]).sum(axis=1, dtype=np.int64)
        return (shared <= np.minimum(*sizes)) & (differ <= most)

    return agree


def roomy_pairs(bucket: np.ndarray, left: np.ndarray, sign: np.ndarray, alike: Alike, overlap: Overlap) -> tuple[np.ndarray, np.ndarray]:
    """alike_pairs() of sets with `left` members each from the bucket's member on. A pair that is near has so many in common at
    most, or meets in the bucket of a member before; signatures begin with sizes.

    A pivot meets only sets of sizes for which it has room. Sets with the smallest share of rarer members, originals before
    their copies, are pivots first: 8, then 16, 32, ... of those outside the bucket's largest component so far. A bucket that
    costs more than `BUCKET_PIVOTS` that meet it whole links what is left to that component: contents decide.
    """
    size = sign[:, 0].astype(np.int64)
    order = np.lexsort((size, bucket))
    size, left, sign = size[order], left[order], sign[order]
    new = np.concatenate([[True], np.diff(bucket[order]) != 0])
    begins, of = np.flatnonzero(new), np.cumsum(new) - 1
    ends = np.append(begins[1:], len(size))

    def first(low: np.ndarray, high: np.ndarray, beyond: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """For each set the first place from low to high where the size is beyond a bound, else high."""
        while (going := low < high).any():
            middle = (low + high) // 2
            found = beyond(size[np.minimum(middle, len(size) - 1)])
            low, high = np.where(going & ~found, middle + 1, low), np.where(going & found, middle, high)
        return high

    least = overlap.least(size)
    low = first(begins[of], ends[of], lambda x: x >= least)
    high = first(begins[of], ends[of], lambda x: overlap.fewest(size, x) > left)
    label, waiting, spent = np.arange(len(size)), np.ones(len(size), bool), np.zeros(len(begins))
    turn = np.lexsort(((size - left) / np.maximum(1, size), of))
    us, vs, step = [], [], 8
    pivots = turn[np.arange(len(size)) - begins[of] < step]
    while len(pivots):
        waiting[pivots] = False
        width = np.maximum(high[pivots] - low[pivots], 0)
        spent += np.bincount(of[pivots], width, len(begins))
        done = np.cumsum(width)
        cuts = np.unique(np.searchsorted(done, np.arange(0, int(done[-1]) + PAIRS, PAIRS), "right"))
        now = len(us)
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(pivots)), strict=True):
            some, wide = pivots[a:b], width[a:b]
            pivot = np.repeat(some, wide)
            at = np.repeat(low[some] - (np.cumsum(wide) - wide), wide) + np.arange(len(pivot))
            kept = np.flatnonzero((at != pivot) & (overlap.fewest(size[at], size[pivot]) <= np.minimum(left[at], left[pivot])))
            at, pivot = at[kept], pivot[kept]
            same = np.concatenate([alike(sign[at[k : k + PAIRS]], sign[pivot[k : k + PAIRS]]) for k in range(0, len(at), PAIRS)]) if len(at) else np.zeros(0, bool)
            us.append(at[same])
            vs.append(pivot[same])
        u, v = np.concatenate(us[now:]), np.concatenate(vs[now:])
        label = settle(len(size), label[u], label[v])[label]
        largest = label[np.lexsort((label, np.bincount(label, minlength=len(size))[label], of))[ends - 1]]
        waits = turn[(waiting & (label != largest[of]))[turn]]
        dear = spent[of[waits]] >= BUCKET_PIVOTS * (ends - begins)[of[waits]]
        us.append(waits[dear])
        vs.append(largest[of[waits[dear]]])
        waits = waits[~dear]
        step *= 2
        pivots = waits[np.arange(len(waits)) - np.searchsorted(of[waits], of[waits]) < step]
    return order[np.concatenate(us)], order[np.concatenate(vs)]


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """A row of uint64 words for each sorted set; members that only one set has are left out: they are in no intersection."""
    sizes = np.array([len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = count > 1
    column = (np.cumsum(kept) - 1)[place]
    shared, owner = kept[place], np.repeat(np.arange(len(sets)), sizes)
    column, owner = column[shared], owner[shared]
    words = int(kept.sum()) // 64 + 1
    rows = np.zeros((len(sets), words), np.uint64)
    begins = np.searchsorted(owner, np.arange(0, len(sets) + ROWS, ROWS))
    for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False)):
        part = rows[k * ROWS : (k + 1) * ROWS]
        flat = np.zeros((len(part), words * 64), np.uint8)
        flat[owner[a:b] - k * ROWS, column[a:b]] = 1
        part[:] = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    return rows


def prefix_groups(sets: list[np.ndarray], overlap: Overlap) -> list[np.ndarray]:
    """Places of sets that may be linked, directly or through others, by prefix filtering over members ordered by how
    rare they are, and where that leaves crowds, by signatures too."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), sizes)
    member = rank[place]
    order = np.lexsort((member, owner))
    within = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = within < np.repeat(sizes - overlap.least(sizes) + 1, sizes)
    member, owner, left = member[order][kept], owner[kept], (np.repeat(sizes, sizes) - within)[kept]
    order = np.argsort(member, kind="stable")
    member, owner, left = member[order], owner[order], left[order]
    begins = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
    each = np.diff(np.append(begins, len(member)))
    label = np.arange(len(sets))
    while True:
        low = np.repeat(np.minimum.reduceat(label[owner], begins), each)
        new = label.copy()
        np.minimum.at(new, owner, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    crowded = np.bincount(label, minlength=len(sets))[label] > SIGNED
    if crowded.any():
        some = np.flatnonzero(crowded)
        kept = crowded[owner]
        member, at = member[kept], (np.cumsum(crowded) - 1)[owner[kept]]
        u, v = roomy_pairs(member, left[kept], np.stack([signature(sets[k]) for k in some.tolist()])[at], agreeing(overlap), overlap)
        label[some] = some[settle(len(some), at[u], at[v])]
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return [x for x in np.split(order, cuts) if len(x) > 1]


Confirm = Callable[[int, int], bool]


#: Other sets of the same contents, and whether so many shared members leave them near.
Also = tuple[list[np.ndarray], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def exact_links(sets: list[np.ndarray], overlap: Overlap, confirm: Confirm | None = None, left: int | None = None, also: Also | None = None) -> Iterator[tuple[int, int]]:
    """Links that join all components of sets that are near, in `also` too, by exact intersections and `confirm`. With
    `left`, only the first `left` sets meet all others; else all sets meet."""
    left = len(sets) if left is None else left
    for at in prefix_groups(sets, overlap) if len(sets) > 8 else [np.arange(len(sets))]:
        again = (lambda i, j, at=at: confirm(int(at[i]), int(at[j]))) if confirm else None
        other = ([also[0][k] for k in at.tolist()], also[1]) if also else None
        yield from ((int(at[i]), int(at[j])) for i, j in group_links([sets[k] for k in at.tolist()], overlap, again, int((at < left).sum()), other))


def group_links(sets: list[np.ndarray], overlap: Overlap, confirm: Confirm | None = None, left: int | None = None, also: Also | None = None) -> Iterator[tuple[int, int]]:
    """The links of one group, held as bit rows; the first `left` sets, or all, meet all.

    If all do, sets with most members in common with the others come first: `ROWS` of them meet all sets, so the original
    of many copies joins them at once. Then every set outside the largest component meets all sets.
    """
    n = len(sets)
    left = n if left is None else left
    if n < 2 or not left:
        return
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if overlap.near(np.int64(both), np.int64(len(sets[0])), np.int64(len(sets[1]))) and (confirm is None or confirm(0, 1)):
            yield 0, 1
        return
    bits, sizes = bit_rows(sets), np.array([len(x) for x in sets], np.int64)
    others, all_sizes = (bit_rows(also[0]), np.array([len(x) for x in also[0]], np.int64)) if also else (None, None)
    common = np.array([np.bitwise_count(r).sum() for r in bits], np.int64)
    order = np.lexsort((np.arange(n), sizes, -common))
    union = Union(n)

    def shared(bits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        both = np.zeros((len(rows), len(columns)), np.int64)
        for x, y in zip(bits[rows].T.copy(), bits[columns].T.copy(), strict=True):
            both += np.bitwise_count(x[:, None] & y[None, :])
        return both

    def meet(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
        ra, rb = union.roots(rows), union.roots(columns)
        if (ra == ra[0]).all() and (rb == ra[0]).all():
            return
        near = overlap.near(shared(bits, rows, columns), sizes[rows][:, None], sizes[columns][None, :]) & (ra[:, None] != rb[None, :])
        if also and near.any():
            near &= also[1](shared(others, rows, columns), all_sizes[rows][:, None], all_sizes[columns][None, :])
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            p, q = int(rows[i]), int(columns[j])
            if union.find(p) != union.find(q) and (confirm is None or confirm(p, q)):
                union.join(union.find(p), union.find(q))
                yield p, q

    rows = order if left == n else np.arange(left)
    for b in range(0, n, ROWS):
        yield from meet(rows[:ROWS], order[b : b + ROWS])
    if len(rows) > ROWS:
        roots = union.roots(np.arange(n))
        names, count = np.unique(roots, return_counts=True)
        rest = rows[ROWS:]
        rest = rest[roots[rest] != names[count.argmax()]] if left == n else rest
        for a in range(0, len(rest), ROWS):
            for b in range(0, n, ROWS):
                yield from meet(rest[a : a + ROWS], order[b : b + ROWS])


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(id, comp): each node of the edges (u, v) and the least node of its component."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack_all(batches):
        for batch in batches:
            u, v = (batch.column(c).to_numpy() for c in (0, 1))
            some = u != v
            yield packed_edges(np.maximum(u, v)[some], np.minimum(u, v)[some], parts)

    return united(links.select("u", "v").mapInArrow(bounded(pack_all), PACKED))


def united(edges: DataFrame) -> DataFrame:
    """components() of packed edges.

    Edges are dealt by their larger end, and a task unites what lies in its partition: of n nodes at most n - 1 edges are
    left, each from a node to the least one of its piece. An item is the larger end of as many edges as it has buckets at
    most, so a hub isn't a hot key. Once no node has two parents, paths are halved: where a node's parent has one too, it
    takes that. Parents that have parents are few, or else the join can be split on the side where many have the same.
    Each round is written to the shared folder, and counts what it changed and how many edges are left, for which the next
    takes as many tasks as they need; what one task holds is settled at once.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def unite(batches):
        u, v = unpacked_edges(batches)
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = settle(len(nodes), place[: len(u)], place[len(u) :])
        own = np.zeros(len(nodes), bool)
        own[place[: len(u)]] = True
        some = np.flatnonzero(label != np.arange(len(nodes)))
        if len(some):
            yield packed_edges(nodes[some], nodes[label[some]], parts, int((~own[some]).any()))

    def rows(batches):
        u, v = unpacked_edges(batches)
        for k in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 50_000]), pa.array(v[k : k + 50_000])], names=["u", "v"])

    def halved(edges: DataFrame) -> DataFrame | None:
        """A node's least parent's least parent in its place; None if no parent has one."""
        middle = edges.select(F.col("v").alias("u")).distinct()
        above = durable(edges.join(middle, "u", "left_semi").groupBy(F.col("u").alias("p")).agg(F.min("v").alias("above")), "above")
        if above.isEmpty():
            return None
        return edges.join(above, edges["v"] == above["p"], "left").select("u", F.coalesce("above", "v").alias("v"))

    moved, rounds, tasks = 1, 0, parts
    while moved:
        seen = Observation()
        edges = durable(edges.repartitionById(tasks, F.col("part") % tasks).mapInArrow(bounded(unite), PACKED).observe(seen, F.sum("moved").alias("moved"), F.sum(F.length("data")).alias("bytes")), "edges")
        moved, rounds = tasks > 1 and (seen.get["moved"] or 0), rounds + 1
        tasks = min(parts, (seen.get["bytes"] or 0) // (16 * EDGES) + 1)
        if moved and tasks > 1 and rounds > 2:  # long paths that run side by side would unite a step a round
            shorter = halved(edges.mapInArrow(bounded(rows), "u long, v long"))
            edges = edges if shorter is None else shorter.mapInArrow(bounded(lambda batches: (packed_edges(b.column(0).to_numpy(), b.column(1).to_numpy(), parts) for b in batches)), PACKED)
    forest = edges.mapInArrow(bounded(rows), "u long, v long")
    while (shorter := halved(forest)) is not None:
        forest = durable(shorter, "paths")
    return forest.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(forest.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


# ---------------------------------------------------------------- families

#: Contents, and how many of the first meet all; yields index pairs.
Compare = Callable[[list[bytes], int], Iterator[tuple[int, int]]]


def _compared(groups: DataFrame, compare: Compare) -> DataFrame:
    """(u, v) of `groups` (family, i, j, left, id, data): in each (family, i, j) what is `left` meets all. Spanning links."""

    def run(batches):
        at, ids, contents, left, first = None, [], [], 0, set()
        us, vs = [], []

        def close() -> None:
            if len(ids) > 1 and left:
                for a, b in compare(contents, left):
                    us.append(ids[a])
                    vs.append(ids[b])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us.clear()
            vs.clear()
            return out

        for batch in batches:
            for family, i, j, meets, id_, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (family, i, j) != at:
                    close()
                    at, ids, contents, left, first = (family, i, j), [], [], 0, set()
                if meets:
                    left += 1
                    first.add(id_)
                elif id_ in first:
                    continue
                ids.append(id_)
                contents.append(data)
            if len(us) > 10_000:
                yield flush()
        close()
        yield flush()

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("family", "i", "j", "left", "id", "data").repartition(parts, "family", "i", "j")
    return dealt.sortWithinPartitions("family", "i", "j", F.desc("left"), "id").mapInArrow(bounded(run), "u long, v long")


@dataclass(frozen=True)
class Sets:
    """What an operator's contents are: the sorted set of each content; and how near sets are."""

    members: Callable[[bytes], np.ndarray]
    overlap: Overlap


def _counters(large: DataFrame, sets: Sets) -> np.ndarray:
    """How many contents hold a member, by its hash; a task sends one array, and the driver holds their sum."""

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                np.add.at(total, (sets.members(data) % np.uint64(COUNTERS)).astype(np.int64), 1)
        if total.any():
            pieces = np.split(total, 16)
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "data"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(data, np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "data"])

    kind = "piece int, data binary"
    out = large.select("data").mapInArrow(bounded(count), kind).repartition(16, "piece").mapInArrow(bounded(add), kind).collect()  # COUNTERS numbers
    whole = np.zeros((16, COUNTERS // 16), np.int64)
    for r in out:
        whole[r["piece"]] = np.frombuffer(r["data"], np.int64)
    return whole.ravel()


def _parted(large: DataFrame, sets: Sets) -> DataFrame:
    """(id, comp): smaller families of `large` (family, id, data), by what sets must share at least. A member that no other
    content holds gives no key."""
    counters = large.sparkSession.sparkContext.broadcast(np.minimum(_counters(large, sets), 0xFFFFFFFF).astype(np.uint32))

    def keys(batches):
        for batch in batches:
            out, signs = [], []
            for family, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                members = sets.members(data)
                held = counters.value[(members % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((members, held))[: len(members) - int(sets.overlap.least(np.array([len(members)]))[0]) + 1]
                first = members[order[held[order] > 1]]
                out.append(pack((first ^ np.uint64(family)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)))
                signs.append(signature(members).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()), pa.array(signs, pa.binary())], names=["id", "keys", "sign"])

    return united(bucket_edges(large.select("family", "id", "data").mapInArrow(bounded(keys), "id long, keys binary, sign binary"), agreeing(sets.overlap), 1 + SIGN_WORDS, sets.overlap))


def _large(held: DataFrame, block_bytes: int) -> DataFrame:
    """(family, bytes, blocks) of families beyond a block."""
    sizes = held.groupBy("family").agg(F.sum(F.length("data") + 64).alias("bytes"))
    return durable(sizes.where(F.col("bytes") > block_bytes).select("family", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks")), "large")


def link(items: DataFrame, alike: Alike, words: int, fetch: Callable[[DataFrame], DataFrame], compare: Compare, sets: Sets, block_bytes: int | None = None) -> DataFrame:
    """Components (id, comp) of the links that `compare` finds among items of a family.

    `fetch` takes (id, family) and returns (family, id, data), the contents.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    families = durable(united(bucket_edges(items, alike, words)), "families")
    held = durable(fetch(families.select("id", F.col("comp").alias("family"))).select("family", "id", "data"), "contents")
    zero = F.lit(0)
    as_small = lambda x: x.select("family", zero.alias("i"), zero.alias("j"), F.lit(True).alias("left"), "id", "data")
    large = _large(held, block_bytes)
    if large.isEmpty():
        return components(_compared(as_small(held), compare))
    small = as_small(held.join(large, "family", "left_anti"))
    held = durable(held.join(large.select("family"), "family", "left_semi").select("family", "id", "data"), "crowded")
    parted = durable(_parted(held, sets), "parted")
    held = durable(held.select("id", "data").join(parted, "id").select(F.col("comp").alias("family"), "id", "data"), "parts")
    large = _large(held, block_bytes)
    if large.isEmpty():
        return components(_compared(small.union(as_small(held)), compare))
    small = small.union(as_small(held.join(large, "family", "left_anti")))
    placed = held.join(large, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = lambda n: F.explode(F.sequence(zero, n - 1))
    drawn = placed.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) * (F.col("bytes") / PIVOT_BYTES) < (1 << 30))
    pivots = drawn.select("family", every(F.col("blocks")).alias("i"), zero.alias("j"), F.lit(True).alias("left"), "id", "data")
    blocks = placed.select("family", F.col("block").alias("i"), zero.alias("j"), F.lit(False).alias("left"), "id", "data")
    found = durable(_compared(small.union(pivots).union(blocks), compare), "links")
    settled = durable(components(found), "settled")
    ids = placed.select("family", "id").join(settled, "id", "left").select("family", "id", F.coalesce("comp", "id").alias("comp"))
    largest = ids.groupBy("family", "comp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    rest = durable(ids.join(largest, "family").where("comp <> most").select("id"), "rest")
    if rest.isEmpty():
        return settled
    outside = placed.join(rest, "id", "left_semi")
    pieces = durable(outside.groupBy("family").agg(F.ceil(F.sum(F.length("data") + 64) / block_bytes).cast("int").alias("pieces")), "pieces")
    lefts = outside.join(pieces, "family").select("family", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("pieces")).cast("int").alias("i"), every(F.col("blocks")).alias("j"), F.lit(True).alias("left"), "id", "data")
    alls = placed.join(pieces, "family").select("family", every(F.col("pieces")).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "id", "data")
    return components(found.union(durable(_compared(lefts.union(alls), compare), "more")))
