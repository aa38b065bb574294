"""Near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled with its occurrence number, so repeats count. Each of
`SKETCHES` hash functions picks the `PICKED` labelled k-mers of least hash; they are kept in text order, and that
ordered tuple is a bucket key: documents agree on it if they share the k-mers and their order, which follows edit
similarity. Documents are linked if their words align within a band, with edit similarity (1 - edits / words of the
longer) of at least 0.8. Alignment alone decides; what comes before it only leaves out pairs that can't align:

* of a bucket, documents whose word counts differ too much, or whose signatures (112 bits of minima over labelled word
  pairs) agree too little. An edit takes two word pairs at most, so aligned texts share at least 0.6 of them, and so
  much of a signature with a chance of over 0.999;
* of a family, pairs that share fewer labelled words, or labelled word pairs, than the edits allow, which is exact, and in
  large ones those whose signatures of labelled words (512 bits) agree less than all but one in a million such pairs do.

Words are what white space separates. Exact copies are one text with one sketch: they join their class by a digest
of the whole text, whatever their number.

Edge cases: a null text is an empty one; empty texts are copies of each other; a text of fewer than five words has
one shingle, the whole of it; a null doc_id is in its class, but represents it only if no doc_id is there; repeated
rows are copies; an empty table gives no rows. The table must read alike each time, as files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded, durable, prepare
from .lsh import Overlap, Sets, exact_links, link, pack
from .passes import by_partition, numbered, of_partition

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 40, 2
#: Bits of a signature; steps of the logarithm of a word count; what of a signature agrees at a similarity of 0.8, and by
#: how many standard deviations a pair may fall below.
SIGN_BITS, LENGTH_STEPS, AGREE, BELOW = 112, 1024, 0.715, 3.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.array([xxhash.xxh64_intdigest(b"sketch", seed=k) | 1 for k in range(SKETCHES)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, known: WordHash) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A hash for each run of k words; of all of them if fewer."""
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = mix(out * _MIX + words[j : j + n])
    return out


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer mixed with how often it occurred before."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    label = np.arange(len(kmers)) - np.maximum.accumulate(np.where(first, np.arange(len(kmers)), 0))
    out = kmers.copy()
    again = label > 0
    if again.any():
        out[order[again]] = mix(ordered[again] + label[again].astype(np.uint64) * _MIX)
    return out


def sketch(words: np.ndarray) -> bytes:
    """Bucket keys: the ordered tuples, hashed."""
    kmers = labelled(shingles(words))
    n, places = len(kmers), np.arange(SKETCHES)
    first, second = np.zeros(SKETCHES, np.int64), np.zeros(SKETCHES, np.int64)
    for a in range(0, SKETCHES, step := max(1, min(SKETCHES, 100_000 // n))):
        h = kmers[None, :] * SEEDS[a : a + step, None]
        rows = places[: len(h)]
        first[a : a + step] = h.argmin(axis=1)
        h[rows, first[a : a + step]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second[a : a + step] = h.argmin(axis=1) if n > 1 else 0
    begin, end = kmers[np.minimum(first, second)], kmers[np.maximum(first, second)]
    return pack(mix(mix(begin + places.astype(np.uint64)) * _MIX + end))


def word_pairs(words: np.ndarray) -> np.ndarray:
    """The labelled pairs of neighbouring words; the word itself if there is one."""
    return labelled(shingles(words, 2))


def sign(words: np.ndarray) -> bytes:
    """A bit of the least hash of word pairs in each bin (an empty bin takes that of the next full one), and a step of the
    logarithm of the number of words."""
    h = mix(word_pairs(words) + np.uint64(1))
    least = np.full(SIGN_BITS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, (((h >> np.uint64(32)) * np.uint64(SIGN_BITS)) >> np.uint64(32)).astype(np.int64), h.astype(np.uint32))
    full = np.flatnonzero(least != 0xFFFFFFFF)
    if len(full) < SIGN_BITS:
        least = least[full[np.searchsorted(full, np.arange(SIGN_BITS)) % max(1, len(full))]] if len(full) else least
    length = np.array([round(np.log2(len(words) + 1) * LENGTH_STEPS)], "<u2")
    return np.packbits(((least >> np.uint32(3)) & np.uint32(1)).astype(np.uint8)).tobytes() + length.tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lengths and signatures leave an edit similarity of 0.8 possible. Short texts have few word pairs, and
    their signatures vary more."""
    low = np.uint64((1 << 48) - 1)
    differ = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count((a[:, 1] ^ b[:, 1]) & low)
    lengths = [(x[:, 1] >> np.uint64(48)).astype(np.int64) for x in (a, b)]
    shorter = np.minimum(*lengths)
    words = np.exp2(shorter / LENGTH_STEPS)
    seen = np.minimum(SIGN_BITS, np.maximum(1, SIMILARITY * words))
    least = SIGN_BITS * (AGREE - BELOW * np.sqrt(AGREE * (1 - AGREE) / seen))
    # Of n and m words, m >= 0.8 n; each is counted with one more, and rounded to half a step.
    return (np.abs(lengths[0] - lengths[1]) <= np.log2(1 / SIMILARITY) * LENGTH_STEPS + 1) & (SIGN_BITS - differ >= least)


def banded_distance(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance of two word sequences along diagonals at most `band` off; None if it exceeds the band.

    The differences between neighbouring cells of a column are bits of two numbers, of the band's width. They move down
    one row with each word of `b`, so the top bit stays on the band's lower edge; its distance is followed along that
    diagonal, and from the last word of `a` on along that row.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m, begin = len(a), len(b), 0
    while begin < m and a[begin] == b[begin]:
        begin += 1
    while m > begin and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[begin:n], b[begin:m], n - begin, m - begin
    if n - m > band or not m:
        return n if n <= band else None
    if band >= n:
        return n if (found := banded_distance(a, b, n - 1)) is None else found
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << 2 * band + 1) - 1
    top = edge = 1 << 2 * band
    up, down = ((1 << band + 1) - 1) << band, 0
    distance, most = band, 2 * band + m - n
    for j, y in enumerate(b):
        equal = at.get(y, 0)
        equal = (equal >> j - band if j >= band else equal << band - j) & full
        straight = ((((equal & up) + up) ^ up) | equal | down) & full
        right = down | (full & ~(straight | up))
        left = straight & up
        if j < n - band:
            distance += not straight & top
        else:
            edge >>= 1
            distance += bool(right & edge) - bool(left & edge)
        if distance > most:
            return None
        up = left | (full & ~((straight >> 1) | right))
        down = (straight >> 1) & right
    return distance if distance <= band else None


def most_edits(n: int) -> int:
    """Edits that leave texts of n words, the longer's, at a similarity of 0.8."""
    return int((1 - SIMILARITY) * n + 1e-9)


def _near(both, a, b):
    """Sets of word pairs are one smaller than texts are long; an edit takes two of the longer text's pairs at most."""
    longer = np.maximum(a, b)
    return both >= longer - 2 * np.floor((1 - SIMILARITY) * (longer + 1) + 1e-9)


def _near_words(both, a, b):
    longer = np.maximum(a, b)
    return both >= longer - np.floor((1 - SIMILARITY) * longer + 1e-9)


LABELLED_WORDS = Overlap(_near_words, lambda n: np.ceil(SIMILARITY * n - 1e-9).astype(np.int64), lambda a, b: np.ceil(SIMILARITY * np.maximum(a, b) - 1e-9).astype(np.int64))


def word_set(content: bytes) -> np.ndarray:
    """The labelled words of a text, which an edit changes one of: aligned texts share 0.8 of the longer's."""
    return np.unique(labelled(shingles(np.frombuffer(content, np.uint64), 1)))


def compare(contents: list[bytes], left: int):
    """Index pairs of texts that align, one of them among the first `left`, among packed word sequences."""
    words = [np.frombuffer(x, np.uint64) for x in contents]

    def aligned(i: int, j: int) -> bool:
        return banded_distance(words[i].tolist(), words[j].tolist(), most_edits(max(len(words[i]), len(words[j])))) is not None

    also = [np.unique(word_pairs(w)) for w in words], _near
    yield from exact_links([word_set(x) for x in contents], LABELLED_WORDS, aligned, left, also)


# ---------------------------------------------------------------- DataFrames


ROWS = "row long, doc_id long, h1 long, h2 long, keys binary, sign binary"


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, h1 and h2 (a 128-bit digest of the text), keys, sign: a row a document; copies in a batch share the work."""
    prepare(docs.sparkSession)

    def run(batches):
        known = WordHash()
        for rows, ids, bodies in arrow_rows(batches, "__row", "doc_id", "text"):
            for k in range(0, len(rows), 1000):
                digest = [xxhash.xxh3_128_intdigest(x or "") for x in bodies[k : k + 1000]]
                done: dict[int, tuple[bytes, bytes]] = {}
                for d, text in zip(digest, bodies[k : k + 1000], strict=True):
                    if d not in done:
                        words = word_hashes(text or "", known)
                        done[d] = sketch(words), sign(words)
                halves = np.array([(d >> 64, d & 0xFFFFFFFFFFFFFFFF) for d in digest], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[k : k + 1000], pa.int64()), pa.array(ids[k : k + 1000], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(pa.array([done[d][i] for d in digest], pa.binary()) for i in (0, 1))], names=["row", "doc_id", "h1", "h2", "keys", "sign"])

    return numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bounded(run), ROWS)


def fetch_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, id, data): the packed word hashes of the texts at (family, id, row), from another pass over the table."""
    folder = by_partition(wanted, "row", "wanted")

    def run(batches):
        known, ids_of = WordHash(), None
        for rows, bodies in arrow_rows(batches, "__row", "text"):
            if ids_of is None:
                ids_of = {r: (f, i) for f, i, r in zip(*of_partition(folder, rows[0], ["family", "id", "row"]), strict=True)}
            some = [(*ids_of[r], x or "") for r, x in zip(rows, bodies, strict=True) if r in ids_of]
            for k in range(0, len(some), 500):
                part = some[k : k + 500]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in part], pa.int64()) for c in (0, 1)), pa.array([word_hashes(x[2], known).tobytes() for x in part], pa.binary())], names=["family", "id", "data"])

    return numbered(docs, "text").mapInArrow(bounded(run), "family long, id long, data binary")


def members(docs: DataFrame) -> DataFrame:
    """row, doc_id, class_id, class_size, first: the row number of the class's document of least doc_id. A row a document."""
    rows = durable(sketches(docs), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"), F.any_value("sign").alias("sign"))
    items = durable(groups.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "copies", "keys", "sign"), "items")
    comps = link(items, alike, 2, lambda ids: fetch_words(docs, items.select("id", F.col("first.row").alias("row")).join(ids, "id")), compare, Sets(word_set, LABELLED_WORDS))
    named = durable(items.select("id", "h1", "h2", "first", "copies").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "named")
    sized = named.groupBy("comp").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    of_text = named.select("h1", "h2", "comp").join(sized, "comp").select("h1", "h2", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.row").alias("first"))
    return rows.select("row", "doc_id", "h1", "h2").join(of_text, ["h1", "h2"]).select("row", "doc_id", "class_id", "class_size", "first")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size: a row a document."""
    return members(docs).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The same columns: of each class the document of least doc_id stays (of its repeated rows the first)."""
    folder = by_partition(members(docs).where("row <> first").select("row"), "row", "removals")

    def run(batches):
        gone: set[int] | None = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if gone is None and rows:
                gone = set(of_partition(folder, rows[0], ["row"])[0])
            if rows:
                kept = pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:]))
                yield kept.filter(pa.array([r not in gone for r in rows], pa.bool_()))

    return numbered(docs, *(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(bounded(run), docs.schema)
