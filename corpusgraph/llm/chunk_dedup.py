"""Substring dedup by content-defined chunking: a gear rolling hash cuts, digests find repeats.

A gear hash sums a random value for each of the last bytes, shifted by age, so it depends on the last `REACH` bytes
alone. A cut falls after a byte whose hash is less than those of the `WINDOW` bytes on either side, so an insertion moves
the cuts near it and no others; chunks have 17 bytes or more, 33 on average, and end after `LONGEST` bytes at the latest.
A chunk is told by the digest of its bytes and the next chunk's: what two common fragments have in common with two
other documents is no repeat. Of each digest the first, by doc_id, row and position, stays; the others are repeats.

Neighbouring repeats are a run as long as their first copies are neighbours too, in one document: the whole run occurs
there. Runs of at least `LEAST` bytes are reported as spans and can be cut out; a span begins where the one before
ends. Of a repeated passage some 36 bytes at either end are missed on average, since chunks there reach beyond it.

Chunks travel as arrays, a row a batch and partition. A batch keeps the first chunk of each digest for the exchange and
marks the others as repeats at once, so a passage in a third of all documents is one entry a batch, and a task holds
36 bytes for each distinct digest of a batch.

Edge cases: a null text is an empty one and has no chunks; repeats within a document count like others; repeated
rows are copies, ordered by their place in the table's files; a null doc_id sorts before all others; an empty table
gives no rows; texts without cuts, such as one repeated character, are chunks of at most `LONGEST` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded, durable, prepare, texts

REACH, WINDOW, LONGEST = 8, 16, 1024
LEAST = 100
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)
_NEVER = np.uint32(0xFFFFFFFF)


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text; none lies within a character."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    octets = np.frombuffer(raw, np.uint8)
    values = GEAR[octets]
    h = values.copy()
    for age in range(1, min(REACH, n)):
        h[age:] += values[:-age] << np.uint32(age)
    begins = np.append((octets[1:] & 0xC0) != 0x80, True)  # whether a character begins after this byte
    h[~begins] = _NEVER
    least = np.concatenate([np.full(WINDOW, _NEVER), h, np.full(WINDOW, _NEVER)])  # from WINDOW before each byte on
    width = 1
    while width < WINDOW:  # WINDOW is a power of two; in the end the least of WINDOW values from each place on
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    ends = np.flatnonzero((h < least[:n]) & (h <= least[WINDOW + 1 :])) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    if np.diff(ends, prepend=0).max() > LONGEST:
        out, at = [], 0
        for e in ends.tolist():
            while e - at > LONGEST:
                at += LONGEST
                while not begins[at - 1]:
                    at -= 1
                out.append(at)
            out.append(e)
            at = e
        ends = np.array(out)
    return ends


NONE = np.iinfo(np.int64).min  # stands for a null doc_id
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<u4"), ("own", "<u2"), ("both", "<u2")])
REPEAT = np.dtype([("doc", "<i8"), ("row", "<i8"), ("pos", "<u4"), ("own", "<u2"), ("both", "<u2"), ("first_doc", "<i8"), ("first_row", "<i8"), ("first_pos", "<u4")])


def entries(rows: list[int], ids: list[int | None], bodies: list[str]) -> np.ndarray:
    """The chunks of some texts, in order of digest, doc_id, row and position. `own` is a chunk's size, `both` with the
    next chunk's."""
    parts, digests = [], []
    for r, d, text in zip(rows, ids, bodies, strict=True):
        raw = text.encode()
        ends = cuts(raw)
        if not len(ends):
            continue
        part = np.zeros(len(ends), ENTRY)
        starts, both = np.concatenate([[0], ends[:-1]]), np.append(ends[1:], ends[-1])
        part["doc"], part["row"], part["pos"], part["own"], part["both"] = NONE if d is None else d, r, starts, ends - starts, both - starts
        parts.append(part)
        digests += [xxhash.xxh3_128_digest(raw[s:e])[:12] for s, e in zip(starts.tolist(), both.tolist(), strict=True)]
    if not parts:
        return np.zeros(0, ENTRY)
    out, halves = np.concatenate(parts), np.frombuffer(b"".join(digests), np.dtype([("h1", "<u8"), ("h2", "<u4")]))
    out["h1"], out["h2"] = halves["h1"], halves["h2"]
    return out[in_order(out)]


def in_order(x: np.ndarray) -> np.ndarray:
    return np.lexsort((x["pos"], x["row"], x["doc"], x["h2"], x["h1"]))


def first_of(x: np.ndarray) -> np.ndarray:
    """For each entry of an ordered array the place of the first with its digest."""
    new = np.concatenate([[True], (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])])
    return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))


def repeats(x: np.ndarray) -> np.ndarray:
    """Of an ordered array the entries that aren't the first of their digest, with the first's place."""
    first = first_of(x)
    again = first != np.arange(len(x))
    out = np.zeros(int(again.sum()), REPEAT)
    for c in ("doc", "row", "pos", "own", "both"):
        out[c] = x[c][again]
    for c in ("doc", "row", "pos"):
        out[f"first_{c}"] = x[c][first[again]]
    return out


def runs(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, start and end of each run of at least `least` bytes among repeats ordered by row and position."""
    pos, first_pos = x["pos"].astype(np.int64), x["first_pos"].astype(np.int64)
    follows = (x["row"][1:] == x["row"][:-1]) & (pos[1:] == pos[:-1] + x["own"][:-1]) & (x["first_row"][1:] == x["first_row"][:-1]) & (first_pos[1:] - pos[1:] == first_pos[:-1] - pos[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~follows]))
    lasts = np.append(begins[1:], len(x)) - 1
    start, end = pos[begins], pos[lasts] + x["both"][lasts]
    long_ = end - start >= least
    begins, start, end = begins[long_], start[long_], end[long_]
    same = x["row"][begins][1:] == x["row"][begins][:-1]
    start[1:] = np.where(same, np.maximum(start[1:], end[:-1]), start[1:])
    some = end > start
    return begins[some], start[some], end[some]


def spread(x: np.ndarray, by: np.ndarray, parts: int, kind: int):
    """A row for each partition that gets entries: kind, partition, entries as bytes."""
    to = (by % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    x, to = x[order], to[order]
    begins = np.flatnonzero(np.diff(to, prepend=-1))
    spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(x)], strict=True)) if len(x) else []
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(spans), pa.int32()), pa.array([int(to[a]) for a, _ in spans], pa.int32()), pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())], names=["kind", "part", "data"])


PACKED = "kind int, part int, data binary"
SPANS = "row long, doc_id long, start long, end long, earlier_doc_id long"


def by_row(x: np.ndarray) -> np.ndarray:
    return x["row"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def gathered(batches, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(data, kind) for batch in batches for data in batch.column(batch.schema.get_field_index("data")).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def numbered(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The spans of a table of documents: see spans_of()."""
    return spans_of(numbered(docs), least)


def spans_of(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """row, doc_id, start, end (UTF-8 bytes), earlier_doc_id: each run of at least `least` bytes, and where it occurs before."""
    spark = rows.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunk(batches):
        for rows, ids, bodies in arrow_rows(batches, "row", "doc_id", "text"):
            for k in range(0, len(rows), 2000):
                x = entries(rows[k : k + 2000], ids[k : k + 2000], bodies[k : k + 2000])
                if len(x):
                    keep = first_of(x) == np.arange(len(x))
                    yield spread(x[keep], x["h1"][keep], parts, 0)
                    again = repeats(x)
                    yield spread(again, by_row(again), parts, 1)

    def find(batches):
        """Repeats across batches; those within one pass by."""
        held = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            held += [np.frombuffer(x, ENTRY) for x in batch.column(2).filter(pa.array(kinds == 0)).to_pylist()]
            if kinds.any():
                yield batch.filter(pa.array(kinds == 1))
        if held:
            x = np.concatenate(held)
            again = repeats(x[in_order(x)])
            yield spread(again, by_row(again), parts, 1)

    def merge(batches):
        x = gathered(batches, REPEAT)
        if not len(x):
            return
        x = x[np.lexsort((x["pos"], x["row"]))]
        at, start, end = runs(x, least)
        for k in range(0, len(at), 10_000):
            some = at[k : k + 10_000]
            doc, first = x["doc"][some], x["first_doc"][some]
            yield pa.RecordBatch.from_arrays([pa.array(x["row"][some]), pa.array(doc, mask=doc == NONE), pa.array(start[k : k + 10_000]), pa.array(end[k : k + 10_000]), pa.array(first, mask=first == NONE)], names=["row", "doc_id", "start", "end", "earlier_doc_id"])

    dealt = lambda x: x.repartitionById(parts, F.col("part"))
    return dealt(dealt(rows.mapInArrow(bounded(chunk), PACKED)).mapInArrow(bounded(find), PACKED)).mapInArrow(bounded(merge), SPANS)


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each document with repeated passages: doc_id, n_spans, n_bytes, spans (`start:end` in UTF-8 bytes,
    comma-joined), earlier_doc_ids (documents that hold an earlier copy)."""
    found = spans(docs, least)
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    grouped = found.groupBy("row", "doc_id").agg(ordered.alias("s"), F.array_sort(F.collect_set("earlier_doc_id")).alias("earlier_doc_ids"))
    return grouped.select(
        "doc_id",
        F.size("s").cast("long").alias("n_spans"),
        F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("n_bytes"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        "earlier_doc_ids",
    )


def cut_out(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text without its repeated passages."""
    source = durable(numbered(docs), "numbered")
    return _cut(source, spans_of(source, least))


def _cut(source: DataFrame, found: DataFrame) -> DataFrame:
    grouped = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))

    def run(batches):
        for ids, bodies, cut in arrow_rows(batches, "doc_id", "text", "s"):
            out = []
            for text, pieces in zip(bodies, cut, strict=True):
                raw, at, kept = text.encode(), 0, []
                for p in pieces or ():
                    kept.append(raw[at : p["start"]])
                    at = p["end"]
                out.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return source.join(grouped, "row", "left").select("doc_id", "text", "s").mapInArrow(bounded(run), "doc_id long, text string")
