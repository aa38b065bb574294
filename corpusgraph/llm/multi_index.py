"""Approximate nearest neighbours by an inverted multi-index, reranked by exact Euclidean distance.

Each half of a vector is quantised with a codebook of its own; a pair of centroids is a cell. For a query, cells are
visited by the sum of the two halves' distances: a heap holds the frontier of the two sorted centroid lists, and the
visit ends when the cells hold `share` of all vectors (and at least `LEAST` ones). Rows of the visited cells are
reranked in double precision on the original vectors. With `share` 1 all cells are visited, and the search is exact.

Vectors without clusters need a large share: of 51,282 random directions in 64 dimensions the ten nearest are 0.76 as far
as the median one, and 0.2, 0.3 and 0.4 of all vectors hold 0.92, 0.95 and 0.99 of them with 256 centroids a half
(0.73, 0.82 and 0.89 with 32). Where vectors cluster, a smaller share does.

Codebooks are fitted to at most `SAMPLE` vectors, those of least hash; every vector is indexed. Index rows are dealt
by groups of first centroids, in chunks of bounded size, so a crowded cell is spread; a task holds one chunk while
queries stream past it, each once, with a bit for each cell of the group. Of each chunk a query takes its k best on to
the final ranking.

Edge cases: vectors that are null, zero, of another length than the sample's commonest, or with null or non-finite
parts take no part, as neighbours or as queries; a null vec_id neither; repeated vec_ids are repeated candidates,
but never candidates of a query of that id; with fewer than k candidates all are returned; an empty table gives no
rows; ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, durable, prepare

SAMPLE, CENTROIDS, ROUNDS = 20_000, 256, 8
#: First centroids whose vectors are dealt together.
GROUP = 8
#: Share of all vectors that a query's cells hold together; vectors at least; rows of a chunk.
SHARE, LEAST, CHUNK = 0.35, 1_000, 8_192


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points; an empty centroid stays where it was."""
    k = max(1, min(k, len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        order, full = np.argsort(near, kind="stable"), np.unique(near)
        sums = np.add.reduceat(points[order], np.searchsorted(near[order], full))
        centres[full] = sums / np.bincount(near)[full][:, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(points[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(points), 4096)])


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> Iterator[tuple[int, int]]:
    """Non-empty cells by ascending first[a] + second[b], until they hold `wanted` vectors.

    Of the grid of both sorted lists, a cell enters the heap once its neighbours above and to the left are out.
    """
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, taken, found = [(first[rows[0]] + second[columns[0]], 0, 0)], np.zeros((len(rows), len(columns)), bool), 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        taken[i, j] = True
        a, b = int(rows[i]), int(columns[j])
        if counts[a, b]:
            found += int(counts[a, b])
            yield a, b
        if i + 1 < len(rows) and (j == 0 or taken[i + 1, j - 1]):
            heapq.heappush(heap, (first[rows[i + 1]] + second[b], i + 1, j))
        if j + 1 < len(columns) and (i == 0 or taken[i - 1, j + 1]):
            heapq.heappush(heap, (first[a] + second[columns[j + 1]], i, j + 1))


#: `cells`: of an index row its cell in the group (4 bytes), of a query a bit for each cell.
ROW = "list int, chunk int, query boolean, id long, vector binary, cells binary"


def search(vectors: DataFrame, query: Column, k: int = 10, share: float = SHARE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `vectors` that `query` picks, against all rows but their own."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]  # bounded by SAMPLE
    lengths = np.bincount([len(v) for v in sample]) if len(sample) else np.zeros(1, int)
    n_parts = int(lengths.argmax())
    out = "query_id long, rank int, vec_id long, score double"
    if not n_parts:
        return vectors.sparkSession.createDataFrame([], out)
    points, half = np.array([v for v in sample if len(v) == n_parts], np.float64), n_parts // 2
    books = codebook(points[:, :half], CENTROIDS) if half else np.zeros((1, 0)), codebook(points[:, half:], CENTROIDS)
    a_cells, b_cells = len(books[0]), len(books[1])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                a, b = (nearest(x[:, :half], books[0]) if half else np.zeros(len(x), np.int64)), nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)], names=["id", "a", "b", "vector", "query"])

    index = durable(rows.where(F.size("vector") == n_parts).mapInArrow(bounded(assign), "id long, a int, b int, vector binary, query boolean"), "index")
    counts = np.zeros((a_cells, b_cells), np.int64)
    for r in index.groupBy("a", "b").agg(F.count("*").alias("n")).collect():  # a row a cell, at most CENTROIDS squared
        counts[r["a"], r["b"]] = r["n"]
    total = int(counts.sum())
    chunks = np.maximum(1, -(-np.add.reduceat(counts.sum(axis=1), np.arange(0, a_cells, GROUP)) // CHUNK))
    wanted = max(LEAST, k + 1, int(share * total))

    def place(batches):
        """Index rows to their group and chunk; queries to every chunk of each group they visit, with the cells wanted."""
        for batch in batches:
            ids, a, b, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            raw = batch.column(3)
            chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[a // GROUP]
            yield pa.RecordBatch.from_arrays([pa.array((a // GROUP).astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(np.zeros(len(ids), bool)), pa.array(ids), raw, pa.array([x.tobytes() for x in (a % GROUP * b_cells + b).astype("<u4")], pa.binary())], names=["list", "chunk", "query", "id", "vector", "cells"])
            for i in np.flatnonzero(query):
                x = np.frombuffer(raw[i].as_py(), np.float64)[None]
                seen = np.array(list(visit(squares(x[:, :half], books[0])[0], squares(x[:, half:], books[1])[0], counts, wanted))).reshape(-1, 2)
                cells = {}
                for p in np.unique(seen[:, 0] // GROUP).tolist():
                    mine, bits = seen[seen[:, 0] // GROUP == p], np.zeros(GROUP * b_cells, np.uint8)
                    bits[mine[:, 0] % GROUP * b_cells + mine[:, 1]] = 1
                    cells[p] = np.packbits(bits).tobytes()
                to = [(p, c) for p in cells for c in range(int(chunks[p]))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in to], pa.int32()), pa.array([c for _, c in to], pa.int32()), pa.array([True] * len(to)), pa.array([int(ids[i])] * len(to), pa.int64()), pa.array([raw[i].as_py()] * len(to), pa.binary()), pa.array([cells[p] for p, _ in to], pa.binary())], names=["list", "chunk", "query", "id", "vector", "cells"])

    def rerank(batches):
        """Rows come by list and chunk, index rows first: they are held, queries stream past."""
        at, held_ids, held, held_cells = None, [], [], []
        ready = None
        for batch in batches:
            q_out, v_out, s_out = [], [], []
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for list_, chunk, is_query, id_, vector, cells in zip(*columns, strict=True):
                if (list_, chunk) != at:
                    at, held_ids, held, held_cells, ready = (list_, chunk), [], [], [], None
                if not is_query:
                    held_ids.append(id_)
                    held.append(np.frombuffer(vector, np.float64))
                    held_cells.append(int.from_bytes(cells, "little"))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = np.array(held_ids), np.array(held), np.array(held_cells)
                ids, points_, seconds = ready
                mine = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[seconds].astype(bool) & (ids != id_))
                score = np.sqrt(((points_[mine] - np.frombuffer(vector, np.float64)) ** 2).sum(axis=1))
                best = np.lexsort((ids[mine], score))[:k]
                q_out += [id_] * len(best)
                v_out += ids[mine][best].tolist()
                s_out += score[best].tolist()
            if q_out:
                yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.int64()), pa.array(v_out, pa.int64()), pa.array(s_out, pa.float64())], names=["query_id", "vec_id", "score"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.mapInArrow(bounded(place), ROW).repartition(parts, "list", "chunk").sortWithinPartitions("list", "chunk", "query")
    found = placed.mapInArrow(bounded(rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
