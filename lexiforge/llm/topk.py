"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are packed to small blocks stored dimension by dimension. A grid deals them: a group of query blocks meets a group
of candidate blocks in one place of the grid (one row a block there, never one a pair of vectors). There the queries are
held and candidates stream past, 4096 at a time. Partial scores grow dimension block by dimension block; a candidate whose
partial score plus the product of both vectors' remaining norms cannot reach the query's k-th score so far is dropped, and
the survivors are compacted: first the candidates that no query needs, then the pairs. The k-th scores rise with every block
of candidates. Each place returns k rows a query, a window keeps the best k.

Partial scores are sums of products of whole numbers, which are exact below 2**53; where they could be larger, all scores
are computed in 64-bit integers without bounds. Scores beyond 2**63 have no meaning.

Vectors that are null, or hold null or non-finite components, take no part; shorter ones count as padded with zeros.
Ties go to the smaller vec_id. Rows of one vec_id are all candidates for others; as a query it is asked once, with the
smallest of its vectors. An empty table, or one without queries, gives no rows. Null vec_ids take no part. Extra columns,
also such that are named as columns of the result, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.shared import arrow_map
from lexiforge.session import spread

ROWS = 4096  # candidates scored at once
PACKED_BYTES = 64 << 10  # of a packed block, so that a batch of them stays small
DIM_BLOCK = 16
QUERIES_AT_ONCE = 256
HELD, STREAMED = 16 * ROWS, 64 * ROWS  # queries of a group; candidates that stream past them
EXACT = 2.0**53


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows).combine_chunks().to_batches()[0]
            held = table.slice(rows).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack(scale: float, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in gathered(batches, ROWS):
            lists = part.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            dims = max(1, int(sizes.max(initial=0)))
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            matrix = np.zeros((len(sizes), dims))
            matrix[np.arange(dims)[None, :] < sizes[:, None]] = flat
            ids, step = part.column(0).to_numpy(), max(1, PACKED_BYTES // (8 * dims))
            starts = range(0, len(ids), step)
            packed = [[ids[a : a + step].tobytes() for a in starts], [np.ascontiguousarray(matrix[a : a + step].T).tobytes() for a in starts]]
            m = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(number + np.arange(m)), pa.array(np.full(m, dims, np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["kind", "block", "dims", "ids", "columns"])
            number += m

    return run


class Best:
    """The k best candidates so far of each of some queries. q: dimensions by queries, whole numbers."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), -np.inf)

    def _merge(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        rows, found, scores = np.concatenate([self.rows, rows]), np.concatenate([self.found, found]), np.concatenate([self.scores, scores.astype(np.int64)])
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < self.k
        last = rank == self.k - 1
        self.floor[rows[last]] = scores[last]
        self.rows, self.found, self.scores = rows[top], found[top], scores[top]

    def see(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Takes in candidates (dimensions by candidates)."""
        dims = max(len(self.q), len(c))
        q, c = (np.pad(m, ((0, dims - len(m)), (0, 0))) if len(m) < dims else m for m in (self.q, c))
        if dims * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) >= EXACT:
            scores = q.astype(np.int64).T @ c.astype(np.int64)
            rows, at = np.nonzero(self.ids[:, None] != ids[None, :])
            self._merge(rows, ids[at], scores[rows, at])
            return
        if np.isinf(self.floor).any() and c.shape[1] > 8 * self.k:  # some whole scores first, for bounds to start from
            some = 4 * self.k
            self._bound(q, ids[:some], c[:, :some])
            ids, c = ids[some:], c[:, some:]
        self._bound(q, ids, c)

    def _bound(self, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        edges = [*range(0, len(q), DIM_BLOCK), len(q)]
        squares = lambda m: [np.sqrt((m[e:] ** 2).sum(0)) * (1 + 1e-9) for e in edges[1:]]  # noqa: E731  mass that remains after each block
        rest_q, rest_c = squares(q), squares(c)
        columns, rows, at = np.arange(c.shape[1]), None, None
        partial = np.zeros((q.shape[1], c.shape[1]))
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if rows is not None:
                partial = partial + np.einsum("dn,dn->n", q[lo:hi, rows], c[lo:hi, at])
                alive = partial + rest_q[b][rows] * rest_c[b][at] >= self.floor[rows]
                rows, at, partial = rows[alive], at[alive], partial[alive]
                continue
            partial += q[lo:hi].T @ c[lo:hi, columns]
            alive = partial + np.multiply.outer(rest_q[b], rest_c[b][columns]) >= self.floor[:, None]
            if hi == len(q) or alive.mean() < 0.2:
                rows, place = np.nonzero(alive & (self.ids[:, None] != ids[columns][None, :]))
                partial, at = partial[rows, place], columns[place]
            else:
                needed = alive.any(axis=0)
                if needed.mean() < 0.75:
                    columns, partial = columns[needed], partial[:, needed]
        self._merge(rows, ids[at], partial)


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and columns (dimensions by vectors) of packed blocks."""
    dims = max(d for d, _, _ in rows)
    matrices = [np.frombuffer(x, np.float64).reshape(d, -1) for d, _, x in rows]
    return np.concatenate([np.frombuffer(i, np.int64) for _, i, _ in rows]), np.concatenate([np.pad(m, ((0, dims - len(m)), (0, 0))) for m in matrices], axis=1)


def _meet(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: row, column of the grid, kind (0: queries, 1: candidates), dims, ids, columns; sorted by the first three."""
        place, held, packed, asked, waiting = None, [], [], False, 0

        def ask() -> None:
            ids, q = _unpacked(packed)
            held.extend(Best(ids[a : a + QUERIES_AT_ONCE], q[:, a : a + QUERIES_AT_ONCE], k) for a in range(0, len(ids), QUERIES_AT_ONCE))

        def see() -> None:
            if packed:
                ids, c = _unpacked(packed)
                for best in held:
                    best.see(ids, c)

        def answers() -> Iterator[pa.RecordBatch]:
            if asked:
                see()
            for best in held:
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.rows]), pa.array(best.found), pa.array(best.scores)], schema=schema)

        for batch in batches:
            for row, column, kind, dims, ids, columns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (row, column) != place:
                    yield from answers()
                    place, held, packed, asked, waiting = (row, column), [], [], False, 0
                if kind and not asked:
                    if packed:
                        ask()
                    packed, asked = [], True
                packed.append((dims, ids, columns))
                waiting += len(ids) // 8
                if asked and waiting >= ROWS:
                    see()
                    packed, waiting = [], 0
        yield from answers()

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each query among all other rows of vectors (vec_id, embedding)."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asked"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    asked = usable.where("asked").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, m = usable.select(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(1, math.ceil(m / HELD))
    across = max(1, min(math.ceil(n / ROWS), max(math.ceil(3 * cores / down), math.ceil(n / STREAMED))))
    # a sort within tasks: a task that is repeated packs the same blocks again
    packed = lambda df, kind: arrow_map(df.select("vec_id", "embedding").sortWithinPartitions("vec_id", "embedding"), _pack(scale, kind), "kind byte, block long, dims int, ids binary, columns binary")
    own = lambda groups: F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    queries = packed(asked, 0).select(own(down).alias("row"), every(across).alias("column"), "kind", "block", "dims", "ids", "columns")
    candidates = packed(spread(usable), 1).select(every(down).alias("row"), own(across).alias("column"), "kind", "block", "dims", "ids", "columns")
    grid = queries.unionByName(candidates).repartition(down * across, "row", "column").sortWithinPartitions("row", "column", "kind", "block")
    found = arrow_map(grid.select("row", "column", "kind", "dims", "ids", "columns"), _meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for queries at every vec_id divisible by 20: every pair scored.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored QUALIFY "rank" <= 20
"""
