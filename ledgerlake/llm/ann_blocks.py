"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised per row to int8 with one scale. A tile is the product of a query block and a row block in
integers; with the scales it gives every inner product up to a proven error. Per query, the k-th best lower bound
so far discards all rows whose upper bound lies below it; the survivors are recomputed in double precision from
the original vectors and merged by heaps. Nothing that could be among the k nearest is ever discarded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLOCK_ROWS, batches_of, write_table
from ledgerlake.llm.vector_blocks import HELD_QUERIES, first_copies, lanes_for, packed, tiles, unpack, usable

#: int8 products of this many components sum exactly in single precision, so a tile is one float matrix product.
EXACT_DIMS = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows (held as float32 for the product) and their scales; |x - scale * q| <= scale / 2 per component."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    return np.rint(x / scale[:, None]).astype(np.float32), scale


def tile(q: np.ndarray, qs: np.ndarray, r: np.ndarray, rs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of quantised blocks and their error bounds.

    With x = s q + e and |e| <= s / 2 per component: |x.y - s t q.r| <= s t (|q|_1 + |r|_1) / 2 + s t d / 4.
    """
    dims = q.shape[1]
    product = np.zeros((len(q), len(r)))
    for at in range(0, dims, EXACT_DIMS):
        product += q[:, at:at + EXACT_DIMS] @ r[:, at:at + EXACT_DIMS].T
    scale = qs[:, None] * rs[None]
    error = scale * ((np.abs(q).sum(axis=1)[:, None] + np.abs(r).sum(axis=1)[None]) / 2 + dims / 4)
    return product * scale, error * (1 + 1e-9)


def exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in their order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * r[:, d]
    return total


def _best_of_tile(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score, then smaller id) of each query in a tile."""
    order = np.lexsort((vec, -score, query))
    ranked = query[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by query the k best (score, -vec_id); passed on at the end, or when a further block would be too many
        heaps: dict[int, list[tuple[float, int]]] = {}
        blocks: set[int] = set()

        def flush() -> pa.RecordBatch:
            out = [(i, -v, s) for i, heap in heaps.items() for s, v in heap]
            heaps.clear()
            blocks.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("q_block")[row].as_py()
                if block not in blocks and len(heaps) > HELD_QUERIES:
                    yield flush()
                blocks.add(block)
                dim = batch.column("q_dim")[row].as_py()
                qi, q = unpack(batch.column("q_ids")[row].as_py(), batch.column("q_data")[row].as_py(), dim)
                ri, r = unpack(batch.column("r_ids")[row].as_py(), batch.column("r_data")[row].as_py(), dim)
                near, error = tile(*quantise(q), *quantise(r))
                near[qi[:, None] == ri[None]] = -np.inf  # a query is no candidate of its own
                low = near - error
                floor = np.full(len(qi), -np.inf)
                if len(ri) > k:
                    floor = np.partition(low, len(ri) - k, axis=1)[:, len(ri) - k]
                held = np.array([h[0][0] if len(h := heaps.get(v, ())) >= k else -np.inf for v in qi.tolist()])
                a, b = np.nonzero((near + error >= np.maximum(floor, held)[:, None]) & (near > -np.inf))
                score = np.concatenate([exact(q[a[at:at + 65536]], r[b[at:at + 65536]]) for at in range(0, len(a), 65536)]) if len(a) else np.empty(0)
                keep = _best_of_tile(qi[a], ri[b], score, k)
                for i, vec, s in zip(qi[a][keep].tolist(), ri[b][keep].tolist(), score[keep].tolist(), strict=True):
                    heap = heaps.setdefault(i, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -vec))
                    elif (s, -vec) > heap[0]:
                        heapq.heapreplace(heap, (s, -vec))
        yield flush()

    return run


def _merge(k: int):
    """Merges the lists of one query (at most k entries of each task)."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, {(-s, v) for s, v in zip(table["score"].to_pylist(), table["vec_id"].to_pylist(), strict=True)})
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                         "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_rows: int = 512, block_rows: int = 2048) -> DataFrame:
    """The ``k`` rows of largest inner product for every row with ``is_query`` (over the column vec_id).

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id; all candidates if
    there are fewer. Scores are inner products of the original vectors in double precision. Candidates are all rows
    but the query's own (by id). Vectors that are null, empty, all zero or hold a null or non-finite component take
    no part, nor do rows without id; vectors of another length are no candidates. Repeated rows count once; an id
    with several vectors stands for each of them, as query and as candidate. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col, zeros=False)
    blocks, _ = write_table(packed(first_copies(rows, k + 1), block_rows), "row-blocks")
    asked, _ = write_table(packed(rows.where(is_query).dropDuplicates(["vec_id", "v"]), query_rows), "query-blocks")
    with batches_of(vectors.sparkSession, BLOCK_ROWS):
        lists, _ = write_table(tiles(asked, blocks, lanes_for(blocks)).mapInArrow(_search(k), "query_id long, vec_id long, score double"), "tile-lists")
    return lists.groupBy("query_id").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
