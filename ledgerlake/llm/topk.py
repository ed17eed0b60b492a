"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into parts; every part is a node with its own list of partial scores per query. Phase 1
gathers, wherever row blocks meet query blocks, each node's k best partial scores with the scores of their rows; the
k-th best score so gathered bounds the k-th best of all. Phase 2 sends every query the uniform share of that bound:
a score that reaches it has a part that reaches the share, so every other row is passed over at all nodes. Phase 3
adds up the remaining parts of the rows that were collected, exactly and where both vectors are at hand, and keeps
what reaches the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLOCK_ROWS, batches_of, write_table
from ledgerlake.llm.vector_blocks import HELD_QUERIES, first_copies, lanes_for, packed, tiles, unpack, usable


def product(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer matrix product: in doubles as long as every partial sum is exact there, else in 64-bit integers."""
    if len(q) and len(r) and np.abs(q).max() * np.abs(r).max() * q.shape[1] >= 2.0 ** 53:
        return q.astype(np.int64) @ r.astype(np.int64).T
    return (q @ r.T).astype(np.int64)


def _cuts(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


NONE = np.iinfo(np.int64).min


def _parts(q: np.ndarray, r: np.ndarray, parts: int) -> list[np.ndarray]:
    """The partial scores of a tile at every node."""
    cut = _cuts(q.shape[1], parts)
    return [product(q[:, cut[p]:cut[p + 1]], r[:, cut[p]:cut[p + 1]]) for p in range(parts)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.shape[1] > k:
        top = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
        ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
    return ids, scores


def _gather(k: int, parts: int):
    """Phase 1 in a task: per query the k best scores among the rows on its nodes' lists of k partial scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per query block (queries, ids, scores); passed on at the end, or when a further block would be too many
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for asked, ids, scores in held.values():
                at, col = np.nonzero(scores > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids[at, col]), pa.array(scores[at, col])], names=["query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("q_block")[row].as_py()
                if block not in held and sum(len(x[0]) for x in held.values()) > HELD_QUERIES:
                    yield from flush()
                dim = batch.column("q_dim")[row].as_py()
                asked, q = unpack(batch.column("q_ids")[row].as_py(), batch.column("q_data")[row].as_py(), dim)
                ri, r = unpack(batch.column("r_ids")[row].as_py(), batch.column("r_data")[row].as_py(), dim)
                nodes = _parts(q, r, parts)
                total, own = sum(nodes), asked[:, None] == ri[None]
                lists = []
                for s in nodes:
                    s[own] = NONE  # the query itself is no candidate
                    lists.append(np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape))
                on = np.sort(np.hstack(lists), axis=1)
                scores = np.take_along_axis(np.where(own, NONE, total), on, 1)
                scores[:, 1:][on[:, 1:] == on[:, :-1]] = NONE  # on several lists: counted once
                ids = ri[on]
                if block in held:
                    ids, scores = np.hstack((held[block][1], ids)), np.hstack((held[block][2], scores))
                held[block] = (asked, *_best(ids, scores, k))
        yield from flush()

    return run


def _collect(parts: int):
    """Phases 2 and 3 in a task: rows with an entry that reaches the share, their scores added up, those at or above
    the bound; the share and the bound are the last columns of a query's row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("r_dim")[row].as_py()
                qi, wide = unpack(batch.column("q_ids")[row].as_py(), batch.column("q_data")[row].as_py(), dim + 2)
                ri, r = unpack(batch.column("r_ids")[row].as_py(), batch.column("r_data")[row].as_py(), dim)
                nodes = _parts(wide[:, :dim], r, parts)
                enough = np.zeros(nodes[0].shape, bool)
                for s in nodes:
                    enough |= s >= wide[:, dim][:, None]
                a, b = np.nonzero(enough & (qi[:, None] != ri[None]))
                score = sum(s[a, b] for s in nodes)
                keep = score >= wide[a, dim + 1]
                yield pa.RecordBatch.from_arrays([pa.array(qi[a[keep]]), pa.array(ri[b[keep]]), pa.array(score[keep], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          parts: int = 2, query_rows: int = 512, block_rows: int = 2048) -> DataFrame:
    """The ``k`` highest integer inner products for every row with ``is_query`` (over the column vec_id).

    Components are turned into floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long); highest
    first, ties to the smaller vec_id; all candidates if there are fewer. Candidates are all rows but the query's
    own (by id). Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
    without id; vectors of another length are no candidates. Repeated rows count once; of an id with several
    vectors the largest (as an array) counts. Other columns are not read. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col, zeros=True)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), "dim")
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    rows, _ = write_table(rows, "integer-vectors")
    queries = rows.where(is_query)
    blocks, _ = write_table(packed(first_copies(rows, k + 1), block_rows), "row-blocks")
    lanes = lanes_for(blocks)

    # phase 1: local lists and the bound
    lists = tiles(packed(queries, query_rows), blocks, lanes).mapInArrow(_gather(k, parts), "query_id long, vec_id long, score long")
    with batches_of(vectors.sparkSession, BLOCK_ROWS):
        lists, _ = write_table(lists, "local-lists")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    bounds = lists.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    # with fewer than k rows known, everything is to be collected
    bounds, _ = write_table(bounds.where(F.col("n") == k).select("query_id", "kth"), "bounds")

    # phases 2 and 3: a part of any score that reaches the bound reaches its equal share
    def safe(x: Column) -> Column:  # as a double not above it
        return F.when(F.abs(x) < 2.0 ** 53, x.cast("double")).otherwise(x.cast("double") - F.abs(x.cast("double")) * 1e-15)

    kth = F.col("kth")
    wide = queries.join(bounds, queries.vec_id == bounds.query_id, "left")
    share, bound = (F.coalesce(x, F.lit(float("-inf"))) for x in (safe(kth) / parts, safe(kth)))
    wide = wide.select("vec_id", F.concat("v", F.array(share, bound)).alias("v"), "dim")
    asked = packed(wide.withColumn("dim", F.col("dim") + 2), query_rows).withColumn("dim", F.col("dim") - 2)
    entries = tiles(asked, blocks, lanes).mapInArrow(_collect(parts), "query_id long, vec_id long, score long")
    with batches_of(vectors.sparkSession, BLOCK_ROWS):
        entries, _ = write_table(entries, "entries")
    return entries.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
